"""Rules that check, repair and derive HT, VAT and TTC of a line, in exact decimals.

A line is described by columns ``ht, tva, ttc`` (decimal(18,2)) and ``pct``,
the rate in percent (0, 10 or 20). Ratios are compared by multiplication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import MONEY, near_ratio


def money(x: str) -> Column:
    return F.lit(x).cast(MONEY)


def ht_of_total(total: Column, pct: Column) -> Column:
    """HT of a TTC, half up to the cent, in integer arithmetic (total >= 0)."""
    cents = F.round(total * 100).cast("long")

    def part(k: int) -> Column:
        n, d = cents * 200 + (100 + k), 2 * (100 + k)
        return ((n - n % d) / d).cast("long")

    exact = F.when(pct == 0, cents).when(pct == 10, part(10)).otherwise(part(20))
    return (exact.cast("decimal(18,0)") / 100).cast(MONEY)


def coherent(ht: Column, tva: Column, ttc: Column, pct: Column) -> Column:
    """HT + VAT = TTC within 5 cents or 1 %, and VAT fits the rate."""
    h, v, t = F.abs(ht), F.abs(tva), F.abs(ttc)
    nothing = (h < money("0.01")) & (t < money("0.01"))
    adds_up = F.abs(h + v - t) <= F.greatest(money("0.05").cast("decimal(22,4)"), (t * F.lit("0.01").cast("decimal(4,2)")).cast("decimal(22,4)"))
    fits = F.when(h <= money("0.01"), True).when(pct == 0, (v <= money("0.05")) & (F.abs(h - t) <= money("0.05"))).when(pct == 10, near_ratio(v, h, 0.1)).when(pct == 20, near_ratio(v, h, 0.2)).otherwise(True)
    return ~nothing & adds_up & fits


def blended(ht: Column, tva: Column) -> Column:
    """Overall rate between 10 and 20 %: several rates in one line."""
    h, v = F.abs(ht), F.abs(tva)
    within = lambda a, b: (v >= h * F.lit(a).cast("decimal(6,4)")) & (v <= h * F.lit(b).cast("decimal(6,4)"))
    return (h >= money("0.01")) & (v >= money("0.01")) & within("0.085", "0.215") & ~within("0.085", "0.115") & ~within("0.185", "0.215")


def negate_credit(amount: Column, is_credit: Column) -> Column:
    """Positive amounts of credit notes turn negative."""
    return F.when(is_credit & (amount > 0), -amount).otherwise(amount)


def repair(df: DataFrame) -> DataFrame:
    """Repair impossible amounts (C4) of lines with a ``credit`` flag; adds ``sanitized``.

    In order: a zero-rate line stays; a rate typed as HT is undone; a coherent
    or blended line stays; the three magnitudes are put in order if they add
    up at 10 or 20 %; otherwise the largest is taken as TTC and split anew.
    The sign follows the credit-note flag. Each step names its results, so no
    expression is evaluated twice.
    """
    C = F.col
    h, v, t, given = C("__h"), C("__v"), C("__t"), C("__given")
    df = df.withColumns({"__h": F.abs("ht"), "__v": F.abs("tva"), "__t": F.abs("ttc"), "__given": F.when(C("pct").isin(0, 10, 20), C("pct")).otherwise(20), "__o": F.sort_array(F.array(F.abs("ht"), F.abs("tva"), F.abs("ttc")))})
    small, mid, large = C("__o")[0], C("__o")[1], C("__o")[2]
    typed = F.when((F.abs(h - 20) <= money("0.01")) | (h == money("0.2")), 20).when((F.abs(h - 10) <= money("0.01")) | (h == money("0.1")), 10)
    zero = (h >= money("0.01")) & (v <= money("0.05")) & (F.abs(h - t) <= money("0.05"))
    fits = F.when(h <= money("0.01"), True).when(given == 0, (v <= money("0.05")) & (F.abs(h - t) <= money("0.05"))).when(given == 10, near_ratio(v, h, 0.1)).otherwise(near_ratio(v, h, 0.2))
    df = df.withColumns({"__typed": F.when(((h > money("0.01")) & (v * 4 <= h)) | ((t < 50) & (v < 50)), None).otherwise(typed), "__zero": zero, "__fits": fits, "__adds": F.abs(h + v - t) <= money("0.05"), "__blend": blended(h, v), "__ordered": (large > money("0.01")) & (F.abs(mid + small - large) <= money("0.05")) & (mid > money("0.01"))})
    stays = C("__adds") & ((~((h < money("0.01")) & (t < money("0.01"))) & C("__fits")) | C("__blend"))
    kind = (
        F.when(C("__zero"), "zero").when(C("__typed").isNotNull(), "split").when(stays, "stay")
        .when(C("__ordered") & near_ratio(small, mid, 0.1), "order10").when(C("__ordered") & near_ratio(small, mid, 0.2), "order20")
        .when(large > money("0.01"), "split").otherwise("stay")
    )
    total = F.when(C("__typed").isNull(), large).when((t < 50) & (v > 50), (v * 100 / C("__typed").cast("decimal(3,0)")).cast(MONEY)).otherwise(t)
    df = df.withColumns({"__kind": kind, "__total": total.cast(MONEY), "__rate": F.coalesce("__typed", "__given")})
    df = df.withColumn("__base", ht_of_total(C("__total"), C("__rate")))
    split, ordered = C("__kind") == "split", C("__kind").isin("order10", "order20")
    sign = F.when(C("credit"), -1).otherwise(1).cast("decimal(2,0)")

    def chosen(a: Column, b: Column, c: Column) -> Column:
        return (F.when(split, a).when(ordered, b).otherwise(c) * sign).cast(MONEY)

    df = df.withColumns({
        "__ht": chosen(C("__base"), mid, h), "__tva": chosen(C("__total") - C("__base"), small, v), "__ttc": chosen(C("__total"), large, t),
        "__pct": F.when(C("__kind") == "zero", 0).when(split, C("__rate")).when(C("__kind") == "order10", 10).when(C("__kind") == "order20", 20).otherwise(C("pct")),
    })
    df = df.withColumn("sanitized", (C("__ht") != C("ht")) | (C("__tva") != C("tva")) | (C("__ttc") != C("ttc")) | (C("__pct") != C("pct")))
    df = df.withColumns({c: C(f"__{c}") for c in ("ht", "tva", "ttc", "pct")})
    return df.drop("__h", "__v", "__t", "__given", "__o", "__typed", "__zero", "__fits", "__adds", "__blend", "__ordered", "__kind", "__total", "__rate", "__base", "__ht", "__tva", "__ttc", "__pct")


def fill_total(ht: Column, tva: Column, ttc: Column, pct: Column) -> Column:
    """Missing TTC from HT and VAT, unless their signs or sizes forbid it."""
    missing = (F.abs(ttc) < money("0.01")) & (F.abs(ht) >= money("0.01"))
    no_vat = F.abs(tva) < money("0.01")
    mixed = ~no_vat & (F.signum(ht) != F.signum(tva))
    return F.when(missing & no_vat & (pct == 0), ht).when(missing & ~no_vat & ~mixed & (F.abs(tva) <= F.abs(ht) + money("0.05")), (ht + tva).cast(MONEY)).otherwise(ttc)


def fee_split(total: Column) -> Column:
    """Bank fee at 10 %: ``struct(ht, tva)``."""
    ht = ht_of_total(total, F.lit(10))
    return F.struct(ht.alias("ht"), (total - ht).cast(MONEY).alias("tva"))


def recompute(ht: Column, pct: Column) -> Column:
    """VAT and TTC after an edit of HT or rate (C11)."""
    tva = F.round(ht * pct.cast("decimal(3,0)") / 100, 2).cast(MONEY)
    return F.struct(tva.alias("tva"), (ht + tva).cast(MONEY).alias("ttc"))
