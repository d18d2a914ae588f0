"""Transforms over ledger lines: amounts, suppliers, duplicates, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import scalars as S
from ledgerloom.functions.lineage import cut
from ledgerloom.functions.scalars import MONEY


def credit(df: DataFrame) -> DataFrame:
    """Add ``credit``: the document speaks of a credit note in its file name or any of its numbers."""
    own = S.credit_note(F.col("source_file"), F.col("fact_num"))
    return df.withColumn("credit", F.max(own).over(Window.partitionBy("dossier", "source_file")))


def credit_by_list(df: DataFrame) -> DataFrame:
    """As :func:`credit`, without dealing lines by file.

    A file whose name speaks of a credit note needs no other line. The other
    files of which a number does are listed first, from the few columns that
    tell, and lines look themselves up.
    """
    named, numbered = S.credit_note(F.col("source_file")), S.credit_note(F.col("fact_num"))
    told = cut(df.where(~named & numbered).select("dossier", "source_file").distinct()).toDF("__d", "__f").withColumn("__told", F.lit(True))
    found = df.join(told, F.col("dossier").eqNullSafe(F.col("__d")) & F.col("source_file").eqNullSafe(F.col("__f")), "left")
    return found.withColumn("credit", named | F.coalesce("__told", F.lit(False))).drop("__d", "__f", "__told")


def apply_credit_signs(df: DataFrame) -> DataFrame:
    """Positive amounts of credit notes turn negative (C1); needs ``credit``."""
    return df.withColumns({c: A.negate_credit(F.col(c), F.col("credit")).cast(MONEY) for c in ("ht", "tva", "ttc")})


def repair(df: DataFrame) -> DataFrame:
    """Impossible amounts repaired (C4), then missing TTC filled (C5); needs ``credit``."""
    fixed = A.repair(df)
    total = A.fill_total(F.col("ht"), F.col("tva"), F.col("ttc"), F.col("pct"))
    return fixed.withColumn("__t", total).withColumn("reconstructed", F.col("__t") != F.col("ttc")).withColumn("ttc", F.col("__t").cast(MONEY)).drop("__t")


def most_common(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Most frequent non-blank value of each key, ties to the greatest (F2): two aggregations with map-side combine."""
    counted = df.select(*keys, F.trim(value).alias("__v")).where("__v <> ''").groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    return counted.groupBy(*keys).agg(F.max_by("__v", F.struct("__n", "__v")).alias(name))


def best_ice(df: DataFrame, keys: list[str], excluded: Column | None = None) -> DataFrame:
    """Most frequent valid company id of each key, never all zeros nor an excluded one."""
    value = S.ice(F.col("ice_frs"))
    ok = ~value.rlike("^0*$")
    if excluded is not None:
        ok = ok & (value != excluded)
    return most_common(df.where(ok), keys, value, "best_ice")


def _identified(df: DataFrame) -> DataFrame:
    """Add supplier key and ids as they are compared: ``__key, __ice, __if``."""
    return df.withColumns({"__key": S.supplier_key(F.col("lib_frss")), "__ice": S.ice(F.col("ice_frs")), "__if": S.digits(F.col("if_number"))})


def _fills(keyed: DataFrame, scope: list[str]) -> DataFrame:
    """What lines of a supplier and ids lack (F6): ``scope, __key, __ice, __if, __k_ice, __found_if``.

    The company id comes first; the fiscal id prefers lines that share the
    (possibly just filled) company id. All aggregates are of the values given:
    lines are counted once by supplier and ids, and what is most frequent is
    told from these counts.
    """
    C = F.col
    by = [*scope, "__key", "__ice", "__if"]
    cells = cut(keyed.groupBy(*by).agg(F.count("*").alias("__n")))  # three steps read it
    value = F.explode(F.array(F.struct(F.lit(0).alias("kind"), C("__ice").alias("v")), F.struct(F.lit(1).alias("kind"), C("__if").alias("v"))))
    named = cells.where("__key <> ''").select(*scope, "__key", "__n", value.alias("__x")).where("__x.v <> ''").groupBy(*scope, "__key", "__x").agg(F.sum("__n").alias("__n"))
    most = lambda kind, name: F.max_by(F.when(C("__x.kind") == kind, C("__x.v")), F.when(C("__x.kind") == kind, F.struct("__n", C("__x.v")))).alias(name)
    by_key = named.groupBy(*scope, "__key").agg(most(0, "__k_ice"), most(1, "__k_if"))
    of_ice = cells.where("__ice <> '' and __if <> ''").groupBy(*scope, "__ice", "__if").agg(F.sum("__n").alias("__n"))
    by_ice = of_ice.groupBy(*scope, "__ice").agg(F.max_by("__if", F.struct("__n", "__if")).alias("__i_if")).withColumnRenamed("__ice", "__ice2")
    found = cells.where("__ice = '' or __if = ''").drop("__n").join(by_key, [*scope, "__key"], "left")
    found = found.withColumn("__ice2", F.when(C("__ice") != "", C("__ice")).otherwise(F.coalesce("__k_ice", F.lit(""))))
    return cut(found.join(by_ice, [*scope, "__ice2"], "left").select(*by, "__k_ice", F.coalesce("__i_if", "__k_if").alias("__found_if")))


def _filled(keyed: DataFrame) -> DataFrame:
    """Ids that lines take from :func:`_fills`: ``__new_ice, __new_if``, null where they keep their own."""
    no_if = F.trim(S.text_of(F.col("if_number"))) == ""
    return keyed.withColumns({"__new_ice": F.when(F.col("__ice") == "", F.col("__k_ice")), "__new_if": F.when(no_if, F.col("__found_if"))})


def _with_new_ids(df: DataFrame) -> DataFrame:
    new_ice, new_if = F.col("__new_ice"), F.col("__new_if")
    return df.withColumns({"ice_frs": F.coalesce(new_ice, "ice_frs"), "ice_inferred": new_ice.isNotNull(), "if_inferred": new_if.isNotNull(), "if_number": F.coalesce(new_if, "if_number")})


def complete_identifiers(df: DataFrame, scope: list[str]) -> DataFrame:
    """Fill missing company and fiscal ids from the supplier's other lines of the scope.

    What a line gets depends on its supplier and ids alone, so it is worked out
    on their counts and the lines are joined once.
    """
    keyed = _identified(df)
    out = _filled(keyed.join(_fills(keyed, scope), [*scope, "__key", "__ice", "__if"], "left"))
    return _with_new_ids(out).select(*df.columns, "ice_inferred", "if_inferred")


def complete_and_mark(df: DataFrame, scope: list[str], line: str) -> DataFrame:
    """:func:`complete_identifiers` and :func:`mark_duplicates` of kept lines that ``line`` identifies.

    Neither deals whole lines. Lines that lack an id, and the signatures of all,
    give two narrow tables by line: new ids, and duplicates. Lines meet both by
    one key: by broadcast while these are small, else dealt once.
    """
    by = [*scope, "__key", "__ice", "__if"]
    keyed = _identified(df)
    lacking = keyed.where("__ice = '' or __if = ''").select(line, *by, "if_number").join(_fills(keyed, scope), by)
    ids = cut(_filled(lacking).select(line, "__new_ice", "__new_if").where("__new_ice is not null or __new_if is not null"))
    twice = cut(mark_duplicates(df).where("duplicate").select(line)).withColumn("duplicate", F.lit(True))
    out = df.join(ids, line, "left").join(twice, line, "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
    return _with_new_ids(out).select(*df.columns, "ice_inferred", "if_inferred", "duplicate")


def normalise_groups(df: DataFrame, client_ice: Column | None = None) -> DataFrame:
    """Fill ids and names by group (F7): lines of one top folder, else of one supplier, else ``unknown`` of their dossier.

    Adds ``group`` and whether an id came from it: ``group_ice, group_if``. A
    missing name is that of the folder of the group's first file (``from_folder``
    is set then), else the group's most frequent. The client's own id is never a group's, and is replaced where a line bears it.
    """
    folder, key = S.top_folder(F.col("source_file")), S.supplier_key(F.col("lib_frss"))
    grouped = df.withColumn("__g", F.when(folder != "", F.concat(F.lit("folder:"), folder)).when(key != "", F.concat(F.lit("supplier:"), key)).otherwise("unknown"))
    by = ["dossier", "__g"]
    grouped = cut(grouped)  # five steps read it
    ices, names = best_ice(grouped, by, client_ice), most_common(grouped, by, F.col("lib_frss"), "__name")
    fiscal = most_common(grouped, by, S.fiscal_id(F.col("if_number")), "__if")
    hints = grouped.groupBy(*by).agg(S.supplier_hint(F.min_by("source_file", "pos")).alias("__hint"))
    # every group has a row of hints; lines are joined once
    out = grouped.join(hints.join(ices, by, "left").join(names, by, "left").join(fiscal, by, "left"), by, "left")
    unnamed = S.text_of(F.col("lib_frss")) == ""
    told = F.coalesce(F.col("from_folder"), F.lit(False)) if "from_folder" in df.columns else F.lit(False)
    own = S.ice(F.col("ice_frs"))
    lacks = (own == "") if client_ice is None else (own == "") | F.coalesce(own == client_ice, F.lit(False))
    no_ice, no_if = lacks & F.col("best_ice").isNotNull(), (S.fiscal_id(F.col("if_number")) == "") & F.col("__if").isNotNull()
    return out.withColumns({"group": F.col("__g"), "group_ice": no_ice, "group_if": no_if, "ice_frs": F.when(no_ice, F.col("best_ice")).otherwise(F.col("ice_frs")), "if_number": F.when(no_if, F.col("__if")).otherwise(F.col("if_number")), "from_folder": told | (unnamed & F.col("__hint").isNotNull()), "lib_frss": F.when(unnamed, F.coalesce("__hint", "__name", "lib_frss")).otherwise(F.col("lib_frss"))}).select(*dict.fromkeys([*df.columns, "from_folder"]), "group", "group_ice", "group_if")


def consolidate(df: DataFrame) -> DataFrame:
    """Merge the lines of one number and rate where lines with and without VAT coexist (F8).

    Sums replace the amounts of the first line; VAT is recomputed if a line had
    none, TTC if it did not exceed HT. Other lines stay as they are.
    """
    key = ["dossier", "source_file", "fact_num", "pct"]
    zero = F.abs("tva") < A.money("0.01")
    stats = df.groupBy(*key).agg(
        F.count("*").alias("__n"), F.max(zero).alias("__zero"), F.max(~zero).alias("__some"), F.min("pos").alias("__first"),
        F.sum("ht").cast(MONEY).alias("__ht"), F.sum("tva").cast(MONEY).alias("__tva"), F.sum("ttc").cast(MONEY).alias("__ttc"),
        F.max(F.col("ht") < 0).alias("__negative"), F.max(F.abs("ttc") <= F.abs("ht")).alias("__flat"),
    )
    merged = (F.col("__n") > 1) & F.col("__zero") & F.col("__some")
    both = df.join(stats, key).where(~merged | (F.col("pos") == F.col("__first")))
    sign = F.when((F.col("__ht") < 0) | F.col("__negative"), -1).otherwise(1).cast("decimal(2,0)")
    rate = F.when(F.col("pct") == 10, F.lit("0.10")).when(F.col("pct") == 20, F.lit("0.20")).otherwise("0.00").cast("decimal(3,2)")
    size = F.abs("__ht")
    tva = F.when(size > 0, F.round(size * rate, 2) * sign).otherwise(F.col("__tva")).cast(MONEY)
    both = both.withColumn("__tva2", tva)
    ttc = F.when((size > 0) & ((F.abs("__ttc") <= size) | F.col("__flat")), F.col("__ht") + F.col("__tva2")).otherwise(F.col("__ttc")).cast(MONEY)
    return both.withColumns({"merged": merged, "ttc": F.when(merged, ttc).otherwise(F.col("ttc")), "ht": F.when(merged, F.col("__ht")).otherwise(F.col("ht")), "tva": F.when(merged, F.col("__tva2")).otherwise(F.col("tva"))}).select(*df.columns, "merged")


def signatures() -> dict[str, tuple[Column, list[Column]]]:
    """The four signatures of a line (G1) beside its rate and TTC: whether the line has it, and its values."""
    number, file = F.lower(F.trim(F.col("fact_num"))), F.lower(F.col("source_file"))
    pairs = {"supplier": S.supplier_key(F.col("lib_frss")), "source": F.col("source_id"), "file": file}
    made = {k: ((v != "") & (number != ""), [v, number]) for k, v in pairs.items()}
    return made | {"day": ((F.col("source_file") != "") & F.col("date_fac").isNotNull(), [file, F.col("date_fac")])}


def mark_duplicates(df: DataFrame) -> DataFrame:
    """Add ``duplicate``: an earlier line of the dossier shares a signature (G1).

    Signatures hold the rate and the TTC, so lines are dealt once, by dossier and
    these; within a task they are ranked by position for each signature, which
    keeps one row in memory at a time.
    """
    total = ["dossier", "pct", "__cents"]
    made = signatures()
    values = {f"__{k}{i}": v for k, (_, parts) in made.items() for i, v in enumerate(parts)}
    # values are named after the shuffle, where lines are read once
    out = df.withColumn("__cents", F.round(F.col("ttc") * 100).cast("long")).repartition(*total).withColumns(values)
    later = [F.coalesce(has, F.lit(False)) & (F.rank().over(Window.partitionBy(*total, f"__{k}0", f"__{k}1").orderBy("pos")) > 1) for k, (has, _) in made.items()]
    marks = {f"__later_{k}": mark for k, mark in zip(made, later)}
    out = out.withColumns(marks).withColumn("duplicate", F.greatest(*marks))
    return out.drop("__cents", *values, *marks)


def remove_duplicates(df: DataFrame) -> DataFrame:
    """First occurrences only."""
    return mark_duplicates(df).where("not duplicate").drop("duplicate")


def merge_key() -> Column:
    """Identity of a line in a ledger (G3): source id or file, number and rate."""
    where = F.when(F.col("source_id") != "", F.col("source_id")).otherwise(F.element_at(S.identity_keys(F.col("source_file")), 1))
    return F.concat_ws("|", where, F.lower(F.trim(F.col("fact_num"))), F.col("pct").cast("string"))


def merge_lines(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing lines stay; of new ones the first of each key that the ledger lacks is added."""
    both = existing.withColumn("origin", F.lit(0)).unionByName(new.withColumn("origin", F.lit(1))).withColumn("__k", merge_key())
    rank = F.row_number().over(Window.partitionBy("dossier", "__k").orderBy("origin", "pos"))
    return both.withColumn("__n", rank).where((F.col("origin") == 0) | (F.col("__n") == 1)).drop("__k", "__n")


#: Mark of a line that was checked as a whole, among the verified fields.
REVIEWED = "__line_review__"
#: Engines that read images, and words in a document's warnings that tell of a poor image.
IMAGE_ENGINES = ["ai", "scan", "tesseract"]
POOR_IMAGE = ["scan difficile", "relu avec", "contrôle ia", "ocr", "non détectés", "saisie manuelle", "illisible"]
#: Fields whose warnings do not hold a line up.
SOFT = ["date_paie", "if"]


def confidence(df: DataFrame, client_ice: Column) -> DataFrame:
    """Level and reason for each field of a line (J1, J2), first matching rule wins; adds the map ``conf``.

    ``verified``: fields that a user has confirmed; they are ok. Amounts that
    contradict each other are an error of all three amounts. A zero rate that
    fits its amounts needs confirmation only where the image was poor.
    """
    C = F.col
    h, v, t = F.abs("ht"), F.abs("tva"), F.abs("ttc")
    cent, slack = A.money("0.01"), A.money("0.05")
    signs = F.array_distinct(F.filter(F.array(*[F.when(F.abs(c) >= cent, F.signum(c)) for c in ("ht", "tva", "ttc")]), lambda x: x.isNotNull()))
    issue = (
        F.when((h < cent) & (t < cent), "zero").when(F.size(signs) > 1, "sign")
        .when((h >= cent) & (v > h + slack), "vat above ht").when(F.abs(h + v - t) > slack, "sum")
    )
    implied = F.when(h < cent, None).when(v < slack, 0).when(S.near_ratio(C("tva"), C("ht"), 0.1), 10).when(S.near_ratio(C("tva"), C("ht"), 0.2), 20)
    df = df.withColumns({
        "__poor": C("engine").isin(IMAGE_ENGINES) & F.lower(S.text_of(C("warnings"))).rlike("|".join(POOR_IMAGE)),
        "__free": (C("pct") == 0) & (h >= cent) & (v <= slack) & (F.abs(h - t) <= slack),
        "__issue": issue, "__implied": implied, "__code": S.vat_code(C("designation"), C("pct")), "__ice": S.ice(C("ice_frs")),
    })
    poor, sure, unsure = C("__poor"), C("__free") & ~C("__poor"), C("__free") & C("__poor")

    def pick(field: str, *rules: tuple[Column, str, str]) -> Column:
        out = F.struct(F.lit("ok").alias("level"), F.lit("").alias("reason"))
        for test, level, reason in reversed(rules):
            said = F.lit(reason) if isinstance(reason, str) else reason
            out = F.when(test, F.struct(F.lit(level).alias("level"), said.alias("reason"))).otherwise(out)
        return F.when(F.array_contains(C("verified"), field), F.struct(F.lit("ok").alias("level"), F.lit("verified").alias("reason"))).otherwise(out)

    def amount(field: str, *own: tuple[Column, str, str]) -> Column:
        last = [(C("duplicate"), "warn", "duplicate")] if field == "m_ttc" else []
        return pick(field, (C("__issue").isNotNull(), "error", C("__issue")), (C("sanitized"), "warn", "repaired"), *own, (poor, "warn", "poor scan"), *last)

    fields = {
        "fact_num": pick("fact_num", (F.trim(S.text_of(C("fact_num"))) == "", "error", "missing"), (C("duplicate"), "warn", "duplicate"), (poor, "warn", "poor scan")),
        "lib_frss": pick("lib_frss", (F.trim(S.text_of(C("lib_frss"))) == "", "error", "missing"), (C("from_folder"), "warn", "from folder"), (~S.plausible_name(C("lib_frss")), "warn", "implausible"), (poor, "warn", "poor scan")),
        "ice_frs": pick("ice_frs", (C("__ice") == "", "error", "missing"), (F.coalesce(C("__ice") == client_ice, F.lit(False)), "error", "client"), (C("ice_inferred"), "warn", "inferred"), (poor, "warn", "poor scan")),
        "if": pick("if", (F.trim(S.text_of(C("if_number"))) == "", "warn", "missing"), (C("if_inferred"), "warn", "inferred")),
        "designation": pick("designation", (C("__code").isNull() & (C("pct") == 0) & sure, "ok", "zero rate"), (C("__code").isNull() & (C("pct") == 0) & unsure, "warn", "confirm zero rate"), (C("__code").isNull() & (C("pct") == 0), "warn", "zero rate without code"), (C("__code").isNull(), "warn", "no code")),
        "m_ht": amount("m_ht", (unsure, "ok", "zero rate")),
        "tva": amount("tva", (C("tva_calculated") & sure, "ok", "zero rate"), (C("tva_calculated") & unsure, "warn", "confirm zero rate"), (C("tva_calculated"), "warn", "computed"), (unsure, "warn", "confirm zero rate")),
        "m_ttc": amount("m_ttc", (C("reconstructed") & sure, "ok", "zero rate"), (C("reconstructed"), "warn", "computed"), (unsure, "ok", "zero rate")),
        "taux": pick(
            "taux", (~C("pct").isin(0, 10, 20), "error", "unknown rate"), ((C("pct") == 0) & (v > slack), "error", "vat at zero rate"), (A.blended(C("ht"), C("tva")) & (F.abs(h + v - t) <= slack), "warn", "blended"),
            (F.coalesce(C("__implied") != C("pct"), F.lit(False)) & (v >= slack), "warn", "rate"), (poor & unsure, "warn", "confirm zero rate"), (poor, "warn", "poor scan"),
        ),
        "date_fac": pick("date_fac", (C("date_fac").isNull(), "warn", "missing"), (poor, "warn", "poor scan")),
        "date_paie": pick("date_paie", (C("date_paie").isNull(), "warn", "missing")),
    }
    return df.withColumn("conf", F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*fields.values()))).drop("__poor", "__free", "__issue", "__implied", "__code", "__ice")


def line_reviewed(verified: Column) -> Column:
    """Whether the line as a whole was checked."""
    return F.array_contains(verified, REVIEWED)


def soft(field: Column, level: Column) -> Column:
    """A warning that does not hold the line up."""
    return (level == "warn") & field.isin(SOFT)


def needs_review(conf: Column, duplicate: Column) -> Column:
    """A duplicate, or any field that is not ok."""
    return duplicate | F.exists(F.map_values(conf), lambda e: e["level"] != "ok")


def has_anomaly(conf: Column, verified: Column, duplicate: Column, dismissed: Column) -> Column:
    """What a user must act on (J3, F14): a duplicate not dismissed, an error, or a warning that is not soft, on a line not yet checked."""
    return ~line_reviewed(verified) & ((duplicate & ~dismissed) | F.exists(F.map_entries(conf), lambda e: (e["value"]["level"] != "ok") & ~soft(e["key"], e["value"]["level"])))


def issues(conf: Column, verified: Column, duplicate: Column, dismissed: Column) -> Column:
    """Issues of a line (J4): ``array<struct<level, field, reason>>``, a duplicate first, without soft ones; none once the line is checked."""
    own = F.transform(F.filter(F.map_entries(conf), lambda e: (e["value"]["level"] != "ok") & ~soft(e["key"], e["value"]["level"])), lambda e: F.struct(e["value"]["level"].alias("level"), e["key"].alias("field"), e["value"]["reason"].alias("reason")))
    twice = F.array(F.struct(F.lit("warn").alias("level"), F.lit("duplicate").alias("field"), F.lit("duplicate").alias("reason")))
    return F.when(line_reviewed(verified), F.slice(own, 1, 0)).when(duplicate & ~dismissed, F.concat(twice, own)).otherwise(own)


def label(fact_num: Column, lib_frss: Column, pos: Column) -> Column:
    """How a line is called in lists (J5): its invoice and supplier, else its position."""
    number, name = F.trim(S.text_of(fact_num)), F.trim(S.text_of(lib_frss))
    head = F.when(number != "", F.concat(F.lit("Facture "), number)).otherwise(F.concat(F.lit("Ligne "), pos.cast("string")))
    return F.when(name != "", F.concat(head, F.lit(" ("), name, F.lit(")"))).otherwise(head)


def review_list(df: DataFrame) -> DataFrame:
    """Distinct issues of each dossier's unchecked lines, errors before warnings (J5): ``dossier, rank, label, field, level, reason``.

    A line's issues stay together in one row; rows of one label are put together
    before and after the shuffle.
    """
    open_lines = df.where(~line_reviewed(F.col("verified"))).withColumn("label", label(F.col("fact_num"), F.col("lib_frss"), F.col("pos")))
    issue = lambda field, level, reason: F.struct(field.alias("field"), level.alias("level"), reason.alias("reason"))
    own = F.transform(F.filter(F.map_entries("conf"), lambda e: e["value"]["level"] != "ok"), lambda e: issue(e["key"], e["value"]["level"], e["value"]["reason"]))
    twice = F.array(issue(F.lit("duplicate"), F.lit("warn"), F.lit("duplicate")))
    found = F.when(F.expr("duplicate and not dismissed"), F.concat(own, twice)).otherwise(own)
    rows = cut(open_lines.select("dossier", "label", found.alias("found")).where(F.size("found") > 0))
    each = rows.groupBy("dossier", "label").agg(F.array_distinct(F.flatten(F.collect_set("found"))).alias("found")).select("dossier", "label", F.inline("found"))
    return each.select("dossier", F.when(F.col("level") == "error", 0).otherwise(1).alias("rank"), "label", "field", "level", "reason")


def verify_line(df: DataFrame, which: Column) -> DataFrame:
    """Mark lines as checked (C15); a duplicate among them is thereby dismissed."""
    return df.withColumns({"verified": F.when(which, F.array_union("verified", F.array(F.lit(REVIEWED)))).otherwise(F.col("verified")), "dismissed": F.col("dismissed") | (which & F.col("duplicate"))})


def unverify_line(df: DataFrame, which: Column) -> DataFrame:
    """Take the mark and the dismissal back."""
    return df.withColumns({"verified": F.when(which, F.array_remove("verified", REVIEWED)).otherwise(F.col("verified")), "dismissed": F.col("dismissed") & ~which})


def verify_field(df: DataFrame, which: Column, field: str) -> DataFrame:
    """Confirm one field (C15): the line must be checked again, and an inferred id counts as given."""
    out = unverify_line(df, which)
    out = out.withColumn("verified", F.when(which, F.array_union("verified", F.array(F.lit(field)))).otherwise(F.col("verified")))
    flag = {"ice_frs": "ice_inferred", "if": "if_inferred"}.get(field)
    return out.withColumn(flag, F.col(flag) & ~which) if flag else out


def stored(df: DataFrame) -> DataFrame:
    """Lines as they are kept in a ledger (C18): 24 fields under their stored names; each field's confidence with its reason."""
    C = F.col
    text = lambda c: F.coalesce(C(c).cast("string"), F.lit(""))
    return df.select(
        "source_file", "source_id", "fact_num", "designation", C("ht").alias("m_ht"), "tva", C("ttc").alias("m_ttc"), text("if_number").alias("if"), text("lib_frss").alias("lib_frss"), text("ice_frs").alias("ice_frs"),
        "ice_inferred", "if_inferred", C("reconstructed").alias("ttc_reconstructed"), "tva_calculated", C("sanitized").alias("amounts_sanitized"), C("from_folder").alias("supplier_from_folder"), F.lit(False).alias("date_paie_from_bank"),
        C("engine").alias("extraction_engine"), C("verified").alias("user_verified_fields"), C("conf").alias("field_confidence"), (C("pct") / F.lit(100)).cast("decimal(4,2)").alias("taux"), F.lit(None).cast("int").alias("id_paie"), text("date_paie").alias("date_paie"), text("date_fac").alias("date_fac"),
    )
