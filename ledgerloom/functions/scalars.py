"""Scalar rules of the ledger as Spark column expressions (no UDFs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------
LEGAL_FORMS = ["SARL", "SARLAU", "SA", "SAS", "SASU", "SNC", "SCS", "STE", "SOCIETE", "AU", "EURL"]
GENERIC_FOLDERS = [".", "..", "unknown", "factures", "invoices", "scans", "documents", "pdf"]
CONSUMABLES, SERVICES, TELEPHONE, BANK_FEES = "MATIERES CONSOMMABLES", "PRESTATIONS", "TELEPHONIE", "FRAIS BANCAIRE"
#: (designation, rate in percent) -> VAT code
VAT_CODES = {(CONSUMABLES, 20): 146, (CONSUMABLES, 10): 150, (SERVICES, 20): 140, (TELEPHONE, 20): 140, (BANK_FEES, 10): 142}
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
FEE_WORDS = r"(?i)commission|frais\s*banc|agios|tenue\s*de\s*compte|cotisation|carte\s*banc|retrait\s*dab|frais\s*de\s*|pakage|package|interet|intérêt"
SKIP_WORDS = r"(?i)virement\s+recu|virement\s+reçu|remise\s+cheque|remise\s+chèque|depot\s+especes|dépôt\s+espèces|solde\s+initial|solde\s+final|total\s+mouvement"
PERIOD_WORDS = r"(?i)\b(janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[uû]t|septembre|octobre|novembre|d[ée]cembre|trimestre|semestre)\b"
DRIVE_STEM = r"(?i)^(.+)-\d{8}T\d{6}Z(?:-\d+)+(?:_[a-z0-9]+)?$"
MONEY = "decimal(18,2)"
# ----------------------------------------------------------------------------


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def digits(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"\D", "")


def fold(c: Column) -> Column:
    """Upper case without accents, blanks collapsed."""
    return F.trim(F.regexp_replace(F.upper(F.translate(text_of(c), ACCENTED, PLAIN)), r"\s+", " "))


def _number(c: Column) -> Column:
    """Unsigned number: the last of comma and point is the decimal mark, others group thousands; one mark alone may stand once."""
    lone = c.rlike(r"^[^.]*,[^.]*,[^.]*$|^[^,]*\.[^,]*\.[^,]*$")
    return F.when(~lone, F.replace(F.regexp_replace(c, r"[.,](?=.*[.,])", ""), F.lit(","), F.lit("."))).try_cast("double")


def money_document(raw: Column) -> Column:
    """Amount printed on a document (B1): blanks dropped; minus or bracket in front means negative."""
    value = _number(F.regexp_replace(text_of(raw), r"^[   ]*[-(]+|\)+[   ]*$|[   ]", ""))
    return F.when(raw.rlike(r"^[   ]*[-(]"), -value).otherwise(value)


def money_bank(raw: Column) -> Column:
    """Amount in a bank file (B2): everything but digits, marks and minus is dropped."""
    value = F.abs(_number(F.regexp_replace(text_of(raw), r"^\s*-|[^0-9,.\-]", "")))
    return F.when(raw.rlike(r"^\s*[-(]"), -value).otherwise(value)


def money_delivery(raw: Column) -> Column:
    """Amount of a delivery platform (B3): commas group thousands, currency dropped, unreadable is zero."""
    return F.coalesce(F.trim(F.regexp_replace(text_of(raw), r"(?i)MAD|,|\s", "")).try_cast("double"), F.lit(0.0))


def date_bank(raw: Column) -> Column:
    """ISO text of a date in a bank file (B4): day first, two-digit years in 20xx, or a spreadsheet serial; the calendar is not checked."""
    t = F.trim(text_of(raw))
    serial = t.try_cast("double")
    fr = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})"
    year = F.regexp_extract(t, fr, 3)
    return (
        F.when(t.rlike(r"^\d+(\.\d+)?$") & (serial > 30000) & (serial < 60000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")).cast("string"))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10))
        .when(t.rlike(fr), F.concat_ws("-", F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), F.lpad(F.regexp_extract(t, fr, 2), 2, "0"), F.lpad(F.regexp_extract(t, fr, 1), 2, "0")))
        .otherwise("")
    )


def _calendar(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def date_document(raw: Column) -> Column:
    """First valid date of a text (B5): day first, else year first."""
    dmy, ymd = r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})", r"(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})"
    t = text_of(raw)
    return F.coalesce(
        F.when(t.rlike(dmy), _calendar(F.regexp_extract(t, dmy, 3), F.regexp_extract(t, dmy, 2), F.regexp_extract(t, dmy, 1))),
        F.when(t.rlike(ymd), _calendar(F.regexp_extract(t, ymd, 1), F.regexp_extract(t, ymd, 2), F.regexp_extract(t, ymd, 3))),
    )


def supplier_key(name: Column) -> Column:
    """Name without accents, punctuation and legal forms."""
    t = F.upper(F.regexp_replace(F.translate(text_of(name), ACCENTED, PLAIN), "[.'’]", ""))
    return F.array_join(F.filter(F.split(t, "[^A-Z0-9]+"), lambda x: (x != "") & ~x.isin(LEGAL_FORMS)), "")


def ice(c: Column) -> Column:
    """Company id (B8): 15 digits, or empty."""
    return F.when(F.length(digits(c)) == 15, digits(c)).otherwise("")


def fiscal_id(c: Column) -> Column:
    """Fiscal id (B9): digits, but never 15 of them."""
    return F.when(F.length(digits(c)) == 15, "").otherwise(digits(c))


def designation(c: Column) -> Column:
    """Closest designation of a label."""
    t = F.trim(F.regexp_replace(F.upper(text_of(c)), r"\s+", " "))
    kinds = [CONSUMABLES, SERVICES, TELEPHONE, BANK_FEES]
    fixed = F.replace(F.replace(F.replace(t, F.lit("MATIERE "), F.lit("MATIERES ")), F.lit("CONSOMABLE"), F.lit("CONSOMMABLES")), F.lit("CONSOMABLES"), F.lit("CONSOMMABLES"))
    return (
        F.when(t.isin(kinds), t)
        .when(fixed.isin(kinds), fixed)
        .when(t.rlike("TELEPHON|ORANGE|INWI|IAM"), TELEPHONE)
        .when(t.rlike("BANCAIRE|BANQUE|COMMISSION"), BANK_FEES)
        .when(t.rlike("PRESTATION|SERVICE|HONORAIRE"), SERVICES)
        .otherwise(CONSUMABLES)
    )


def designation_of_text(c: Column) -> Column:
    """Designation guessed from a document's text."""
    t = F.lower(text_of(c))
    return (
        F.when(t.rlike("téléphon|telephon|abonnement mobile|forfait"), TELEPHONE)
        .when(t.rlike("relevé de compte|releve de compte|agios|frais bancaire"), BANK_FEES)
        .when(t.rlike(r"\b(prestations?|honoraires?|frais de service)\b") | t.rlike(r"(?<!bon de )\bservice de livraison\b"), SERVICES)
        .otherwise(CONSUMABLES)
    )


def rate(c: Column) -> Column:
    """One of the rates 0, 0.1 and 0.2 (B12); null where none is within 0.015."""
    r = F.when(F.abs(c) > 1, c / 100.0).otherwise(c)
    return F.coalesce(*[F.when(F.abs(r - a) <= 0.015, F.lit(a)) for a in (0.0, 0.1, 0.2)])


def near_ratio(part: Column, whole: Column, ratio: float, by: float = 0.025) -> Column:
    """Whether part / whole is within ``by`` of a ratio, without dividing."""
    p, w = F.abs(part), F.abs(whole)
    return (p >= w * F.lit(round(ratio - by, 4)).cast("decimal(6,4)")) & (p <= w * F.lit(round(ratio + by, 4)).cast("decimal(6,4)"))


def rate_from_amounts(ht: Column, tva: Column) -> Column:
    """Rate in percent that HT and VAT imply."""
    return (
        F.when(ht.isNull() | (F.abs(ht) < 0.01), 20)
        .when(tva.isNull() | (F.abs(tva) < F.lit("0.05").cast(MONEY)), 0)
        .when(near_ratio(tva, ht, 0.1), 10)
        .otherwise(20)
    )


def vat_code(kind: Column, percent: Column, explicit: Column | None = None) -> Column:
    """VAT code of a designation and a rate in percent; an explicit code wins."""
    found = F.lit(None).cast("int")
    for (k, p), code in VAT_CODES.items():
        found = F.when((kind == k) & (percent == p), code).otherwise(found)
    return F.coalesce(explicit, found) if explicit is not None else found


def plausible_name(c: Column) -> Column:
    """Whether a text can be a supplier's name."""
    t = F.trim(text_of(c))
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    n_digits = F.length(F.regexp_replace(t, r"[^0-9]", ""))
    return (F.length(t).between(4, 60)) & (F.length(letters) >= 4) & (n_digits * 4 <= F.length(t)) & F.lower(letters).rlike("[aeiouyàâéèêîôûü]") & (F.size(F.split(t, r"\s+")) <= 6)


def path_parts(c: Column) -> Column:
    return F.filter(F.split(text_of(c), "/"), lambda p: (p != "") & (p != "."))


def top_folder(c: Column) -> Column:
    """First segment of a path that has folders."""
    parts = F.split(text_of(c), "/")
    return F.when(F.size(parts) > 1, F.lower(F.trim(parts[0]))).otherwise("")


def _is_period(p: Column) -> Column:
    return p.rlike(r"^[\d\s._/\-]+$") | p.rlike(PERIOD_WORDS)


def supplier_folder(c: Column) -> Column:
    """Innermost telling folder of a path: the first that is neither generic, nor a drive export, nor a period."""
    parts = path_parts(c)
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    stem = lambda p: F.trim(F.regexp_extract(F.trim(p), DRIVE_STEM, 1))
    useful = F.filter(folders, lambda p: ~F.lower(F.trim(p)).isin(GENERIC_FOLDERS) & (stem(p) == "") & ~_is_period(F.lower(F.trim(p))))
    stems = F.filter(F.transform(folders, stem), lambda s: (s != "") & ~F.lower(s).isin(GENERIC_FOLDERS) & ~_is_period(F.lower(s)))
    return F.coalesce(F.get(useful, 0), F.get(stems, 0), F.lit(""))


def supplier_hint(c: Column) -> Column:
    """Label made of the supplier folder, null if it is mostly digits."""
    words = F.filter(F.split(supplier_folder(c), r"[\s_\-]+"), lambda w: w != "")
    label = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), " ")
    n = F.length(F.regexp_replace(label, r"\D", ""))
    return F.when((label != "") & (n <= F.greatest(F.lit(3.0), F.length(label) / 4)), label)


def split_tag(c: Column) -> Column:
    """File name and id of ``name__RC__src-1.ext`` or ``name.ext__RC__src-1``."""
    t = text_of(c)
    new, old = r"^(.*)__RC__(src-\d+)(\.[^./]+)$", r"^(.*)__RC__(src-\d+)$"
    return (
        F.when(t.rlike(new), F.struct(F.concat(F.regexp_extract(t, new, 1), F.regexp_extract(t, new, 3)).alias("file"), F.regexp_extract(t, new, 2).alias("id")))
        .when(t.rlike(old), F.struct(F.regexp_extract(t, old, 1).alias("file"), F.regexp_extract(t, old, 2).alias("id")))
        .otherwise(F.struct(t.alias("file"), F.lit("").alias("id")))
    )


def add_tag(file: Column, tag: Column) -> Column:
    """Inverse of :func:`split_tag`: the id goes before the extension."""
    ext = F.regexp_extract(file, r"(\.[^./]+)$", 1)
    return F.concat(F.substring(file, F.lit(1), F.length(file) - F.length(ext)), F.lit("__RC__"), tag, ext)


def identity_keys(c: Column) -> Column:
    """Lower-case ``parent/base`` and ``base`` of a path."""
    parts = F.filter(F.split(F.lower(text_of(c)), "/"), lambda p: p != "")
    base, parent = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("document")), F.get(parts, F.size(parts) - 2)
    return F.when(F.size(parts) > 1, F.array(F.concat_ws("/", parent, base), base)).otherwise(F.array(base))


def period_code(year: Column, month: Column) -> Column:
    """MMAAAA (B22)."""
    return F.concat(F.lpad(month.cast("string"), 2, "0"), year.cast("string"))


def period_parts(code: Column) -> Column:
    """Year and month of MMAAAA, null unless the month exists."""
    m, y = F.substring(code, 1, 2).try_cast("int"), F.substring(code, 3, 4).try_cast("int")
    return F.when(F.length(code).eqNullSafe(6) & m.between(1, 12) & y.isNotNull(), F.struct(y.alias("year"), m.alias("month")))


def alias_token(c: Column) -> Column:
    return F.regexp_replace(fold(c), "[^A-Z0-9]", "")


def beneficiary(label: Column) -> Column:
    """Who a transfer favours, letters and digits only."""
    return F.regexp_replace(F.regexp_extract(fold(label), r"EN FAVEUR DE\s+([^,]+)", 1), "[^A-Z0-9]", "")


def half_month(day: Column) -> Column:
    """q1 up to the 15th, then q2; null below 1."""
    return F.when(day < 1, None).when(day <= 15, "q1").when(day > 15, "q2")


def delivered(status: Column) -> Column:
    return F.upper(F.trim(text_of(status))) == "DELIVERED"


def returned_or_cancelled(status: Column) -> Column:
    s = F.upper(text_of(status))
    return s.contains("RETURN") | s.contains("CANCEL")


def credit_note(*texts: Column) -> Column:
    """Whether any of the texts speaks of a credit note."""
    return F.lower(F.concat_ws("\n", *texts)).contains("avoir")


def signed_total(ttc: Column, is_credit: Column) -> Column:
    """Total for matching: credit notes are negative."""
    return F.when(is_credit | (ttc < 0), -F.abs(ttc)).otherwise(F.coalesce(ttc, F.lit(0)))


def rate_mentions(c: Column) -> Column:
    """The rates 0, 10 and 20 % that a text names."""
    found = F.regexp_extract_all(text_of(c), F.lit(r"(?<![\d.,])(0|10|20)(?:[.,]0+)?\s*%"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def useful_text(c: Column, least: int = 60) -> Column:
    """Whether a text layer is worth reading."""
    t = text_of(c)
    return (F.length(F.regexp_replace(t, r"\s", "")) >= least) & (t.rlike(r"\d{15}") | t.rlike(r"(?i)total|facture|\bICE\b"))


def difficult(warnings: Column) -> Column:
    """Whether a document's warnings call it hard to read."""
    return F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: F.lower(w).rlike("difficile|illisible|flou|faible"))


def label_score(label: Column, supplier: Column, number: Column) -> Column:
    """Two for each supplier word over three letters in the label, three for the invoice number."""
    hay = fold(label)
    words = F.filter(F.split(fold(supplier), r"\s+"), lambda w: (F.length(w) > 3) & hay.contains(w))
    return F.size(words) * 2 + F.when((text_of(number) != "") & hay.contains(fold(number)), 3).otherwise(0)


def deadline(year: Column, month: Column) -> Column:
    """Last second of the 20th of the month after the period."""
    return F.add_months(F.make_date(year, month, F.lit(20)), 1).cast("timestamp") + F.expr("interval 23 hours 59 minutes 59 seconds")


def days_left(year: Column, month: Column, as_of: Column) -> Column:
    return F.ceil((F.unix_timestamp(deadline(year, month)) - F.unix_timestamp(as_of)) / 86400.0).cast("int")


def serial(day: Column) -> Column:
    """Spreadsheet serial of a date."""
    return F.datediff(day, F.lit("1899-12-30").cast("date"))
