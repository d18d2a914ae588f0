"""Stored documents: identity, archives and their children, what is extracted, pending or deleted.

A document row has ``id, dossier, kind, filename, source_id, size, created_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S


def stem(c: Column) -> Column:
    """Lower-case base name without extension."""
    return F.lower(F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]+$", ""))


def identity(df: DataFrame) -> Column:
    """First non-null of source id and path: one key per document."""
    return F.when(F.col("source_id") != "", F.concat(F.lit("src:"), F.col("source_id"))).otherwise(F.concat(F.lit("path:"), F.lower("filename")))


def member_path(archive: Column, member: Column) -> Column:
    """Path of an archive member under the archive's stem, unless it is there already."""
    first = F.substring_index(member, "/", 1)
    base = F.regexp_replace(F.regexp_extract(archive, r"([^/]+)$", 1), r"(?i)\.zip$", "")
    return F.when(member.contains("/") & (F.lower(first) == F.lower(base)), member).otherwise(F.concat_ws("/", base, member))


def manifest_filter(df: DataFrame) -> DataFrame:
    """Files worth reading (A7): known extensions, no dotfiles or system junk, at least 400 bytes."""
    base = F.regexp_extract("filename", r"([^/]+)$", 1)
    keep = F.lower(base).rlike(r"\.(pdf|png|jpe?g|webp|csv|txt|zip)$") & ~base.startswith(".") & ~F.col("filename").contains("__MACOSX") & ~F.lower(base).isin("thumbs.db", "desktop.ini")
    return df.where(keep & (F.col("size") >= 400))


def newest(df: DataFrame) -> DataFrame:
    """Newest document of each identity in a dossier."""
    w = Window.partitionBy("dossier", "identity").orderBy(F.desc("created_at"), F.desc("id"))
    return df.withColumn("identity", identity(df)).withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def archive_bounds(df: DataFrame) -> DataFrame:
    """Archives with the time of the next upload of the same name."""
    a = df.where("kind = 'archive'").withColumn("stem", stem(F.col("filename")))
    times = a.select("dossier", "stem", "created_at").distinct()
    nxt = times.withColumn("until", F.lead("created_at").over(Window.partitionBy("dossier", "stem").orderBy("created_at")))
    return a.join(nxt, ["dossier", "stem", "created_at"])


def archive_children(df: DataFrame) -> DataFrame:
    """Archives with the documents of their folder created before the next upload (E9): ``dossier, archive, id``."""
    children = df.where("kind <> 'archive'").select("dossier", "id", F.col("created_at").alias("at"), F.lower(F.substring_index("filename", "/", 1)).alias("stem"), F.col("filename").contains("/").alias("nested")).where("nested").drop("nested")
    bounds = archive_bounds(df).select("dossier", "stem", F.col("id").alias("archive"), F.col("created_at").alias("since"), "until")
    return bounds.join(children, ["dossier", "stem"]).where((F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))).select("dossier", "archive", "id")


def extracted(df: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents that have lines (E10): by source id if they carry one, else by an identity key of the file name."""
    by_id = lines.where("source_id <> ''").select("dossier", "source_id").distinct()
    by_key = lines.select("dossier", F.explode(S.identity_keys(F.col("source_file"))).alias("key")).distinct()
    tagged = df.where("source_id <> ''").join(by_id, ["dossier", "source_id"], "left_semi").select("dossier", "id")
    named = df.where("source_id = ''").select("dossier", "id", F.explode(S.identity_keys(F.col("filename"))).alias("key")).join(by_key, ["dossier", "key"], "left_semi").select("dossier", "id").distinct()
    return tagged.unionByName(named)


def pending(df: DataFrame, lines: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Working documents neither extracted, nor archives, nor being read."""
    work = df.where("kind <> 'archive'")
    return work.join(extracted(df, lines), ["dossier", "id"], "left_anti").join(in_flight, ["dossier", "source_id"], "left_anti")


def skipped_archives(df: DataFrame, lines: DataFrame) -> DataFrame:
    """Archives all of whose children, at least one, are extracted."""
    done = extracted(df, lines).withColumn("done", F.lit(1))
    c = archive_children(df).join(done, ["dossier", "id"], "left").groupBy("dossier", "archive").agg(F.count("*").alias("children"), F.count("done").alias("done"))
    return c.where("children = done")


def document_lines(df: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of each document by source id or identity key (E8); a line's best document by id first."""
    by_id = df.where("source_id <> ''").select("dossier", "id", "source_id").join(lines.where("source_id <> ''").select("dossier", "source_id", "pos"), ["dossier", "source_id"]).select("dossier", "id", "pos", F.lit(0).alias("way"))
    keyed = lines.select("dossier", "pos", F.explode(S.identity_keys(F.col("source_file"))).alias("key"))
    by_key = df.select("dossier", "id", F.explode(S.identity_keys(F.col("filename"))).alias("key")).join(keyed, ["dossier", "key"]).select("dossier", "id", "pos", F.lit(1).alias("way"))
    return by_id.unionByName(by_key).groupBy("dossier", "id", "pos").agg(F.min("way").alias("way"))


def assign_uploads(results: DataFrame, uploads: DataFrame) -> DataFrame:
    """Upload of each result (E14): by explicit id, then exact name, then a base name that is unique; each upload once."""
    first = results.join(uploads.select("source_id", F.col("upload").alias("u0")), "source_id", "left") if "source_id" in results.columns else results.withColumn("u0", F.lit(None))
    base = lambda c: F.lower(F.regexp_extract(c, r"([^/]+)$", 1))
    exact = uploads.groupBy("name").agg(F.min("upload").alias("u1"))
    unique = uploads.groupBy(base(F.col("name")).alias("base")).agg(F.count("*").alias("n"), F.min("upload").alias("u2")).where("n = 1").drop("n")
    both = first.join(exact, "name", "left").withColumn("base", base(F.col("name"))).join(unique, "base", "left")
    found = both.withColumns({"upload": F.coalesce("u0", "u1", "u2"), "way": F.when(F.col("u0").isNotNull(), 0).when(F.col("u1").isNotNull(), 1).otherwise(2)}).where("upload is not null")
    w = Window.partitionBy("upload").orderBy("way", "result")
    return found.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("result", "upload", "way")


def reusable(new: DataFrame, df: DataFrame) -> DataFrame:
    """Stored document that a new upload repeats (E18): by source id, else the newest sharing an identity key; same size."""
    ids = new.where("source_id <> ''").select(F.col("id").alias("new"), "dossier", "source_id", "size").join(df.where("source_id <> ''").select("dossier", "source_id", "id", F.col("size").alias("had"), "created_at"), ["dossier", "source_id"]).select("new", "id", "size", "had", "created_at", F.lit(0).alias("way"))
    keys = new.select(F.col("id").alias("new"), "dossier", "size", F.explode(S.identity_keys(F.col("filename"))).alias("key")).join(df.select("dossier", "id", F.col("size").alias("had"), "created_at", F.explode(S.identity_keys(F.col("filename"))).alias("key")), ["dossier", "key"]).select("new", "id", "size", "had", "created_at", F.lit(1).alias("way"))
    best = ids.unionByName(keys).groupBy("new").agg(F.min_by(F.struct("id", "size", "had"), F.struct("way", -F.unix_micros(F.col("created_at").cast("timestamp")), -F.col("id"))).alias("x"))
    return best.select("new", "x.id", (F.col("x.size") == F.col("x.had")).alias("reuse"))


def deletion_closure(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Documents to delete (I4): the chosen ones, and archives all of whose children are among them."""
    c = archive_children(df).join(chosen.select("dossier", "id").withColumn("gone", F.lit(1)), ["dossier", "id"], "left")
    empty = c.groupBy("dossier", "archive").agg(F.count("*").alias("n"), F.count("gone").alias("g")).where("n = g").select("dossier", F.col("archive").alias("id"))
    return chosen.select("dossier", "id").unionByName(empty).distinct()


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows left after deletion by id."""
    return df.join(gone.select("dossier", "id"), ["dossier", "id"], "left_anti")


def recreated(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents that repeat a deleted one by id, path or source id."""
    keys = lambda d: d.select("dossier", "id", F.explode(F.filter(F.array(F.concat(F.lit("id:"), F.col("id").cast("string")), F.concat(F.lit("path:"), F.lower("filename")), F.when(F.col("source_id") != "", F.concat(F.lit("src:"), "source_id"))), lambda x: x.isNotNull())).alias("key"))
    return keys(df).join(keys(gone).select("dossier", "key").distinct(), ["dossier", "key"], "left_semi").select("dossier", "id").distinct()


def by_supplier(df: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents grouped (F27): statements, the supplier of their first line, their folder, archives, others."""
    first = document_lines(df, lines).groupBy("dossier", "id").agg(F.min_by("pos", F.struct("way", "pos")).alias("pos"))
    named = first.join(lines.select("dossier", "pos", "lib_frss"), ["dossier", "pos"]).select("dossier", "id", "lib_frss")
    folder = S.supplier_folder(F.col("filename"))
    key = F.when(F.col("kind") == "bank", "1 bank").when(F.col("lib_frss").isNotNull(), F.concat(F.lit("0 "), S.supplier_key(F.col("lib_frss")))).when(folder != "", F.concat(F.lit("2 "), F.lower(folder))).when(F.col("kind") == "archive", "3 archives").otherwise("4 others")
    return df.join(named, ["dossier", "id"], "left").groupBy("dossier", key.alias("group")).agg(F.count("*").alias("n"))
