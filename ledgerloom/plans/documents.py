"""Queries of stored documents, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import documents as O
from ledgerloom.plans.scalars import key_sql
from ledgerloom.sources import driver_tables as D


def docs(spark, sf_dir):
    return D.documents(spark, sf_dir)


def lines(spark, sf_dir):
    """Lines already extracted from a third of the documents, by their ids or names."""
    d = D.documents(spark, sf_dir).where("id % 3 = 0 and kind <> 'archive'")
    name = F.concat(F.lit("Supplier#"), (F.col("id") % 7).cast("string"), F.lit(" SARL"))
    return d.select("dossier", F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, F.col("source_id")).otherwise("").alias("source_id"), F.col("filename").alias("source_file"), name.alias("lib_frss"))


LINES = f"{D.DOCUMENTS}, ln AS (SELECT dossier, id AS pos, CASE WHEN id % 2 = 0 THEN source_id ELSE '' END AS source_id, filename AS source_file, 'Supplier#' || (id % 7) || ' SARL' AS lib_frss FROM docs WHERE id % 3 = 0 AND kind <> 'archive')"


def flight(spark, sf_dir):
    return D.import_jobs(spark, sf_dir).where("status = 'processing'").select(F.floor(F.col("dossier") / 10).alias("dossier"), F.concat(F.lit("src-"), (F.col("job") % 700).cast("string")).alias("source_id")).distinct()


def chosen(spark, sf_dir):
    return D.documents(spark, sf_dir).where("id % 5 <> 0 and kind <> 'archive'")


def a07_manifest(spark, sf_dir):
    """Files worth reading."""
    return O.manifest_filter(docs(spark, sf_dir)).select("dossier", "id", "filename")


def a08_member_path(spark, sf_dir):
    """Paths of archive members."""
    return docs(spark, sf_dir).select("id", O.member_path(F.lit("in/Lot1.zip"), F.col("filename")).alias("path"))


def g04_newest_documents(spark, sf_dir):
    """Newest document of each identity."""
    return O.newest(docs(spark, sf_dir)).select("dossier", "id", "identity")


def g06_archive_bounds(spark, sf_dir):
    """Archives with the time of their next upload."""
    return O.archive_bounds(docs(spark, sf_dir)).select("dossier", "id", F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until"))


def e09_archive_children(spark, sf_dir):
    """Archives with their children."""
    return O.archive_children(docs(spark, sf_dir))


def e10_extracted(spark, sf_dir):
    """Documents that have lines."""
    return O.extracted(docs(spark, sf_dir), lines(spark, sf_dir))


def e11_pending(spark, sf_dir):
    """Documents still to read, by kind."""
    return O.pending(docs(spark, sf_dir), lines(spark, sf_dir), flight(spark, sf_dir)).groupBy("dossier", "kind").agg(F.count("*").alias("n"))


def e12_skipped_archives(spark, sf_dir):
    """Archives that need no reading."""
    return O.skipped_archives(docs(spark, sf_dir), lines(spark, sf_dir)).select("dossier", "archive", "children")


def e08_document_lines(spark, sf_dir):
    """Lines of each document."""
    return O.document_lines(docs(spark, sf_dir), lines(spark, sf_dir))


def e14_assign_uploads(spark, sf_dir):
    """Results assigned to uploads."""
    d = docs(spark, sf_dir).where("kind = 'invoice'")
    uploads = d.where("id % 2 = 0").select(F.col("id").alias("upload"), F.when(F.col("id") % 8 == 0, F.concat(F.lit("u"), "id")).otherwise(F.concat(F.lit("src-"), "id")).alias("source_id"), F.concat("filename", (F.col("id") % 97).cast("string")).alias("name"))
    results = d.where("id % 2 = 1").select(F.col("id").alias("result"), F.concat(F.lit("src-"), (F.col("id") + 1).cast("string")).alias("source_id"), F.concat("filename", (F.col("id") % 97).cast("string")).alias("name"))
    return O.assign_uploads(results, uploads)


def e18_reusable(spark, sf_dir):
    """Uploads that repeat a stored document."""
    d = docs(spark, sf_dir)
    return O.reusable(d.where("id % 4 = 1"), d.where("id % 4 <> 1"))


def i04_deletion_closure(spark, sf_dir):
    """Documents to delete with the chosen ones."""
    return O.deletion_closure(docs(spark, sf_dir), chosen(spark, sf_dir))


def i05_deleted(spark, sf_dir):
    """Documents left after deletion."""
    return O.without(docs(spark, sf_dir), O.deletion_closure(docs(spark, sf_dir), chosen(spark, sf_dir))).select("dossier", "id")


def i06_recreated(spark, sf_dir):
    """Documents that repeat a deleted one."""
    d = docs(spark, sf_dir)
    return O.recreated(d.where("id % 3 = 0"), d.where("id % 3 <> 0"))


def f27_by_supplier(spark, sf_dir):
    """Documents by supplier."""
    return O.by_supplier(docs(spark, sf_dir), lines(spark, sf_dir))


def f28_counts(spark, sf_dir):
    """Documents of each dossier by kind, with archives that have children."""
    d = docs(spark, sf_dir)
    kids = O.archive_children(d).groupBy("dossier").agg(F.countDistinct("archive").alias("with_children"))
    return d.groupBy("dossier").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("invoice", "bank", "archive")]).join(kids, "dossier", "left").fillna(0)


def h06_document_list(spark, sf_dir):
    """The 25 newest invoices of each dossier."""
    from ledgerloom.operators.portfolio import newest

    return newest(docs(spark, sf_dir).where("kind = 'invoice'"), "dossier", [F.desc("created_at"), F.desc("id")], 25).select("dossier", "id", "rank")


def j11_analysed(spark, sf_dir):
    """Whether each document has been read."""
    d = docs(spark, sf_dir)
    return d.join(O.extracted(d, lines(spark, sf_dir)).withColumn("x", F.lit(True)), ["dossier", "id"], "left").select("dossier", "id", F.coalesce("x", F.lit(False)).alias("analysed"))


def i03_shared_identity(spark, sf_dir):
    """Identity keys that several documents of a dossier share."""
    from ledgerloom.functions.scalars import identity_keys

    return docs(spark, sf_dir).select("dossier", "id", F.explode(identity_keys(F.col("filename"))).alias("key")).groupBy("dossier", "key").agg(F.count("*").alias("n")).where("n > 1")


QUERIES = {f.__name__: f for f in (a07_manifest, a08_member_path, g04_newest_documents, g06_archive_bounds, e09_archive_children, e10_extracted, e11_pending, e12_skipped_archives, e08_document_lines, e14_assign_uploads, e18_reusable, i04_deletion_closure, i05_deleted, i06_recreated, f27_by_supplier, f28_counts, h06_document_list, j11_analysed, i03_shared_identity)}

IDENT = "CASE WHEN source_id <> '' THEN 'src:' || source_id ELSE 'path:' || lower(filename) END"
KEYS = lambda c: f"unnest(CASE WHEN contains({c}, '/') THEN [lower({c}), lower(split_part({c}, '/', -1))] ELSE [lower({c})] END)"
BOUNDS = "ar AS (SELECT *, lower(replace(filename, '.zip', '')) AS stem FROM docs WHERE kind = 'archive'), tm AS (SELECT dossier, stem, created_at, lead(created_at) OVER (PARTITION BY dossier, stem ORDER BY created_at) AS until FROM (SELECT DISTINCT dossier, stem, created_at FROM ar)), bd AS (SELECT ar.*, until FROM ar JOIN tm USING (dossier, stem, created_at))"
CHILDREN = f"{BOUNDS}, ch AS (SELECT bd.dossier, bd.id AS archive, d.id FROM bd JOIN docs d ON d.dossier = bd.dossier AND d.kind <> 'archive' AND contains(d.filename, '/') AND lower(split_part(d.filename, '/', 1)) = bd.stem AND d.created_at >= bd.created_at AND (until IS NULL OR d.created_at < until))"
EXTRACTED = f"lk AS (SELECT DISTINCT dossier, {KEYS('source_file')} AS key FROM ln), dk AS (SELECT dossier, id, source_id, {KEYS('filename')} AS key FROM docs), ex AS (SELECT dossier, id FROM docs d WHERE source_id <> '' AND EXISTS (SELECT 1 FROM ln WHERE ln.dossier = d.dossier AND ln.source_id = d.source_id) UNION SELECT dk.dossier, id FROM dk JOIN lk USING (dossier, key) WHERE source_id = '')"
CHOSEN = f"{CHILDREN}, pick AS (SELECT dossier, id FROM docs WHERE id % 5 <> 0 AND kind <> 'archive'), gone AS (SELECT * FROM pick UNION SELECT dossier, archive FROM (SELECT ch.dossier, archive, count(*) AS n, count(pick.id) AS g FROM ch LEFT JOIN pick ON pick.dossier = ch.dossier AND pick.id = ch.id GROUP BY ALL) WHERE n = g)"
DL = f"dl AS (SELECT dossier, id, pos, min(way) AS way FROM (SELECT d.dossier, d.id, pos, 0 AS way FROM docs d JOIN ln ON ln.dossier = d.dossier AND ln.source_id = d.source_id AND d.source_id <> '' UNION ALL SELECT dk.dossier, dk.id, pos, 1 FROM (SELECT dossier, id, {KEYS('filename')} AS key FROM docs) dk JOIN (SELECT dossier, pos, {KEYS('source_file')} AS key FROM ln) lk USING (dossier, key)) GROUP BY ALL)"
DELKEYS = "SELECT dossier, id, unnest(list_filter(['id:' || id, 'path:' || lower(filename), CASE WHEN source_id <> '' THEN 'src:' || source_id END], lambda x: x IS NOT NULL)) AS key FROM docs"

ORACLES = {
    "a07_manifest": f"WITH {D.DOCUMENTS} SELECT dossier, id, filename FROM docs WHERE regexp_matches(filename, '\\.(pdf|csv|zip)$') AND size >= 400",
    "a08_member_path": f"WITH {D.DOCUMENTS} SELECT id, CASE WHEN contains(filename, '/') AND split_part(filename, '/', 1) = 'lot1' THEN filename ELSE 'Lot1/' || filename END AS path FROM docs",
    "g04_newest_documents": f"WITH {D.DOCUMENTS} SELECT dossier, id, {IDENT} AS identity FROM docs QUALIFY row_number() OVER (PARTITION BY dossier, {IDENT} ORDER BY created_at DESC, id DESC) = 1",
    "g06_archive_bounds": f"WITH {D.DOCUMENTS}, {BOUNDS} SELECT dossier, id, strftime(until, '%Y-%m-%d %H:%M:%S') AS until FROM bd",
    "e09_archive_children": f"WITH {D.DOCUMENTS}, {CHILDREN} SELECT * FROM ch",
    "e10_extracted": f"WITH {LINES}, {EXTRACTED} SELECT * FROM ex",
    "e11_pending": f"WITH {LINES}, {D.JOBS}, {EXTRACTED} SELECT dossier, kind, count(*) AS n FROM docs d WHERE kind <> 'archive' AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.dossier = d.dossier AND ex.id = d.id) AND NOT EXISTS (SELECT 1 FROM jobs j WHERE status = 'processing' AND j.dossier // 10 = d.dossier AND 'src-' || (job % 700) = d.source_id) GROUP BY dossier, kind",
    "e12_skipped_archives": f"WITH {LINES}, {CHILDREN}, {EXTRACTED} SELECT dossier, archive, children FROM (SELECT ch.dossier, archive, count(*) AS children, count(ex.id) AS done FROM ch LEFT JOIN ex ON ex.dossier = ch.dossier AND ex.id = ch.id GROUP BY ALL) WHERE children = done",
    "e08_document_lines": f"WITH {LINES}, {DL} SELECT * FROM dl",
    "e14_assign_uploads": f"WITH {D.DOCUMENTS}, u AS (SELECT id AS upload, CASE WHEN id % 8 = 0 THEN 'u' || id ELSE 'src-' || id END AS source_id, filename || (id % 97) AS name FROM docs WHERE kind = 'invoice' AND id % 2 = 0), r AS (SELECT id AS result, 'src-' || (id + 1) AS source_id, filename || (id % 97) AS name FROM docs WHERE kind = 'invoice' AND id % 2 = 1), e AS (SELECT name, min(upload) AS u1 FROM u GROUP BY name), b AS (SELECT lower(split_part(name, '/', -1)) AS base, min(upload) AS u2 FROM u GROUP BY 1 HAVING count(*) = 1), f AS (SELECT result, coalesce(u.upload, u1, u2) AS upload, CASE WHEN u.upload IS NOT NULL THEN 0 WHEN u1 IS NOT NULL THEN 1 ELSE 2 END AS way FROM r LEFT JOIN u ON u.source_id = r.source_id LEFT JOIN e ON e.name = r.name LEFT JOIN b ON b.base = lower(split_part(r.name, '/', -1))) SELECT * FROM f WHERE upload IS NOT NULL QUALIFY row_number() OVER (PARTITION BY upload ORDER BY way, result) = 1",
    "e18_reusable": f"WITH {D.DOCUMENTS}, n AS (SELECT * FROM docs WHERE id % 4 = 1), o AS (SELECT * FROM docs WHERE id % 4 <> 1), c AS (SELECT n.id AS new, o.id, n.size = o.size AS reuse, 0 AS way, o.created_at AS t FROM n JOIN o ON n.dossier = o.dossier AND n.source_id = o.source_id AND n.source_id <> '' UNION ALL SELECT a.id, b.id, a.size = b.size, 1, b.created_at FROM (SELECT *, {KEYS('filename')} AS key FROM n) a JOIN (SELECT *, {KEYS('filename')} AS key FROM o) b ON a.dossier = b.dossier AND a.key = b.key) SELECT new, id, reuse FROM c QUALIFY row_number() OVER (PARTITION BY new ORDER BY way, t DESC, id DESC) = 1",
    "i04_deletion_closure": f"WITH {D.DOCUMENTS}, {CHOSEN} SELECT dossier, id FROM gone",
    "i05_deleted": f"WITH {D.DOCUMENTS}, {CHOSEN} SELECT dossier, id FROM docs EXCEPT SELECT dossier, id FROM gone",
    "i06_recreated": f"WITH {D.DOCUMENTS}, k AS ({DELKEYS}) SELECT DISTINCT a.dossier, a.id FROM k a JOIN k b ON a.dossier = b.dossier AND a.key = b.key WHERE a.id % 3 = 0 AND b.id % 3 <> 0",
    "f27_by_supplier": f"WITH {LINES}, {DL}, f AS (SELECT dossier, id, arg_min(pos, (way, pos)) AS pos FROM dl GROUP BY ALL), nm AS (SELECT f.dossier, id, lib_frss FROM f JOIN ln USING (dossier, pos)) SELECT d.dossier, CASE WHEN kind = 'bank' THEN '1 bank' WHEN lib_frss IS NOT NULL THEN '0 ' || {key_sql('lib_frss')} WHEN contains(filename, '/') THEN '2 ' || split_part(filename, '/', 1) WHEN kind = 'archive' THEN '3 archives' ELSE '4 others' END AS \"group\", count(*) AS n FROM docs d LEFT JOIN nm ON nm.dossier = d.dossier AND nm.id = d.id GROUP BY ALL",
    "f28_counts": f"WITH {D.DOCUMENTS}, {CHILDREN}, k AS (SELECT dossier, count(DISTINCT archive) AS n FROM ch GROUP BY dossier) SELECT dossier, count(*) FILTER (kind = 'invoice') AS invoice, count(*) FILTER (kind = 'bank') AS bank, count(*) FILTER (kind = 'archive') AS archive, coalesce(any_value(n), 0) AS with_children FROM docs LEFT JOIN k USING (dossier) GROUP BY dossier",
    "h06_document_list": f"WITH {D.DOCUMENTS} SELECT dossier, id, row_number() OVER (PARTITION BY dossier ORDER BY created_at DESC, id DESC) AS rank FROM docs WHERE kind = 'invoice' QUALIFY rank <= 25",
    "j11_analysed": f"WITH {LINES}, {EXTRACTED} SELECT d.dossier, d.id, ex.id IS NOT NULL AS analysed FROM docs d LEFT JOIN ex ON ex.dossier = d.dossier AND ex.id = d.id",
    "i03_shared_identity": f"WITH {D.DOCUMENTS} SELECT dossier, key, count(*) AS n FROM (SELECT dossier, id, {KEYS('filename')} AS key FROM docs) GROUP BY ALL HAVING count(*) > 1",
}
