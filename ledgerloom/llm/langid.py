"""Language identification by Bayesian evidence fusion.

The posterior of a language combines the likelihood of the text (byte bigrams),
the likelihood of the declared language given the true one, and a prior of the
host that is smoothed towards its address suffix and that towards all rows.
All three are estimated by grouped aggregation over the whole table.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, cut, fresh, partitions, shared_dir

UNKNOWN = "und"
#: Strength of a parent's prior, in rows.
STRENGTH = 20.0
#: Prior odds of text in none of the languages.
OUTSIDE = 1e-4
#: Languages whose scores stand in a full table, and whose counts a task holds at once; more are scored from a sparse table.
DENSE = 64
#: Every declared value names a language. Those of at least one in so many of the rows that declare something are held by the driver and
#: the tasks: no more than this number, with at most 65,536 bigram counts each. The others, of any number, stay in distributed tables.
RAREST = 16_384
#: Languages whose share of a posterior is below e to the minus this, far under what a double resolves, are not scored one by one.
NEGLIGIBLE = 40.0
#: Counts of languages by hosts, or by declared values, up to this number are broadcast; beyond it they are joined by shuffle.
BROADCAST_PRIORS = 640_000
#: Such counts up to this number are looked up in the tasks, so that no row carries them.
LOOKUP = 65_536
#: Parts that rows without a key are dealt to where they are joined by shuffle.
SALT = 4096

# letters stay, A-Z is lower-cased, anything else in ASCII counts as a blank
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
SYMBOLS = 26 + 128 + 1


def bigrams(text: bytes) -> np.ndarray:
    """Codes of adjacent byte pairs that hold a letter, the text set between blanks."""
    x = FOLD[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.int32)
    codes = x[:-1] * 256 + x[1:]
    return codes[codes != 32 * 256 + 32]


def count_bigrams(docs: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram counts (language, code, n) of each declared language over all rows; only pairs that occur reach the driver."""

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        at = {x: i for i, x in enumerate(languages)}

        def out():
            seen = {i: np.flatnonzero(c) for i, c in counts.items()}
            cols = [np.repeat(np.array(list(seen), np.int64), [len(j) for j in seen.values()]), np.concatenate([*seen.values(), np.empty(0, np.int64)]), np.concatenate([*(counts[i][j] for i, j in seen.items()), np.empty(0, np.int64)])]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["l", "c", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                codes = bigrams(text)
                if name in at and len(codes):
                    if at[name] not in counts and len(counts) == DENSE:
                        yield out()
                        counts.clear()
                    held = counts.setdefault(at[name], np.zeros(65536, np.int64))
                    if len(codes) < 5000:
                        np.add.at(held, codes, 1)
                    else:
                        held += np.bincount(codes, minlength=65536)
        yield out()

    found = docs.select("declared", "text").mapInArrow(run, "l long, c long, n long").groupBy("l", "c").agg(F.sum("n").alias("n")).toArrow()
    return tuple(found.column(j).to_numpy() for j in range(3))


def likelihoods(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities (code x language, last column: none of them, all pairs alike)."""
    p = (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * SYMBOLS**2)
    return np.vstack([np.log(p), np.full((1, 65536), -2 * math.log(SYMBOLS))]).T.astype(np.float32).copy()


class Sparse:
    """The same log-probabilities of any number of languages: what an unseen pair scores, and by how much seen ones exceed it."""

    def __init__(self, l: np.ndarray, c: np.ndarray, n: np.ndarray, k: int) -> None:
        total = np.bincount(l, n, k) + 0.1 * SYMBOLS**2
        self.unseen = np.r_[np.log(0.1 / total), -2 * math.log(SYMBOLS)]
        order = np.argsort(c, kind="stable")
        self.language = l[order].astype(np.int32)
        self.more = np.log((n[order] + 0.1) / 0.1).astype(np.float32)
        self.edge = np.searchsorted(c[order], np.arange(65537))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = len(codes) * self.unseen
        code, times = np.unique(codes, return_counts=True)
        for a, b, m in zip(self.edge[code].tolist(), self.edge[code + 1].tolist(), times.tolist()):
            out[self.language[a:b]] += m * self.more[a:b].astype(np.float64)
        return out


def learned(l: np.ndarray, c: np.ndarray, n: np.ndarray, k: int) -> np.ndarray | Sparse:
    """The model of ``k`` languages from their bigram counts."""
    if k > DENSE:
        return Sparse(l, c, n, k)
    counts = np.zeros((k, 65536))
    counts[l, c] = n
    return likelihoods(counts)


def text_scores(model: np.ndarray | Sparse, text: bytes) -> np.ndarray:
    codes = bigrams(text)
    if isinstance(model, Sparse):
        return model.scores(codes)
    out = np.zeros(model.shape[1])
    for at in range(0, len(codes), 100_000):
        out += model[codes[at : at + 100_000]].sum(0, dtype=np.float64)
    return out


def bags(texts: DataFrame, key: str) -> DataFrame:
    """Bigrams of each text with their numbers, from the columns ``key`` and ``text``: rows (key, code, m)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [np.unique(bigrams(t), return_counts=True) for t in byte_values(batch.column(1))]
                rows = np.repeat(np.arange(len(found)), [len(c) for c, _ in found])
                codes, m = (np.concatenate([x[j] for x in found]).astype(np.int64) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(codes), pa.array(m)], names=["key", "code", "m"])

    return texts.select(F.col(key).cast("string"), "text").mapInArrow(run, "key string, code long, m long")


def model_parts(path: str):
    """The models of rare languages, 128 at a time, from the files in the shared folder."""
    system, folder = pa.fs.FileSystem.from_uri(path) if ":/" in path else (pa.fs.LocalFileSystem(), path)
    for f in sorted(x.path for x in system.get_file_info(pa.fs.FileSelector(folder)) if x.path.endswith(".parquet")):
        with system.open_input_file(f) as source:
            yield from pq.ParquetFile(source).iter_batches(batch_size=128, use_threads=False)


class Rare:
    """Languages too many to be held by tasks: their models are tables, and ``ceiling`` holds the most that any of them gives each pair."""

    def __init__(self, base: DataFrame, names: DataFrame) -> None:
        smooth = 0.1 * SYMBOLS**2
        counts = cut(bags(base.join(names, "declared"), "declared").groupBy(F.col("key").alias("rare"), "code").agg(F.sum("m").alias("n")))
        totals = counts.groupBy("rare").agg(F.sum("n").alias("total"))
        models = names.select(F.col("declared").alias("rare")).join(totals, "rare", "left").withColumn("total", F.coalesce("total", F.lit(0)) + smooth)
        self.models = cut(models.select("rare", "total", F.log(0.1 / F.col("total")).alias("unseen")))
        self.more = counts.select("rare", "code", F.log((F.col("n") + 0.1) / 0.1).alias("more"))
        self.ceiling = np.full(65536, self.models.agg(F.max("unseen")).first()[0])
        lists = self.more.groupBy("rare").agg(F.collect_list(F.struct("code", "more")).alias("seen"))
        held = self.models.join(lists, "rare", "left").select("rare", "unseen", F.coalesce("seen.code", F.array().cast("array<long>")).alias("codes"), F.coalesce("seen.more", F.array().cast("array<double>")).alias("more"))
        self.path = f"{shared_dir(base.sparkSession).rstrip('/')}/rare-{uuid.uuid4().hex}"
        held.write.option("parquet.block.size", 16 << 20).parquet(self.path)
        for r in self.more.join(self.models, "rare").groupBy("code").agg(F.max(F.col("more") + F.col("unseen")).alias("most")).collect():
            self.ceiling[r["code"]] = max(self.ceiling[r["code"]], r["most"])

    def scores(self, texts: DataFrame, best: bool) -> DataFrame:
        """Log-likelihoods of at least ``least`` that texts (key, text, least) have in these languages, or the best of them: rows (key, rare, s).

        Every text meets every language, a part of the texts and of the models at a time.
        """
        path = self.path

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    found = [np.unique(bigrams(t), return_counts=True) for t in byte_values(batch.column(1))]
                    held = np.unique(np.concatenate([c for c, _ in found]))
                    place = np.full(65536, -1)
                    place[held] = np.arange(len(held))
                    x = np.zeros((len(found), len(held)))
                    for row, (codes, m) in enumerate(found):
                        x[row, place[codes]] = m
                    size, least = x.sum(1)[:, None], batch.column(2).to_numpy(zero_copy_only=False).copy()
                    top: dict[int, tuple[float, str]] = {}
                    for models in model_parts(path):
                        name = models.column("rare").to_pylist()
                        codes, more = (models.column(c).flatten().to_numpy() for c in ("codes", "more"))
                        of = np.repeat(np.arange(len(name)), np.diff(models.column("codes").offsets.to_numpy()))
                        w = np.zeros((len(held), len(name)))
                        in_use = place[codes] >= 0
                        w[place[codes[in_use]], of[in_use]] = more[in_use]
                        # rounded, so that equal texts tie
                        s = np.round(x @ w + size * models.column("unseen").to_numpy(), 9)
                        hit, language = np.nonzero(s >= least[:, None])
                        if not best:
                            yield rows_of(batch.column(0).take(pa.array(hit)), [name[j] for j in language], s[hit, language])
                            continue
                        for i, j in zip(hit.tolist(), language.tolist()):
                            if i not in top or (-s[i, j], name[j]) < (-top[i][0], top[i][1]):
                                top[i] = (float(s[i, j]), name[j])
                                least[i] = s[i, j]
                    if best:
                        yield rows_of(batch.column(0).take(pa.array(list(top), pa.int64())), [n for _, n in top.values()], [v for v, _ in top.values()])

        def rows_of(keys, names, values):
            return pa.RecordBatch.from_arrays([keys, pa.array(names, pa.string()), pa.array(values, pa.float64())], names=["key", "rare", "s"])

        spread = texts.dropDuplicates(["key"]).repartition(partitions(texts.sparkSession), "key")
        return spread.select("key", "text", "least").mapInArrow(run, "key string, rare string, s double")

    def guesses(self, guessed: DataFrame, languages: DataFrame) -> DataFrame:
        """Rows (l, rare, declared, host): the best language of each text, ``l`` -1 where that is a rare one; ``text`` is set where one may be."""
        tried = guessed.withColumn("key", F.sha2("text", 256))
        best = self.scores(tried.where("text is not null").select("key", "text", F.col("score").alias("least")), True)
        compared = tried.where("text is not null").join(best, "key", "left").join(F.broadcast(languages), "l", "left")
        wins = F.col("rare").isNotNull() & (F.col("name").isNull() | (F.col("s") > F.col("score")) | ((F.col("s") == F.col("score")) & (F.col("rare") < F.col("name"))))
        compared = compared.select(F.when(wins, -1).otherwise(F.col("l")).alias("l"), F.when(wins, F.col("rare")).alias("rare"), "declared", "host")
        return guessed.where("text is null and l >= 0").select("l", F.lit(None).cast("string").alias("rare"), "declared", "host").unionByName(compared)

    def posteriors(self, asked: DataFrame, cells: DataFrame, classes: int) -> DataFrame:
        """What the rare languages together and the best of them score for each row of ``asked`` (key, text, declared, host, least): rows (key, top, lang, more).

        Those whose likelihood is below ``least`` count for nothing, even together.

        ``more`` is the logarithm of the sum of their scores; ``cells`` (l, rare, declared, host, n) are the guesses.
        """
        suffix = F.element_at(F.split("host", r"\."), -1).alias("suffix")
        cells = cells.select("*", suffix)
        every = cells.agg(F.sum("n")).first()[0] or 0
        number = lambda rows, of, name: rows.groupBy(*of).agg(F.sum("n").alias(name))
        hosted, own = cells.where("host is not null"), cells.where("rare is not null")
        asked = asked.select("*", suffix, F.sha2("text", 256).alias("of_text"))
        texts = asked.groupBy(F.col("of_text").alias("key")).agg(F.first("text").alias("text"), F.min("least").alias("least"))
        z = self.scores(texts, False).withColumnRenamed("key", "of_text")
        z = z.join(asked.drop("text").join(number(hosted, ["host"], "n_host"), "host", "left").join(number(hosted, ["suffix"], "n_suffix"), "suffix", "left"), "of_text").where("s >= least")
        for of, name in ((["rare"], "own"), (["rare", "host"], "own_host"), (["rare", "suffix"], "own_suffix"), (["rare", "declared"], "own_declared")):
            z = z.join(number(own.dropna(subset=of), of, name), of, "left")
        z = z.join(number(own.where("declared is not null"), ["rare"], "said"), "rare", "left").fillna(0, ["own", "own_host", "own_suffix", "own_declared", "said", "n_suffix"])
        overall = (F.col("own") + 1) / (classes + every)
        of_suffix = (F.col("own_suffix") + STRENGTH * overall) / (F.col("n_suffix") + STRENGTH)
        prior = F.when(F.col("n_host").isNull(), overall).otherwise((F.col("own_host") + STRENGTH * of_suffix) / (F.col("n_host") + STRENGTH))
        told = F.when(F.col("declared").isNull(), 1.0).otherwise((F.col("own_declared") + 0.5) / (0.5 * (classes + 1) + F.col("said")))
        # sums of exponentials by steps of 500, so that none overflows; the two highest steps hold all that counts
        z = z.select("key", "rare", (F.col("s") + F.log(prior) + F.log(told)).alias("z")).withColumn("step", F.floor(F.col("z") / 500))
        steps = z.groupBy("key", "step").agg(F.sum(F.exp(F.col("z") - 500 * F.col("step"))).alias("sum"), F.min(F.struct((-F.col("z")).alias("cost"), "rare")).alias("best"))
        high = steps.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("step", "sum", "best")), asc=False).alias("high"))
        first, second = F.get("high", F.lit(0)), F.get("high", F.lit(1))
        below = F.coalesce(second["sum"] * F.exp(500.0 * (second["step"] - first["step"])), F.lit(0.0))
        return high.select("key", (-first["best"]["cost"]).alias("top"), first["best"]["rare"].alias("lang"), (500 * first["step"] + F.log(first["sum"] + below)).alias("more"))


def smoothed(counts: list, parent: np.ndarray) -> np.ndarray:
    """Shares of the languages in ``counts`` (l, n), smoothed towards those of the parent; -1, the last, stands for the rare ones together."""
    out, total = STRENGTH * parent, 0
    for x in counts:
        out[x["l"]] += x["n"]
        total += x["n"]
    return out / (total + STRENGTH)


def attached(docs: DataFrame, key: Column, table: DataFrame, of: str, entries: Column, apart: str, other: str) -> DataFrame:
    """``docs`` left-joined with ``table`` whose column ``of`` equals ``key``; ``entries`` counts what a row of the table holds, ``apart`` and ``other`` are free names.

    Beyond the bound for a broadcast the join is by shuffle; rows without a key
    are then dealt to many tasks, and adaptive execution splits hot keys.
    """
    if (table.agg(F.sum(entries)).first()[0] or 0) <= BROADCAST_PRIORS:
        return docs.join(F.broadcast(table), key == F.col(of), "left")
    part = F.when(key.isNull(), F.pmod(F.xxhash64(*[F.col(c) for c, t in docs.dtypes if "map<" not in t]), F.lit(SALT)).cast("int")).otherwise(-1)
    return docs.withColumn(apart, part).join(table.withColumn(other, F.lit(-1)), (key == F.col(of)) & (F.col(apart) == F.col(other)), "left")


def identify(docs: DataFrame, text: str = "text", declared: Column | None = None, host: Column | None = None, into: str = "language") -> DataFrame:
    """Add the struct ``into`` (lang, probability, accepted) to every row of ``docs``.

    ``declared``: language named by markup or metadata; ``host``: host name or
    source, whose last dot-separated part is the address suffix. Nulls there
    are no evidence; every other declared value is a language, however rare.
    Rare ones (under one in 16,384 of the rows that declare something) are
    scored one by one, which takes texts times languages, where a bound on them
    all together does not show that they count for nothing. A text without letters (null and empty ones too), or one
    that no language explains better than chance, is ``und`` and not accepted,
    and so is a text whose best posterior is below one half. Repeated rows are
    judged alike; an empty table, or one without declared languages, accepts
    nothing; all columns of ``docs`` are kept as they are, whatever their
    names; ``into`` must not be one of them.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {into} already")
    spark = docs.sparkSession
    declared = F.lit(None).cast("string") if declared is None else declared
    host = F.lit(None).cast("string") if host is None else host
    base = docs.select(F.col(text).alias("text"), F.lower(declared).alias("declared"), F.lower(host).alias("host"))
    stated = base.where("declared is not null").groupBy("declared").count()
    rows, classes = stated.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    languages = sorted(r[0] for r in stated.where(F.col("count") * RAREST >= rows).select("declared").collect())
    k = len(languages)
    if not classes:
        return docs.withColumn(into, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(1.0).alias("probability"), F.lit(False).alias("accepted")))
    model = spark.sparkContext.broadcast(learned(*count_bigrams(base, languages), k))
    rare = Rare(base, stated.where(F.col("count") * RAREST < rows).select("declared")) if classes > k else None
    ceiling = spark.sparkContext.broadcast(rare.ceiling if rare else None)

    def guess(batches):
        for batch in batches:
            best = [int(s[:k].argmax()) if (s := text_scores(model.value, t)).any() else -1 for t in byte_values(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), batch.column(1), batch.column(2)], names=["l", "declared", "host"])

    def try_rare(batches):
        for batch in batches:
            out = []
            for t, text in zip(byte_values(batch.column(0)), batch.column(0).to_pylist()):
                s = text_scores(model.value, t)
                score = float(s[:k].max(initial=-np.inf))
                may_be = s.any() and ceiling.value[bigrams(t)].sum() >= score - 1e-6 * (1 + abs(s[k]))
                out.append((int(s[:k].argmax()) if k and s.any() else -1, score, text if may_be else None))
            l, scores, texts = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(l, pa.int32()), pa.array(scores, pa.float64()), pa.array(texts, pa.string()), batch.column(1), batch.column(2)], names=["l", "score", "text", "declared", "host"])

    # counts of text-only guesses by declared language and host: the one pass that both priors come from; -1 stands for rare languages
    if rare:
        # from Arrow: rows of Python would start workers of their own
        names = spark.createDataFrame(pa.table({"l": pa.array(range(k), pa.int32()), "name": pa.array(languages, pa.string())}))
        guessed = rare.guesses(cut(base.mapInArrow(try_rare, "l int, score double, text string, declared string, host string")), names)
        by_name = cut(guessed.groupBy("l", "rare", "declared", "host").agg(F.count("*").alias("n")))
        cells = by_name.groupBy("l", "declared", "host").agg(F.sum("n").alias("n"))
    else:
        cells = cut(base.mapInArrow(guess, "l int, declared string, host string").where("l >= 0").groupBy("l", "declared", "host").agg(F.count("*").alias("n")))
    # what is declared when a language is found: half a row for each pair (and for none), and the rows counted
    pairs = cells.where("declared is not null").groupBy("declared", "l").agg(F.sum("n").alias("n"))
    found = np.full(k + 1, 0.5 * (classes + 1))
    for r in pairs.groupBy("l").agg(F.sum("n").alias("n")).collect():
        found[r["l"]] += r["n"]
    said = spark.sparkContext.broadcast((languages, found))
    overall = np.append(np.full(k, 1.0), classes - k)
    for r in cells.groupBy("l").agg(F.sum("n").alias("n")).collect():
        overall[r["l"]] += r["n"]
    overall /= overall.sum()

    by_host = cells.where("host is not null").withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).groupBy("suffix", "host", "l").agg(F.sum("n").alias("n"))
    by_suffix = by_host.groupBy("suffix", "l").agg(F.sum("n").alias("n")).groupBy("suffix").agg(F.collect_list(F.struct("l", "n")).alias("of_suffix"))
    by_host = by_host.groupBy("suffix", "host").agg(F.collect_list(F.struct("l", "n")).alias("of_host"))
    key, of, prior, said_by, told, *apart = fresh(docs, "key", "of", "prior", "said_by", "told", "apart1", "apart2", "apart3", "apart4")
    priors = by_host.join(by_suffix, "suffix").select(F.col("host").alias(of), F.struct("of_host", "of_suffix").alias(prior))
    by_declared = pairs.groupBy(F.col("declared").alias(said_by)).agg(F.collect_list(F.struct("l", "n")).alias(told))
    of_prior, of_told = F.size(f"{prior}.of_host") + F.size(f"{prior}.of_suffix"), F.size(told)
    counts = sum(table.agg(F.sum(entries)).first()[0] or 0 for table, entries in ((priors, of_prior), (by_declared, of_told)))

    def posterior(t: str | None, d: str | None, pairs_of, h, sfx) -> tuple:
        names, found = said.value
        s = text_scores(model.value, t.encode() if t else b"")
        if not s.any():
            return UNKNOWN, 1.0, False, 0.0, 0.0, True, 0.0, False
        prior = overall if h is None else smoothed(h, smoothed(sfx, overall))
        s[:k] += np.log(prior[:k])
        s[k] += math.log(OUTSIDE)
        by = np.full(k + 1, 0.5)
        if d is not None:
            for x in pairs_of if pairs_of is not None else ():
                by[x["l"]] += x["n"]
            s[:k] += np.log(by[:k] / found[:k])
            s[k] += math.log(1 / classes)
        top = float(s.max())
        s = np.exp(s - top)
        total = s.sum()
        s /= total
        i = int(s.argmax())
        may_be, least = False, 0.0
        if classes > k:
            # the most that the rare languages' priors come to together, and that the declared value says for one of them
            most = by[k] / (0.5 * classes + by[k]) if d is not None else 1.0
            least = top - NEGLIGIBLE - math.log(prior[k]) - math.log(most)
            may_be = bool(ceiling.value[bigrams(t.encode())].sum() >= least)
        return UNKNOWN if i == k else names[i], float(s[i]), i < k and bool(s[i] >= 0.5), top, top + math.log(total), i == k, least, may_be

    fields = ["lang", "probability", "accepted"] + (["top", "total", "outside", "least", "may_be"] if rare else [])
    result = "lang string, probability double, accepted boolean" + (", top double, total double, outside boolean, least double, may_be boolean" if rare else "")
    if counts <= min(LOOKUP, BROADCAST_PRIORS):
        hosts = {r[of]: ([x.asDict() for x in r[prior]["of_host"]], [x.asDict() for x in r[prior]["of_suffix"]]) for r in priors.collect()}
        tags = {r[said_by]: [x.asDict() for x in r[told]] for r in by_declared.collect()}
        held = spark.sparkContext.broadcast((hosts, tags))

        @F.pandas_udf(result)
        def looked_up(texts: pd.Series, named: pd.Series, hosted: pd.Series) -> pd.DataFrame:
            hosts, tags = held.value
            return pd.DataFrame([posterior(t, d, tags.get(d), *hosts.get(h, (None, None)))[: len(fields)] for t, d, h in zip(texts, named, hosted)], columns=fields)

        judged = docs.withColumn(into, looked_up(F.col(text), F.lower(declared), F.lower(host)))
    else:

        @F.pandas_udf(result)
        def judge(texts: pd.Series, named: pd.Series, pairs: pd.Series, of_host: pd.Series, of_suffix: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([posterior(*row)[: len(fields)] for row in zip(texts, named, pairs, of_host, of_suffix)], columns=fields)

        joined = attached(docs.withColumn(key, F.lower(host)), F.col(key), priors, of, of_prior, *apart[:2])
        joined = attached(joined.withColumn(key, F.lower(declared)), F.col(key), by_declared, said_by, of_told, *apart[2:])
        judged = joined.withColumn(into, judge(F.col(text), F.col(key), F.col(told), F.col(f"{prior}.of_host"), F.col(f"{prior}.of_suffix"))).select(*docs.columns, into)
    if not rare:
        return judged

    # rows for which rare languages may count are asked again, each text, declared value and host once
    whole = F.sha2(F.concat_ws("|", *[F.sha2(F.coalesce(F.concat(F.lit("="), c), F.lit("")), 256) for c in (F.col(text), F.lower(declared), F.lower(host))]), 256)
    asked = judged.where(F.col(f"{into}.may_be")).select(whole.alias("key"), F.col(text).alias("text"), F.lower(declared).alias("declared"), F.lower(host).alias("host"), F.col(f"{into}.least").alias("least"))
    asked = cut(asked.dropDuplicates(["key"]))
    others = cut(rare.posteriors(asked, by_name, classes)).select(F.col("key").alias(of), F.struct("top", "lang", "more").alias(prior))
    both = judged.withColumn(key, whole).join(others, F.col(key) == F.col(of), "left")
    mine, other = F.col(into), F.col(prior)
    known = F.struct(mine["lang"].alias("lang"), mine["probability"].alias("probability"), mine["accepted"].alias("accepted"))
    most = F.greatest(mine["total"], other["more"])
    total = most + F.log(F.exp(mine["total"] - most) + F.exp(other["more"] - most))
    wins = (other["top"] > mine["top"]) | ((other["top"] == mine["top"]) & (mine["outside"] | (other["lang"] < mine["lang"])))
    share = F.exp(F.greatest(mine["top"], other["top"]) - total)
    mixed = F.struct(F.when(wins, other["lang"]).otherwise(mine["lang"]).alias("lang"), share.alias("probability"), ((share >= 0.5) & (wins | ~mine["outside"])).alias("accepted"))
    return both.withColumn(into, F.when(other.isNull(), known).otherwise(mixed)).select(*docs.columns, into)
