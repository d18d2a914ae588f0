"""Language posteriors and quality scores recomputed in plain numpy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import langid, queries, rules

LETTERS = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}


def sample(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_posterior_against_numpy(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        lang = rng.choice(list(LETTERS))
        declared = lang if rng.random() < 0.7 else rng.choice([*LETTERS, None, None])
        rows.append((i, sample(rng, lang, rng.randint(1, 6)), declared, rng.choice([f"{lang}.x", "mixed.x", "other.y", None])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    got = {r.doc_id: r.language for r in langid.identify(docs, declared=F.col("lang"), host=F.col("host")).collect()}

    names = sorted({d for _, _, d, _ in rows if d})
    k = len(names)
    counts = np.zeros((k, 65536))
    for _, t, d, _ in rows:
        if d:
            np.add.at(counts[names.index(d)], langid.bigrams(t.encode()), 1)
    logp = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * langid.SYMBOLS**2))
    likelihood = {i: np.append(logp[:, langid.bigrams(t.encode())].sum(1), -2 * math.log(langid.SYMBOLS) * len(langid.bigrams(t.encode()))) for i, t, _, _ in rows}
    guess = {i: int(s[:k].argmax()) for i, s in likelihood.items()}
    told, overall = np.full((k, k), 0.5), np.ones(k)  # declared x guessed
    by_host, by_suffix = {}, {}
    for i, _, d, h in rows:
        overall[guess[i]] += 1
        if d:
            told[names.index(d), guess[i]] += 1
        if h:
            by_host.setdefault(h, np.zeros(k))[guess[i]] += 1
            by_suffix.setdefault(h.split(".")[-1], np.zeros(k))[guess[i]] += 1
    overall /= overall.sum()
    found = told.sum(0) + 0.5  # half a row for none declared

    def smooth(n, parent):
        return (langid.STRENGTH * parent + n) / (langid.STRENGTH + n.sum())

    for i, _, d, h in rows:
        s = likelihood[i].copy()
        s[:k] += np.log(overall if h is None else smooth(by_host[h], smooth(by_suffix[h.split(".")[-1]], overall)))
        s[k] += math.log(langid.OUTSIDE)
        if d:
            s[:k] += np.log(told[names.index(d)] / found)
            s[k] += math.log(1 / k)
        p = np.exp(s - s.max())
        p /= p.sum()
        best = int(p.argmax())
        assert math.isclose(got[i].probability, p[best], rel_tol=1e-3, abs_tol=1e-4), i
        assert got[i].lang == (names[best] if best < k else "und")


def test_hidden_languages_are_found(spark):
    """Rows whose language is declared nowhere: told by text and host alone."""
    rng = random.Random(2)
    rows = [(i, sample(rng, lang, 12), lang if i % 2 else None, f"{i % 5}.{lang}") for i, lang in enumerate(random.Random(3).choices(list(LETTERS), k=200))]
    truth = dict(zip(range(200), random.Random(3).choices(list(LETTERS), k=200)))
    got = {r.doc_id: r.language for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, host string"), declared=F.col("lang"), host=F.col("host")).collect()}
    hidden = [i for i in range(200) if i % 2 == 0]
    assert np.mean([got[i].lang == truth[i] for i in hidden]) >= 0.98


def test_language_of_pages(spark, tmp_path):
    rng = random.Random(4)
    page = lambda lang, mark: f"<html{mark}><head><style>zzz qqq</style></head><body><p>{sample(rng, lang, 30)}</p><!-- no --></body></html>"
    rows = [(i, f"https://h{i % 3}.{lang}/p?x=1", page(lang, f' lang="{lang}"' if i % 2 else "")) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    rows += [(100, None, None), (101, "nonsense", ""), (102, "https://h0.aa/", "<html lang='aa'><body>12 34</body></html>"), rows[1]]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.language_of_pages(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r for r in out}
    assert all(got[i].lang == ["aa", "bb", "cc"][i % 3] and got[i].accepted for i in range(60))
    assert all(got[i].lang == "und" and not got[i].accepted for i in (100, 101, 102))


def test_compiled_score_is_the_weighted_sum_of_rules(spark):
    rng = np.random.default_rng(5)
    x = rng.random((300, len(rules.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 7] < 0.6) | (x[:, 4] > 0.8)).astype(float)
    model = rules.Ensemble.fit(x, y)
    assert len(model.rules) > 3 and all(1 <= len(r) <= rules.DEPTH for r in model.rules)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, stats array<double>")
    got = np.array([r.p for r in df.select("i", model.score(F.col("stats")).alias("p")).orderBy("i").collect()])
    margin = model.intercept + sum(w * rules.holds(r, x) for r, w in zip(model.rules, model.weights))
    assert np.allclose(got, 1 / (1 + np.exp(-margin)), atol=1e-9) and np.mean((got >= 0.5) == y) > 0.95


def test_statistics_against_plain_counts():
    text = "Ab cd cd 12\nzz! zz! | x."
    s = dict(zip(rules.STATISTICS, rules.statistics(text.encode())))
    words = text.split()
    assert s["bytes"] == len(text) and s["words"] == len(words) and s["lines"] == 2 and s["longest_word"] == 3
    assert math.isclose(s["upper"], 1 / len(text)) and math.isclose(s["digits"], 2 / len(text)) and math.isclose(s["top_word"], 2 / len(words)) and math.isclose(s["distinct_words"], len(set(words)) / len(words))
