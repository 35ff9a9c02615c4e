import re

import numpy as np
from pyspark.sql import functions as F

from wardflow.llm import quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(repeated)


def check(rows, texts):
    for r in rows:
        n, chars, symbols, dup, repeated = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated), r
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert not (r.kept and r.base_failed)


def test_counts_against_plain_python(edge_docs, small_docs):
    for docs in (edge_docs, small_docs):
        rows = quality.verdicts(docs).collect()
        assert len(rows) == docs.count()
        check(rows, {r.doc_id: r.text for r in docs.collect()})


def test_empty_table(no_docs):
    assert quality.verdicts(no_docs).count() == 0
    assert quality.accepted(no_docs).count() == 0


def test_planted_outliers_are_rejected_and_the_rest_kept(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["w" + "".join(rng.choice(list("abcdefghij"), 5)) for _ in range(500)]
    good = [" ".join(rng.choice(vocabulary, rng.integers(60, 900))) + "." for _ in range(300)]
    bad = [" ".join(w + "***" for w in rng.choice(vocabulary, 200)) for _ in range(6)]
    bad += [" ".join(w.upper() + "!!" for w in rng.choice(vocabulary, 200)) for _ in range(6)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality.accepted(docs).select("doc_id").collect()}
    assert kept == set(range(300))


def features(r):
    n, chars = max(r.n_words, 1), max(r.word_chars, 1)
    return [np.log(n / max(r.n_lines, 1)), np.log(chars / n), r.n_upper / max(r.n_letters, 1), r.n_marks / chars]


def zeros(r):
    n = max(r.n_words, 1)
    return [np.log1p(100 * r.n_symbols / n), r.n_dup_lines / max(r.n_lines, 1), r.n_repeat_words / n]


def quantile(values, share):
    return np.quantile(values, share, axis=0, method="inverted_cdf")


def estimate(x):
    """Mean, inverse covariance with the least deviations, log determinant and the variance lifted."""
    unit = np.outer(quality.RESOLUTION, quality.RESOLUTION)
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True) / unit)
    precision = (vector / np.maximum(value, 1)) @ vector.T / unit
    return x.mean(0), precision, np.log(np.maximum(value, 1)).sum(), (1 - np.clip(value, 0, 1)).sum()


def far(x, centre, precision):
    return np.einsum("ij,jk,ik->i", x - centre, precision, x - centre)


def plain_mcd(x):
    """The estimate with the least determinant, from three starts."""
    centre = quantile(x, 0.5)
    scale = np.maximum(1.4826 * quantile(abs(x - centre), 0.5), quality.RESOLUTION)
    gap = (x - centre) / scale
    norm = np.maximum(np.linalg.norm(gap, axis=1, keepdims=True), 1e-300)
    starts = [(centre, np.diag(1 / scale**2), np.inf, 0.0)]
    for bent in (np.tanh(gap), 2 * gap / norm):
        found = estimate(centre + scale * bent)
        starts.append((found[0], found[1], np.inf, 0.0))
    best = []
    for now in starts:
        while True:
            d2 = far(x, now[0], now[1])
            after = estimate(x[d2 <= quantile(d2, quality.SUPPORT)])
            fell, now = after[2] < now[2] - quality.LEAST_FALL, min(after, now, key=lambda e: e[2])
            if not fell:
                break
        best.append(now)
    return min(best, key=lambda e: round(e[2] / (10 * quality.LEAST_FALL)))


def test_verdicts_match_numpy(small_docs):
    """Distances and verdicts of the registered path against numpy, all documents as one group."""
    one = small_docs.withColumn("lang", F.lit("l")).withColumn("source", F.lit("s"))
    picked = quality.statistics(one.select("doc_id", F.col("lang").alias("_lang"), F.col("source").alias("_source"), "text"), "doc_id", "_lang", "_source")
    every = quality.judge(picked).collect()
    rows = [r for r in every if not r.base_failed]
    assert {(r.doc_id, r.kept) for r in quality.verdicts(one).collect()} == {(r.doc_id, r.kept) for r in every}
    x = np.array([features(r) for r in rows])
    n = np.array([r.n_words for r in rows])[:, None]
    x = (x - quantile(x, 0.5)) * n / (n + quality.SHRINK_WORDS)
    centre, precision, _, lifted = plain_mcd(x)
    d2 = far(x, centre, precision)
    factor = max((quantile(d2, 0.5) + lifted) / quality.CHI_MEDIAN, (quantile(d2, quality.SUPPORT) + lifted) / quality.CHI_SUPPORT)
    d2 = d2 / factor + ((np.array([zeros(r) for r in rows]) / quality.ZERO_UNITS) ** 2).sum(axis=1)
    assert np.allclose(d2, [r.distance for r in rows], rtol=0.02, atol=0.02)
    clear = abs(d2 / quality.CUT - 1) > 0.05
    assert [r.kept for r, c in zip(rows, clear) if c] == (d2 <= quality.CUT)[clear].tolist()


def test_covariance_of_real_groups_comes_from_the_data(spark):
    """In most groups of the larger table every direction deviates by more than the resolution."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stats = quality.statistics(docs, "doc_id", "lang").filter(~quality.base_failed())
    raw = stats.select("lang", "n_words", *[f.cast("double").alias(c) for f, c in zip(quality._features(), quality.FEATURES)]).toPandas()
    free = []
    for _, group in raw.groupby("lang"):
        x = group[quality.FEATURES].to_numpy()
        if len(x) >= quality.LEAST_GROUP:
            n = group["n_words"].to_numpy()[:, None]
            x = (x - quantile(x, 0.5)) * n / (n + quality.SHRINK_WORDS)
            free.append(plain_mcd(x)[3] == 0)
    assert len(free) > 2 and np.mean(free) > 0.5


def test_precision_follows_the_spread_of_a_group(spark):
    """Two groups that differ in how much the length of words varies have different precisions, each that of its data."""
    rng = np.random.default_rng(8)
    rows = []
    for source, spread in (("narrow", 0.03), ("wide", 0.2)):
        for _ in range(400):
            rows.append((source, *rng.normal([5.5, 1.6, 0, 0.02], [1.2, spread, 0, 0.01]).tolist()))
    fitted = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{x} double" for x in quality.FEATURES))
    found = {r.grp: np.array(r.precision).reshape(4, 4) for r in quality._concentrated(fitted).collect()}
    for source, spread in (("narrow", 0.03), ("wide", 0.2)):
        # the covariance of the nearest three quarters is less than that of all
        assert 1 < found[source][1, 1] * spread**2 < 3.5
        assert np.isclose(found[source][2, 2], 1 / quality.RESOLUTION[2] ** 2)


def test_symbols_on_a_third_of_the_words_are_rejected(spark):
    """The cut-off is the chi-square quantile: a third of a symbol a word lies far beyond it where others have none."""
    rng = np.random.default_rng(4)
    vocabulary = ["w" + "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(900)]
    good = [" ".join(rng.choice(vocabulary, rng.integers(60, 900))) + "." for _ in range(300)]
    bad = [" | ".join(" ".join(rng.choice(vocabulary, 2)) for _ in range(120)) for _ in range(5)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(good + bad)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality.verdicts(docs).filter("kept").select("doc_id").collect()}
    assert not kept & set(range(300, 305)) and len(kept) >= 285
