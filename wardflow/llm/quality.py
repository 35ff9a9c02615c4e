"""Quality rules with a robust multivariate outlier test.

Every document gets counts of its whole text; documents that fail the base rules are
rejected.  The others are described by a vector of transformed statistics in two blocks.

Four statistics vary in every text (words a line, word length, capitals, marks).  What a short text
says about them is uncertain, so their deviation from the median of the group shrinks by
``n / (n + SHRINK_WORDS)``.  For every language and source the minimum-covariance-determinant
estimate of their centre and covariance is found by concentration steps: a step keeps
the share ``SUPPORT`` of documents that lie nearest in Mahalanobis distance, and takes
centre and covariance from those.  Steps run from three starts (median deviations,
covariance of squashed deviations, spatial signs) until the determinant stops falling,
and the start with the least determinant is taken.  The covariance is that of the data; only a
direction in which documents deviate by less than ``RESOLUTION`` has that deviation.  Squared
distances are divided by a consistency factor for each group, which brings their median and
their quantile ``SUPPORT`` to those of chi-square or below.

Three statistics are zero in most texts (symbols, repeated lines, repeated words), so the nearest
documents have no variance in them.  They deviate from zero in the stated units ``ZERO_UNITS``, and
their squares are added to the distance.  Documents whose distance exceeds the chi-square quantile
``CUT`` are rejected.  No kind of document is exempt.

All steps are aggregates over all documents with partial sums before the shuffle, and
what a group has found is stored before rows meet it, so its size is known and a small table is
sent to the rows: a hot source is not one task.

Defined results: null text counts as empty; documents without words fail the base
rules; null languages and sources are groups of their own; groups with fewer than
``LEAST_GROUP`` fitted documents are pooled by language, and what is still smaller is
pooled once more; a pool that stays smaller has no outlier test.  Repeated rows are
judged each on its own, with equal results.  Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import aside, passes, sieve, stored
from wardflow.llm.octets import U, Texts, mix, owners, slices, windows

WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
SUPPORT = 0.75
#: Most concentration steps; the determinant stops falling far earlier.
STEPS = 100
#: Least fall of the logarithm of the determinant for which steps go on.
LEAST_FALL = 1e-4
LEAST_GROUP = 50
#: Statistics that vary in every text, and those that are zero in most.
FEATURES = ["x0", "x1", "x2", "x3"]
ZEROS = ["z0", "z1", "z2"]
#: Words at which a deviation from the median of the group counts half.
SHRINK_WORDS = 100
#: Least deviation of a direction, for groups of nearly equal documents: words a line by a tenth, one letter in 200,
#: one capital and one mark in 1,000 letters.
RESOLUTION = [0.1, 0.005, 0.001, 0.001]
#: Deviations from zero: symbols by the logarithm of one more than those in 100 words, a line in 16, a repeated word in 20.
ZERO_UNITS = [0.5, 0.06, 0.05]
#: Quantiles 0.5, SUPPORT and 0.999 of a chi-square variable with as many degrees of freedom as there are features.
CHI_MEDIAN, CHI_SUPPORT, CUT = 3.357, 5.385, 18.467

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_letters", "n_marks"]
_STAT_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS + EXTRA])

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_MARK = np.isin(np.arange(256), np.frombuffer(b".,!?;:=_~^+@{}[]()\"'/\\", np.uint8))


def _distinct_per_text(owner: np.ndarray, value: np.ndarray, count: int) -> np.ndarray:
    key = np.unique(np.stack([owner.astype(U), value]), axis=1)[0] if len(value) < 64 else None
    if key is None:
        order = np.lexsort((value, owner))
        o, v = owner[order], value[order]
        new = np.ones(len(o), dtype=bool)
        new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
        key = o[new]
    return np.bincount(key.astype(np.int64), minlength=count)


def text_counts(t: Texts) -> dict[str, np.ndarray]:
    """The counts of each text of a slice."""
    data = t.data
    start, end, n_words = t.words()
    separator = (data == 32) | ((data >= 9) & (data <= 13))
    out = {"n_words": n_words}
    out["word_chars"] = t.sums(~separator & ((data & 0xC0) != 0x80))
    out["n_symbols"] = t.sums(_SYMBOL[data])
    out["n_upper"], out["n_letters"], out["n_marks"] = t.sums(_UPPER[data]), t.sums(_LETTER[data]), t.sums(_MARK[data])
    prefix = t.prefix_hash()
    line_start, line_end, line_owner = t.lines()
    filled = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    lines = np.bincount(line_owner[filled], minlength=t.count)
    line_hash = t.span_hash(prefix, line_start[filled], line_end[filled])
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - _distinct_per_text(line_owner[filled], line_hash, t.count)
    owner = owners(n_words)
    gram, at = windows(t.span_hash(prefix, start, end), n_words, WINDOW)
    key = mix(gram + owner[at].astype(U) * U(0xA24BAED4963EE407))
    order = np.argsort(key)
    same = np.zeros(len(key), dtype=bool)
    ordered = key[order]
    equal = ordered[1:] == ordered[:-1]
    same[order[1:]] |= equal
    same[order[:-1]] |= equal
    cover = np.zeros(len(start) + WINDOW + 1, dtype=np.int64)
    np.add.at(cover, at[same], 1)
    np.add.at(cover, at[same] + WINDOW, -1)
    covered = np.cumsum(cover)[: len(start)] > 0
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=t.count)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        for low, high, texts in slices(batch.column(at)):
            values = text_counts(texts)
            kept = [batch.column(i).slice(low, high - low) for i in range(batch.num_columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(values[c], pa.int64()) for c in COUNTS + EXTRA], names + COUNTS + EXTRA)


def statistics(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Counts of every whole text, beside the columns ``keep``."""
    picked = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = T.StructType([f for f in picked.schema.fields if f.name != "_text"] + _STAT_SCHEMA.fields)
    return picked.mapInArrow(_counts, schema)


def base_failed() -> Column:
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (n < LEAST_WORDS) | (100 * repeated > REPEAT_PERCENT * n)


def _features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log(n / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log(chars / n),
        F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)),
        F.col("n_marks") / chars,
    ]


def _zeros() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log1p(100 * F.col("n_symbols") / n), F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / n]


def _shrunk() -> list[Column]:
    """The features, with deviations from ``medians`` of the group shrunk by the number of words."""
    share = F.col("n_words") / (F.col("n_words") + SHRINK_WORDS)
    return [((F.col(x) - F.col("medians")[i]) * share).alias(x) for i, x in enumerate(FEATURES)]


def _distance() -> Column:
    """Squared Mahalanobis distance from ``centre`` under ``precision`` (row-major)."""
    d = len(FEATURES)
    gap = [F.col(x) - F.col("centre")[i] for i, x in enumerate(FEATURES)]
    terms = [F.col("precision")[i * d + j] * gap[i] * gap[j] * (1 if i == j else 2) for i in range(d) for j in range(i, d)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _moments() -> list[Column]:
    d = len(FEATURES)
    return (
        [F.count("*").cast("double").alias("n")]
        + [F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)]
        + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i in range(d) for j in range(i, d)]
    )


_ESTIMATE = "grp string, start int, centre array<double>, precision array<double>, logdet double, lifted double"


def _invert(batches: Iterator["pd.DataFrame"]) -> Iterator["pd.DataFrame"]:  # noqa: F821
    """Centre, inverse covariance and log determinant of each group and start from its sums, and the variance lifted."""
    import pandas as pd

    d = len(FEATURES)
    for frame in batches:
        centres, precisions, logdets, lifted = [], [], [], []
        for row in frame.itertuples():
            mean = np.array([getattr(row, f"s{i}") for i in range(d)]) / row.n
            cov = np.zeros((d, d))
            for i in range(d):
                for j in range(i, d):
                    cov[i, j] = cov[j, i] = getattr(row, f"q{i}{j}") / row.n - mean[i] * mean[j]
            value, vector = np.linalg.eigh(cov / np.outer(RESOLUTION, RESOLUTION))
            inverse = (vector / np.maximum(value, 1.0)) @ vector.T / np.outer(RESOLUTION, RESOLUTION)
            centres.append(mean.tolist())
            precisions.append(inverse.ravel().tolist())
            logdets.append(float(np.log(np.maximum(value, 1.0)).sum()))
            lifted.append(float((1 - np.clip(value, 0.0, 1.0)).sum()))
        yield pd.DataFrame({"grp": frame["grp"], "start": frame["start"], "centre": centres, "precision": precisions, "logdet": logdets, "lifted": lifted})


def _estimates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp", "start").agg(*_moments()).mapInPandas(_invert, _ESTIMATE)


def _medians(fitted: DataFrame, name: str) -> DataFrame:
    return fitted.groupBy("grp").agg(F.array(*[F.percentile_approx(x, 0.5, 2000) for x in FEATURES]).alias(name))


def _starts(fitted: DataFrame) -> DataFrame:
    """First estimates of a group: squared median deviations, and covariances of squashed deviations and of spatial signs."""
    d = len(FEATURES)
    medians = stored(_medians(fitted, "centre"), "quality-start")
    gaps = fitted.join(medians, "grp")
    spread = gaps.groupBy("grp").agg(
        F.first("centre").alias("centre"),
        F.array(*[F.percentile_approx(F.abs(F.col(x) - F.col("centre")[i]), 0.5, 2000) for i, x in enumerate(FEATURES)]).alias("mad"),
    )
    scale = [F.greatest(1.4826 * F.col("mad")[i], F.lit(RESOLUTION[i])) for i in range(d)]
    spread = stored(spread.select("grp", "centre", F.array(*scale).alias("scale")), "quality-start")
    cells = [1 / (F.col("scale")[i] * F.col("scale")[i]) if i == j else F.lit(0.0) for i in range(d) for j in range(d)]
    plain = spread.select("grp", F.lit(0).alias("start"), "centre", F.array(*cells).alias("precision"), F.lit(float("inf")).alias("logdet"), F.lit(0.0).alias("lifted"))
    gap = [(F.col(x) - F.col("centre")[i]) / F.col("scale")[i] for i, x in enumerate(FEATURES)]
    norm = F.sqrt(sum((g * g for g in gap[1:]), gap[0] * gap[0]))
    bent = {1: [F.tanh(g) for g in gap], 2: [F.when(norm > 0, d**0.5 * g / norm).otherwise(0.0) for g in gap]}
    met = fitted.join(spread, "grp")
    moved = [
        met.select("grp", F.lit(k).alias("start"), *[(F.col("centre")[i] + F.col("scale")[i] * y).alias(x) for i, (x, y) in enumerate(zip(FEATURES, ys))])
        for k, ys in bent.items()
    ]
    others = _estimates(moved[0].unionByName(moved[1])).withColumn("logdet", F.lit(float("inf")))
    return plain.unionByName(others)


def _concentrated(fitted: DataFrame) -> DataFrame:
    """The estimate of each group with the least determinant, after concentration steps from every start."""
    active = stored(_starts(fitted), "quality-fit")
    settled = []
    for _ in range(STEPS):
        placed = fitted.join(active, "grp").select("grp", "start", *FEATURES, _distance().alias("d2"))
        # stored, so that its size is known when rows meet it and they need not be shuffled by group
        limits = stored(placed.groupBy("grp", "start").agg(F.percentile_approx("d2", SUPPORT, 2000).alias("limit")), "quality-limits")
        near = placed.join(limits, ["grp", "start"]).filter(F.col("d2") <= F.col("limit"))
        # lifted directions can make the determinant rise: then the estimate before is the better one
        fell = F.col("a.logdet") < F.col("b.logdet") - LEAST_FALL
        lower = F.when(F.col("a.logdet") <= F.col("b.logdet"), F.struct("a.*")).otherwise(F.struct("b.*"))
        both = active.alias("b").join(_estimates(near).alias("a"), ["grp", "start"])
        after = stored(both.select(lower.alias("e"), fell.alias("_fell")).select("e.*", "_fell"), "quality-fit")
        settled.append(after.filter(~F.col("_fell")).drop("_fell"))
        active = after.filter("_fell").drop("_fell")
        if active.isEmpty():
            break
    found = active
    for s in settled:
        found = found.unionByName(s)
    # equal determinants up to the last fall are one estimate: the first start has it
    rank = F.struct(F.round(F.col("logdet") / (10 * LEAST_FALL)), "start")
    return found.groupBy("grp").agg(F.min_by(F.struct("centre", "precision", "lifted"), rank).alias("best")).select("grp", "best.*")


def judge(stats: DataFrame) -> DataFrame:
    """Add ``base_failed``, ``distance`` and ``kept`` to counts that carry ``_lang`` and ``_source``.

    ``stats`` is stored first; every estimate is a table with one row per group.
    """
    fields = [x for x in stats.columns]
    rows = stats.withColumn("base_failed", base_failed())
    rows = stored(rows.select("*", *[f.cast("double").alias(x) for f, x in zip(_features() + _zeros(), FEATURES + ZEROS)]), "quality-stats")
    fine = F.concat(F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n")), F.lit("\x01"), F.coalesce(F.concat(F.lit("l"), F.col("_lang")), F.lit("n")))
    broad = F.concat(F.lit("\x02"), F.coalesce(F.concat(F.lit("l"), F.col("_lang")), F.lit("n")))
    sizes = rows.filter(~F.col("base_failed")).groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("grp", F.when(F.col("n") >= LEAST_GROUP, fine).otherwise(broad))
    pools = sizes.groupBy("grp").agg(F.sum("n").alias("pool"))
    groups = sizes.join(pools, "grp").select(
        "_lang", "_source", F.when(F.col("pool") >= LEAST_GROUP, F.col("grp")).otherwise(F.lit("\x03")).alias("grp")
    )
    groups = stored(groups, "quality-groups").withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    rows = rows.join(groups, rows["_lang"].eqNullSafe(groups["_l"]) & rows["_source"].eqNullSafe(groups["_s"]), "left").drop("_l", "_s")
    good = rows.filter(~F.col("base_failed"))
    medians = stored(_medians(good, "medians"), "quality-medians")
    fitted = good.join(medians, "grp").select("grp", *_shrunk())
    estimate = stored(_concentrated(fitted), "quality-fit")
    placed = fitted.join(estimate, "grp").select("grp", "lifted", _distance().alias("d2"))
    # a lifted direction counts as if documents deviated by the resolution
    parts = F.percentile_approx("d2", [0.5, SUPPORT], 2000)
    scale = placed.groupBy("grp").agg(F.count("*").alias("fit_size"), parts.alias("at"), F.first("lifted").alias("more"))
    factor = F.greatest((F.col("at")[0] + F.col("more")) / CHI_MEDIAN, (F.col("at")[1] + F.col("more")) / CHI_SUPPORT)
    final = stored(estimate.join(scale, "grp").join(medians, "grp").withColumn("factor", factor), "quality-fit")
    plain = [x for x in rows.columns if x not in FEATURES]
    met = rows.join(final, "grp", "left").select(*plain, *_shrunk(), "centre", "precision", "factor", "fit_size")
    beside = sum(((F.col(z) / u) * (F.col(z) / u) for z, u in zip(ZEROS, ZERO_UNITS)), F.lit(0.0))
    judged = met.withColumn("distance", F.when(F.col("fit_size") >= LEAST_GROUP, _distance() / F.col("factor") + beside))
    far = F.coalesce(F.col("distance") > CUT, F.lit(False))
    return judged.select(*fields, "base_failed", "distance", (~F.col("base_failed") & ~far).alias("kept"))


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: ``doc_id``, its counts, ``base_failed``, ``distance`` and ``kept``."""
    picked = docs.select(F.col(doc_id).alias("_doc"), F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_source"), F.col(text).cast("string").alias("text"))
    return judge(statistics(picked, "_doc", "_lang", "_source")).withColumnRenamed("_doc", "doc_id").drop("_lang", "_source")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    docs, back = aside(docs, "doc_id", "text", "lang", "source")
    fields = ["_key", "_lang", "_source"]
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")), "lang", "source"))
    picked = keyed.select("_key", F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"), "text")
    rejected = stored(judge(statistics(picked, *fields)).filter(~F.col("kept")).select("_key").distinct(), "quality-rejected")
    # only rows that the sieve lets through need be shuffled to the join
    asked = passes(sieve(rejected, "_key"), "_key")
    met = keyed.filter(asked).join(rejected, "_key", "left_anti")
    return back(met.unionByName(keyed.filter(~asked)))
