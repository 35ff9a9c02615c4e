"""Divergence of sources by the words they use, from exact integer word shares.

Terms are runs of letters and of signs outside ASCII.  Inside a task the terms of a few
megabytes of text are packed by length: up to 8 bytes into one 64-bit word, up to 16
into two, in the order of their bytes.  Packed terms are radix-sorted in numpy, longer
ones are sorted as bytes in buckets of similar length, and runs of equal terms are
counted.  So one row for each group and term leaves the task, not one for each word.

A language keeps the terms that enough of its documents use.  Every source of the
language, and the language itself, gives each kept term a share in billionths, all in
whole numbers.  Sources are compared in pairs over all kept terms, in buckets of terms
that tasks share; a source is compared with its language term by term.

Defined results: null text, language and source count as ''; every row is a document, so
repeated rows count each; a group without terms takes part with counts of zero; where a
language keeps no term, pairs have the value 0; values that are equal are ranked by item;
columns besides text, language and source are not read; an empty table gives an empty
table.  All sources of one language meet in a task, as every pair of them is a result row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.llm.common import parts_for, stored
from wardflow.llm.octets import owners, slices

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
SLICE_BYTES = 12 << 20
#: Rows of one bucket of terms, and cells of a table of shares that numpy works on at once.
BUCKET_ROWS = 150_000
CELLS = 1 << 20
#: Into so many parts the candidates for the top terms of a group are dealt at first.
SPREAD = 16

# Byte classes: plain letters and all bytes outside ASCII belong to a term.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def packed_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, count: int) -> list[np.ndarray]:
    """Terms of at most ``8 * count`` bytes as big-endian 64-bit words, filled up with zeros."""
    eights = np.lib.stride_tricks.sliding_window_view(data, 8)
    out = []
    for i in range(count):
        word = np.ascontiguousarray(eights[start + 8 * i]).view(">u8").ravel().astype(np.uint64)
        unused = (8 * (8 - np.clip(size - 8 * i, 0, 8))).astype(np.uint64)
        whole = unused < 64
        unused[~whole] = 0
        out.append(np.where(whole, (word >> unused) << unused, np.uint64(0)))
    return out


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order of packed terms, 16 bits at a time from the last; equal digits are skipped."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def spelled(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of terms one after another, and where each begins (one more than terms)."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def byte_order(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of long terms of at most ``width`` bytes, and which differ from the one before."""
    rows = np.zeros((len(start), width), dtype=np.uint8)
    letters, offsets = spelled(data, start, size)
    rows.ravel()[np.repeat(np.arange(len(start)) * width - offsets[:-1], size) + np.arange(offsets[-1])] = letters
    keys = rows.view(f"S{width}").ravel()
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    return order, fresh


def term_buckets(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length bucket: the places of its terms in order of their bytes, and which begin a run."""
    for least, most in ((1, 8), (9, 16)):
        at = np.flatnonzero((size >= least) & (size <= most))
        if len(at):
            words = packed_words(data, start[at], size[at], most // 8)
            order = radix_order(words)
            fresh = np.zeros(len(at), dtype=bool)
            fresh[0] = True
            for word in words:
                fresh[1:] |= word[order[1:]] != word[order[:-1]]
            yield at[order], fresh
    at = np.flatnonzero(size > 16)
    level = np.ceil(np.log2(size[at])).astype(np.int64)
    for power in np.unique(level):
        some = at[level == power]
        order, fresh = byte_order(data, start[some], size[some], 1 << int(power))
        yield some[order], fresh


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``(lang, source, text)`` the rows ``(lang, source, term, n, docs)``, some of a group and term more than once."""
    for batch in batches:
        lang, source = (pc.dictionary_encode(batch.column(i)) for i in (0, 1))
        width = max(1, len(source.dictionary))
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + source.indices.to_numpy(zero_copy_only=False)
        # documents of a group lie together, and stay so through the stable sort of the terms
        order = np.argsort(group, kind="stable")
        group = group[order]
        for low, high, t in slices(batch.column(2).take(pa.array(order)), SLICE_BYTES):
            start, end, per_text = t.runs(_INSIDE[t.data])
            if not len(start):
                continue
            size, owner = end - start, owners(per_text)
            data = np.concatenate([_LOWER[t.data], np.zeros(16, np.uint8)])
            of = group[low:high][owner]
            for at, fresh in term_buckets(data, start, size):
                new_group, new_doc = fresh.copy(), fresh.copy()
                new_group[1:] |= of[at[1:]] != of[at[:-1]]
                new_doc[1:] |= owner[at[1:]] != owner[at[:-1]]
                first = np.flatnonzero(new_group)
                letters, offsets = spelled(data, start[at[first]], size[at[first]])
                terms = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters))
                found = of[at[first]]
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(found // width)),
                        source.dictionary.take(pa.array(found % width)),
                        terms.cast(pa.string()),
                        pa.array(np.diff(np.append(first, len(at)))),
                        pa.array(np.add.reduceat(new_doc, first, dtype=np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """Share of a term in billionths, from its count, the sum of counts and the number of kept terms."""
    count, total, kept = (F.expr(x) if isinstance(x, str) else x for x in (count, total, kept))
    top = (count + 2).cast("decimal(20,0)") * F.lit(UNIT)
    return F.call_function("div", top, (total + 2 * kept).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """What a term adds to the divergence of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of distances between all pairs of sources over the terms of a bucket.

    ``left`` has the terms with their shares where a source has them, ``right`` all
    sources of the language with the share of a term that they do not have.
    """
    right = right.sort_by("source")
    sources, absent = right.column("source").combine_chunks(), right.column("absent").to_numpy()
    total = np.zeros((len(sources), len(sources)), dtype=np.int64)
    term = pc.rank(left.column("term"), tiebreaker="dense").to_numpy().astype(np.int64) - 1 if left.num_rows else np.zeros(0, np.int64)
    place = pc.index_in(left.column("source"), sources).to_numpy()
    order = np.argsort(term, kind="stable")
    term, place, value = term[order], place[order], left.column("p").to_numpy()[order]
    step = max(1, CELLS // max(1, len(sources)))
    for low in range(0, int(term[-1]) + 1 if len(term) else 0, step):
        a, b = np.searchsorted(term, [low, low + step])
        shares = np.repeat(absent[:, None], int(term[b - 1]) + 1 - low, axis=1)
        shares[place[a:b], term[a:b] - low] = value[a:b]
        for i in range(len(sources) - 1):
            gap = shares[i + 1 :] - shares[i]
            total[i, i + 1 :] += ((gap * gap) // (shares[i + 1 :] + shares[i])).sum(axis=1)
    total += total.T
    one, other = np.nonzero(~np.eye(len(sources), dtype=bool))
    lang = right.column("lang").combine_chunks().take(pa.array(np.zeros(len(one), np.int64)))
    return pa.table(
        {"lang": lang, "source": sources.take(pa.array(one)), "item": sources.take(pa.array(other)), "value": pa.array(total[one, other])}
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """How often each term occurs in each language and source, and in how many documents."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = plain.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame) -> DataFrame:
    """Divergence between the sources of each language, and the terms that set a source apart.

    Rows ``(lang, source, part, item, value, rank)``: part ``pair`` compares a source
    with every other one of its language, part ``term`` has its ``TOP_TERMS`` terms that
    it uses more than the language as a whole.
    """
    counts = stored(term_counts(docs), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"))
    kept = kept.where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs")
    held = stored(counts.join(kept, ["lang", "term"]).select("lang", "term", "source", "n", "all_n"), "divergence-held")

    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = held.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("lang_total"))
    # an explicit column, as rows of a term are counted in several sources
    kept_of = held.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    sizes = (
        groups.join(sums, ["lang", "source"], "left")
        .join(of_lang.join(kept_of, "lang"), "lang", "left")
        .na.fill(0, ["total", "rows", "lang_total", "kept"])
    )
    sizes = stored(sizes, "divergence-groups")

    shared = held.join(sizes, ["lang", "source"]).withColumn("buckets", _buckets())
    shared = shared.select(
        "lang",
        "source",
        "term",
        F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"),
        share("n", "total", "kept").alias("p"),
        share("all_n", "lang_total", "kept").alias("q"),
    )
    return _pairs(shared, sizes).unionByName(_terms(shared))


def _buckets() -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(BUCKET_ROWS))).cast("long")


def _pairs(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    absent = F.when(F.col("kept") > 0, share(F.lit(0), "total", "kept")).otherwise(1)
    sources = sizes.select("lang", "source", absent.alias("absent"), F.explode(F.sequence(F.lit(0).cast("long"), _buckets() - 1)).alias("bucket"))
    left = shared.select("lang", "bucket", "term", "source", "p").groupBy("lang", "bucket")
    sums = left.cogroup(sources.groupBy("lang", "bucket")).applyInArrow(pair_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(pairs, "pair")


def _terms(shared: DataFrame) -> DataFrame:
    more = shared.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    # a source with most of the terms is dealt out before its best terms meet
    part = F.pmod(F.xxhash64("item"), F.lit(SPREAD))
    first = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = more.withColumn("part", part).withColumn("place", F.row_number().over(first)).where(F.col("place") <= TOP_TERMS)
    return _ranked(best, "term").where(F.col("rank") <= TOP_TERMS)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
