"""Near-duplicates of documents by BagMinHash signatures of their word shingles.

A document is a multiset of five-word shingles.  A shingle of weight w owns the weight
axis up to w; a hierarchy of Poisson processes, one on each dyadic range of that axis
with a rate as wide as the range, throws points that are the same in every document.
A point counts for a document if it lies under the shingle's weight there, and falls
to a random component; a component is the earliest point.  Two documents agree in a component
with probability equal to their weighted Jaccard similarity.  Only points before a
horizon, at which all components are filled, are ever made.

Components are banded, and candidates are verified by the exact overlap of
their multisets, at least ``SIMILAR``.  Equal multisets are one node.  A first round verifies
every node of a bucket against the bucket's first; what is then in one component needs no
more comparisons, so only pairs of nodes of different components are left.  Classes are the
connected components of verified pairs.

Defined results: shorter texts are one shingle of all their words; texts without words are
one class; null ids come first; repeated rows are in one class; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import aside, passes, sieve, stored
from wardflow.llm.octets import U, Texts, mix, owners, slices, windows

SHINGLE = 5
SIMILAR = 0.8
BANDS = 32
ROWS = 5
COMPONENTS = BANDS * ROWS
#: Share of equal components under which a pair is not verified: five standard errors below SIMILAR.
LEAST_EQUAL = SIMILAR - 5 * (SIMILAR * (1 - SIMILAR) / COMPONENTS) ** 0.5
_GOLD = U(0x9E3779B97F4A7C15)
_SILVER = U(0xC2B2AE3D27D4EB4F)


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text, hash and count, in order of text and hash."""
    start, end, count = t.words()
    hashes = t.span_hash(t.prefix_hash(), start, end)
    gram, at = windows(hashes, count, SHINGLE)
    owner = owners(count)[at]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])
        whole = np.array([_whole(hashes[first[i] : first[i] + count[i]]) for i in short], U)
        gram, owner = np.concatenate([gram, whole]), np.concatenate([owner, short])
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], gram[at], np.diff(np.append(at, len(gram)))


def _whole(hashes: np.ndarray) -> np.uint64:
    """Hash of all words of a short text."""
    total = np.full(1, len(hashes), U)
    for h in hashes:
        total = mix(total * _GOLD + h)
    return total[0]


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers above 0 and up to 1 from 64-bit values."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(owner: np.ndarray, gram: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    """BagMinHash components of ``count`` texts: times of the earliest points, texts by components."""
    found = np.full((count, COMPONENTS), np.inf)
    total = np.bincount(owner, weight, count)
    todo = np.flatnonzero(total > 0)
    reach = np.log(COMPONENTS) + 4
    while len(todo):
        horizon = np.zeros(count)
        horizon[todo] = COMPONENTS / total[todo] * reach
        mine = horizon[owner] > 0
        found[todo] = np.inf
        _throw(owner[mine], gram[mine], weight[mine], horizon, found)
        todo = todo[np.isinf(found[todo]).any(axis=1)]
        reach *= 2
    return found


def _throw(owner: np.ndarray, gram: np.ndarray, weight: np.ndarray, horizon: np.ndarray, found: np.ndarray) -> None:
    """All points before each text's horizon, level by level of the weight axis."""
    flat = found.reshape(-1)
    level, low, width = 0, 0, 1
    while len(owner):
        seed = mix(gram + np.full(1, level, U) * _SILVER)
        streams = np.arange(len(owner))
        time = np.zeros(len(owner))
        number, block = 0, 1
        while len(streams):
            draw = seed[streams][:, None] + np.arange(number + 1, number + block + 1, dtype=U) * _GOLD
            gaps = -np.log(_unit(mix(draw))) / width
            gaps[:, 0] += time[streams]
            times = np.cumsum(gaps, axis=1)
            early = times < horizon[owner[streams]][:, None]
            row, column = np.nonzero(early)
            stream = streams[row]
            bits = mix(draw[row, column] ^ _SILVER)
            place = low + ((bits & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) * width
            under = place < weight[stream]
            part = ((bits >> U(32)) * U(COMPONENTS)) >> U(32)
            np.minimum.at(flat, owner[stream[under]] * COMPONENTS + part[under].astype(np.int64), times[row, column][under])
            going = early[:, -1]
            time[streams] = times[:, -1]
            streams = streams[going]
            number += block
            block = min(2 * block, 64)
        low, width, level = low + width, max(1, low + width), level + 1
        tall = weight > low
        owner, gram, weight = owner[tall], gram[tall], weight[tall]


_SIGNED = T.StructType(
    [
        T.StructField("doc", T.LongType()),
        T.StructField("uid", T.LongType()),
        T.StructField("bag", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("bytes", T.BinaryType()),
    ]
)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, t in slices(batch.column(2)):
            owner, gram, weight = shingles(t)
            times = signatures(owner, gram, weight.astype(np.float64), t.count).view(U)
            bag = np.zeros(t.count, U)
            np.add.at(bag, owner, mix(gram + weight.astype(U) * _SILVER))
            size = np.bincount(owner, weight, t.count).astype(np.int64)
            spread = mix(times)
            bands = np.zeros((t.count, BANDS), U)
            for k in range(ROWS):
                bands = mix(bands * _GOLD + spread[:, k::ROWS])
            bands = mix(bands + np.arange(BANDS, dtype=U) * _SILVER)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(t.count + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel()))
            rows = (spread >> U(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(mix(bag).view(np.int64)), pa.array(size), lists, pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["doc", "uid", "bag", "size", "bands", "bytes"],
            )


def overlap(a: Texts, b: Texts) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each text of ``a`` with that of ``b``."""
    oa, ga, wa = shingles(a)
    ob, gb, wb = shingles(b)
    owner, gram = np.concatenate([oa, ob]), np.concatenate([ga, gb])
    weight = np.concatenate([wa, wb])
    order = np.lexsort((gram, owner))
    owner, gram, weight = owner[order], gram[order], weight[order]
    both = np.flatnonzero((owner[1:] == owner[:-1]) & (gram[1:] == gram[:-1]))
    shared = np.bincount(owner[both], np.minimum(weight[both], weight[both + 1]), a.count)
    total = np.bincount(oa, wa, a.count) + np.bincount(ob, wb, a.count)
    return np.where(total > 0, shared / np.maximum(total - shared, 1), 1.0)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # pairs are few bytes each: cut by the first text, then bound by rows
        for low, high, a in slices(batch.column(2)):
            for part_low in range(low, high, 256):
                n = min(256, high - part_low)
                one = next(slices(batch.column(2).slice(part_low, n), 1 << 62))[2]
                two = next(slices(batch.column(3).slice(part_low, n), 1 << 62))[2]
                keep = pa.array(overlap(one, two) >= SIMILAR)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(part_low, n).filter(keep) for i in range(2)], names=["a", "b"])


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes whose multisets overlap enough."""
    sides = nodes.select("bag", "size", "bytes")
    equal = F.aggregate(
        F.sequence(F.lit(1), F.lit(COMPONENTS)), F.lit(0), lambda n, i: n + F.when(F.substring("ba", i, F.lit(1)) == F.substring("bb", i, F.lit(1)), 1).otherwise(0)
    )
    met = pairs.distinct().join(sides.toDF("a", "sa", "ba"), "a").join(sides.toDF("b", "sb", "bb"), "b")
    near = met.filter((F.least("sa", "sb") >= SIMILAR * F.greatest("sa", "sb")) & (equal >= LEAST_EQUAL * COMPONENTS))
    near = stored(near.select("a", "b"), "near-pairs")
    asked = near.select(F.explode(F.array("a", "b")).alias("bag")).distinct()
    wanted = stored(nodes.join(asked, "bag", "left_semi").select("bag", F.col("first.uid").alias("uid")), "near-nodes")
    texts = docs.filter(passes(sieve(wanted, "uid"), "_uid")).select(F.col("_uid").alias("uid"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["uid"])
    texts = stored(wanted.join(texts, "uid").select("bag", "text"), "near-texts")
    rows = near.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return stored(rows.mapInArrow(_similar, "a long, b long"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the least node reachable over ``links`` (a, b), for every node that has a link.

    Every round moves both ends of a link to the least neighbour of each, and drops
    links that have become loops.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "cc-edges")
    roots = stored(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), "cc-roots")
    while not edges.isEmpty():
        least = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-least")
        # a node that is its own least keeps its place; others move, and the place they move to may move on
        onward = least.toDF("m", "mm")
        least = stored(least.join(onward, "m", "left").select("a", F.coalesce("mm", "m").alias("m")), "cc-least")
        roots = stored(roots.join(least.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc-roots")
        moved = edges.join(least, "a").select(F.col("m").alias("x"), "b").join(least.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = stored(moved.filter("a <> b").distinct(), "cc-edges")
    return roots


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, uid, class_id, class_size, kept`` for every row; ``docs`` has ``_uid``."""
    picked = docs.select(F.col("doc_id").cast("long"), F.col("_uid"), F.col("text").cast("string"))
    signed = stored(picked.mapInArrow(_signed, _SIGNED), "near-signed")
    nodes = stored(
        signed.groupBy("bag", "size").agg(F.min(F.struct("doc", "uid")).alias("first"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes")), "near-nodes"
    )
    buckets = nodes.filter("size > 0").select("bag", "first", F.explode("bands").alias("key"))
    window = Window.partitionBy("key").orderBy("first", "bag")
    stars = buckets.withColumn("lead", F.first("bag").over(window)).filter("bag <> lead").select(F.col("bag").alias("a"), F.col("lead").alias("b"))
    links = _verified(docs, nodes, stars)
    roots = components(links)
    placed = buckets.select("bag", "key").join(roots.toDF("bag", "root"), "bag", "left").select("bag", "key", F.coalesce("root", "bag").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key")
    open_rows = stored(placed.join(split, "key", "left_semi"), "near-open")
    one, two = open_rows.toDF("a", "key", "ra"), open_rows.toDF("b", "key", "rb")
    more = _verified(docs, nodes, one.join(two, "key").filter("ra < rb").select("a", "b"))
    if not more.isEmpty():
        roots = components(links.union(more))
    placed = signed.join(roots.toDF("bag", "root"), "bag", "left").select("doc", "uid", F.coalesce("root", "bag").alias("root"))
    groups = placed.groupBy("root").agg(F.min(F.struct("doc", "uid")).alias("first"), F.count("*").alias("class_size"))
    return placed.join(groups, "root").select(
        F.col("doc").alias("doc_id"), "uid", F.col("first.doc").alias("class_id"), "class_size", (F.struct("doc", "uid") == F.col("first")).alias("kept")
    )


def identified(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_uid", F.xxhash64("doc_id", "text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (least id of the class), ``class_size, kept`` (first of its class)."""
    return classes(identified(docs)).drop("uid")


def unique_documents(docs: DataFrame) -> DataFrame:
    """One document of each class, with all columns of ``docs``.

    Of rows equal in id and text the one with the least source and language stays.
    """
    docs, back = aside(docs, "doc_id", "text", "lang", "source")
    columns = docs.columns
    rows = identified(docs)
    dropped = stored(classes(rows).groupBy("uid").agg(F.max("kept").alias("_kept"), F.count("*").alias("_equal")).filter("not _kept or _equal > 1"), "near-dropped")
    asked = passes(sieve(dropped, "uid"), "_uid")
    met = rows.filter(asked).join(dropped.withColumnRenamed("uid", "_uid"), "_uid", "left").filter(F.coalesce("_kept", F.lit(True)))
    single = met.filter("_equal is null").select(*columns).unionByName(rows.filter(~asked).select(*columns))
    least = F.min_by(F.struct(*columns), F.struct(*[F.col(c) for c in ("source", "lang") if c in columns], F.lit(0)))
    of_equal = met.filter("_equal > 1").groupBy("_uid").agg(least.alias("_row")).select("_row.*")
    return back(single.unionByName(of_equal))
