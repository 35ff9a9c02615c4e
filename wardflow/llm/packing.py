"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids; longer ones are cut into pieces of ``CAPACITY``.  Full
pieces are sequences of their own.  All other pieces are dealt to shards by a hash, and
every shard is a bin-packing problem.  Where best fit, largest first, does not reach the
least number of bins that the sizes allow, several islands work on it: an island keeps a
population of packings, a child inherits whole well-filled bins of one parent,
bins of the other that repeat a piece are dissolved, and displaced pieces are put by
best fit.  An island searches until ``PATIENCE`` children in a row have saved no bin.
Between epochs the best packing of an island moves to the next island of its shard
through a shuffle, while the island keeps its population; epochs go on until one saves
no bin in any shard.  Shards have a bounded number of pieces, so neither the size of the table, a
hot source nor many equal rows make a task larger.

Defined results: null text is empty and becomes the single end token; repeated rows
are packed each; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import parts_for, stored
from wardflow.llm.octets import Texts, slices

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 6000
ISLANDS = 4
POPULATION = 8
#: Children in a row without a bin saved that end the search of an island.
PATIENCE = 200
#: Words that are encoded at a time.
JOINED = 1000
#: Words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000

# Byte classes: 0 white space, 1 letter, 2 mark, 3 digit, 4 anything that must stay with its neighbours.
_CLASS = np.full(256, 4, dtype=np.uint8)
_CLASS[33:127] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 3
_CLASS[ord("'")] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Where two neighbouring classes may be cut without changing any id.
_CUT = np.zeros((5, 5), dtype=bool)
for _a, _b in ((1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2), (3, 3)):
    _CUT[_a, _b] = True


class Encoder:
    """Token ids of whole texts.

    The vocabulary splits texts at white space, and between plain letters, marks and
    digits, before any merge.  So every distinct part is encoded once by the
    tokenizer, and a text is the concatenation of its parts.  Texts that spell a special
    token are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and every thread keeps memory of its own
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another, and how many each has."""
        encoded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *encoded]), np.fromiter(map(len, encoded), np.int64, len(encoded))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain words, many in one text: the last id of a word ends it."""
        texts = ["\n".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        ids, _ = self._encoded(texts)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or len(words) and ends[-1] != len(ids):
            return self._encoded(words)
        return ids, np.diff(ends, prepend=0)

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        plain = np.array([p.isascii() and p.isalpha() for p in parts], dtype=bool)
        hashes = np.concatenate([hashes[plain], hashes[~plain]])
        words, others = self._words([p for p, is_word in zip(parts, plain) if is_word]), self._encoded([p for p, is_word in zip(parts, plain) if not is_word])
        ids, length = (np.concatenate(pair) for pair in zip(words, others))
        first = len(self.ids) + np.cumsum(length) - length
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known)
        self.known = known[order]
        self.first = np.concatenate([self.first, first])[order]
        self.length = np.concatenate([self.length, length])[order]
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice one after another, and how many each text has."""
        data = _LOWER[t.data]
        kind = _CLASS[data]
        inside = kind > 0
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = _CUT[kind[:-1], kind[1:]]
        start, end, count = self._parts(t, inside, cut)
        texts = Texts(data, t.offsets)
        hashes = texts.span_hash(texts.prefix_hash(), start, end)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        missing = np.ones(len(distinct), dtype=bool)
        found = at < len(self.known)
        missing[found] = self.known[at[found]] != distinct[found]
        if missing.any():
            raw = data.tobytes()
            spans = where[missing]
            self._learn(distinct[missing], [raw[a:b].decode() for a, b in zip(start[spans].tolist(), end[spans].tolist())])
            at = np.searchsorted(self.known, distinct)
        at = at[back]
        length = self.length[at]
        total = int(length.sum())
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(self.first[at] - (ends - length), length) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        return self._with_specials(t, ids, np.diff(bounds))

    @staticmethod
    def _parts(t: Texts, inside: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(inside)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = t.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
        first |= cut
        last[:-1] |= cut[1:]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, np.diff(np.searchsorted(start, t.offsets))

    def _with_specials(self, t: Texts, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = t.data.tobytes()
        if not any(s in raw for s in self.special):
            return ids, count
        pieces = np.split(ids, np.cumsum(count)[:-1])
        for i in range(t.count):
            text = raw[t.offsets[i] : t.offsets[i + 1]]
            if any(s in text for s in self.special):
                pieces[i] = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(pieces), np.array([len(p) for p in pieces])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        encode = encoder(path).encode
        for batch in batches:
            for low, high, texts in slices(batch.column(1)):
                ids, count = encode(texts)
                rows = {name: [] for name in _PIECE.names}
                at = 0
                for doc, n in zip(batch.column(0)[low:high].to_pylist(), count.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(END_ID)).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, n + 1, CAPACITY)):
                        part = own[start : start + CAPACITY]
                        for name, value in zip(_PIECE.names, (doc, k, start, len(part), zlib.crc32(part.tobytes()))):
                            rows[name].append(value)
                yield pa.RecordBatch.from_pydict(rows, schema=_PIECE)

    picked = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, items: list[int], bins: list[list[int]], room: list[int]) -> None:
    """Put ``items`` into the fullest bin with room, largest first; opens bins as needed."""
    free = sorted((r, i) for i, r in enumerate(room) if r)
    for item in sorted(items, key=lambda i: -sizes[i]):
        size = int(sizes[item])
        k = bisect_left(free, (size, -1))
        if k < len(free):
            left, b = free.pop(k)
            bins[b].append(item)
            room[b] = left - size
        else:
            b = len(bins)
            bins.append([item])
            room.append(CAPACITY - size)
        if room[b]:
            insort(free, (room[b], b))


def merit(room: list[int]) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: mean of squared fill."""
    return -len(room), sum((1 - r / CAPACITY) ** 2 for r in room)


def crossover(sizes: np.ndarray, one: tuple, other: tuple, rng: np.random.Generator) -> tuple:
    """Whole well-filled bins of ``other`` go into ``one``; displaced pieces are put by best fit."""
    bins, room = one
    given, spare = other
    full = [i for i in np.argsort(np.array(spare) + rng.random(len(spare)) * CAPACITY * 0.02)[: max(1, len(given) // 2)]]
    chosen = [given[i] for i in full if rng.random() < 0.5] or [given[full[0]]]
    injected = {x for b in chosen for x in b}
    out_bins, out_room, displaced = [list(b) for b in chosen], [CAPACITY - int(sizes[b].sum()) for b in chosen], []
    for b, r in zip(bins, room):
        if injected.isdisjoint(b):
            out_bins.append(list(b))
            out_room.append(r)
        else:
            displaced += [x for x in b if x not in injected]
    best_fit(sizes, displaced, out_bins, out_room)
    return out_bins, out_room


def mutate(sizes: np.ndarray, one: tuple, rng: np.random.Generator) -> tuple:
    """Dissolve the emptiest bins and a few others, and put their pieces anew."""
    bins, room = one
    order = np.argsort(-np.array(room))
    gone = set(order[:2].tolist()) | set(rng.integers(0, len(bins), 4).tolist())
    out_bins = [list(b) for i, b in enumerate(bins) if i not in gone]
    out_room = [r for i, r in enumerate(room) if i not in gone]
    best_fit(sizes, [x for i in gone for x in bins[i]], out_bins, out_room)
    return out_bins, out_room


def least_bins(sizes: np.ndarray) -> int:
    """A bound: by the sum of sizes, and by pieces of more than half a bin, of which no two share one."""
    return max(-(-int(sizes.sum()) // CAPACITY), int((sizes * 2 > CAPACITY).sum()))


def _labelled(packing: tuple, count: int) -> np.ndarray:
    label = np.zeros(count, np.int32)
    for k, b in enumerate(packing[0]):
        label[b] = k
    return label


def decreasing(sizes: np.ndarray) -> np.ndarray:
    """Bin of each piece by best fit, largest first."""
    first: tuple = ([], [])
    best_fit(sizes, list(range(len(sizes))), *first)
    return _labelled(first, len(sizes))


def population(sizes: np.ndarray, seeds: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """Packings (bin of each piece), best first, after a search from ``seeds`` that ends when it saves no bin any more."""
    rng = np.random.default_rng(seed)

    def packed(label: np.ndarray | None) -> tuple:
        bins, room = [], []
        if label is None:  # a random third first, so that members differ
            order = rng.permutation(len(sizes))
            head = order[: len(order) // 3].tolist()
            best_fit(sizes, head, bins, room)
            best_fit(sizes, order[len(head) :].tolist(), bins, room)
        else:
            order = np.argsort(label, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                bins.append(part.tolist())
                room.append(CAPACITY - int(sizes[part].sum()))
        return bins, room

    def ranked(people: list[tuple]) -> list[tuple]:
        return sorted(people, key=lambda p: merit(p[1]), reverse=True)[:POPULATION]

    people = [packed(s) for s in seeds]
    while len(people) < POPULATION:
        people.append(packed(None))
    people, idle = ranked(people), 0
    least = least_bins(sizes)
    while idle < PATIENCE and len(people[0][0]) > least:
        a, b = sorted(rng.choice(len(people), 2, replace=False))
        before = len(people[0][0])
        people = ranked(people + [mutate(sizes, crossover(sizes, people[a], people[b], rng), rng)])
        idle = 0 if len(people[0][0]) < before else idle + 1
    return [_labelled(p, len(sizes)) for p in people]


def evolve(sizes: np.ndarray, seeds: list[np.ndarray], seed: int) -> np.ndarray:
    """The best packing (bin of each piece), of ``seeds``, best fit and their descendants."""
    return population(sizes, [decreasing(sizes), *seeds], seed)[0]


_ISLAND = "shard long, island int, sizes binary, labels array<binary>, bins int"


def _epoch(number: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                sizes = np.frombuffer(r.sizes, np.int64)
                held = [*r.labels, *([] if r.guest is None else [r.guest])]
                seeds = [np.frombuffer(x, np.int32) for x in held]
                labels = population(sizes, seeds, (int(r.shard) * 31 + int(r.island)) * 31 + number)
                rows.append((r.shard, r.island, r.sizes, [x.tobytes() for x in labels], int(labels[0].max(initial=-1)) + 1))
            yield pd.DataFrame(rows, columns=["shard", "island", "sizes", "labels", "bins"])

    return run


def _searched(solved: DataFrame) -> DataFrame:
    """``shard, label``: the packings of all shards, searched for where best fit leaves more bins than the least."""
    columns = ["shard", "label", "bins"]
    best = solved.select(*columns)
    state = solved.filter("bins > least").withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    state = state.select("shard", "island", "sizes", F.array("label").alias("labels"), F.lit(None).cast("binary").alias("guest"))
    used, number = solved.filter("bins > least").agg(F.count("*").alias("n"), F.sum("bins").alias("bins")).first(), 0
    shards, bins = used["n"], used["bins"]
    while shards:
        # islands are few and large: spread them by their own key
        spread = state.repartition(max(2, shards * ISLANDS), "shard", "island")
        after = stored(spread.mapInPandas(_epoch(number), _ISLAND), "pack-islands")
        found = after.groupBy("shard").agg(F.min_by(F.struct(F.col("labels")[0].alias("label"), "bins"), F.struct("bins", "island")).alias("b"))
        now = found.agg(F.sum("b.bins")).first()[0]
        best_found = found.select("shard", "b.label", "b.bins")
        if now == bins:
            best = best.join(best_found.select("shard"), "shard", "left_anti").unionByName(best_found)
            break
        bins, number = now, number + 1
        guests = after.select(F.col("shard").alias("_s"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("_i"), F.col("labels")[0].alias("guest"))
        state = after.join(guests, (F.col("shard") == F.col("_s")) & (F.col("island") == F.col("_i"))).select("shard", "island", "sizes", "labels", "guest")
    return best.select("shard", "label")


def pack(found: DataFrame) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of ``pieces``; columns of ``found`` stay."""
    columns = found.columns
    # the row number is fixed by storing it; it spreads rows that are equal in all else
    rows = stored(found.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    key = F.xxhash64("doc_id", "piece", "ids_crc32", "length", "_row")
    small = rows.filter(F.col("length") < CAPACITY)
    shards = parts_for(small.count(), SHARD_PIECES)
    dealt = small.withColumn("_shard", F.pmod(key, F.lit(shards)))

    def problem(table: pa.Table) -> pa.Table:
        sizes = np.sort(table.column("length").to_numpy())[::-1].astype(np.int64)
        label = decreasing(sizes)
        bins = int(label.max(initial=-1)) + 1
        cells = {"sizes": pa.array([sizes.tobytes()], pa.binary()), "label": pa.array([label.tobytes()], pa.binary())}
        return pa.table({"shard": table.column("_shard").slice(0, 1), **cells, "bins": pa.array([bins], pa.int32()), "least": pa.array([least_bins(sizes)], pa.int32())})

    solved = dealt.select("_shard", "length").groupBy("_shard").applyInArrow(problem, "shard long, sizes binary, label binary, bins int, least int")
    best = _searched(stored(solved, "pack-problems"))

    def place(_: tuple, table: pa.Table, solution: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({**{c: pa.array([], table.schema.field(c).type) for c in columns}, "sequence_id": pa.array([], pa.int64()), "offset": pa.array([], pa.int64())})
        size = table.column("length").to_numpy().astype(np.int64)
        order = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy(), -size))
        label = np.frombuffer(solution.column("label")[0].as_py(), np.int32)
        grouped = np.argsort(label, kind="stable")
        length = size[order][grouped]
        bins = label[grouped]
        before = np.cumsum(length) - length
        first = np.searchsorted(bins, bins, "left")
        out = table.take(pa.array(order[grouped]))
        shard = out.column("_shard").to_numpy()
        return out.select(columns).append_column("sequence_id", pa.array(shard + bins.astype(np.int64) * shards)).append_column("offset", pa.array(before - before[first]))

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in found.schema.fields)}, sequence_id long, offset long"
    packed = dealt.groupBy("_shard").cogroup(best.groupBy("shard")).applyInArrow(place, schema)
    # A full piece is a sequence of its own, numbered below zero.
    full = rows.filter(F.col("length") >= CAPACITY).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
