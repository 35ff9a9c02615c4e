import os
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardflow.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def check_pieces(rows, docs, tokenizer):
    whole = defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
    for d in docs:
        ids = np.array(tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4")
        got = {(r.piece, r.start, r.length, r.ids_crc32) for r in whole[d.doc_id]}
        cuts = range(0, len(ids), packing.CAPACITY)
        assert got == {(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(cuts)}, d.doc_id


def check_sequences(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(bins)


def test_pieces_and_sequences(edge_docs, small_docs, tokenizer):
    for docs in (edge_docs, small_docs):
        rows = packing.pack(packing.pieces(docs)).collect()
        check_pieces(rows, docs.collect(), tokenizer)
        used = check_sequences(rows)
        least = -(-sum(r.length for r in rows) // packing.CAPACITY)
        assert least <= used <= least * 1.02 + 2


def test_repeated_rows_are_packed_each(edge_docs):
    rows = packing.pack(packing.pieces(edge_docs)).collect()
    assert sum(r.doc_id == 9 for r in rows) == 2 * len({r.piece for r in rows if r.doc_id == 9})


def test_empty_table(no_docs):
    assert packing.pack(packing.pieces(no_docs)).count() == 0


def test_more_shards_lose_nothing(small_docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 40)
    rows = packing.pack(packing.pieces(small_docs)).collect()
    check_sequences(rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in small_docs.collect()}


def test_equal_rows_are_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 40)
    rows = spark.range(600).selectExpr("cast(null as long) doc_id", "0 piece", "0L start", "100L length", "7L ids_crc32").repartition(3)
    packed = packing.pack(rows)
    assert packed.columns == rows.columns + ["sequence_id", "offset"]
    out = packed.collect()
    check_sequences(out)
    shards = np.bincount([r.sequence_id % 15 for r in out], minlength=15)
    assert len(out) == 600 and shards.min() > 0 and shards.max() < 80


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 4096, 400))[::-1]
    parents = []
    for _ in range(2):
        bins, room = [], []
        head = rng.permutation(400).tolist()
        packing.best_fit(sizes, head[:130], bins, room)
        packing.best_fit(sizes, head[130:], bins, room)
        parents.append((bins, room))
    bins, room = packing.crossover(sizes, *parents, rng)
    assert sorted(x for b in bins for x in b) == list(range(400))
    assert all(sizes[b].sum() + r == packing.CAPACITY and r >= 0 for b, r in zip(bins, room))
    label = packing.evolve(sizes, [], 5)
    assert np.bincount(label, sizes).max() <= packing.CAPACITY and label.max() + 1 <= len(parents[0][0])


def hard_shard(seed, bins=40):
    """Pieces that fill ``bins`` sequences by threes without a gap; best fit, largest first, needs more."""
    rng = np.random.default_rng(seed)
    one, two = rng.integers(1100, 1700, bins), rng.integers(1100, 1400, bins)
    return np.sort(np.concatenate([one, two, 4096 - one - two]))[::-1].astype(np.int64)


def test_search_saves_sequences_where_best_fit_is_not_least(spark):
    sizes = [hard_shard(seed) for seed in range(6)]
    plain = [int(packing.decreasing(s).max()) + 1 for s in sizes]
    found = [int(packing.evolve(s, [], 3).max()) + 1 for s in sizes]
    assert all(f <= p for f, p in zip(found, plain)) and sum(found) < sum(plain), (plain, found)
    lengths = [(i, int(n)) for i, n in enumerate(sizes[0])]
    rows = spark.createDataFrame(lengths, "doc_id long, length long").selectExpr("doc_id", "0 piece", "0L start", "length", "7L ids_crc32")
    out = packing.pack(rows).collect()
    assert check_sequences(out) < plain[0] and sorted(r.length for r in out) == sorted(n for _, n in lengths)


def test_words_are_encoded_as_alone(tokenizer):
    words = ["plain", "qzxkv", "a", "tokenization"] * 700
    ids, count = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))._words(words)
    assert [p.tolist() for p in np.split(ids, np.cumsum(count)[:-1])] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]


def test_encoding_starts_no_threads():
    """A task has one core, and the memory of every further thread would count for its executor."""
    code = (
        "import os, public_tokenizers\n"
        "from wardflow.llm import packing\n"
        "encoder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))\n"
        "before = len(os.listdir('/proc/self/task'))\n"
        "encoder._encoded([f'word {i}' for i in range(5000)])\n"
        "assert len(os.listdir('/proc/self/task')) == before\n"
    )
    root = Path(packing.__file__).resolve().parents[2]
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    assert subprocess.run([sys.executable, "-c", code], cwd=root, env=env, timeout=60).returncode == 0
