"""Ids and texts against the library that goes with the vocabulary."""

import hashlib
import random
import unicodedata

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import TEXTS
from wardflow.llm import prefixbpe, queries


@pytest.fixture(scope="module")
def codec():
    return prefixbpe.codec(prefixbpe.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(prefixbpe.default_vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def check(codec, library, texts):
    for text, theirs in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ids(codec, text) == theirs.ids, text[:80]
        assert codec.decode(codec.encode(text)) == library.decode(theirs.ids, skip_special_tokens=False)


def test_odd_texts(codec, library):
    check(codec, library, [t or "" for t in TEXTS] + ["<|endoftext|><|startoftext|>x<|endoftext", "<|ENDOFTEXT|>", "Σας ΟΔΟΣ İstanbul", "é Å क़"])


def test_random_words(codec, library):
    rng = random.Random(5)
    alphabets = ["ab", "aab", "thein ", "abcdefghijklmnopqrstuvwxyz", "eéßñ漢 字", "0123 4", "'s't've l", "!?.,-…", "​́İΣσ x"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(1, 30))) for a in alphabets for _ in range(400)]
    check(codec, library, texts)


def test_every_kind_of_sign(codec, library):
    """One sign of each block of 64, settled or not, inside and at the end of a word."""
    rng = random.Random(6)
    picked = [rng.randrange(low, low + 64) for low in range(0, 0x32000, 64)]
    signs = [chr(cp) for cp in picked if unicodedata.category(chr(cp)) != "Cs"]
    check(codec, library, [f"a{s}b {s}1 x{s}" for s in signs])


def test_long_words_and_a_full_memory(codec, library, monkeypatch):
    monkeypatch.setattr(prefixbpe, "REMEMBERED", 20)
    rng = random.Random(7)
    check(codec, library, ["ab" * 40_000, "a" * 50_001, "".join(rng.choice("etaoin") for _ in range(30_000))])
    check(codec, library, [" ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(500))])


def test_a_pair_fits_exactly_when_it_is_an_encoding(codec, library):
    """The seam test of a token and an ending says what the library makes of both together."""
    rng = random.Random(8)
    letters = {t: name for t, name in codec.names.items() if name.isascii() and name.removesuffix("</w>").isalpha() and name.islower()}
    plain = [t for t, name in letters.items() if not name.endswith("</w>")]
    ending = [t for t, name in letters.items() if name.endswith("</w>")]
    pairs = [(rng.choice(plain), rng.choice(ending)) for _ in range(3000)]
    words = [letters[a] + letters[b].removesuffix("</w>") for a, b in pairs]
    for (a, b), word, theirs in zip(pairs, words, library.encode_batch(words, add_special_tokens=False)):
        assert codec.fitting[a, b] == (theirs.ids == [a, b]), word


def test_frames(spark, codec, edge_docs, no_docs):
    coded = prefixbpe.decode(prefixbpe.encode(edge_docs))
    assert coded.columns == [*edge_docs.columns, "ids", "decoded"]
    rows = coded.collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert r.ids == codec.encode(r.text) and r.decoded == codec.decode(r.ids)
    assert prefixbpe.decode(prefixbpe.encode(no_docs)).count() == 0


def test_clashing_columns_and_long_rows(spark, codec, monkeypatch):
    rows = [("old", 1, "one two", "x", b"z"), (None, None, None, None, None), ("b", 2, "word " * 400_000, "y", None)]
    docs = spark.createDataFrame(rows, "ids string, DOC_ID long, text string, c0 string, decoded binary")
    got = sorted(prefixbpe.decode(prefixbpe.encode(docs)).collect(), key=lambda r: r.DOC_ID or 0)
    assert [r.c0 for r in got] == [None, "x", "y"] and got[0].ids == b"" and got[0].decoded == ""
    assert got[2].ids == codec.encode("word") * 400_000


def test_query(spark, codec, library, folder):
    got = {r.doc_id: r for r in queries.QUERIES["op11_prefix_bpe"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, theirs in zip(docs, library.encode_batch([d.text or "" for d in docs], add_special_tokens=False)):
        r = got[d.doc_id]
        assert r.n_tokens == len(theirs.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(theirs.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(theirs.ids, skip_special_tokens=False).encode()).hexdigest()
