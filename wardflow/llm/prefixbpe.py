"""BPE encoding by dynamic programming over prefixes, and decoding.

A word is encoded from left to right: for every prefix the last token of its encoding is
stored.  An automaton over the vocabulary names all tokens that are a suffix of the
prefix; the right one is the only one whose pair with the last token of the shorter prefix
is itself an encoding.  Following the stored tokens back from the end of the word gives
its ids, in time linear in its length.  Whether a pair of tokens is an encoding is
decided from the merges along its seam.

Works on vocabularies of the kind of ``VOCABULARY``: texts are composed (NFC), lowered,
cut at white space and between letters, digits and other signs; every word ends in a
symbol of its own, and special tokens in the text are ids of their own.  Texts do not
leave their row, so there is no shuffle, and a worker keeps only the vocabulary and a
bounded number of encoded words.

Defined results: null and empty texts have no ids, and no ids are the empty text; ids come
as one binary value, little-endian and 32 bits each, so that a text of any length is one
value; repeated rows are encoded each; an existing column of the name of the result is
replaced, others stay; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wardflow.llm.octets import slices

VOCABULARY = "word_bpe_49k.json"
#: Words, and pairs of tokens, that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Words of more characters are not remembered.
LONG_WORD = 64
#: Added to the last character of a word, which is a symbol of its own.
LAST = 0x1000
NEVER = 1 << 62

# What separates words, and how a text is cut into words.
SPACE = r"\t-\r\x20\x85\p{Z}"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
# Signs whose class and lower case are the same in all recent versions of Unicode: Latin,
# combining marks, Greek, Cyrillic, punctuation, kana, common Han and Hangul syllables.
SETTLED = r"\x00-\u024F\u0300-\u0377\u0391-\u03A1\u03A3-\u03FF\u0400-\u052F\u2000-\u2064\u20A0-\u20BD\u2190-\u23F3\u2500-\u27BF\u3000-\u303F\u3041-\u3096\u3099-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3\uFE30-\uFE44\uFF01-\uFFBE\U0001F300-\U0001F64F"


def byte_letters() -> dict[int, str]:
    """A printable character for each byte: itself where it is one, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def normalised(text: str) -> str:
    """Composed and lowered, one character at a time (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class _Memory(dict):
    """What a function gave for the keys seen so far; forgets all when it is full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value
        return value


class Codec:
    """Ids of texts and texts of ids for one vocabulary file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
            raise ValueError(f"{path} is not a vocabulary of words with end marks")
        self.suffix = model["end_of_word_suffix"]
        self.letters = byte_letters()
        self.names = {i: name for name, i in model["vocab"].items()}
        special = sorted((t["content"], t["id"]) for t in spec["added_tokens"])
        self.special = dict(special)
        self.names |= {i: name for name, i in special}
        self.special_at = regex.compile("(" + "|".join(regex.escape(s) for s, _ in special) + ")") if special else None
        self.word_at = regex.compile(WORDS)
        self.unsettled = regex.compile(f"[^{SETTLED}]")
        self.path, self.cutter = path, None
        self._read_merges(model)
        self.fitting = _Memory(self._fits)
        self.packed = _Memory(self._pack)

    def _read_merges(self, model: dict) -> None:
        ids = model["vocab"]
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.joins: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = ids[left + right]
            if made in self.parts:
                raise ValueError(f"token {made} has several merges")
            self.parts[made] = ids[left], ids[right]
            self.rank[made] = rank
            self.joins[ids[left], ids[right]] = rank
        self.right_edges: dict[int, tuple] = {}
        self.left_edges: dict[int, tuple] = {}
        self.automaton = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        for name, token in ids.items():
            if not self._arises(token):
                continue
            spelled = self._marked(name.removesuffix(self.suffix)) if name.endswith(self.suffix) and name != self.suffix else name
            self.length[token] = len(spelled)
            self.automaton.add_word(spelled, token)
        self.automaton.make_automaton()

    def _marked(self, spelled: str) -> str:
        return spelled[:-1] + chr(ord(spelled[-1]) + LAST)

    def _edge(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """Nodes of the merge tree along one side, from the leaf up, each with the rank of the merge above it."""
        known = self.right_edges if side else self.left_edges
        if token not in known:
            nodes, above = [], NEVER
            node = token
            while node is not None:
                nodes.append((node, above))
                above = self.rank.get(node, NEVER)
                node = self.parts[node][side] if node in self.parts else None
            known[token] = tuple(reversed(nodes))
        return known[token]

    def _seam(self, left: int, right: int, until: int) -> bool:
        """Whether no merge crosses the seam of two tokens before the rank ``until``.

        Both sides of the seam grow in order of rank, of equal ranks the left one first.
        A crossing merge wins if it comes before the next growth of the left side and
        not after that of the right.
        """
        before, after = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, up_x), (y, up_y) = before[i], after[j]
            crossing = self.joins.get((x, y), NEVER)
            if crossing < min(until, up_x) and crossing <= up_y:
                return False
            if up_x == up_y == NEVER:
                return True
            if up_x <= up_y:
                i += 1
            else:
                j += 1

    def _fits(self, pair: tuple[int, int]) -> bool:
        return self._seam(*pair, NEVER)

    def _arises(self, token: int) -> bool:
        """Whether a token is the encoding of its own spelling."""
        return token not in self.parts or self._seam(*self.parts[token], self.rank[token])

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word that is already normalised."""
        spelled = self._marked("".join(map(self.letters.__getitem__, word.encode())))
        last = [-1] * (len(spelled) + 1)
        fitting, length = self.fitting, self.length
        for end, token in self.automaton.iter(spelled):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - length[token]
            if start == 0 or fitting[last[start], token]:
                last[end + 1] = token
        out, at = [], len(spelled)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]

    def _pack(self, word: str) -> bytes:
        return np.array(self.word_ids(word), dtype="<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens.

        Newer or unassigned signs are cut by the library that goes with the vocabulary,
        as versions of Unicode differ in what they are.
        """
        if text.isascii() or not self.unsettled.search(text):
            return self.word_at.findall(normalised(text))
        if self.cutter is None:
            from tokenizers import Tokenizer

            self.cutter = Tokenizer.from_file(self.path)
            self.byte_of = {letter: byte for byte, letter in self.letters.items()}
        cut = self.cutter.pre_tokenizer.pre_tokenize_str(self.cutter.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, word)).decode() for word, _ in cut]

    def _of_plain(self, text: str) -> bytes:
        words = self.words(text)
        if max(map(len, words), default=0) > LONG_WORD:
            return b"".join(self._pack(w) if len(w) > LONG_WORD else self.packed[w] for w in words)
        return b"".join(map(self.packed.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text."""
        if not text:
            return b""
        if self.special_at is None or not any(s in text for s in self.special):
            return self._of_plain(text)
        return b"".join(
            self.special[part].to_bytes(4, "little") if part in self.special else self._of_plain(part)
            for part in self.special_at.split(text)
        )

    def decode(self, packed: bytes | None) -> str:
        """Names of the ids, with a space between them."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(packed or b"", dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _mapped(df: DataFrame, source: str, target: str, kind: T.DataType, make) -> DataFrame:
    """``df`` with the column ``target`` made from ``source``, in bounded batches."""
    kept = [c for c in df.columns if c != target]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(target, kind)])
    rows = df.select(source, *kept).toDF(*[f"c{i}" for i in range(len(kept) + 1)])  # names may differ in case only
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for batch in batches:
            column = batch.column(0)
            for low, high, _ in slices(column, 4 << 20) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else _cuts(column):
                values = pa.array([change(x) for x in column.slice(low, high - low).to_pylist()], arrow)
                rest = batch.slice(low, high - low).columns[1:]
                yield pa.RecordBatch.from_arrays([*rest, values], names=inner.names)

    return rows.mapInArrow(run, inner).toDF(*schema.names)


def _cuts(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, None]]:
    low, size = 0, 0
    for i, value in enumerate(column):
        size += len(value.as_buffer()) if value.is_valid else 0
        if size >= limit or i + 1 == len(column):
            yield low, i + 1, None
            low, size = i + 1, 0


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the packed ids of its texts in the column ``ids``."""
    path = path or default_vocabulary()
    return _mapped(df, text, ids, T.BinaryType(), lambda: codec(path).encode)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its packed ids in the column ``decoded``."""
    path = path or default_vocabulary()
    return _mapped(df, ids, text, T.StringType(), lambda: codec(path).decode)
