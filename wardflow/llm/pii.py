"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans are those of the fixed patterns and checks; they always count.  Candidates are
the base matches, matches that failed their check, and looser forms (written-out
addresses, numbers without a plus sign, addresses of version 6).  Six labelers vote for, against or
not at all on each: pattern, check, gazetteer, context before the span, context after it, and
shape.  The votes of all candidates of the corpus are counted by pattern of votes, expectation
maximisation estimates how reliable every labeler is for each kind, and its
posteriors train a logistic classifier over votes and features of the span.  Loose spans that the
classifier accepts with ``ACCEPT`` or more are added.

Counting is an aggregate over all candidates; what reaches the driver is one row per
pattern of votes and features, at most ``PATTERNS`` whatever the corpus.

Defined results: null text is empty; positions are code points, end exclusive; repeated rows
get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import stored

KINDS = ["email", "ip", "card", "phone"]
LABELERS = 6
FEATURES = 5
PATTERNS = len(KINDS) * 3**LABELERS * 2**FEATURES
ACCEPT = 0.95
EM_STEPS = 40
FIT_STEPS = 300
CONTEXT_CHARS = 32

# Words that speak for or against a kind, and known heads of numbers.
_FOR = {
    0: ["mail", "contact", "write", "reach", "courriel", "correo", "kontakt", "schreib"],
    1: ["ip", "host", "server", "address", "addr", "login", "adresse", "from"],
    2: ["card", "visa", "master", "amex", "credit", "debit", "karte", "carte", "tarjeta"],
    3: ["phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "anruf", "appel", "llam"],
}
_AGAINST = ["version", "release", "isbn", "order", "invoice", "article", "license", "licence", "chapter", "figure", "table", "page", "id=", "sha", "hash"]
_TOP_LEVEL = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "biz", "us", "ch", "at"}
_CARD_HEADS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The parts are possessive: what stops a part cannot begin inside it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_AT = re.compile(r"[ ]?[(\[] ?at ?[)\]] ?([A-Za-z0-9-]{1,63}(?:(?: ?[(\[] ?dot ?[)\]] ?|\.)[A-Za-z0-9-]{1,63}){1,5})")
_BARE_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: nothing else can be at the middle of one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (host := _HOST.match(text, at + 1)):
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _valid(kind: int, found: str) -> bool:
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    if kind == 2:
        digits = _digits(found)
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 9 <= len(_digits(found)) <= 15
    return True


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of the fixed patterns that pass their check, in order, and those that fail."""
    passed, failed = [], []
    if "@" in text:
        passed += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            for m in pattern.finditer(text):
                (passed if _valid(kind, m[0]) else failed).append((m.start(), kind, m.end()))
    return sorted(passed), failed


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans that only the method may add."""
    found = []
    if "(at" in text or "[at" in text or "( at" in text or "[ at" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > max(0, m.start() - 64) and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
    if _DIGIT.search(text):
        found += [(m.start(), 3, m.end()) for m in _BARE_PHONE.finditer(text)]
        if text.count(":") >= 7:
            found += [(m.start(), 1, m.end()) for m in _IP6.finditer(text)]
    return found


def _votes(text: str, start: int, kind: int, end: int, loose: bool, ok: bool) -> tuple[int, int]:
    """Votes in base three (0 abstains, 1 against, 2 for), and feature bits."""
    found = text[start:end]
    before = text[max(0, start - CONTEXT_CHARS) : start].lower()
    after = text[end : end + CONTEXT_CHARS].lower()
    digits = _digits(found)
    pattern = 0 if loose else 2
    check = 2 if ok else 1
    if loose:
        check = 0 if kind == 0 else 2 if len(set(digits)) > 2 else 1
    if kind == 0:
        gazetteer = 2 if re.split(r"[.)\]\s]+", found.lower())[-1] in _TOP_LEVEL else 0
    elif kind == 1:
        gazetteer = 1 if found.startswith(("0.", "127.", "255.")) else 0
    elif kind == 2:
        gazetteer = 2 if digits.startswith(_CARD_HEADS) else 1
    else:
        gazetteer = 2 if digits[:1] not in ("", "0") else 0
    context = 2 if any(w in before for w in _FOR[kind]) else 1 if any(w in before for w in _AGAINST) else 0
    follow = 1 if any(w in after for w in _AGAINST) else 2 if any(w in after for w in _FOR[kind]) else 0
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    tight = left.isalnum() or right.isalnum() or left in ("_", "/", "=", "#") or right in ("_", "/", "=", "%")
    shape = 1 if tight else 2
    code = 0
    for v in (pattern, check, gazetteer, context, follow, shape):
        code = 3 * code + v
    bits = [len(found) > 12, len(found) > 20, len(digits) > 8, " " in found, end == len(text) or right in ".,;:)\n"]
    return code, sum(1 << i for i, b in enumerate(bits) if b)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_CANDIDATE = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("loose", pa.bool_()), ("votes", pa.int32()), ("bits", pa.int32())])
_FOUND_DDL = (
    "doc_id long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, "
    "candidates array<struct<start:int,kind:int,end:int,loose:boolean,votes:int,bits:int>>"
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, bases, candidates = batch.column(0), [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            passed, failed = base_spans(text)
            loose = [s for s in loose_spans(text) if all(s[2] <= a or b <= s[0] for a, _, b in passed)]
            found = []
            for spans, is_loose, ok in ((passed, False, True), (failed, False, False), (loose, True, True)):
                for a, k, b in spans:
                    votes, bits = _votes(text, a, k, b, is_loose, ok)
                    found.append({"start": a, "kind": k, "end": b, "loose": is_loose, "votes": votes, "bits": bits})
            hashes.append(hashlib.sha256(written(passed).encode()).hexdigest())
            bases.append([{"start": a, "kind": k, "end": b} for a, k, b in passed])
            candidates.append(found)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(hashes, pa.string()), pa.array(bases, pa.list_(_SPAN)), pa.array(candidates, pa.list_(_CANDIDATE))],
            names=["doc_id", "base_sha256", "base", "candidates"],
        )


def _unpack(code: int) -> list[int]:
    return [code // 3 ** (LABELERS - 1 - i) % 3 for i in range(LABELERS)]


def posteriors(votes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Probability that spans with these votes are real, by EM over labelers that err independently."""
    share = 0.5
    # chance of each vote given real and given not: labelers start out better than guessing
    chance = np.tile(np.array([[0.2, 0.2, 0.6], [0.2, 0.6, 0.2]])[:, None, :], (1, LABELERS, 1))
    real = np.full(len(count), 0.5)
    for _ in range(EM_STEPS):
        log = [np.log(s) + sum(np.log(chance[c, i, votes[:, i]]) for i in range(LABELERS)) for c, s in ((0, share), (1, 1 - share))]
        real = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
        for c, weight in ((0, real * count), (1, (1 - real) * count)):
            for i in range(LABELERS):
                seen = np.bincount(votes[:, i], weight, 3) + np.array([1.0, 1.0, 1.0])
                chance[c, i] = seen / seen.sum()
        share = float(np.clip((real * count).sum() / count.sum(), 0.01, 0.99))
    return real


def _row(votes: list[int], bits: int) -> list[float]:
    out = [1.0]
    for v in votes:
        out += [float(v == 1), float(v == 2)]
    return out + [float(bits >> i & 1) for i in range(FEATURES)]


WIDTH = 1 + 2 * LABELERS + FEATURES


def train(patterns: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Weights of the span classifier of every kind from rows ``kind, votes, bits, count``."""
    weights = np.zeros((len(KINDS), WIDTH))
    weights[:, 0] = -20.0  # a kind without candidates accepts nothing
    for kind in range(len(KINDS)):
        mine = [p for p in patterns if p[0] == kind]
        if not mine:
            continue
        votes = np.array([_unpack(p[1]) for p in mine])
        count = np.array([p[3] for p in mine], float)
        real = posteriors(votes, count)
        x = np.array([_row(_unpack(p[1]), p[2]) for p in mine])
        importance = count / count.sum()
        w = np.zeros(WIDTH)
        for _ in range(FIT_STEPS):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (importance * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(WIDTH)
            step = np.linalg.solve(hessian, x.T @ (importance * (real - p)) - 1e-3 * w)
            w += np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
        weights[kind] = w
    return weights


def _accepted(candidate: Column, weights: np.ndarray) -> Column:
    """Whether the classifier accepts a candidate, as an expression over its votes and bits."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in weights.ravel())), ",").cast("array<double>")
    at = lambda k: F.get(table, candidate["kind"] * WIDTH + k)
    total = at(F.lit(0))
    for i in range(LABELERS):
        vote = F.floor(candidate["votes"] / 3 ** (LABELERS - 1 - i)).cast("int") % 3
        total = total + F.when(vote > 0, at(2 * i + vote)).otherwise(0.0)
    for i in range(FEATURES):
        total = total + F.when(candidate["bits"].bitwiseAND(F.lit(1 << i)) != 0, at(F.lit(1 + 2 * LABELERS + i))).otherwise(0.0)
    return total >= float(np.log(ACCEPT / (1 - ACCEPT)))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, base_sha256, added``: spans are arrays of ``start, kind, end`` in order."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = stored(picked.mapInArrow(_find, _FOUND_DDL), "pii-found")
    counted = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.bits").count()
    weights = train([tuple(r) for r in counted.orderBy("kind", "votes", "bits").collect()])
    added = F.transform(F.filter("candidates", lambda c: c["loose"] & _accepted(c, weights)), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return found.select("doc_id", "base", "base_sha256", added.alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, and all spans as text."""
    rows = find(docs)
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_sort(F.concat("base", "added"))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], "base_sha256", text.alias("spans"), F.size("added").cast("long").alias("n_added"))
