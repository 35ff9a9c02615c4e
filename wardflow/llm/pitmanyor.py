"""Scores of texts under a hierarchical Pitman-Yor language model over words.

A restaurant stands for a context, the word before (the end token stands before the first word); all
context restaurants share one parent, the restaurant of single words, whose parent is
uniform over the words known and one unknown word.  Customers of a context are its
words in training texts; every table there sends one customer to the parent.  The
seating is sampled by Gibbs sweeps: given all others, the tables of a word in a restaurant
are drawn anew by running the Chinese restaurant process forward, and of
several runs one is chosen in proportion to its weight under the conditional.  Table
counts are averaged over the sweeps after burn-in, and the probabilities that follow
from them sum to one in every context.

How it is spread: a restaurant lives in one part, by hash of its context, and its tables are live during all
sweeps.  The customers that parts send to a word of the parent restaurant are added up at the
home of that word, before the sweeps (one table for each pair) and after them; the
parent does not change in between.  A context with a large share of all tokens is hot: its pairs go to the homes of their second words,
and its total of tables is fixed within a pass.  There are at most as many hot words
as the inverse of that share, and their totals alone pass through the driver.  Texts are stored in
blocks of bounded size.  A block asks the parts for the words and pairs it has, one packed row
per part, and gets the numbers back in the same order.  These rows are made again from the stored blocks for each pass
over the pairs; stored as well they would need more disk than the texts.

Base counts are kept by hashes of 64 bits; a word as the second of a pair is known by 40 bits of its hash.

Defined results: null text is empty and has the end token only; a null id is a training
document; repeated rows count each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.blocks import opened, to_blocks_of
from wardflow.llm.common import parts_for, remove, scratch, stored
from wardflow.llm.octets import U, Texts, mix, slices

FOLDS, HELD_FOLD = 7, 2
#: Bytes of texts in a block, and for which there is one part.
BLOCK_BYTES = PART_BYTES = 8 << 20
STRENGTH = 1.0
BURN_IN, SAMPLES, RUNS = 2, 4, 2
#: A word is hot if it has more than one in so many of all tokens: as many as a quarter of the parts, within these limits.
HOT_LEAST, HOT_MOST = 64, 65536
#: Customers are seated one by one up to this pull of the parent, and in small batches beyond.
BATCH_FROM = 50.0
SEED = 20
END = U(0x51A7E0FEEDBEEF01)
_LOW = U((1 << 40) - 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# Tokens of a block


def _held(doc_id: str) -> "F.Column":
    folds = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(folds == HELD_FOLD, F.lit(False))


def _slice_tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and texts of all tokens of a slice, end tokens included, in order of text."""
    lower = Texts(_LOWER[t.data], t.offsets)
    start, end, count = lower.words()
    last = np.cumsum(count + 1) - 1
    word = np.full(int(count.sum()) + t.count, END, U)
    is_word = np.ones(len(word), dtype=bool)
    is_word[last] = False
    word[is_word] = lower.span_hash(lower.prefix_hash(), start, end)
    return word, np.repeat(np.arange(t.count, dtype=np.int32), count + 1)


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    words, docs = [], []
    for low, _, t in slices(table.column("text")):
        word, owner = _slice_tokens(t)
        words.append(word)
        docs.append(owner + low)
    return np.concatenate(words), np.concatenate(docs)


def part_of(word: np.ndarray, parts: int) -> np.ndarray:
    """The home of a word, from the 40 bits that every side knows."""
    return (mix(word & _LOW) >> U(33)).astype(np.int64) % parts


class Tokens:
    """All tokens of a block; its distinct words in order of home and hash; its distinct pairs in order of part, context and word."""

    def __init__(self, table: pa.Table, parts: int, hot: np.ndarray):
        word, self.doc = _tokens(table)
        known, token = np.unique(word, return_inverse=True)
        del word
        home = part_of(known, parts)
        order = np.argsort(home, kind="stable")
        self.word, self.home = known[order], home[order]
        self.token = _rank(order)[token]
        self.hot = np.isin(self.word, hot)
        n = len(self.word)
        key = np.empty(len(token), np.int64)
        key[1:], key[:1] = self.token[:-1], np.flatnonzero(self.word == END)
        del token
        key *= n
        key += self.token
        pairs, pair = np.unique(key, return_inverse=True)
        del key
        context, second = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
        part = np.where(self.hot[context], self.home[second], self.home[context])
        order = np.argsort(part, kind="stable")
        self.pair, self.context, self.second, self.part = _rank(order)[pair], context[order], second[order], part[order]


def _rank(order: np.ndarray) -> np.ndarray:
    """Where each item comes in the order."""
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank


def _planes(values: np.ndarray) -> bytes:
    """Numbers by byte planes, so that empty high bytes compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _told_as(values: np.ndarray) -> bytes:
    """Numbers of a model as blocks are told them: 16 binary digits, a relative error of at most 2^-16."""
    bits = values.astype(np.float32).view(np.uint32)
    return _planes(((bits + np.uint32(128)) & np.uint32(0xFFFFFF00)).view(np.float32))


def _short(words: np.ndarray) -> bytes:
    """The 40 bits by which second words of pairs are known."""
    return np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unshort(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(U).ravel()


def _frequent(share: int):
    """Words of a block that may be hot, with their tokens, and the tokens of the block (no word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in batch.column(0):
                words, count = np.unique(_tokens(opened(texts.as_py()))[0], return_counts=True)
                often = count > count.sum() / (2 * share)
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array([*words[often].view(np.int64).tolist(), None], pa.int64()),
                    "n": pa.array([*count[often].tolist(), int(count.sum())], pa.int64()),
                })

    return run


def hot_words(blocks: DataFrame, share: int) -> np.ndarray:
    """Hashes of all words with more than one in ``share`` of all tokens, at most 2 ``share`` words.

    A block leaves out a word only below half of that share, so less than half of a hot word's tokens go uncounted.
    """
    counted = blocks.select("texts").mapInArrow(_frequent(share), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "lm-frequent")
    total = counted.filter("word is null").select("n").scalar()
    rows = counted.filter(F.col("word").isNotNull() & (F.col("n") * (2 * share) > total)).select("word").collect()
    return np.sort(np.array([r.word for r in rows], np.int64).view(U))


_ASK = "block long, part long, word binary, fan binary, second binary, customers binary"


def _asker(parts: int, hot: np.ndarray):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                table = opened(texts.as_py())
                t = Tokens(table, parts, hot)
                training = ~table.column("held").to_numpy()
                customers = np.bincount(t.pair[training[t.doc]], minlength=len(t.context)).astype(np.uint32)
                of, at = np.unique(t.part, return_index=True)
                cut = np.append(at, len(t.part))
                rows = {n: [] for n in ("block", "part", "word", "fan", "second", "customers")}
                for k, part in enumerate(of.tolist()):
                    ps = slice(cut[k], cut[k + 1])
                    context, fan = np.unique(t.context[ps], return_counts=True)
                    packed = (t.word[context].tobytes(), _planes(fan.astype(np.uint32)), _short(t.word[t.second[ps]]), _planes(customers[ps]))
                    for name, value in zip(rows, (block, part, *packed)):
                        rows[name].append(value)
                yield pa.RecordBatch.from_pydict(rows)

    return ask


def _lister(parts: int, hot: np.ndarray):
    """The words of a block that are not hot, one packed row for each home, in the order of ``Tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                word = np.setdiff1d(_tokens(opened(texts.as_py()))[0], hot)
                home = part_of(word, parts)
                order = np.argsort(home, kind="stable")
                of, at = np.unique(home[order], return_index=True)
                lists = [w.tobytes() for w in np.split(word[order], at[1:])] if len(of) else []
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block] * len(of), pa.int64()), "part": pa.array(of, pa.int64()), "word": pa.array(lists, pa.binary())
                })

    return run


# Seating


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series after eight recurrence steps."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - np.log(shift)


def _seat_once(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables after seating all customers of a dish in order, and the log weight of the run.

    The next of j customers at t tables opens a table with probability
    pull / (pull + j - discount t).  The wait for that is a Beta-mixed geometric
    number, drawn exactly; strong pulls go in batches over which the chance hardly changes.
    """
    tables = (customers > 0).astype(np.float64)
    weight = np.zeros(len(customers))
    seated = tables.copy()
    busy = np.flatnonzero(customers > 1)
    while len(busy):
        j, t, a, c = seated[busy], tables[busy], pull[busy], customers[busy]
        old = j - discount * t
        single = a <= BATCH_FROM
        step = np.empty(len(busy))
        opened = np.empty(len(busy))
        chance = rng.beta(np.maximum(a[single], 1e-12), old[single])
        wait = np.where(chance > 1e-15, rng.geometric(np.maximum(chance, 1e-15)), np.inf)
        step[single] = np.minimum(wait, c[single] - j[single])
        opened[single] = wait <= c[single] - j[single]
        many = ~single
        step[many] = np.minimum(np.ceil(0.05 * (a[many] + old[many])), c[many] - j[many])
        opened[many] = rng.binomial(step[many].astype(np.int64), a[many] / (a[many] + old[many]))
        weight[busy] += np.where(
            single, _log_gamma(a + old + step) - _log_gamma(a + old), step * np.log(a + old + (step - discount * opened) / 2)
        )
        seated[busy] = j + step
        tables[busy] = t + opened
        busy = busy[seated[busy] < customers[busy]]
    return tables, weight


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish given its customers: one of ``RUNS`` forward runs, chosen by weight."""
    out = (customers > 0).astype(np.float64)
    several = np.flatnonzero(customers > 1)
    customers, pull = customers[several], pull[several]
    tables, weight = _seat_once(customers, pull, discount, rng)
    for _ in range(RUNS - 1):
        other, heavy = _seat_once(customers, pull, discount, rng)
        take = np.log(rng.random(len(weight))) < heavy - np.logaddexp(weight, heavy)
        tables = np.where(take, other, tables)
        weight = np.logaddexp(weight, heavy)
    out[several] = tables
    return out


#: Totals that parts sum, before those of hot words: tokens, words, counts of counts (pairs once and twice, words once and twice), parent's tables and customers.
_SCALARS = ["tokens", "words", "p1", "p2", "w1", "w2", "top_tables", "top_customers"]
#: What is known of a hot word: its training tokens, the tables of its restaurant, its number in the parent.
_OF_HOT = 3


def _sums(hot: np.ndarray, of_hot: dict[int, np.ndarray], **scalars: float) -> list[float]:
    out = np.zeros(len(_SCALARS) + _OF_HOT * len(hot))
    for name, value in scalars.items():
        out[_SCALARS.index(name)] = value
    for k, values in of_hot.items():
        at = len(_SCALARS) + k * len(hot)
        out[at : at + len(hot)] = values
    return out.tolist()


class Totals:
    """Totals over all parts, with those of hot words in order of their hashes."""

    def __init__(self, hot: np.ndarray, values: np.ndarray, parts: int):
        self.hot, self.parts = hot, parts
        for k, name in enumerate(_SCALARS):
            setattr(self, name, float(values[k]))
        self.hot_count, self.hot_tables, self.hot_parent = values[len(_SCALARS) :].reshape(_OF_HOT, -1)
        self.words += float((self.hot_count > 0).sum())
        self.w1 += float((self.hot_count == 1).sum())
        self.w2 += float((self.hot_count == 2).sum())
        self.discount = self._rate(self.p1, self.p2)
        self.top_discount = self._rate(self.w1, self.w2)

    def take_parent(self, values: np.ndarray) -> None:
        """Totals of the parent and its numbers of hot words, from the sums of a later pass."""
        other = Totals(self.hot, values, self.parts)
        self.top_tables, self.top_customers, self.hot_parent = other.top_tables, other.top_customers, other.hot_parent

    def take_tables(self, values: np.ndarray) -> None:
        """Tables of hot restaurants, from the sums of a later pass."""
        self.hot_tables = Totals(self.hot, values, self.parts).hot_tables

    @staticmethod
    def _rate(once: float, twice: float) -> float:
        """The discount that the counts of counts suggest."""
        return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5

    def uniform(self) -> float:
        return (STRENGTH + self.top_discount * self.top_tables) / (self.words + 1)

    def parent(self, own: np.ndarray) -> np.ndarray:
        """Probability of words in the parent, given their customers there less the discount."""
        return (own + self.uniform()) / (STRENGTH + self.top_customers)

    def back(self, tables: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """Share of a context that its parent decides."""
        return (STRENGTH + self.discount * tables) / (STRENGTH + customers)


class Part:
    """The restaurants of a part, merged over blocks: pairs of context and word with training customers.

    Words (dishes) lie in order of home and hash, contexts in order of hash.
    """

    def __init__(self, rows: pa.Table, parts: int, hot: np.ndarray):
        words = [np.frombuffer(b, U) for b in rows.column("word").to_pylist()]
        fans = [_unplanes(b, np.uint32) for b in rows.column("fan").to_pylist()]
        self.word_sizes, self.pair_sizes = [len(w) for w in words], [int(f.sum()) for f in fans]
        self.known, self.word_of_row = np.unique(np.concatenate(words), return_inverse=True)
        context = np.repeat(self.word_of_row, np.concatenate(fans))
        second = _unshort(b"".join(rows.column("second").to_pylist()))
        count = np.concatenate([_unplanes(b, np.uint32) for b in rows.column("customers").to_pylist()])
        order = np.lexsort((second, context))
        u, w = context[order], second[order]
        del context, second
        new = np.ones(len(w), dtype=bool)
        new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        self.merged = np.empty(len(w), np.int64)
        self.merged[order] = np.cumsum(new) - 1
        self.customers = np.add.reduceat(count[order].astype(np.float64), first)
        self.context = u[first]
        dish, of = np.unique(w[first], return_inverse=True)
        home = part_of(dish, parts)
        order = np.argsort(home, kind="stable")
        self.dish, self.home, self.dish_of_pair = dish[order], home[order], _rank(order)[of]
        self.count = np.bincount(self.context, self.customers, len(self.known))
        self.is_hot = np.isin(self.known, hot)
        self.hot_at = np.searchsorted(hot, self.known[self.is_hot])
        self.hots = len(hot)

    def tables_of(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, tables, len(self.known))

    def of_hot(self, values: np.ndarray) -> np.ndarray:
        """Values of contexts as an array over the hot words."""
        return np.bincount(self.hot_at, values[self.is_hot], self.hots)

    def with_hot(self, values: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Values of contexts, for hot ones those of all parts."""
        values = values.copy()
        values[self.is_hot] = hot[self.hot_at]
        return values

    def sent(self, tables: np.ndarray) -> dict[str, list]:
        """Customers that the tables send to words of the parent, one packed row for each home."""
        total = np.bincount(self.dish_of_pair, tables, len(self.dish)).astype(np.float32)
        of, at = np.unique(self.home, return_index=True)
        cut = np.append(at, len(self.home))
        spans = [slice(cut[k], cut[k + 1]) for k in range(len(of))]
        return {"home": of.tolist(), "dish": [_short(self.dish[s]) for s in spans], "sent": [_planes(total[s]) for s in spans]}

    def sweep(self, tables: np.ndarray, parent: np.ndarray, totals: Totals, rng: np.random.Generator) -> np.ndarray:
        """Draw the tables of all pairs anew."""
        back = STRENGTH + totals.discount * self.with_hot(self.tables_of(tables), totals.hot_tables)
        return seat(self.customers, back[self.context] * parent, totals.discount, rng)


def _made(schema: str, **columns: list) -> pa.Table:
    """A table of the columns given, null where one is not."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]
    size = len(next(iter(columns.values())))
    return pa.table([pa.array(columns.get(n, [None] * size), k) for n, k in fields], schema=pa.schema(fields))


_SENT = "part long, home long, dish binary, sent binary, sums array<double>"


def _first_pass(parts: int, hot: np.ndarray):
    """Counts of a part, and what it sends to the parent with one table for each pair."""

    def run(rows: pa.Table) -> pa.Table:
        part, me = Part(rows, parts, hot), rows.column("part")[0].as_py()
        tables = (part.customers > 0).astype(float)
        count = part.count[~part.is_hot]
        sums = _sums(
            hot, {0: part.of_hot(part.count), 1: part.of_hot(part.tables_of(tables))},
            tokens=part.count.sum(), words=(count > 0).sum(), p1=(part.customers == 1).sum(), p2=(part.customers == 2).sum(),
            w1=(count == 1).sum(), w2=(count == 2).sum(),
        )
        out = part.sent(tables)
        return pa.concat_tables([_made(_SENT, part=[me] * len(out["home"]), **out), _made(_SENT, sums=[sums])])

    return run


def _gathered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Words of a home with the customers sent to them, the place of every word of every row, and sizes of rows."""
    dishes = [_unshort(b) for b in rows.column("dish").to_pylist()]
    dish, at = np.unique(np.concatenate([*dishes, np.zeros(0, U)]), return_inverse=True)
    sent = np.concatenate([*(_unplanes(b, np.float32) for b in rows.column("sent").to_pylist()), np.zeros(0, np.float32)])
    return dish, np.bincount(at, sent, len(dish)), at, [len(d) for d in dishes]


_REPLY = "part long, home long, own binary, sums array<double>"


def _parent_pass(totals: Totals):
    """Tables of the parent restaurant, and the customers less the discount as replies to the parts."""

    def run(rows: pa.Table) -> pa.Table:
        me = rows.column("home")[0].as_py()
        _, sent, at, sizes = _gathered(rows)
        rng = np.random.default_rng((SEED, 1, me))
        top = seat(sent, np.full(len(sent), STRENGTH / (totals.words + 1) + totals.top_discount), totals.top_discount, rng)
        own = (sent - totals.top_discount * top).astype(np.float32)[at]
        cut = np.cumsum([0, *sizes])
        replies = [_planes(own[cut[k] : cut[k + 1]]) for k in range(len(sizes))]
        sums = _sums(totals.hot, {}, top_tables=top.sum(), top_customers=sent.sum())
        made = _made(_REPLY, part=rows.column("part").to_pylist(), home=[me] * len(sizes), own=replies)
        return pa.concat_tables([made, _made(_REPLY, sums=[sums])])

    return run


_DRAWN = _SENT + ", block long, own binary, back binary, count binary"


def _second_pass(totals: Totals):
    """Averages over sweeps under the parent, as answers to the blocks, and what the parts then send to it."""

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(rows):
            return _made(_DRAWN, part=[])
        part, me = Part(rows, totals.parts, totals.hot), rows.column("part")[0].as_py()
        own = np.concatenate([_unplanes(b, np.float32) for b in replies.sort_by("home").column("own").to_pylist()])
        # a pair's own customer in the parent does not count for the draw of its tables
        mine = own.astype(np.float64)[part.dish_of_pair]
        parent = totals.parent(np.maximum(mine - (part.customers > 0), 0))
        rng = np.random.default_rng((SEED, 2, me))
        tables = (part.customers > 0).astype(float)
        mean = np.zeros(len(tables))
        for k in range(BURN_IN + SAMPLES):
            tables = part.sweep(tables, parent, totals, rng)
            if k >= BURN_IN:
                mean += tables / SAMPLES
        count = part.with_hot(part.count, totals.hot_count)
        kept = ((part.customers - totals.discount * mean) / (STRENGTH + count[part.context])).astype(np.float32)
        back = totals.back(part.tables_of(mean), count).astype(np.float32)
        out = {"block": [], "own": [], "back": [], "count": []}
        word_at = pair_at = 0
        for block, n, m in zip(rows.column("block").to_pylist(), part.word_sizes, part.pair_sizes):
            word, pair = part.word_of_row[word_at : word_at + n], part.merged[pair_at : pair_at + m]
            word = word[~part.is_hot[word]]
            word_at, pair_at = word_at + n, pair_at + m
            for name, value in zip(out, (block, _told_as(kept[pair]), _told_as(back[word]), _planes(part.count[word].astype(np.int64)))):
                out[name].append(value)
        sent = part.sent(mean)
        sums = _sums(totals.hot, {1: part.of_hot(part.tables_of(mean))})
        return pa.concat_tables([
            _made(_DRAWN, part=[me] * len(out["block"]), **out), _made(_DRAWN, part=[me] * len(sent["home"]), **sent), _made(_DRAWN, sums=[sums])
        ])

    return run


_PARENT = "block long, part long, parent binary, sums array<double>"


def _final_parent(totals: Totals):
    """Numbers of words in the parent under the averaged tables, as answers to the blocks."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        me = (asked.column("part") if len(asked) else rows.column("home"))[0].as_py()
        dish, sent, _, _ = _gathered(rows)
        rng = np.random.default_rng((SEED, 3, me))
        top = np.zeros(len(sent))
        for _ in range(SAMPLES):
            whole = np.floor(sent + rng.random(len(sent)))
            top += seat(whole, np.full(len(sent), totals.uniform()), totals.top_discount, rng) / SAMPLES
        top = np.minimum(top, sent)
        number = np.append(sent - totals.top_discount * top, 0)

        def of(words: np.ndarray) -> np.ndarray:
            low = words & _LOW
            at = np.searchsorted(dish, low)
            found = at < len(dish)
            found[found] = dish[at[found]] == low[found]
            return number[np.where(found, at, len(dish))]

        answers = []
        for raw in asked.column("word").to_pylist():
            answers.append(_told_as(of(np.frombuffer(raw, U))))
        here = part_of(totals.hot, totals.parts) == me
        sums = _sums(totals.hot, {2: np.where(here, of(totals.hot), 0)}, top_tables=top.sum(), top_customers=sent.sum())
        made = _made(_PARENT, block=asked.column("block").to_pylist(), part=[me] * len(answers), parent=answers)
        return pa.concat_tables([made, _made(_PARENT, sums=[sums])])

    return run


def _summed(rows: DataFrame, hot: np.ndarray) -> np.ndarray:
    """The sums of all parts: a few scalars, and three numbers for each hot word."""
    values = np.zeros(len(_SCALARS) + _OF_HOT * len(hot))
    for r in rows.filter("sums is not null").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():
        values[r.k] = r.v
    return values


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _told(t: Tokens, answers: pa.Table, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens of the words of a block, and probabilities of its pairs."""
    answers = answers.sort_by("part")

    def told(name: str, kind: type) -> np.ndarray:
        return np.concatenate([*(_unplanes(b, kind) for b in answers.column(name).to_pylist() if b is not None), np.zeros(0, kind)]).astype(np.float64)

    def of_words(name: str, kind: type, hot: np.ndarray) -> np.ndarray:
        out = np.empty(len(t.word))
        out[~t.hot], out[t.hot] = told(name, kind), hot[np.searchsorted(totals.hot, t.word[t.hot])]
        return out

    count = of_words("count", np.int64, totals.hot_count)
    back = of_words("back", np.float32, totals.back(totals.hot_tables, totals.hot_count))
    parent = totals.parent(of_words("parent", np.float32, totals.hot_parent))
    return count, told("own", np.float32) + back[t.context] * parent[t.second]


def _scorer(totals: Totals):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not len(blocks):
            return schema.empty_table()
        table = opened(blocks.column("texts")[0].as_py())
        t = Tokens(table, totals.parts, totals.hot)
        count, probability = _told(t, answers, totals)
        base, score = np.log10((count + 1) / (totals.tokens + totals.words + 1)), np.log10(probability)
        n = len(table)
        return pa.table(
            [
                table.column("doc_id"), table.column("held"), np.bincount(t.doc, minlength=n), np.bincount(t.doc, (count > 0)[t.token], n).astype(np.int64),
                np.full(n, int(totals.tokens)), np.bincount(t.doc, base[t.token], n), np.bincount(t.doc, score[t.pair], n),
            ],
            schema=schema,
        )

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _held(doc_id).alias("held"), F.col(text).cast("string").alias("text"))
    blocks = stored(picked.mapInArrow(to_blocks_of(BLOCK_BYTES), "block long, bytes long, texts binary"), "lm-blocks")
    parts = parts_for(blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0], PART_BYTES, 4)
    hot = hot_words(blocks, min(HOT_MOST, max(HOT_LEAST, parts // 4)))
    texts = blocks.select("block", "texts")
    # made anew from the stored blocks where it is needed, as it is as large as the texts
    asked = texts.mapInArrow(_asker(parts, hot), _ASK).groupBy("part")
    with scratch() as passing:
        with scratch() as sending:
            sent = stored(asked.applyInArrow(_first_pass(parts, hot), _SENT), "lm-sent")
            totals = Totals(hot, _summed(sent, hot), parts)
            homes = sent.filter("home is not null").select("part", "home", "dish", "sent").groupBy("home")
            replies = stored(homes.applyInArrow(_parent_pass(totals), _REPLY), "lm-replies", outlives=True)
        remove(docs.sparkSession, sending)
        totals.take_parent(_summed(replies, hot))
        sides = replies.filter("home is not null").select("part", "home", "own").groupBy("part")
        drawn = stored(asked.cogroup(sides).applyInArrow(_second_pass(totals), _DRAWN), "lm-drawn", outlives=True)
        totals.take_tables(_summed(drawn, hot))
        homes = drawn.filter("home is not null").select("home", "dish", "sent").groupBy("home")
        words = texts.mapInArrow(_lister(parts, hot), "block long, part long, word binary").groupBy("part")
        parents = stored(words.cogroup(homes).applyInArrow(_final_parent(totals), _PARENT), "lm-parents", outlives=True)
    remove(docs.sparkSession, passing)
    totals.take_parent(_summed(parents, hot))
    sides = drawn.filter("block is not null").select("block", "part", "own", "back", "count", F.lit(None).cast("binary").alias("parent"))
    sides = sides.unionByName(parents.filter("block is not null").select("block", "part", "parent"), allowMissingColumns=True)
    return texts.groupBy("block").cogroup(sides.groupBy("block")).applyInArrow(_scorer(totals), _SCORE)
