"""Repeated byte strings over a corpus, found with run-length compressed indexes.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a document with
a smaller id is removed.

A window of ``LENGTH`` bytes is represented by its anchor: the least hashed string of ``GRAM``
bytes in it, so equal windows have equal anchors, and neighbouring windows with one anchor form
a context.  Anchors are long, as texts share short strings by chance, the more the larger the
input.  Texts lie in blocks of bounded size, which ask parts (by hash of the anchor) in
three rounds, with one packed row for each block and part: which anchors occur in two
documents; for contexts of those, whether a least document with the very same context is here,
and whether the anchor has other contexts; and, for the first occurrences of such contexts
only, their bytes.  For these a part builds a run-compressed Burrows-Wheeler transform with
sampled run ends and streams every context through it from right to left; a window's match is the
interval of rows that share its ``LENGTH`` bytes, and the least document of the interval says
whether it is a repeat.  An anchor with more strings than an index holds is cut by longer anchors.  A passage that is copied a thousand times is one context with
one least document, never a group of a thousand.

Defined results: null text is empty; a null id counts as larger than all others; rows with
equal ids do not repeat each other; texts shorter than ``LENGTH`` keep all bytes; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.blocks import opened, to_blocks_of
from wardflow.llm.common import parts_for, stored
from wardflow.llm.octets import SLICE_BYTES, U, Texts, mix, slices

LENGTH = 50
GRAM = 32
PART_BYTES = 8 << 20
#: Blocks are smaller than those of other operators, as their contexts are held in memory.
TEXT_BYTES = 10 << 20
INDEX_BYTES = 512 << 10
LARGEST = 2**63 - 1
#: Anchors are hashes of so many bits, so that they sort together with their places; those that agree by chance are only asked for once more.
ANCHOR_BITS = 40
_PLACE_BITS = U(28)
_PLACE = U((1 << 28) - 1)


def _stretches(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of stretches of ``n`` items each, one stretch after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


# The run-length index


#: Symbols that are ranked at once at first, and masks that keep the first 0 to 4 of them.
_FIRST = 4
_HEAD = np.array([((1 << 9 * k) - 1) << 9 * (_FIRST - k) for k in range(_FIRST + 1)], np.uint64)


def _changes(ordered: np.ndarray) -> np.ndarray:
    """Where an item differs from the one before."""
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return new


def _sorted(key: np.ndarray, limit: int = 1 << 64) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys below ``limit``, equal ones by place, and where a key differs from the one before."""
    bits = U(max(1, int(len(key)).bit_length()))
    if limit << int(bits) <= 1 << 64:  # key and place in one word sort faster than places by key
        both = np.sort((key.astype(U) << bits) | np.arange(len(key), dtype=U))
        ordered, order = both >> bits, (both & ((U(1) << bits) - U(1))).astype(np.int64)
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    return order, _changes(ordered)


def _ranked(key: np.ndarray, limit: int) -> np.ndarray:
    """Dense ranks from 0."""
    order, new = _sorted(key, limit)
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of many short strings, sorted by ``LENGTH`` symbols.

    Symbols are bytes plus one; 0 stands for the place before a string's start.
    Kept are the heads and starts of runs, the counts that map a row to the row of the
    preceding symbol, and for every interval of rows with equal ``LENGTH`` symbols a value.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, value: np.ndarray):
        # every string ends in an empty suffix, which sorts first and has a row of its own
        strings = len(offsets) - 1
        begin = offsets[:-1] + np.arange(strings)
        end = offsets[1:] + np.arange(strings)
        owner = np.repeat(np.arange(strings), end - begin + 1)
        symbols = np.zeros(len(data) + strings + LENGTH, np.uint64)
        filled = np.ones(len(owner), dtype=bool)
        filled[end] = False
        symbols[: len(owner)][filled] = data.astype(np.uint64) + U(1)
        place, stop = np.arange(len(owner)), end[owner]
        # rank by few symbols, those after a string's end being 0; then by twice as many, and at last by LENGTH
        word = np.zeros(len(owner), np.uint64)
        for j in range(_FIRST):
            word = (word << U(9)) | symbols[j : j + len(owner)]
        rank = _ranked(word & _HEAD[np.minimum(stop - place, _FIRST)], 1 << 9 * _FIRST)
        span, limit = _FIRST, len(owner) ** 2
        while 2 * span < LENGTH:
            rank = _ranked(rank * len(owner) + rank[np.minimum(place + span, stop)], limit)
            span *= 2
        suffixes, new = _sorted(rank * len(owner) + rank[np.minimum(place + LENGTH - span, stop)], limit)
        self.interval = np.flatnonzero(new)
        #: Of every row its interval and its run.
        self.interval_of = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.least = np.minimum.reduceat(value[owner[suffixes]], self.interval)
        before = np.where(suffixes == begin[owner[suffixes]], U(0), symbols[suffixes - 1]).astype(np.int64)
        new = _changes(before)
        self.start = np.flatnonzero(new)
        self.run_of = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.head = before[self.start]
        self.size = np.diff(np.append(self.start, len(before)))
        # rows that begin with a symbol come after the empty suffixes and all smaller symbols
        count = np.bincount(data.astype(np.int64) + 1, minlength=258)
        self.base = strings + np.cumsum(count) - count
        self.by_head = np.argsort(self.head, kind="stable")
        head_from = np.searchsorted(self.head[self.by_head], np.arange(258))
        running = np.cumsum(self.size[self.by_head]) - self.size[self.by_head]
        self.earlier = np.empty(len(self.start), np.int64)
        self.earlier[self.by_head] = running - running[head_from[self.head[self.by_head]]]
        self.keys = self.head[self.by_head] * (len(self.start) + 1) + self.by_head

    def step(self, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The rows of ``symbol`` followed by what ``row`` stands for.

        Where the run of a row has another head, its interval also reaches into the
        nearest run of the symbol, above or below, and the step starts at that run's end.
        """
        run = self.run_of[row]
        other = np.flatnonzero(self.head[run] != symbol)
        if len(other):
            r, s = run[other], symbol[other]
            # place of the next run with this head among all runs with it
            below = np.searchsorted(self.keys, s * (len(self.start) + 1) + r)
            down = self.by_head[np.minimum(below, len(self.keys) - 1)]
            up = self.by_head[np.maximum(below - 1, 0)]
            up_row = self.start[up] + self.size[up] - 1
            ok_up = (self.head[up] == s) & (up < r) & (self.interval_of[up_row] == self.interval_of[row[other]])
            run[other] = np.where(ok_up, up, down)
            row = row.copy()
            row[other] = np.where(ok_up, up_row, self.start[down])
        return self.base[symbol] + self.earlier[run] + row - self.start[run]


def least_values(data: np.ndarray, offsets: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For every window of every string the least value of a string that holds it; windows in order."""
    index = RunIndex(data, offsets, value)
    length = np.diff(offsets)
    windows = np.maximum(length - LENGTH + 1, 0)
    first = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), value.dtype)
    row, at = np.arange(len(length)), length.copy()  # the rows of the empty suffixes
    live = np.arange(len(length))
    while len(live):
        match = live[(length[live] - at[live] >= LENGTH)]
        out[first[match] + at[match]] = index.least[index.interval_of[row[match]]]
        live = live[at[live] > 0]
        symbol = data[offsets[:-1][live] + at[live] - 1].astype(np.int64) + 1
        row[live] = index.step(row[live], symbol)
        at[live] -= 1
    return out


def least_by_anchor(data: np.ndarray, length: np.ndarray, anchor: np.ndarray, value: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """As ``least_values``, with an index for every stretch of anchors that holds about ``INDEX_BYTES``.

    Windows of different anchors are different, so an index need not hold both.  Where an anchor
    of ``gram`` bytes has so many strings that its stretch is larger, longer anchors cut it.
    """
    start = np.cumsum(length) - length
    windows = length - LENGTH + 1
    first = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), value.dtype)
    order, new = _sorted(anchor)
    edge = np.flatnonzero(new)
    chunk = (np.cumsum(length[order])[edge] - length[order][edge]) // INDEX_BYTES
    at = edge[np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))]
    for low, high in zip(at, np.append(at[1:], len(order))):
        mine = order[low:high]
        n = length[mine]
        strings, offsets = data[_stretches(start[mine], n)], np.concatenate([[0], np.cumsum(n)])
        if offsets[-1] > 2 * INDEX_BYTES and gram < LENGTH - 1:
            found = _least_by_longer(strings, offsets, value[mine], (gram + LENGTH) // 2)
        else:
            found = least_values(strings, offsets, value[mine])
        out[_stretches(first[mine], windows[mine])] = found
    return out


def _least_by_longer(data: np.ndarray, offsets: np.ndarray, value: np.ndarray, gram: int) -> np.ndarray:
    """As ``least_values``, by the contexts of anchors of ``gram`` bytes, equal ones once."""
    anchors, hashes, owners, starts, lengths = [], [], [], [], []
    low = 0
    while low < len(value):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1)
        t = Texts(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        anchor, context, owner, start, last = _contexts(t, gram)
        anchors.append(anchor)
        hashes.append(context)
        owners.append(low + owner)
        starts.append(offsets[low] + start)
        lengths.append(last + LENGTH - start)
        low = high
    context, start, length = np.concatenate(hashes), np.concatenate(starts), np.concatenate(lengths)
    order, first, group = _groups(*_sorted(context))
    one = order[first]
    least = np.minimum.reduceat(value[np.concatenate(owners)[order]], first)
    found = least_by_anchor(data[_stretches(start[one], length[one])], length[one], np.concatenate(anchors)[one], least, gram)
    windows = length - LENGTH + 1
    place = np.cumsum(windows[one]) - windows[one]
    return found[_stretches(place[group], windows)]


# Anchors and contexts of a block


class Contexts:
    """The contexts of all texts of a block: runs of windows with one anchor."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").fill_null(LARGEST).to_numpy()
        self.parts: list[tuple] = []
        anchors, hashes, docs, starts, lasts, places = [], [], [], [], [], []
        self.slices: list[tuple[int, int, Texts]] = []
        for low, high, t in slices(table.column("text")):
            self.slices.append((low, high, t))
            anchor, context, owner, start, last = _contexts(t)
            anchors.append(anchor)
            hashes.append(context)
            docs.append(ids[low + owner])
            starts.append(start)
            lasts.append(last)
            places.append(np.full(len(start), len(self.slices) - 1))
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.anchor, self.context = join(anchors, U), join(hashes, U)
        self.doc, self.start, self.last, self.slice = join(docs, np.int64), join(starts, np.int64), join(lasts, np.int64), join(places, np.int64)

    def bytes_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of chosen contexts one after another, and their lengths."""
        length = self.last[which] + LENGTH - self.start[which]
        out = np.empty(int(length.sum()), np.uint8)
        ends = np.cumsum(length)
        for k, (_, _, t) in enumerate(self.slices):
            mine = np.flatnonzero(self.slice[which] == k)
            out[_stretches((ends - length)[mine], length[mine])] = t.data[_stretches(self.start[which][mine], length[mine])]
        return out, length


def _contexts(t: Texts, size: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor of ``size`` bytes, hash, text, first and last window of every context, in order."""
    none = np.zeros(0, np.int64)
    if np.diff(t.offsets).max(initial=0) < LENGTH:
        return none.astype(U), none.astype(U), none, none, none
    prefix = t.prefix_hash()
    gram = t.equal_span_hash(prefix, size)
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=U)
    reach, width = LENGTH - size + 1, 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if reach > width:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    # a place of its own is where a window has another anchor than the one before, and where windows of a text begin or end
    new = _changes(least)
    new[t.offsets[:-1][t.offsets[:-1] < len(new)]] = True
    stop = t.offsets[1:] - LENGTH + 1
    new[stop[(stop >= t.offsets[:-1]) & (stop < len(new))]] = True
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(new)) - 1
    owner = np.searchsorted(t.offsets, s, "right") - 1
    whole = s < stop[owner]
    s, e, owner = s[whole], e[whole], owner[whole]
    a = (least[s] & _PLACE).astype(np.int64)
    return mix(gram[a]) >> U(64 - ANCHOR_BITS), mix(t.span_hash(prefix, s, e + LENGTH) + (a - s).astype(U)), owner, s, e


def _groups(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, first places of groups in that order, and the group of every item."""
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def part_of(anchor: np.ndarray, parts: int) -> np.ndarray:
    """Parts are stretches of the anchors' upper bits, so ordered anchors have ordered parts."""
    return (((anchor >> U(ANCHOR_BITS - 32)) * U(parts)) >> U(32)).astype(np.int64)


def _short(anchor: np.ndarray) -> np.ndarray:
    return (anchor & U(0xFFFFFFFF)).astype(np.uint32)


def _cuts(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal parts of an ordered array."""
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
    for p, a, b in zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(part)]):
        yield p, slice(a, b)


def _reduced(how: np.ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return how.reduceat(values, first) if len(first) else values[:0]


class Asked:
    """What a block asks in each round, in the order in which answers come back."""

    def __init__(self, table: pa.Table, parts: int):
        self.table, self.parts = table, parts
        self.c = Contexts(table)
        self.order, new = _sorted(self.c.anchor, 1 << ANCHOR_BITS)
        self.first = np.flatnonzero(new)
        distinct = self.c.anchor[self.order[self.first]]
        self.anchor_part, self.anchor_short = part_of(distinct, parts), _short(distinct)

    def several(self) -> np.ndarray:
        """First round: which anchors are in two documents of this block."""
        doc = self.c.doc[self.order]
        return _reduced(np.minimum, doc, self.first) != _reduced(np.maximum, doc, self.first)

    def repeated(self, bits: np.ndarray) -> None:
        """Second round: contexts whose anchor is repeated."""
        w = self.which = np.sort(self.order[np.repeat(bits, np.diff(np.append(self.first, len(self.order))))])
        anchor, doc = self.c.anchor[w], self.c.doc[w]
        part = part_of(anchor, self.parts)
        order, _ = _sorted(self.c.context[w])
        order = order[np.argsort(part[order].astype(np.uint16) if self.parts < 1 << 16 else part[order], kind="stable")]
        order, first, self.group = _groups(order, _changes(self.c.context[w][order]))
        # equal contexts have equal bytes, so any of them stands for all
        self.sample = w[order[first]]
        self.part, self.short, self.context = part[order[first]], _short(anchor[order[first]]), self.c.context[self.sample]
        self.doc = _reduced(np.minimum, doc[order], first)

    def undecided(self, begins: np.ndarray, open_: np.ndarray) -> None:
        """Third round: contexts whose least document is here and whose anchor has others."""
        self.begins = begins
        self.open = np.flatnonzero(open_ & begins)


def _received(answers: pa.Table, round_: int, column: str, sizes: list[int]) -> np.ndarray:
    """The bits that the parts answered, ``sizes`` of them each."""
    mine = answers.filter(pa.compute.equal(answers.column("round"), round_)).sort_by("part")
    blobs = mine.column(column).to_pylist()
    return np.concatenate([np.zeros(0, bool), *(_bits(b, n) for b, n in zip(blobs, sizes, strict=True))])


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).view(bool)


def _sizes(part: np.ndarray) -> list[int]:
    return [s.stop - s.start for _, s in _cuts(part)]


def _told(blocks: pa.Table, answers: pa.Table, parts: int) -> tuple[int, Asked]:
    """A block with the answers of all rounds so far."""
    asked = Asked(opened(blocks.column("texts")[0].as_py()), parts)
    rounds = set(answers.column("round").to_pylist())
    asked.repeated(_received(answers, 1, "one", _sizes(asked.anchor_part)) if 1 in rounds else np.zeros(len(asked.anchor_part), bool))
    if 2 in rounds:
        asked.undecided(*(_received(answers, 2, column, _sizes(asked.part)) for column in ("one", "two")))
    else:
        asked.undecided(np.ones(len(asked.doc), bool), np.zeros(len(asked.doc), bool))
    return blocks.column("block")[0].as_py(), asked


_ROW = "block long, part long, round int, one binary, two binary, three binary"
_ROW_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("round", pa.int32()), ("one", pa.binary()), ("two", pa.binary()), ("three", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(_ROW_SCHEMA)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, _ROW_SCHEMA)], schema=_ROW_SCHEMA)


def _ask_anchors(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                a = Asked(opened(texts.as_py()), parts)
                several = a.several()
                rows = [(block, p, 1, a.anchor_short[s].tobytes(), _packed(several[s]), None) for p, s in _cuts(a.anchor_part)]
                yield from _rows(rows).to_batches()

    return run


def _answer_anchors(rows: pa.Table) -> pa.Table:
    short = [np.frombuffer(b, np.uint32) for b in rows.column("one").to_pylist()]
    several = [_bits(b, len(s)) for b, s in zip(rows.column("two").to_pylist(), short)]
    order, first, group = _groups(*_sorted(np.concatenate(short), 1 << 32))
    flag = (np.diff(np.append(first, len(order))) > 1) | np.logical_or.reduceat(np.concatenate(several)[order], first)
    bits = np.split(flag[group], np.cumsum([len(s) for s in short])[:-1])
    part = rows.column("part")[0].as_py()
    return _rows([(b, part, 1, _packed(x), None, None) for b, x in zip(rows.column("block").to_pylist(), bits)])


def _ask_contexts(parts: int):
    def run(_: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(blocks):
            return _rows([])
        block, a = _told(blocks, answers, parts)
        return _rows([(block, p, 2, a.short[s].tobytes(), a.context[s].tobytes(), a.doc[s].tobytes()) for p, s in _cuts(a.part)])

    return run


def _answer_contexts(rows: pa.Table) -> pa.Table:
    read = lambda name, kind: [np.frombuffer(b, kind) for b in rows.column(name).to_pylist()]
    anchor, contexts, doc = np.concatenate(read("one", np.uint32)), read("two", np.uint64), np.concatenate(read("three", np.int64))
    order, first, group = _groups(*_sorted(np.concatenate(contexts)))
    begins = doc == np.minimum.reduceat(doc[order], first)[group]
    # contexts of one anchor, by the first of each
    _, other, of = _groups(*_sorted(anchor[order[first]], 1 << 32))
    open_ = (np.diff(np.append(other, len(first))) > 1)[of][group]
    cut = np.cumsum([len(c) for c in contexts])[:-1]
    part = rows.column("part")[0].as_py()
    pairs = zip(np.split(begins, cut), np.split(open_, cut))
    return _rows([(b, part, 2, _packed(x), _packed(y), None) for b, (x, y) in zip(rows.column("block").to_pylist(), pairs)])


def _ask_bytes(parts: int):
    def run(_: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(blocks):
            return _rows([])
        block, a = _told(blocks, answers, parts)
        rows = []
        for p, s in _cuts(a.part[a.open]):
            data, length = a.c.bytes_of(a.sample[a.open[s]])
            head = np.concatenate([length.astype(np.uint32), a.short[a.open[s]]])
            rows.append((block, p, 3, data.tobytes(), head.tobytes(), a.doc[a.open[s]].tobytes()))
        return _rows(rows)

    return run


def _answer_bytes(rows: pa.Table) -> pa.Table:
    read = lambda name, kind: [np.frombuffer(b, kind) for b in rows.column(name).to_pylist()]
    heads = read("two", np.uint32)
    length = [h[: len(h) // 2].astype(np.int64) for h in heads]
    anchor = np.concatenate([h[len(h) // 2 :] for h in heads])
    data, value = np.concatenate(read("one", np.uint8)), np.concatenate(read("three", np.int64))
    every = np.concatenate(length)
    earlier = least_by_anchor(data, every, anchor, value) < np.repeat(value, every - LENGTH + 1)
    cut = np.cumsum([int((n - LENGTH + 1).sum()) for n in length])[:-1]
    part = rows.column("part")[0].as_py()
    return _rows([(b, part, 3, _packed(x), None, None) for b, x in zip(rows.column("block").to_pylist(), np.split(earlier, cut))])


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _mark(parts: int, digest: bool):
    def run(_: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
        if not len(blocks):
            return pa.schema(kinds).empty_table()
        _, a = _told(blocks, answers, parts)
        c, w = a.c, a.which
        # windows of repeats of a context, all of them; then those windows of first occurrences that were found elsewhere
        windows = c.last - c.start + 1
        first = a.begins[a.group] & (c.doc[w] == a.doc[a.group])
        again = w[~first]
        n = windows[a.sample[a.open]]
        found = _received(answers, 3, "one", [int(n[s].sum()) for _, s in _cuts(a.part[a.open])])
        place_of = np.full(len(a.part), -1)
        place_of[a.open] = np.cumsum(n) - n
        place = place_of[a.group]
        begun = first & (place >= 0)
        n = windows[w[begun]]
        earlier = found[_stretches(place[begun], n)]
        some_slice, some_start = np.repeat(c.slice[w[begun]], n)[earlier], _stretches(c.start[w[begun]], n)[earlier]
        out = {name: [] for name, _ in kinds}
        for k, (low, high, t) in enumerate(c.slices):
            edge = np.zeros(len(t.data) + 1, np.int64)
            mine = again[c.slice[again] == k]
            np.add.at(edge, c.start[mine], 1)
            np.add.at(edge, c.last[mine] + LENGTH, -1)
            single = some_start[some_slice == k]
            np.add.at(edge, single, 1)
            np.add.at(edge, single + LENGTH, -1)
            gone = np.cumsum(edge)[:-1] > 0
            spans = t.runs(gone)[2]
            removed = t.sums(gone)
            for i in range(t.count):
                lo, hi = t.offsets[i], t.offsets[i + 1]
                kept = (t.data[lo:hi] if not removed[i] else t.data[lo:hi][~gone[lo:hi]]).tobytes()
                values = (a.table.column("doc_id")[low + i].as_py(), int(hi - lo), int(removed[i]), int(spans[i]), hashlib.sha256(kept).digest() if digest else kept)
                for name, value in zip(out, values):
                    out[name].append(value)
        return pa.table(out, schema=pa.schema(kinds))

    return run


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row; ``kept`` is what is left, or its SHA-256."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(0).alias("unused"), F.col(text).cast("string").alias("text"))
    blocks = stored(picked.mapInArrow(to_blocks_of(TEXT_BYTES), "block long, bytes long, texts binary"), "repeat-blocks")
    parts = parts_for(blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0], PART_BYTES, 4)
    texts = blocks.select("block", "texts")
    by_block = lambda answers: texts.groupBy("block").cogroup(answers.groupBy("block"))
    asked = texts.mapInArrow(_ask_anchors(parts), _ROW)
    answers = stored(asked.groupBy("part").applyInArrow(_answer_anchors, _ROW), "repeat-anchors")
    asked = by_block(answers).applyInArrow(_ask_contexts(parts), _ROW)
    answers = answers.union(stored(asked.groupBy("part").applyInArrow(_answer_contexts, _ROW), "repeat-contexts"))
    asked = by_block(answers).applyInArrow(_ask_bytes(parts), _ROW)
    answers = answers.union(stored(asked.groupBy("part").applyInArrow(_answer_bytes, _ROW), "repeat-bytes"))
    return by_block(answers).applyInArrow(_mark(parts, digest), _RESULT)
