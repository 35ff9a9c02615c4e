"""Line dedup by an exact set-similarity join of the words of lines.

A line is the set of its words.  Words are ordered by rarity: how often the bucket of
their hash occurs in all lines.  Two lines match when their Jaccard similarity is at least
4/5; then they share a word among the first ``n - ceil(4n/5) + 1`` of each, which is
the join key, together with a class of sizes.  Length, position and a parity bitmap of the
difference bound the overlap before the words themselves are compared, with the nearest
earlier set first.  A line is removed if a line at an earlier position (document id, line
number) matches it.  Large tables are joined in passes over the keys, to bound what lies on disk.

Equal word sets are joined as one.  To keep large groups of near copies from becoming
all pairs, sets are first compared only with the earliest set of their groups (sets
that share a hashed prefix word), in turns over those that have not matched yet; what is
matched there needs no further partner, and only the rest is joined with all earlier sets.

Defined results: null text has no lines and stays null; lines without words are kept
and never match; null ids come first; repeated rows have one position and get equal
results; an empty table gives an empty table.  Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.llm.common import SEPARATORS, aside, passes, remove, scratch, sieve, stored

RARITY_BITS = 16
#: Sets of more words have a parity bitmap of 128 bits, others one of 64.
LARGE = 48
#: Most hashes that are broadcast, about 64 MB.
BROADCAST_ROWS = 2_000_000
GROUP_KEYS = 3
#: Turns of leaders at most, and the sets, also as a share of all, that one must find for another to follow.
TURNS, LEAST_FOUND, LEAST_SHARE = 6, 500, 0.05
#: Sizes whose ratio is below this (5/4 to the fourth) are mostly of one class, and sets only meet inside a class.
CLASS_RATIO = 2.44140625
#: The exact join is done in so many passes over the words from this number of sets on, so that few of its rows lie on disk at once.
PASSES, PASS_SETS = 4, 100_000
_BLANKS = " \t\x0b\x0c\r"
#: What makes splitting at single spaces differ from splitting at separators.
_ODD = "[\t\x0b\x0c\r]|  "

_PARITY = "aggregate({words}, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 AS int)))"
_MARKS = ["mark0", "mark1"]
#: The first line of a set in their order, which names the set.
_AT = ["doc", "uid", "line"]
_LATER, _EARLIER = ["lu", "ll"], ["eu", "el"]


def _words(line: Column) -> Column:
    """Words of a line that has some."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(bare.rlike(_ODD), F.split(bare, SEPARATORS)).otherwise(F.split(bare, " "))


def _identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with ``_uid``, which tells apart rows of equal id and different text."""
    return docs.withColumn("_uid", F.xxhash64("doc_id", text))


def _lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc, uid, line, content`` of every line with a word."""
    lines = docs.select(F.col("doc_id").alias("doc"), F.col("_uid").alias("uid"), F.posexplode(F.split(text, "\n")).alias("line", "content"))
    return lines.filter(F.btrim("content", F.lit(_BLANKS)) != "")


def _plain(text: str) -> Column:
    """The text with spaces in place of all other blanks but line ends."""
    odd = F.lit(False)
    for blank in _BLANKS[1:]:
        odd = odd | F.contains(text, F.lit(blank))
    return F.when(odd, F.translate(text, _BLANKS[1:], " " * len(_BLANKS[1:]))).otherwise(F.col(text))


def _rarity(docs: DataFrame, text: str) -> tuple[Column, int]:
    """A constant array and the rarity rank (0 to 63) that halves all words.

    The hash of a word, xor what the array has at its top bits, has the rank on top, and 57 bits of the hash below.
    Counted over all words; the table has one row per bucket, whatever the input.
    """
    words = docs.select(F.explode(F.split(F.replace(_plain(text), F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter("w <> ''")
    counts = words.groupBy(F.shiftrightunsigned(F.xxhash64("w"), 64 - RARITY_BITS).alias("b")).count()
    ranks, weights = {}, [0] * 64
    for r in counts.select("b", "count", F.least(F.round(2 * F.log2("count")), F.lit(63)).cast("long").alias("rank")).collect():
        ranks[r.b] = r.rank
        weights[r.rank] += r["count"]
    middle = next((i for i in range(64) if 2 * sum(weights[:i]) >= sum(weights)), 0)
    low = 64 - RARITY_BITS
    masks = (i << low ^ (ranks.get(i, 0) << 57 | i % (1 << 57 - low) << low) for i in range(1 << RARITY_BITS))
    return F.split(F.lit(",".join(str(x - (x >> 63 << 64)) for x in masks)), ",").cast("array<long>"), middle


def _sets(docs: DataFrame, text: str) -> DataFrame:
    """Every line as a word set: ``doc, uid, line, sig, n, mark0, mark1, prefix``."""
    mask, middle = _rarity(docs, text)
    lines = docs.select(F.col("doc_id").alias("doc"), F.col("_uid").alias("uid"), F.posexplode(F.split(_plain(text), "\n")).alias("line", "content"))
    lines = lines.filter(F.trim("content") != "")
    hashed = F.array_distinct(F.transform(F.split("content", " "), lambda w: F.xxhash64(w)))
    words = F.array_remove(hashed, F.xxhash64(F.lit("")))  # between two blanks
    placed = F.transform(words, lambda h: h.bitwiseXOR(mask[F.shiftrightunsigned(h, 64 - RARITY_BITS)]))
    keyed = lines.select("doc", "uid", "line", F.sort_array(placed).alias("k"))
    size = F.size("k")
    prefix = F.transform(F.slice("k", F.lit(1), size - F.ceil(size * 4 / 5).cast("int") + 1), lambda k: F.hash(k))
    # 64 bits tell little of large sets: these have 128, 64 for the rarer and 64 for the other words, which give the 64 of others when folded
    bound = f"{middle << 57}L"
    rarer = F.expr(f"cast(array_position(sort_array(array_append(k, {bound})), {bound}) AS int)")
    halves = ["slice(k, 1, rarer - 1)", "slice(k, rarer, size(k))"]
    return keyed.withColumn("rarer", F.when(size > LARGE, rarer)).select(
        "doc", "uid", "line", F.xxhash64("k").alias("sig"), size.alias("n"),
        F.when(size > LARGE, F.expr(_PARITY.format(words=halves[0]))).otherwise(F.expr(_PARITY.format(words="k"))).alias("mark0"),
        F.when(size > LARGE, F.expr(_PARITY.format(words=halves[1]))).otherwise(F.lit(0)).cast("long").alias("mark1"),
        prefix.alias("prefix"),
    )


def _verified(docs: DataFrame, text: str, pairs: DataFrame) -> DataFrame:
    """``uid, line`` of the later sets of ``pairs`` (with ``apart``, a bound of their difference) that match the earlier one.

    The nearest of the earlier sets is compared first, the others only where that one does not match.
    """
    pairs = stored(pairs.distinct(), "line-pairs")
    asked = stored(pairs.select(*_LATER).union(pairs.select(*_EARLIER)).distinct().toDF("uid", "line"), "line-places")
    near = _lines(docs.filter(passes(sieve(asked, "uid"), "_uid")), text).select("uid", "line", "content", F.xxhash64("uid", "line").alias("_at"))
    near = near.filter(passes(sieve(asked.select(F.xxhash64("uid", "line").alias("_at")), "_at"), "_at"))
    lines = near.select("uid", "line", "content").dropDuplicates(["uid", "line"])
    words = stored(asked.join(lines, ["uid", "line"]).select("uid", "line", F.array_distinct(_words(F.col("content"))).alias("w")), "line-words")

    def matched(some: DataFrame) -> DataFrame:
        met = some.join(words.toDF(*_LATER, "lw"), _LATER).join(words.toDF(*_EARLIER, "ew"), _EARLIER)
        same = F.size(F.array_intersect("lw", "ew"))
        return met.filter(9 * same >= 4 * (F.size("lw") + F.size("ew"))).select(*_LATER).distinct()

    nearest = pairs.groupBy(*_LATER).agg(F.min(F.struct("apart", *_EARLIER)).alias("e")).select(*_LATER, *[f"e.{c}" for c in _EARLIER])
    found = stored(matched(nearest), "line-nearest")
    others = pairs.join(nearest, [*_LATER, *_EARLIER], "left_anti").join(_small(found), _LATER, "left_anti")
    return found.union(matched(others)).toDF("uid", "line")


def _apart(n: Column, m: Column, one: list[Column], other: list[Column]) -> Column:
    """At most the number of words that are in one of two sets only, by their parity bitmaps."""
    wide = F.bit_count(one[0].bitwiseXOR(other[0])) + F.bit_count(one[1].bitwiseXOR(other[1]))
    folded = F.bit_count(one[0].bitwiseXOR(one[1]).bitwiseXOR(other[0]).bitwiseXOR(other[1]))
    return F.when((n > LARGE) & (m > LARGE), wide).otherwise(folded)


def _near_size(n: Column, m: Column) -> Column:
    return (5 * n >= 4 * m) & (5 * m >= 4 * n)


def _with_leaders(sets: DataFrame, turn: int) -> DataFrame:
    """Pairs of a set and the earliest set of one of its groups; every turn groups by other words.

    A group is read in order and only its first row is held, so it may be large.
    """
    mixed = F.slice(F.sort_array(F.transform("prefix", lambda t: F.hash(t, F.lit(turn)))), 1, GROUP_KEYS)
    rows = sets.select(F.explode(mixed).alias("g"), *_AT, "n", *_MARKS)
    window = Window.partitionBy("g").orderBy(*_AT)
    led = rows.withColumn("lead", F.first(F.struct("uid", "line", "n", *_MARKS)).over(window))
    n, m = F.col("n"), F.col("lead.n")
    apart = _apart(n, m, [F.col(x) for x in _MARKS], [F.col(f"lead.{x}") for x in _MARKS])
    fits = _near_size(n, m) & (9 * apart <= n + m) & ((F.col("uid") != F.col("lead.uid")) | (F.col("line") != F.col("lead.line")))
    return led.filter(fits).select(F.col("uid").alias("lu"), F.col("line").alias("ll"), F.col("lead.uid").alias("eu"), F.col("lead.line").alias("el"), apart.alias("apart"))


def _led(docs: DataFrame, text: str, sets: DataFrame) -> DataFrame:
    """``uid, line`` of sets that match the leader of a group, in turns over those that have not matched yet.

    A large group of near copies shrinks in every turn, so what the exact join is
    left with does not grow with the square of the group.  Turns end when one finds little.
    """
    done, still = None, sets
    for turn in range(TURNS):
        with scratch() as used:
            found = stored(_verified(docs, text, _with_leaders(still, turn)), "line-led", outlives=True)
        remove(docs.sparkSession, used)
        count = found.count()
        done = found if done is None else stored(done.union(found), "line-done")
        if count < max(LEAST_FOUND, LEAST_SHARE * sets.count()):
            break
        still = stored(sets.join(_small(done), ["uid", "line"], "left_anti"), "line-still")
    return done


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` of one hash, broadcast up to ``BROADCAST_ROWS``; more rows are left to a shuffle join."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _joined(sets: DataFrame, done: DataFrame) -> DataFrame:
    """Candidate pairs, of which the later set is not ``done``, by shared prefix word and class of sizes.

    Both sides are one and the same exchange.  A set meets the larger ones (of equal ones the later) by its
    first ``n / 9 + 1`` words, as at most a ninth of it is not in the other.  So where the next class
    is in reach, only these words are repeated there.
    """
    size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(CLASS_RATIO)) + 1e-9).cast("int")
    own, reach = size_class(F.col("n")), size_class(1.25 * F.col("n") + 1e-6)
    flagged = sets.select(*_AT, "n", *_MARKS, "prefix").join(_small(done.withColumn("_done", F.lit(True))), ["uid", "line"], "left")
    classed = flagged.withColumn("own", own).withColumn("class", F.explode(F.sequence(own, reach)))
    placed = classed.select("*", F.posexplode("prefix").alias("p", "w")).filter((F.col("class") == F.col("own")) | (9 * F.col("p") <= F.col("n")))
    # size, place, and whether it is done or a guest of the class, in one number
    packed = F.col("n").cast("long").bitwiseOR(F.shiftleft(F.col("p").cast("long"), 30))
    packed = packed.bitwiseOR(F.when(F.col("_done"), F.lit(1 << 60)).otherwise(F.lit(0))).bitwiseOR(F.when(F.col("class") != F.col("own"), F.lit(1 << 61)).otherwise(F.lit(0)))
    rows = placed.select(*_AT, *_MARKS, packed.alias("x"), F.hash("w", "class").alias("t"))
    turns = PASSES if sets.count() >= PASS_SETS else 1
    found = None
    for turn in range(turns):
        with scratch() as used:
            some = stored(_met(rows.filter(F.pmod("t", F.lit(turns)) == turn).repartition("t")).distinct(), "line-candidates", outlives=True)
        remove(sets.sparkSession, used)
        found = some if found is None else found.union(some)
    return found


def _met(rows: DataFrame) -> DataFrame:
    """Pairs of the rows that share ``t`` and may match: ``lu, ll, eu, el, apart``."""
    low = F.lit((1 << 30) - 1)
    # those that may lead are on the left and those at home on the right; a filter that is not deterministic
    # (here always true besides) stays above the exchange, so that both sides share it
    ahead = 9 * F.shiftright("x", 30).bitwiseAND(low) <= F.col("x").bitwiseAND(low)
    only = lambda which: F.when(which, F.spark_partition_id() >= 0).otherwise(False)
    a, b = rows.filter(only(ahead)).alias("a"), rows.filter(only(F.col("x") < (1 << 61))).alias("b")
    n, m = F.col("a.x").bitwiseAND(low), F.col("b.x").bitwiseAND(low)
    p, q = (F.shiftright(F.col(f"{side}.x"), 30).bitwiseAND(low) for side in "ab")
    done = {side: F.col(f"{side}.x").bitwiseAND(F.lit(1 << 60)) != 0 for side in "ab"}
    # with similarity 4/5 or more the overlap is at least 4/9 of both sizes, and the difference at most 1/9
    place = 9 * (1 + F.least(n - 1 - p, m - 1 - q)) >= 4 * (n + m)
    apart = _apart(n, m, [F.col(f"a.{x}") for x in _MARKS], [F.col(f"b.{x}") for x in _MARKS])
    first = F.struct(*[f"a.{c}" for c in _AT]) < F.struct(*[f"b.{c}" for c in _AT])
    leads = F.when((n < m) | (n == m) & first, 5 * n >= 4 * m).otherwise(False)
    open_ = F.when(first, ~done["b"]).otherwise(~done["a"])
    found = a.join(b, (F.col("a.t") == F.col("b.t")) & leads & place & (9 * apart <= n + m) & open_)
    ends = [F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")) for x, y in ("ba", "ab") for c in ("uid", "line")]
    return found.select(*[e.alias(c) for e, c in zip(ends, [*_LATER, *_EARLIER])], apart.alias("apart"))


def removed_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``uid, line`` of the lines to remove; ``docs`` has ``_uid``."""
    wide = stored(_sets(docs, text), "line-sets")
    # the first two of equal sets are kept, already before the exchange
    same = Window.partitionBy("sig", "n", *_MARKS)
    firsts = wide.withColumn("place", F.row_number().over(same.orderBy(*_AT))).filter("place <= 2")
    sets = firsts.withColumn("lines", F.count("*").over(same)).filter("place = 1").drop("place")
    sets = stored(sets, "line-distinct")
    with scratch() as used:
        led = _led(docs, text, sets)
        rest = _verified(docs, text, _joined(sets, led))
        matched = stored(led.union(rest), "line-matched", outlives=True).withColumn("_hit", F.lit(True))
    remove(docs.sparkSession, used)
    # sets of one line that match nothing need no decision
    decided = sets.join(_small(matched), ["uid", "line"], "left").filter("_hit is not null or lines > 1").select("sig", F.struct(*_AT).alias("first"), "_hit")
    decided = stored(decided, "line-decided")
    lines = wide.filter(passes(sieve(decided, "sig"), "sig")).select("sig", F.struct(*_AT).alias("at"))
    gone = lines.join(decided, "sig").filter(F.col("_hit").isNotNull() | (F.col("at") > F.col("first")))
    return gone.select("at.uid", "at.line").distinct()


def _marks(removed: DataFrame) -> DataFrame:
    """Removed lines of a document as a bitmap: ``_of``, and words of 64 lines in order."""
    words = removed.groupBy("uid", F.floor(F.col("line") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, line & 63)")).alias("m"))
    gathered = words.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("m"), F.max("w").alias("top"))
    dense = F.transform(F.sequence(F.lit(0), F.col("top")), lambda w: F.coalesce(F.element_at("m", w), F.lit(0)))
    return gathered.select(F.col("uid").alias("_of"), dense.alias("_marks"))


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, plus ``n_lines`` and ``n_removed`` (lines with a word).

    Columns of these two names are replaced, all others stay.
    """
    docs, back = aside(docs, "doc_id", text)
    columns = [c for c in docs.columns if c != text]
    rows = _identified(docs, text)
    marks = stored(_marks(removed_lines(rows, text)), "line-marks")
    touched = passes(sieve(marks, "_of"), "_uid")
    lines = F.split(text, "\n")
    count = F.coalesce(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(_BLANKS)) != "")), F.lit(0))
    count = F.when(F.col(text).isNull(), 0).otherwise(count)
    gone = lambda i: F.coalesce(F.get(F.col("_marks"), F.floor(i / 64).cast("int")), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(F.lit(63)))) != 0
    met = rows.filter(touched).join(marks, F.col("_uid") == F.col("_of"), "left")
    kept = F.when(F.col("_marks").isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~gone(i)), "\n"))
    lost = F.aggregate(F.coalesce("_marks", F.array().cast("array<long>")), F.lit(0), lambda a, m: a + F.bit_count(m))
    out = met.select(*columns, kept.alias(text), count.alias("n_lines"), lost.alias("n_removed"))
    rest = rows.filter(~F.coalesce(touched, F.lit(False))).select(*columns, text, count.alias("n_lines"), F.lit(0).alias("n_removed"))
    return back(out.unionByName(rest), "n_lines", "n_removed", last=text)
