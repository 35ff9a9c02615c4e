"""Mix sources to target weights: hash-random order, prefix sums, a cut at each source's budget.

Every document gets a uniform key from a digest of its id.  The keys are cut into equal
ranges; a source is sorted range by range, and prefix sums of token counts come from
the sums of the earlier ranges plus a running sum inside the range, so no source is
sorted in one task.  A source whose target is a multiple of its size repeats whole
epochs first; the last epoch is cut exactly at the budget, inside the document that
crosses it.

Defined results: null text has size 0; sources are ordered by code point, null last;
rows with equal ids and keys are ordered by size; empty documents take nothing; an empty
table gives an empty table.  Running twice gives the same rows.  Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.llm.common import aside, parts_for, stored, word_count

WEIGHTS = [5, 2, 1]
MOST_EPOCHS = 3
SEED = "mix"
#: Documents of one range of keys, about.
RANGE_ROWS = 20_000
RANGE_DIGITS = 8


def _sizes(docs: DataFrame, text: str, *extra: str) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.select("doc_id", F.col("source").alias("_source"), word_count(F.col(text)).alias("size"), key.alias("_key"), *extra)


def _targets(sources: DataFrame) -> DataFrame:
    """Targets of sources ``(_source, _words, _weight)``: shares by weight, none above the cap.

    The excess of capped sources is dealt out again by weight until none is above its
    cap; a round is one aggregate, and capped sources never come back.
    """
    cap = MOST_EPOCHS * F.col("_words")
    level = 0.0
    while True:
        capped = F.lit(level) * F.col("_weight") >= cap
        free, weight, fixed, total = sources.agg(
            F.count(F.when(~capped, 1)),
            F.sum(F.when(~capped, F.col("_weight"))),
            F.sum(F.when(capped, cap)),
            F.sum("_words"),
        ).first()
        if not free:
            break
        higher = ((total or 0) - (fixed or 0)) / weight
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("_weight")))


def _weighted(sources: DataFrame) -> DataFrame:
    """Weights by place in code-point order; ``sources`` has one row per source."""
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    return sources.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int")))


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``."""
    return mixed(_sizes(docs, text))


def mixed(sizes: DataFrame) -> DataFrame:
    """As ``mix``, from rows of ``doc_id, _source, size, _key``; further columns stay."""
    extra = [c for c in sizes.columns if c not in ("doc_id", "_source", "size", "_key")]
    rows = stored(sizes, "mix-sizes")
    ranges = parts_for(rows.count(), RANGE_ROWS)
    number = F.conv(F.substring("_key", 1, RANGE_DIGITS), 16, 10).cast("long")
    rows = rows.withColumn("_range", F.floor(number * ranges / F.lit(16**RANGE_DIGITS)).cast("long"))
    sums = rows.groupBy("_source", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))), "mix-sums")
    targets = stored(_targets(stored(_weighted(sums.groupBy("_source").agg(F.sum("_sum").alias("_words"))), "mix-sources")), "mix-targets")
    plan = sums.join(targets.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).select(
        F.col("_source").alias("_of"), F.col("_range").alias("_in"), "_before", "_words", "target"
    )
    inside = Window.partitionBy("_source", "_range").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size", *extra)
    placed = rows.withColumn("_inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = placed.join(plan, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("_words") > 0, F.floor(budget / F.greatest(F.col("_words"), F.lit(1)))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("_words")
    part = F.least(F.greatest(rest - F.col("_before") - F.col("_inside"), F.lit(0)), F.col("size"))
    taken = F.least(epochs * F.col("size") + part, MOST_EPOCHS * F.col("size"))
    return joined.select("doc_id", "size", F.col("_words").alias("source_size"), "target", taken.cast("long").alias("taken"), *extra)


def _first_words(text: Column, words: Column) -> Column:
    """A text up to the end of its given word, with what separates them."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.array_join(F.slice(pieces, F.lit(1), (words + lead).cast("int")), "")


def realised(docs: DataFrame) -> DataFrame:
    """The mix as documents: one taken n times is n rows, and the one at a cut keeps its first words.

    Columns are those of ``docs``; ``n_chars`` of a cut document is its new length.
    Equal rows are told apart by their place among equals.
    """
    docs, back = aside(docs, "doc_id", "text", "lang", "source", "n_chars")
    columns = docs.columns
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text", "lang", "source"))
    rows = _sizes(keyed, "text", "_row")
    taken = mixed(rows).groupBy("_row").agg(F.max("size").alias("_size"), F.sum("taken").alias("_taken"), F.count("*").alias("_equal"))
    taken = stored(taken.filter("_taken > 0"), "mix-taken")
    joined = keyed.join(taken, "_row")
    alone = joined.filter("_equal = 1").withColumn("_place", F.lit(0))
    several = joined.filter("_equal > 1").withColumn("_place", F.row_number().over(Window.partitionBy("_row").orderBy("doc_id")) - 1)
    whole = F.floor(F.col("_taken") / F.col("_size"))
    copies = F.floor((whole + F.col("_equal") - 1 - F.col("_place")) / F.col("_equal")).cast("int")
    cut = F.when(F.col("_place") == 0, F.col("_taken") % F.col("_size")).otherwise(0)
    each = F.concat(
        F.array_repeat(F.col("text"), copies),
        F.when(cut > 0, F.array(_first_words(F.col("text"), cut))).otherwise(F.array().cast("array<string>")),
    )
    spread = alone.unionByName(several).withColumn("_texts", each)
    out = spread.select(*[c for c in columns if c != "text"], F.explode("_texts").alias("text"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(out)
