import os
import re

import corpus_pipeline
from tests.llm.test_bagminhash import brute as near_classes
from tests.llm.test_linededup import brute as removed_lines
from tests.llm.test_packing import check_sequences
from wardflow.llm.common import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_name(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mix", "best_fit_packing"]


def test_every_stage_acts_on_what_it_is_given(spark, folder, small_docs):
    docs = small_docs
    texts = {r.doc_id: r.text for r in docs.collect()}
    after = by_name("quality_rules")(spark, docs, folder).cache()
    assert after.columns == COLUMNS and {r.doc_id: r.text for r in after.collect()}.items() <= texts.items()

    lines = by_name("line_dedup")(spark, after, folder).cache()
    gone = removed_lines(after.collect())
    want = {
        r.doc_id: "\n".join(line for i, line in enumerate(r.text.split("\n")) if (True, r.doc_id, i) not in gone) for r in after.collect()
    }
    assert lines.columns == COLUMNS and {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = by_name("near_dedup")(spark, lines, folder).cache()
    rows = sorted(lines.collect(), key=lambda r: r.doc_id)
    first = {}
    for r, root in zip(rows, near_classes(rows)):
        first.setdefault(root, r.doc_id)
    assert near.columns == COLUMNS and {r.doc_id for r in near.collect()} == set(first.values())

    mixed = by_name("source_mix")(spark, near, folder).cache()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(size(r.text) for r in near.collect())
    assert mixed.columns == COLUMNS and abs(sum(size(r.text) for r in mixed.collect()) - total) <= 20
    assert {r.doc_id for r in mixed.collect()} <= set(first.values())

    packed = by_name("best_fit_packing")(spark, mixed, folder).collect()
    check_sequences(packed)
    assert len({(r.doc_id, r.piece) for r in packed}) <= len(packed) and sum(r.piece == 0 for r in packed) == mixed.count()


def test_run_is_the_stages_one_after_another(spark, folder):
    place = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(place))
    rows = corpus_pipeline.run(spark, folder).collect()
    left = {x.split("-")[0] for x in set(os.listdir(place)) - before}
    assert not left & {"line", "near", "mix", "quality", "sieve", "cc"}  # went with the stages after them
    used = check_sequences(rows)
    assert used >= -(-sum(r.length for r in rows) // 4096)


def test_empty_table_through_all_stages(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_columns_of_any_name_stay(spark, folder, small_docs):
    """Names that the operators use inside, in any case, keep their values; only packing has its own columns."""
    from pyspark.sql import functions as F

    names = ["n_lines", "n_removed", "_of", "_marks", "_kept", "_size", "_uid", "_row", "_place", "_key", "uid", "line", "bag", "_equal", "_taken", "Doc_ID", "TEXT", "other_0"]
    rows = small_docs.limit(120)
    docs = rows.select(*rows.columns, *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        at = {n: i for i, n in enumerate(out.columns)}
        found = out.collect()
        assert found and all(r[at[n]] == f"{n}:{r[at['doc_id']]}" for r in found for n in names), name
    plain = by_name("best_fit_packing")(spark, rows, folder)
    assert by_name("best_fit_packing")(spark, docs, folder).columns == plain.columns
