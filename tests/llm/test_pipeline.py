"""The pipeline against brute force of each stage on the rows that the stage before it kept."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from solargrid.llm import decontaminate, quality_rules
from tests.llm.test_text_operators import brute_groups, brute_removed


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == before.columns
        if k == 0:
            assert kept[0] == {r.doc_id for r in quality_rules.judged(before).where("kept").collect()}
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if k == 1:
            assert kept[1] == {g for g, _ in brute_groups(rows).values()}
        if k == 2:
            want = {d: n for d, n, *_ in [(r[0], r[2]) for r in brute_removed(rows, 400)]}
            got = {r.doc_id: len(r.text.encode()) for r in docs.collect()}
            old = {d: len(t.encode()) for d, t in rows}
            assert all(0 <= old[d] - want[d] - got[d] < 8 for d in old) and kept[2] == kept[1]
        if k == 3:
            bad = {r.doc_id for r in decontaminate.leaks(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert kept[3] == kept[2] - bad
        if k == 4:
            text = {}
            for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.no)):
                text[r.doc_id] = text.get(r.doc_id, "") + r.text
            assert text == {d: t for d, t in rows}
    assert pq.read_table(str(tmp_path / "0")).num_rows >= len(kept[4]) > 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == kept[4]


HELPERS = ["q_id", "k_id", "k_text", "q_text", "q_n", "k_row", "q_row", "q_first", "row", "cls", "n_words", "kept", "hash", "item", "no", "item_id"]


@pytest.fixture(scope="module")
def clashing(spark, sf_dir):
    """Documents with null and repeated ids, and columns that are called like the operators' own."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 4000")
    ids = F.when(F.col("doc_id") % 5 > 0, F.floor(F.col("doc_id") / 2))
    return d.withColumn("doc_id", ids).withColumns({c: F.concat(F.lit(f"{c} "), F.sha1("text")) for c in HELPERS}).withColumn("with.dot", F.length("text"))


@pytest.mark.parametrize("stage", range(4))
def test_columns_come_back_whatever_they_are_called(stage, clashing, spark, sf_dir):
    out = corpus_pipeline.STAGES[stage][1](spark, clashing, sf_dir)
    assert out.columns == clashing.columns and out.schema.simpleString() == clashing.schema.simpleString()
    rows = out.collect()
    # doc_id, text and n_chars are all that a stage may change.
    same = [c for c in clashing.columns if c not in ("text", "n_chars", "with.dot")]
    known = {tuple(r[c] for c in same) for r in clashing.collect()}
    assert rows and {tuple(r[c] for c in same) for r in rows} <= known
    assert out.where("text IS NULL").count() == clashing.where("text IS NULL").count()
    assert corpus_pipeline.STAGES[stage][1](spark, clashing.limit(0), sf_dir).count() == 0


def test_pipeline_runs_on_such_a_table_and_on_an_empty_one(clashing, spark, sf_dir, tmp_path):
    for name, docs in (("clashing", clashing), ("empty", clashing.limit(0))):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
        assert (corpus_pipeline.run(spark, str(folder)).count() > 0) == (name == "clashing")
