"""The registered queries and the corpus pipeline."""

from __future__ import annotations

import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import compare
import corpus_pipeline
from parcelyard.llm import decontamination, mixing, queries, sharding, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = compare.connect(SF)
    yield con
    con.close()


def test_all_are_registered():
    names = [re.match(r"op(\d+)_", n) for n in entry.queries()]
    assert sorted(int(m[1]) for m in names if m) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(queries.all_oracles()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_query(spark, duck, name):
    assert compare.difference(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["op1_mixing", "op6_sharding", "op7_line_dedup"])
def test_native_plans_have_no_python(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stage_by_stage(spark):
    """Each stage's effect, from the operators' own results on its input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda df: sorted(map(tuple, df.collect()))

    clean = stages[0](spark, docs, SF).cache()
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert rows(clean) == rows(docs.where(docs.doc_id.isin([d for d, s in scores.items() if s < 0.5])))
    assert clean.count() < docs.count()

    single = stages[1](spark, clean, SF).cache()
    kept = {r["component_id"] for r in simhash.near_duplicates(clean).collect()}
    assert rows(single) == rows(clean.where(clean.doc_id.isin(list(kept))))
    assert single.count() < clean.count()

    fresh = stages[2](spark, single, SF).cache()
    good = [r["doc_id"] for r in decontamination.contamination(single, items).collect() if not r["n_hit"]]
    assert rows(fresh) == rows(single.where(single.doc_id.isin(good)))

    mixed = stages[3](spark, fresh, SF).cache()
    assert Counter(rows(mixed)) == Counter(rows(mixing.mix(fresh, exponent=queries.MIX_EXPONENT).select(*docs.columns)))
    assert all(d.columns == docs.columns for d in (clean, single, fresh, mixed))

    placed = stages[4](spark, mixed, SF)
    table = sharding.lookup_table(sharding.shard_names(queries.SHARDS))
    assert all(table[r["slot"]] == r["shard"] for r in placed.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(placed)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


CLASHES = ["row", "score", "copy_", "_id", "_n", "_row", "_covered", "_source", "_bad", "fp", "node", "n_words", "segment", "_z"]


def test_stages_keep_columns_whose_names_clash(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = plain.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.columns[: len(docs.columns)] == docs.columns, name
        rows = got.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES), name


def test_stages_take_null_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None,) * 5, (None,) * 5, (7, None, None, None, None), (8, "", "", "", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        ids = [r["doc_id"] for r in stage(spark, docs.unionByName(odd), SF).select("doc_id").collect()]
        if name != "mixing":
            assert {None, 7} <= set(ids), name
