"""The registered queries: names, and plans that stay fit for large tables."""

import re

import pytest

import __spark_entry__ as entry
from maskwright.functions import patterns

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"lang", "type", "n"} == set(rows[0].asDict())


@pytest.mark.parametrize("name", ["sanitize_documents", "placeholders", "mappings", "confidence_filter"])
def test_texts_are_scanned_once_per_pattern(spark, name):
    """One search and one split per pattern: neither a filter nor a generator repeats the detectors."""
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert plan.count(patterns.PHONE[:6]) <= 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert re.findall(r"ReadSchema: (.*)", plan) in ([], ["struct<doc_id:bigint,text:string>"])


def test_masking_needs_no_shuffle_on_an_input_in_many_pieces(spark, tmp_path):
    from maskwright.operators.masking import sanitize

    path = str(tmp_path / "docs")
    spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(8).write.parquet(path)
    assert "Exchange" not in plan_of(sanitize(spark.read.parquet(path)))


@pytest.mark.parametrize("name, source", [("policy_rules_table", "pages"), ("vocabulary", "benchmark")])
def test_derived_rules_and_pieces_are_tables(spark, monkeypatch, name, source):
    import duckdb
    from pyspark.sql import functions

    import __spark_entry__ as entry

    monkeypatch.delattr(functions, "collect_list")
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view {source} as select * from '{folder}/{source}.parquet'")
    theirs = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in theirs.description]
    ours = entry.queries()[name](spark, folder).select(*names).collect()
    assert sorted(map(repr, map(tuple, ours))) == sorted(map(repr, theirs.fetchall()))
