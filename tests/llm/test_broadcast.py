"""What Spark's estimates may have broadcast: rows that explode, packed columns, compressed files."""

import pytest

from voxelloom.llm import graph, simhash, substring
from voxelloom.llm.setup import ready, stored


def joins(df):
    return str(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def docs(spark):
    ready(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    rows = [(i, " ".join(f"w{j % 7}" for j in range(i, i + 30))) for i in range(40)]
    yield stored(spark.createDataFrame(rows, "doc_id long, text string"), "docs")  # files, as their size is known
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_simhash_cells_are_not_broadcast(docs):
    plan = joins(simhash.links(simhash.fingerprints(docs).select("fp").distinct()))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_links_and_fingerprints_are_not_broadcast(docs, monkeypatch):
    plans, write = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: plans.append(joins(df)) or write(df, name))
    plans.append(joins(simhash.group(docs)))
    assert len(plans) > 2 and "SortMergeJoin" in plans[1] and not any("Broadcast" in p for p in plans)


def test_substring_runs_are_not_broadcast(docs):
    plan = joins(substring.dedup(docs))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
