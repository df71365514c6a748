"""Joins whose sides grow with the input, and are estimated too small, aren't planned as broadcasts through the driver."""

from __future__ import annotations

import pytest

simhash = pytest.importorskip("tessera.llm.simhash")
components = pytest.importorskip("tessera.llm.components")


def plan(df):
    """The plan as it stands before it runs, by the session's default settings."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_copies_are_linked_without_broadcasts(spark):
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) == 10 << 20
    nodes = simhash.written(spark.range(40).selectExpr("xxhash64(id) fp"), "nodes")
    met = simhash.written(simhash.meetings(nodes), "cells")
    for found in (simhash.meetings(nodes), simhash.edges(met)):
        assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)


def test_component_rounds_make_no_broadcasts(spark):
    now = simhash.written(spark.range(40).selectExpr("id + 1 u", "id v"), "edges")
    for found in (components.large_star(now), components.small_star(now)):
        assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)


def test_documents_get_their_class_without_broadcasts(spark):
    docs = simhash.written(spark.createDataFrame([(k, f"some words of text {k % 7}") for k in range(20)], "doc_id long, text string"), "docs")
    for found in (simhash.classes(docs), simhash.keep_representatives(docs)):
        assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
