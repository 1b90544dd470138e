"""Joins and groups of rows that hardly combine take more tasks as tables grow."""

import pytest

from mnemo.operators import frames, graph, maintain, portfolio, recall
from mnemo.plans.roles import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def tables(spark, monkeypatch):
    monkeypatch.setattr(frames, "TASK_ROWS", 500, raising=False)
    return Tables(spark, SF)


def test_mentions(tables):
    lines = tables.raw("lineitem").count()
    assert tables.mentions().rdd.getNumPartitions() >= lines // 500
    assert tables.mentions().count() == tables.raw("lineitem").select("l_orderkey", "l_partkey").distinct().count()


def test_associations(tables):
    lines = tables.raw("lineitem").count()
    assert tables.assoc().rdd.getNumPartitions() >= 2 * lines // 500
    out = recall.bump(tables.assoc(), tables.assoc(), 2 * lines)
    assert out.rdd.getNumPartitions() >= 2 * lines // 500
    assert out.agg({"weight": "sum"}).head()[0] == 2 * tables.assoc().agg({"weight": "sum"}).head()[0]


def test_summaries(tables):
    out = maintain.summaries_due(tables.mentions(), tables.atoms(), 1, tables.pairs())
    assert out.rdd.getNumPartitions() >= tables.pairs() // 500
    assert out.agg({"atoms": "sum"}).head()[0] == tables.assoc().agg({"weight": "sum"}).head()[0]


def test_entity_detail(tables):
    e, m, a = tables.assoc(), tables.mentions(), tables.atoms()
    out = graph.entity_detail(e, m, a, tables.entities(), pairs=tables.pairs(), lines=tables.lines())
    assert out.rdd.getNumPartitions() >= (2 * tables.pairs() + tables.lines()) // 500
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in graph.entity_detail(e, m, a, tables.entities()).collect()}


def test_shared_packages(tables):
    out = portfolio.shared_packages(tables.uses())
    rows = tables.uses().select("project", "dep").distinct().groupBy("dep").count().selectExpr("sum(count * (count - 1) div 2)").head()[0]
    assert out.rdd.getNumPartitions() >= rows // 500
    assert out.agg({"shared": "sum"}).head()[0] == rows
