"""The planner: refusals, pruning, filters and expansion."""

from __future__ import annotations

from datetime import date

import pytest

from semaspark.catalogue import planner, retail
from semaspark.plans.model import Workspace, resolve
from semaspark.plans.planner import Filter, Planner, SemanticError, SemanticQuery


def tiny(tmp_path, text, **tables):
    root = tmp_path / "p"
    root.mkdir()
    (root / "p.model.lkml").write_text(text)
    model = resolve(Workspace([root]), "p")
    assert model.problems == []
    return Planner(model, tables.__getitem__, lambda s: None)


@pytest.fixture
def fan(spark, tmp_path):
    text = """
    view: a { sql_table_name: a ;; dimension: id { primary_key: yes type: number } dimension: g { }
      measure: n { type: count } measure: s { type: sum sql: ${TABLE}.v ;; } measure: top { type: max sql: ${TABLE}.v ;; }
      measure: bad { type: number sql: ${s} / 2 ;; filters: [g: "x"] } measure: half { type: number sql: ${s} / 2 ;; } }
    view: b { sql_table_name: b ;; dimension: id { } dimension: k { } measure: t { type: sum sql: ${TABLE}.w ;; }
      dimension: loop1 { sql: ${loop2} ;; } dimension: loop2 { sql: ${loop1} ;; } dimension: uses_m { sql: ${t} ;; } }
    explore: a { join: b { relationship: one_to_many sql_on: ${a.id} = ${b.id} ;; } join: nosql { from: b } join: odd { from: b type: sideways sql_on: 1=1 ;; } }
    """
    a = spark.createDataFrame([(1, "x", 10), (2, "y", 20), (3, None, 5)], "id int, g string, v int")
    b = spark.createDataFrame([(1, "p", 1), (1, "q", 2), (2, "p", 3)], "id int, k string, w int")
    return tiny(tmp_path, text, a=a, b=b)


def ask(p, *fields, **how):
    return p.plan(SemanticQuery("a", fields, **how))


def test_refusals(fan):
    for fields, what in (
        (("b.t",), "multiplied"), (("a.s", "b.k"), "multiplied"), (("a.none",), "unknown field"), (("c.x",), "unknown view"), (("b.loop1",), "circular"), (("b.uses_m",), "refers to measure"),
        (("nosql.k",), "no sql_on"), (("odd.k",), "unknown type"), (("a.bad",), "can't have filters"), ((), "needs a field"),
    ):
        with pytest.raises(SemanticError, match=what):
            ask(fan, *fields)
    with pytest.raises(SemanticError, match="has no values"):
        ask(fan, "a.n", filters=(Filter("a.g"),))
    with pytest.raises(SemanticError, match="pivots"):
        ask(fan, "a.n", pivots=("a.g",))


def test_counts_by_key_survive_fan_out(fan):
    assert [tuple(r) for r in ask(fan, "b.k", "a.n", "a.top").frame.collect()] == [("p", 2, 20), ("q", 1, 10), (None, 1, 5)]


def test_unused_joins_are_left_out(fan):
    p = ask(fan, "a.g", "a.s")
    assert p.aliases == ["a"] and p.columns == ["a.g", "a.s"]
    assert [tuple(r) for r in p.frame.collect()] == [("x", 10), ("y", 20), (None, 5)]  # nulls last


def test_filters(fan):
    one = lambda *f: ask(fan, "a.n", filters=f).frame.first()[0]
    assert one(Filter("a.g", ("x",))) == 1 and one(Filter("a.g", ("-x",))) == 1 and one(Filter("a.g", ("x", "y", "-y"))) == 1
    assert one(Filter("a.id", ("1", "3"))) == 2
    assert [tuple(r) for r in ask(fan, "a.g", "a.half", filters=(Filter("a.half", (">4",)),)).frame.collect()] == [("x", 5.0), ("y", 10.0)]


def test_sorts_and_limit(fan):
    assert [r[0] for r in ask(fan, "a.g", "a.s", sorts=("a.s desc",), limit=2).frame.collect()] == ["y", "x"]


def test_window_reaches_the_scan(spark, sf):
    q = SemanticQuery("orders", ("orders.ordered_month", "orders.order_count"), (Filter("orders.ordered_date", start=date(1997, 8, 1), end=date(1997, 11, 1)),))
    p = planner(spark, sf).plan(q)
    assert p.aliases == ["orders", "customers"]  # the guard's, and no others
    assert {r[0] for r in p.frame.collect()} <= {"1997-08", "1997-09", "1997-10"}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = planner(spark, sf).frame(q)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text and "o_orderpriority" not in text


def test_keys_of_rows_that_no_join_repeats_are_counted_plainly(spark, sf, fan):
    text = planner(spark, sf).frame(SemanticQuery("orders", ("orders.status", "orders.order_count")))._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in text
    assert "distinct" in ask(fan, "b.k", "a.n").frame._jdf.queryExecution().analyzed().toString()


def test_grants_hide_fields(spark, sf):
    p = planner(spark, sf)
    p.grants = {}
    with pytest.raises(SemanticError, match="needs grants"):
        p.frame(SemanticQuery("orders", ("customers.balance",)))
    p.grants = {"can_view_balances": True}
    assert p.frame(SemanticQuery("orders", ("customers.balance",))).count() > 0


def test_model_has_no_problems():
    m = retail()
    assert m.problems == [] and m.queryable() == ["all_orders", "lines", "orders", "supplier_nations"]
    assert [op for op, _ in m.explores["orders"].history] == ["define", "override"]
