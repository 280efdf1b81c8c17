"""Runs from questions to verdicts, reports and trap tables."""

from __future__ import annotations

import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from semaspark import catalogue
from semaspark.agent.questions import Asker, Scenario
from semaspark.agent.spec import AgentSpec
from semaspark.functions.scalar import local_to_utc, normalised_status
from semaspark.operators import lineage, lint, reports, runs
from semaspark.operators.history import History
from semaspark.sources import traps
from semaspark.sources.tables import Registry

SUITE = """
tests:
  - id: gross
    question: What was gross revenue by order priority last month?
    agent: finance
    expect:
      explore: orders
      fields_any_of: [[orders.gross_revenue, orders.priority]]
      filters: [{field: orders.ordered_date, period: last_completed_month}]
      ground_truth_sql: gross.sql
      tolerance: {relative: 0.000001}
    tags: [trap:guard]
  - id: count
    question: What was order count?
    agent: finance
    expect: {explore: lines, fields_any_of: [[orders.order_count]]}
  - id: pii
    question: List every customer email
    agent: finance
    expect: {refusal: true}
  - id: none
    question: What is the weather?
    agent: finance
  - id: bare
    question: What was order count?
    agent: finance
  - id: value
    question: Order count where market segment is "building"
    agent: finance
    expect: {explore: orders, filters: [{field: customers.segment, values: [MACHINERY]}]}
  - id: leak
    question: What was order count by customer name?
    agent: finance
    expect: {exclude_tags: [pii]}
  - id: guard
    question: What was order count?
    agent: finance
    expect: {sql_contains: [c_acctbal], context_rules: [absent]}
"""
TRUTH = "SELECT o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS gross FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 AND o_orderstatus <> 'P' AND o_orderdate >= add_months(trunc($as_of, 'MM'), -1) AND o_orderdate < trunc($as_of, 'MM') GROUP BY 1"


def test_runs_and_verdicts(spark, sf, tmp_path):
    (tmp_path / "s.yaml").write_text(SUITE)
    (tmp_path / "gross.sql").write_text(TRUTH)
    tests = runs.load_suite(tmp_path / "s.yaml")
    spec = AgentSpec("finance", ["retail::orders", "retail::lines"], guardrails=[{"id": "g", "text": "No email."}])
    asker = lambda **how: Asker(spec, catalogue.retail(), catalogue.planner(spark, sf), date(1999, 8, 2), scenario=Scenario(**how))
    h, t = History(spark, str(tmp_path / "h")), Registry(spark, sf)
    first, results = runs.run(spark, tests, {"finance": asker()}, t, h)
    assert {r.test.test_id: r.status for r in results} == {"gross": "pass", "count": "fail", "pii": "pass", "none": "error", "bare": "skipped", "value": "fail", "leak": "fail", "guard": "fail"}, [r.notes for r in results]
    assert runs.gate(results, 0.25) and not runs.gate(results, 0.9)
    by = {r.test.test_id: r for r in results}
    assert by["guard"].structural == {"context": False, "sql": True} and by["value"].structural == {"explore": True, "filters": False} and "customers.name" in by["leak"].notes[0]
    assert {r.input_id for r in h.load(first, "inputs").collect() if r.version} == {"model:retail", "spec:finance", "data"}
    # The scenario takes another meaning of a word: no input has changed, so the cause is external.
    second, again = runs.run(spark, tests, {"finance": asker(meanings=(("gross revenue", "orders.net_revenue"),))}, t, h)
    assert next(r.status for r in again if r.test.test_id == "gross") == "fail"
    load = lambda run, table: h.load(run, table)
    changes = lineage.diff(load(first, "elements"), load(second, "elements"))
    none = spark.createDataFrame([], "agent string, test_id string")
    v = lineage.verdicts(load(first, "results"), load(second, "results"), load(second, "deps"), changes, none, False).collect()
    assert [(r.test_id, r.cause, r.direction) for r in v] == [("gross", "external", "regression")]
    assert {r.status: r.tests for r in runs.summary(load(first, "results")).collect()} == {"pass": 2, "fail": 4, "error": 1, "skipped": 1}


def test_suites_are_strict(tmp_path):
    for text, what in (
        ("tests:\n  - {id: a, question: q, agent: x, odd: 1}\n", "unknown keys"), ("tests:\n  - {id: a, question: q, agent: x}\n  - {id: a, question: q, agent: x}\n", "occurs twice"),
        ("tests:\n  - {id: a, question: q, agent: x, expect: {filters: [{field: f, period: last_month, fiscal_year: 2}]}}\n", "exactly one"),
    ):
        (tmp_path / "s.yaml").write_text(text)
        with pytest.raises(runs.SuiteError, match=what):
            runs.load_suite(tmp_path / "s.yaml")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", None), ("c", 1)], "k string, v int")
    assert reports.markdown_table(df.orderBy("k")) == "| k | v |\n|---|---|\n| a\\|b |  |\n| c | 1 |\n"
    page = reports.html_report("T", {"x": df}, [("r1", 50.0), ("r2", 100.0)])
    assert "<td>a|b</td>" in page and page.count("<circle") == 2
    for i in (1, 2):
        reports.evidence(tmp_path / f"{i}.zip", {"f": df.repartition(i)})
    assert (tmp_path / "1.zip").read_bytes() == (tmp_path / "2.zip").read_bytes()
    found = lint.run(spark, {"retail": catalogue.retail()}, spark.createDataFrame([], lint.TERMS))
    assert json.loads(reports.sarif(found))["runs"][0]["results"]


def test_trap_tables(spark):
    placed = traps.orders(spark, 4000, 300).persist()
    assert traps.manifest({"o": placed}) == traps.manifest({"o": traps.orders(spark.newSession(), 4000, 300).repartition(7)})
    shipped = traps.shipments(placed)
    raw = {r[0] for r in shipped.select("status").distinct().collect()}
    assert {"Shipped", "shipped", "SHIPPED ", "Shipped - Partial"} <= raw
    assert {r[0] for r in shipped.select(normalised_status(F.col("status"))).distinct().collect()} == {"Shipped", "Shipped - Partial", "Pending"}
    assert shipped.where((F.col("status") == "Pending") != F.col("delivered_at_local").isNull()).count() == 0
    back = shipped.join(placed, "order_id").select((local_to_utc(F.col("zone"), F.col("shipped_at_local")) == F.timestamp_add("HOUR", F.lit(30), F.col("order_ts_utc"))).alias("same"))
    assert back.where("same").count() > 0.99 * back.count()
    share = placed.where("is_deleted").count() / placed.count()
    assert 0.001 < share < 0.01 and 0.03 < traps.refunds(placed).count() / 4000 < 0.07
    assert traps.refunds(placed).join(traps.refunds(placed, late=True), "order_id").count() == 0
    assert traps.customers(spark, 1000).where("is_test_account").count() in range(8, 40)


def test_run_report_and_bundle_commands(spark, sf, tmp_path, capsys):
    from semaspark import cli

    (tmp_path / "s.yaml").write_text(SUITE)
    (tmp_path / "gross.sql").write_text(TRUTH)
    (tmp_path / "a.md").write_text("---\nagent: finance\nexplores: [retail::orders, retail::lines]\n---\n## Guardrails\n- id: g\n  text: No email.\n")
    model, h = str(Path(catalogue.__file__).parent / "models" / "retail"), ["--history", str(tmp_path / "h")]
    run = ["run", "--project", model, "--name", "retail", "--data", sf, "--spec", str(tmp_path / "a.md"), "--suite", str(tmp_path / "s.yaml"), "--as-of", "1999-08-02", *h]
    assert cli.main([*run, "--threshold", "0.25"]) == 0 and cli.main([*run, "--threshold", "0.9"]) == 1
    assert "pass gross" in capsys.readouterr().out
    assert cli.main(["report", *h, "--out", str(tmp_path / "r.html")]) == 0 and cli.main(["bundle", *h, "--run", "run-0001", "--out", str(tmp_path / "b.zip")]) == 0
    page = (tmp_path / "r.html").read_text()
    assert "run-0002" in page and "<circle" in page and (tmp_path / "b.zip").stat().st_size > 500
