"""Verification, lineage, history, agents, sources and registered queries."""

from __future__ import annotations

import copy
from datetime import date

import pytest
from pyspark.sql import functions as F

from semaspark import catalogue
from semaspark.agent.questions import Asker, QuestionError, Scenario
from semaspark.agent.spec import SpecError, generated_tests, load_spec
from semaspark.functions import fiscal, scalar
from semaspark.operators import lineage, lint, verify
from semaspark.operators.history import History
from semaspark.plans.planner import SemanticQuery
from semaspark.sources import tables
from semaspark.streaming.drift import watch

AS_OF = date(2026, 1, 20)


def test_periods():
    p = fiscal.last_completed_fiscal_quarter(AS_OF)
    assert (p.start, p.end, p.label) == (date(2025, 8, 1), date(2025, 11, 1), "FY2026-Q3")
    assert fiscal.last_completed_fiscal_year(AS_OF).label == "FY2025" and fiscal.last_completed_month(AS_OF).start == date(2025, 12, 1)
    assert fiscal.fiscal_quarter_range(2026, 4).end == date(2026, 2, 1) and fiscal.last_calendar_quarter(AS_OF).label == "2025-Q4"


def test_scalars(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2025-01-01 10:59:00' a, TIMESTAMP_NTZ '2025-01-01 12:01:00' b")
    assert df.select(scalar.hour_diff(F.col("a"), F.col("b"))).first()[0] == 2
    assert df.select(scalar.local_to_utc(F.lit("America/New_York"), F.col("a"))).first()[0].hour == 15
    assert scalar.fuzzy_equal("Northstar Freight", "North Star Freight LLC") and not scalar.fuzzy_equal("!!", "x")
    values = [0.0, 2.0, 1234567.0, 1e-5, 0.1 + 0.2, -3.14159265, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(scalar.six_digits(F.col("v"))).collect()]
    assert got == ["0", "2e+00", "1.23457e+06", "1e-05", "3e-01", "-3.14159e+00", ""]


def test_compare_rows(spark):
    f = lambda rows: spark.createDataFrame(rows, "k string, v double")
    a = [("x", 1.0), ("y", 2.0), (None, None), ("d", 1.0), ("d", 2.0)]
    same = lambda b, **how: {(r.k, r.kind) for r in verify.compare_rows(f(a), f(b), ["k"], **how).collect()}
    assert same(a[::-1]) == set() and same([("x", 1.0000001), *a[1:]], relative=1e-6) == set()
    assert same([("x", 1.1), *a[1:]]) == {("x", "value")} and same([*a[:2], (None, 0.0), *a[3:]]) == {(None, "value")}
    assert same(a[1:]) == {("x", "missing")} and same([*a, ("n", 1.0)]) == {("n", "unexpected")}


def test_fingerprints(spark):
    f = lambda rows, kind="double": verify.fingerprint(spark.createDataFrame(rows, f"k string, v {kind}")).first()
    a = f([("x", 1.0), ("y", None)])
    assert a == f([("y", None), ("x", 1.0)]) and a == f([("x", 1.0 + 1e-12), ("y", None)]) and a != f([("x", 1.1), ("y", None)])
    assert a == f([("x", 1), ("y", None)], "int") and f([])["n_rows"] == 0


def test_a_run_that_broke_off_leaves_nothing_behind(spark, tmp_path):
    h = History(spark, str(tmp_path))
    results = lambda *ids: spark.createDataFrame([("a", i, "pass", "h", "h", [], []) for i in ids], "agent string, test_id string, status string, truth_hash string, answer_hash string, tags array<string>, rule_ids array<string>")
    results("old", "older").write.parquet(f"{h.root}/results/run_id=run-0001")  # of a run without a row
    assert h.record({"results": results("new")}, "2026-01-20", "mock", "1") == "run-0001"
    assert [r.test_id for r in h.load("run-0001", "results").collect()] == ["new"] and [r.test_id for r in h.baselines().collect()] == ["new"]


def test_impact_equals_what_changed(spark):
    """A change of SQL touches just the tests whose rows are checked."""
    before = catalogue.retail()
    after = copy.deepcopy(before)
    after.views["orders"].parts["net_revenue"].params["sql"] = "${total}"
    changes = lineage.diff(lineage.snapshot(spark, before), lineage.snapshot(spark, after))
    assert [(r.element_id, r.facet, r.change, r.params) for r in changes.collect()] == [("field:orders.net_revenue", "semantic", "modified", ["sql"])]
    tests = [
        {"agent": "a", "test_id": "net", "explore": "orders", "fields": ["orders.net_revenue"], "checked": True}, {"agent": "a", "test_id": "shape", "explore": "orders", "fields": ["orders.net_revenue"], "checked": False},
        {"agent": "a", "test_id": "gross", "explore": "orders", "fields": ["orders.gross_revenue"], "checked": True},
    ]
    deps = lineage.dependencies(lineage.model_dependencies(spark, after, tests))
    assert [r.test_id for r in lineage.impact(deps, changes, deps).collect()] == ["net"]
    one = deps.where("test_id = 'net' AND element_id = 'field:customers.in_debt'").first()
    assert one.role == "guard" and one.facets == ["semantic", "surface"]
    assert {r.reason for r in lineage.impact(deps, changes.limit(0), deps.limit(0)).collect()} == {"new"}


def test_verdict_causes(spark):
    deps = spark.createDataFrame([("a", "i", "e1", ["semantic"], "queried", 0), ("a", "m", "e1", ["semantic"], "queried", 0), ("a", "m", "e2", ["semantic"], "context", 3)], "agent string, test_id string, element_id string, facets array<string>, role string, rank int")
    changes = spark.createDataFrame([("e1", "semantic", "in1", "f:1"), ("e2", "semantic", "in2", "f:2")], "element_id string, facet string, input_id string, location string")
    frame = lambda s: spark.createDataFrame([("a", t, s if t != "same" else "pass") for t in ("i", "m", "d", "x", "same")], "agent string, test_id string, status string")
    out = {r.test_id: r for r in lineage.verdicts(frame("pass"), frame("fail"), deps, changes, spark.createDataFrame([("a", "d")], "agent string, test_id string"), True).collect()}
    assert {t: (r.cause, r.confidence) for t, r in out.items()} == {"i": ("input", "high"), "m": ("multiple", "low"), "d": ("data", "high"), "x": ("external", "high")}
    assert out["m"].cause_element == "e1" and out["i"].direction == "regression"


def test_history(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    results = lambda v: spark.createDataFrame([("a", "t1", "pass", v, "x", ["trap:z"], []), ("a", "t2", "fail", None, "x", [], [])], "agent string, test_id string, status string, truth_hash string, answer_hash string, tags array<string>, rule_ids array<string>")
    assert h.record({"results": results("h1")}, "2026-01-20", "mock", "1") == "run-0001"
    assert h.record({"results": results("h2")}, "2026-01-21", "mock", "1") == "run-0002"
    assert [r.truth_hash for r in h.baselines().collect()] == ["h1"]
    h.record({"results": results("h3")}, "2026-01-22", "mock", "1", rebaseline=True)
    assert [r.truth_hash for r in h.baselines().collect()] == ["h3"]
    assert h.load("run-0002", "results").count() == 2 and [r.seq for r in h.runs().collect()] == [1, 2, 3]


SPEC = """---
agent: finance
explores: [retail::orders, retail::lines]
EXT---
## Role
Answers questions on revenue.
## Rules
- id: sales-net
  text: '"Sales" and "net sales" mean net revenue.'
- id: quarter
  text: '"Quarter" means fiscal quarter.'
## Vocabulary
- "basket size", "ticket" → orders.average_order_value
## Guardrails
- id: no-pii
  text: Never reveal email or phone.
"""


@pytest.fixture
def asker(spark, sf, tmp_path):
    path = tmp_path / "a.agent.md"
    path.write_text(SPEC.replace("EXT", ""))
    terms = [{"id": "net_revenue", "name": "Net Revenue", "synonyms": ["revenue"], "linked_fields": ["retail.orders.net_revenue"]}]
    return lambda **how: Asker(load_spec(path), catalogue.retail(), catalogue.planner(spark, sf), date(2001, 8, 2), terms, Scenario(**how))


def test_questions(asker, spark, sf):
    a = asker().ask("What were net sales by region last quarter?")
    assert a.query.explore == "orders" and a.query.fields == ("regions.region_name", "orders.net_revenue") and "rule:sales-net" in a.applied
    assert a.query.filters[0].start == date(2001, 5, 1) and a.period.label == "FY2002-Q2"
    assert catalogue.planner(spark, sf).frame(a.query).count() > 0
    assert asker().ask("revenue monthly in FY1998").query.fields == ("orders.ordered_month", "orders.net_revenue")
    assert asker().ask("What was the basket size?").query.fields == ("orders.average_order_value",)
    v = asker().ask('Order count where market segment is "building"').query
    assert v.filters[0].values == ("BUILDING",) and v.fields == ("orders.order_count",)
    assert asker(fuzzy_values=True).ask('Order count where market segment is "buildin"').query.filters[0].values == ("BUILDING",)
    assert asker().ask("List every customer email").refused
    assert asker(meanings=(("revenue", "orders.gross_revenue"),)).ask("revenue last month").query.fields == ("orders.gross_revenue",)
    assert asker().ask("order count").query.explore == "orders" and asker(worst_explore=True).ask("order count").query.explore == "lines"
    with pytest.raises(QuestionError):
        asker().ask("What is the weather?")


def test_specs(tmp_path):
    (tmp_path / "base.md").write_text(SPEC.replace("EXT", "").replace("text: '\"Quarter\"", "locked: true\n  text: '\"Quarter\""))
    child = tmp_path / "child.md"
    child.write_text("---\nagent: child\nextends: [base.md]\n---\n## Rules\n- id: own\n  text: '\"Bookings\" means gross revenue.'\n")
    spec = load_spec(child)
    assert [r.rule_id for r in spec.rules] == ["sales-net", "quarter", "own"] and spec.vocabulary["ticket"] == "orders.average_order_value"
    assert {t["tags"][0] for t in generated_tests(spec)} == {"spec:rule", "spec:vocabulary", "spec:guardrail"}
    child.write_text("---\nagent: child\nextends: [base.md]\n---\n## Rules\n- id: quarter\n  override: true\n  text: x\n")
    with pytest.raises(SpecError, match="locked"):
        load_spec(child)
    child.write_text("---\nagent: c\n---\n## Nonsense\nx\n")
    with pytest.raises(SpecError, match="unknown section"):
        load_spec(child)


def test_lint(spark):
    rows = {(r.rule, r.object) for r in catalogue.queries()["lint_model"](spark, "").collect()}
    assert ("LNT005", "customers.name") in rows and ("LNT017", "orders.net_revenue") in rows and [o for r, o in rows if r == "LNT008"] == ["all_orders"]
    off = lint.run(spark, {"retail": catalogue.retail()}, spark.createDataFrame([], lint.TERMS), {"LNT005": "off"}).collect()
    assert not any(r.rule == "LNT005" for r in off)


def test_sources(spark, sf, tmp_path):
    df = spark.createDataFrame([(2, 'a "q", b', None), (1, None, date(2025, 1, 1))], "id int, s string, d date")
    tables.write_csv(df, str(tmp_path / "c"), ["id"])
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "c"), df.schema).orderBy("id").collect()] == sorted(map(tuple, df.collect()))
    assert tables.render_sql("$as_of $as $x", {"as": 1, "as_of": date(2026, 1, 20)}) == "DATE '2026-01-20' 1 $x"
    r = tables.Registry(spark, sf)
    assert r.sql("SELECT :d AS d, COUNT(*) AS n FROM region", d=date(2026, 1, 20)).first().n == 5
    with pytest.raises(tables.RowLimitError):
        tables.SparkTruth(r).query("SELECT * FROM nation", 5)
    assert sorted(map(tuple, tables.SparkTruth(r).query("SELECT r_name FROM region"))) == sorted(map(tuple, tables.DuckTruth(sf).query("SELECT r_name FROM region")))
    v = tables.vendor_rows(spark, {"rows": [{"n": "1.5", "d": "x"}, {"n": None, "d": "y"}]}, ["d"], ["n"])
    assert v.columns == ["d", "n"] and [tuple(x) for x in v.collect()] == [("x", 1.5), ("y", None)]


def test_drift_monitor(spark, tmp_path):
    source = tmp_path / "in"
    schema = "k string, v int"
    stream = lambda: spark.readStream.schema(schema).parquet(str(source))
    truth = lambda df: df.groupBy("k").agg(F.max("v").alias("v"))
    for rows in ([("a", 5)], [("a", 3)], [("a", 9)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        watch(stream(), str(tmp_path / "t"), str(tmp_path / "log"), truth, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2  # the second batch moved nothing


SOME = ["flagship_revenue_by_fiscal_quarter_region", "measure_cross_view_net", "join_role_playing_calendar", "always_filter_default", "filter_not_in", "filter_measure", "fiscal_calendar", "verify_compare_rows", "lineage_verdicts", "owner_resolution", "lint_ambiguous_measure", "lint_synonym_collision", "cte_scalar_subquery", "local_to_utc"]


@pytest.mark.parametrize("name", SOME)
def test_queries_match_their_oracles(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in tables.RELATIONAL:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = catalogue.queries()[name](spark, sf)
    found = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    rows = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    text = lambda r, keys: tuple(f"{r[k]:.9g}" if isinstance(r[k], int | float) and not isinstance(r[k], bool) else str(r[k]) for k in sorted(keys))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(text(r.asDict(), columns) for r in got.collect()) == sorted(text(r, columns) for r in rows)


def test_every_query_has_a_sound_name():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) > 65
    assert SemanticQuery("x", ("y",)).limit is None


def test_values_beyond_the_first_ten_thousand_are_found(spark):
    from semaspark.agent.questions import Asker, Scenario

    class Values:
        def distinct_values(self, explore, name):
            names = spark.range(30_000).selectExpr("concat('Customer ', lpad(id, 6, '0')) AS customers__name")
            return names.unionByName(spark.createDataFrame([(" ZEBRA Ltd ",), ("zebra ltd",), (None,)], "customers__name string"))

    one = Asker.__new__(Asker)
    one.planner, one.scenario, one._values = Values(), Scenario(), {}
    assert one._resolve_value("orders", "customers.name", "Zebra LTD") == (" ZEBRA Ltd ", "zebra ltd")
    assert one._resolve_value("orders", "customers.name", "customer 029999") == ("Customer 029999",)
    assert one._resolve_value("orders", "customers.name", "nobody") == ("nobody",)
    one.scenario, one._values = Scenario(fuzzy_values=True), {}
    assert one._resolve_value("orders", "customers.name", "zebra ltt") == (" ZEBRA Ltd ", "zebra ltd")
