"""Runs: questions are answered, checked against ground truth, and recorded."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.agent.questions import Answer, Asker
from semaspark.functions import fiscal
from semaspark.functions.scalar import normalise
from semaspark.operators import lineage, verify
from semaspark.operators.history import History
from semaspark.sources.tables import Registry, RowLimitError, guarded, render_sql


class SuiteError(ValueError):
    """A suite that can't be read."""


@dataclass(frozen=True)
class FilterExpectation:
    """One of values, a relative period, a fiscal year or explicit dates."""

    field: str
    values: tuple[str, ...] = ()
    period: str = ""
    fiscal_year: int = 0
    start: date | None = None
    end: date | None = None

    def __post_init__(self) -> None:
        if sum(map(bool, (self.values, self.period, self.fiscal_year, self.start))) != 1:
            raise SuiteError(f"filter on '{self.field}' needs exactly one of values, period, fiscal_year and start")

    def window(self, as_of: date) -> tuple[date, date | None] | None:
        if self.period:
            p = getattr(fiscal, self.period)(as_of)
            return p.start, p.end
        if self.fiscal_year:
            p = fiscal.fiscal_year_range(self.fiscal_year)
            return p.start, p.end
        return (self.start, self.end) if self.start else None


@dataclass(frozen=True)
class Test:
    test_id: str
    question: str
    agent: str
    explore: str = ""
    fields_any_of: tuple[tuple[str, ...], ...] = ()
    filters: tuple[FilterExpectation, ...] = ()
    truth_sql: str = ""
    refusal: bool = False
    exclude_tags: tuple[str, ...] = ()
    sql_contains: tuple[str, ...] = ()
    relative: float = 1e-9
    absolute: float = 0.0
    tags: tuple[str, ...] = ()
    rule_ids: tuple[str, ...] = ()

    @property
    def digest(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()[:16]


_KEYS = {"id", "question", "agent", "expect", "tags"}
_EXPECT = {"explore", "fields_any_of", "filters", "ground_truth_sql", "tolerance", "refusal", "exclude_tags", "sql_contains", "context_rules"}


def load_suite(path: str | Path) -> list[Test]:
    """Tests of a YAML suite; SQL files are read next to it."""
    path = Path(path)
    out: list[Test] = []
    for t in (yaml.safe_load(path.read_text(encoding="utf-8")) or {}).get("tests", []):
        want = t.get("expect", {})
        if unknown := (set(t) - _KEYS) | (set(want) - _EXPECT):
            raise SuiteError(f"{path.name}: unknown keys {sorted(unknown)}")
        if any(o.test_id == t["id"] for o in out):
            raise SuiteError(f"{path.name}: id '{t['id']}' occurs twice")
        sql = want.get("ground_truth_sql", "")
        text = (path.parent / sql).read_text(encoding="utf-8") if sql.endswith(".sql") else sql
        tolerance = want.get("tolerance", {})
        filters = tuple(FilterExpectation(f["field"], tuple(map(str, f.get("values", ()))), f.get("period", ""), f.get("fiscal_year", 0), f.get("start"), f.get("end")) for f in want.get("filters", ()))
        out.append(Test(
            t["id"], t["question"], t["agent"], want.get("explore", ""), tuple(map(tuple, want.get("fields_any_of", ()))), filters, text, bool(want.get("refusal")),
            tuple(want.get("exclude_tags", ())), tuple(want.get("sql_contains", ())), tolerance.get("relative", 1e-9), tolerance.get("absolute", 0.0), tuple(t.get("tags", ())), tuple(want.get("context_rules", ())),
        ))
    return out


@dataclass
class Result:
    """Verdicts of one test; the status is folded from them over all tests."""

    test: Test
    status: str = ""
    notes: list[str] = field(default_factory=list)
    structural: dict[str, bool | None] = field(default_factory=dict)
    rows_ok: bool | None = None
    refusal: bool | None = None
    error: bool = False
    moved: bool = False
    truth_hash: str | None = None
    answer_hash: str | None = None


def structure(test: Test, answer: Answer, as_of: date) -> tuple[dict[str, bool | None], list[str]]:
    """Verdicts on an answer's query by what they are about (explore, fields,
    filters), and what is wrong; its rows aren't looked at."""
    q = answer.query
    assert q is not None
    verdicts: dict[str, bool | None] = {}
    notes: list[str] = []
    if test.explore:
        verdicts["explore"] = q.explore == test.explore
        if not verdicts["explore"]:
            notes.append(f"explore is {q.explore}, not {test.explore}")
    if test.fields_any_of:
        verdicts["fields"] = any(set(f) <= set(q.fields) for f in test.fields_any_of)
        if not verdicts["fields"]:
            notes.append(f"fields are {list(q.fields)}")
    base = lambda n: n.rpartition("_")[0] if n.rpartition("_")[2] in ("raw", "date", "time") else n
    for f in test.filters:
        own = [g for g in q.filters if base(g.field) == base(f.field)]
        window = f.window(as_of)
        if not own:
            good, why = False, f"no filter on {f.field}"
        elif f.values:
            good, why = any(sorted(g.values) == sorted(f.values) for g in own), f"values of {f.field} aren't {list(f.values)}"
        elif not any(g.start or g.end or g.values for g in own):
            notes.append(f"the window of {f.field} isn't shown, and not checked")
            continue
        else:
            good, why = any((g.start, g.end) == window for g in own), f"window of {f.field} isn't {window[0]} to {window[1]}" if window else f"no window of {f.field}"
        verdicts["filters"] = verdicts.get("filters", True) and good
        if not good:
            notes.append(why)
    return verdicts, notes


def _rows(test: Test, plan, truth: DataFrame, most: int) -> tuple[bool, str, str | None, list[str]]:
    """Whether the answer's rows are the truth's, the two fingerprints, notes."""
    got, keys = normalise(plan.frame), len(plan.columns) - len(plan.measures)
    # Both results are small by the guard, and are read once.
    spark = got.sparkSession
    truth = spark.createDataFrame(guarded(truth, most), truth.schema)
    truth_hash = verify.fingerprint(truth).first()[0]
    if len(truth.columns) != len(got.columns):
        return False, truth_hash, None, [f"{len(got.columns)} columns, not {len(truth.columns)}"]
    got = got.toDF(*truth.columns)
    got = spark.createDataFrame(guarded(got, most), got.schema)
    wrong = verify.compare_rows(truth, got, truth.columns[:keys], test.relative, test.absolute).limit(1).collect()
    return not wrong, truth_hash, verify.fingerprint(got).first()[0], [f"{w.kind}: {w.column} is {w.actual}, not {w.expected}" for w in wrong]


def check(test: Test, asker: Asker, tables: Registry, baseline: str | None, most: int = 10_000) -> Result:
    """Answer one question and judge the answer; the status is left to ``fold``."""
    out = Result(test)
    try:
        answer = asker.ask(test.question)
        if test.exclude_tags and not answer.refused:
            assert answer.query is not None
            leaked = [f for f in answer.query.fields if asker.tags(answer.query.explore, f) & set(test.exclude_tags)]
            out.refusal, out.notes = not leaked, [f"fields with excluded tags: {leaked}"] if leaked else []
            return out
        if test.refusal or test.exclude_tags or answer.refused:
            out.refusal, out.notes = bool(answer.refused) and (test.refusal or bool(test.exclude_tags)), [answer.refused or "not refused"]
            return out
        assert answer.query is not None
        out.structural, out.notes = structure(test, answer, asker.as_of)
        if test.rule_ids:
            lacking = sorted(set(test.rule_ids) - {r.rule_id for r in asker.spec.rules})
            out.structural["context"] = not lacking
            out.notes += [f"the agent lacks the rules {lacking}"] if lacking else []
        if test.sql_contains or test.truth_sql:
            plan = asker.planner.plan(answer.query)
        if test.sql_contains:
            text = plan.frame._jdf.queryExecution().analyzed().toString().lower()
            lacking = [x for x in test.sql_contains if x.lower() not in text]
            out.structural["sql"] = not lacking
            out.notes += [f"the query lacks {lacking}"] if lacking else []
        if test.truth_sql:
            truth = normalise(tables.sql(render_sql(test.truth_sql, {"as_of": asker.as_of})))
            out.rows_ok, out.truth_hash, out.answer_hash, notes = _rows(test, plan, truth, most)
            out.notes += notes
            out.moved = baseline is not None and out.truth_hash != baseline
    except (ValueError, RowLimitError) as e:
        out.error, out.notes = True, [str(e)]
    return out


def fold(spark: SparkSession, results: list[Result]) -> list[Result]:
    """The results with their statuses."""
    rows = [(i, r.error, r.refusal, list(r.structural.values()), r.rows_ok, r.moved) for i, r in enumerate(results)]
    frame = spark.createDataFrame(rows, "i int, error boolean, refusal boolean, structural array<boolean>, rows_ok boolean, moved boolean")
    for r in frame.select("i", verify.fold_status(*map(F.col, ("error", "refusal", "structural", "rows_ok", "moved"))).alias("status")).collect():
        results[r.i].status = r.status
    return results


def run(spark: SparkSession, tests: list[Test], askers: dict[str, Asker], tables: Registry, history: History, rebaseline: bool = False, threads: int = 4) -> tuple[str, list[Result]]:
    """Check all tests, a few at a time on one session, and record the run."""
    known = {r.test_id: r.truth_hash for r in history.baselines().collect()}
    with ThreadPoolExecutor(threads) as pool:
        results = fold(spark, list(pool.map(lambda t: check(t, askers[t.agent], tables, known.get(t.test_id)), tests)))
    rows = [(r.test.agent, r.test.test_id, r.status, r.truth_hash, r.answer_hash, list(r.test.tags), list(r.test.rule_ids)) for r in results]
    frames: dict[str, DataFrame] = {"results": spark.createDataFrame(rows, "agent string, test_id string, status string, truth_hash string, answer_hash string, tags array<string>, rule_ids array<string>")}
    model = next(iter(askers.values())).model
    frames["elements"] = lineage.snapshot(spark, model)
    uses = [{"agent": r.test.agent, "test_id": r.test.test_id, "explore": r.test.explore, "fields": list(r.test.fields_any_of[0]), "checked": bool(r.test.truth_sql)} for r in results if r.test.explore and r.test.fields_any_of]
    if uses:
        frames["deps"] = lineage.dependencies(lineage.model_dependencies(spark, model, uses))
    truth = hashlib.sha256(",".join(sorted(r.truth_hash for r in results if r.truth_hash)).encode()).hexdigest()[:16]
    frames["inputs"] = spark.createDataFrame([(f"model:{model.project}", "model", lineage.model_version(model), "", ""), *[(f"spec:{n}", "spec", hashlib.sha256(repr(a.spec).encode()).hexdigest()[:16], "", "") for n, a in sorted(askers.items())], ("data", "data", truth, "", "")], "input_id string, kind string, version string, owner string, path string")
    as_of = next(iter(askers.values())).as_of.isoformat()
    return history.record(frames, as_of, "deterministic", "1", rebaseline), results


def gate(results: list[Result], threshold: float) -> bool:
    """Whether enough tests pass for a release."""
    ran = [r for r in results if r.status != "skipped"]
    return bool(ran) and sum(r.status in ("pass", "drift") for r in ran) / len(ran) >= threshold


def summary(frame: DataFrame) -> DataFrame:
    """Results by status."""
    return frame.groupBy("status").agg(F.count(F.lit(1)).alias("tests"))
