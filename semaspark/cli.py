"""Commands: graph, lint, compile, ask, run, report, bundle, why, impact, demo."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

from semaspark.agent.questions import Asker, Scenario
from semaspark.agent.spec import generated_tests, load_spec
from semaspark.plans.model import Workspace, resolve
from semaspark.plans.planner import Planner
from semaspark.sources.tables import Registry


def _model(args: argparse.Namespace):
    space = Workspace(args.project)
    return resolve(space, args.name or next(iter(space.projects)))


def _spark():
    from semaspark.session import session

    return session()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="semaspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in {"graph": "the import graph", "lint": "findings over the model", "compile": "tests that a spec implies", "ask": "answer a question", "run": "check suites and record the run; fails below the threshold", "report": "a page on a run, with the trend", "bundle": "a zip of a run's tables", "why": "causes of changed results", "impact": "tests that a change touches", "demo": "the flagship query"}.items():
        c = sub.add_parser(name, help=text)
        c.add_argument("--project", action="append", default=[], help="directory of a project; may be repeated")
        c.add_argument("--name", help="project to resolve")
        if name in ("ask", "run", "demo"):
            c.add_argument("--data", required=True, help="directory of Parquet tables")
        if name in ("ask", "compile"):
            c.add_argument("--spec", required=True)
        if name == "run":
            c.add_argument("--spec", action="append", required=True, help="agents' specs; may be repeated")
            c.add_argument("--suite", action="append", required=True, help="may be repeated")
            c.add_argument("--threshold", type=float, default=1.0, help="least share of passing tests")
            c.add_argument("--rebaseline", action="store_true")
        if name in ("run", "report", "bundle"):
            c.add_argument("--history", required=True)
        if name in ("report", "bundle"):
            c.add_argument("--run", help="the last one by default")
            c.add_argument("--out", required=True)
        if name in ("ask", "run"):
            c.add_argument("--as-of", type=date.fromisoformat, default=date(2001, 8, 2))
        if name == "ask":
            c.add_argument("question")
            c.add_argument("--fuzzy", action="store_true")
        if name in ("why", "impact"):
            c.add_argument("--history", required=True)
            c.add_argument("--before", required=True)
            c.add_argument("--after", required=True)
        c.add_argument("--mermaid", action="store_true") if name == "graph" else None
    args = p.parse_args(argv)
    if args.command == "graph":
        space = Workspace(args.project)
        print(space.mermaid() if args.mermaid else space.tree(), end="")
    elif args.command == "compile":
        print(json.dumps(generated_tests(load_spec(args.spec)), indent=2, default=str))
    elif args.command == "lint":
        from semaspark.operators import lint

        spark, model = _spark(), _model(args)
        rows = lint.run(spark, {model.project: model}, spark.createDataFrame([], lint.TERMS)).collect()
        for r in rows:
            print(r.rule, r.severity, r.location, r.object, r.message)
        return int(any(r.severity == "error" for r in rows))
    elif args.command == "ask":
        spark, model = _spark(), _model(args)
        tables = Registry(spark, args.data)
        planner = Planner(model, tables.table, tables.sql)
        answer = Asker(load_spec(Path(args.spec)), model, planner, args.as_of, scenario=Scenario(fuzzy_values=args.fuzzy)).ask(args.question)
        if answer.refused:
            print(f"refused: {answer.refused}")
            return 1
        assert answer.query is not None
        planner.frame(answer.query).show(50, False)
    elif args.command == "run":
        from semaspark.operators import runs
        from semaspark.operators.history import History

        spark, model = _spark(), _model(args)
        tables = Registry(spark, args.data)
        specs = [load_spec(s) for s in args.spec]
        askers = {s.agent: Asker(s, model, Planner(model, tables.table, tables.sql), args.as_of) for s in specs}
        tests = [t for s in args.suite for t in runs.load_suite(s)]
        if unknown := sorted({t.agent for t in tests} - askers.keys()):
            p.error(f"no spec of the agents {unknown}")
        run_id, results = runs.run(spark, tests, askers, tables, History(spark, args.history), args.rebaseline)
        for r in results:
            print(r.status, r.test.test_id, "; ".join(r.notes))
        good = runs.gate(results, args.threshold)
        print(f"{run_id}: {'passes' if good else 'fails'} at {args.threshold:g}")
        return int(not good)
    elif args.command in ("report", "bundle"):
        from semaspark.operators import reports, verify
        from semaspark.operators.history import History

        h = History(_spark(), args.history)
        every = [r.run_id for r in h.runs().collect()]
        if not every or (args.run and args.run not in every):
            p.error(f"no run {args.run or 'at all'} in {args.history}")
        run_id = args.run or every[-1]
        results = h.load(run_id, "results")
        if args.command == "bundle":
            reports.evidence(args.out, {t: h.load(run_id, t) for t in ("inputs", "elements", "results", "deps")})
        else:
            rates = verify.pass_rate(h.all_results().where(F.col("run_id") <= run_id), ["run_id"]).orderBy("run_id").collect()
            sections = {"Agents": verify.pass_rate(results, ["agent"]).orderBy("agent"), "Not passing": results.where("status NOT IN ('pass', 'drift', 'skipped')").orderBy("agent", "test_id"), "Inputs": h.load(run_id, "inputs").orderBy("input_id")}
            Path(args.out).write_text(reports.html_report(run_id, sections, [(r.run_id, r.rate or 0.0) for r in rates]), encoding="utf-8")
        print(args.out)
    elif args.command in ("why", "impact"):
        from semaspark.operators import lineage
        from semaspark.operators.history import History

        spark = _spark()
        h = History(spark, args.history)
        changes = lineage.diff(h.load(args.before, "elements"), h.load(args.after, "elements"))
        deps, was, now = h.load(args.after, "deps"), h.load(args.before, "results"), h.load(args.after, "results")
        if args.command == "impact":
            lineage.impact(deps, changes, was).orderBy("agent", "test_id").show(1000, False)
        else:
            moved = was.alias("a").join(now.alias("b"), ["agent", "test_id"]).where("a.truth_hash <> b.truth_hash").select("agent", "test_id")
            lineage.verdicts(was, now, deps, changes, moved, False).orderBy("agent", "test_id").show(1000, False)
    else:
        from semaspark.catalogue import flagship

        flagship(_spark(), args.data).show(50, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
