"""Sinks for people and other tools: Markdown, HTML, SARIF, JSON, evidence."""

from __future__ import annotations

import html
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame


def markdown_table(df: DataFrame, most: int = 1_000) -> str:
    """The first rows of a report as a Markdown table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join(map(cell, r))} |\n" for r in df.limit(most).collect())


def trend_svg(points: list[tuple[str, float]], width: int = 480, height: int = 120) -> str:
    """Rates in percent by run as a line."""
    if not points:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"></svg>'
    step = (width - 20) / max(1, len(points) - 1)
    at = [(10 + i * step, height - 10 - (height - 20) * rate / 100) for i, (_, rate) in enumerate(points)]
    line = " ".join(f"{x:.1f},{y:.1f}" for x, y in at)
    dots = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3"><title>{html.escape(n)}: {rate:.1f}%</title></circle>' for (x, y), (n, rate) in zip(at, points, strict=True))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><polyline fill="none" stroke="#356" points="{line}"/>{dots}</svg>'


def html_report(title: str, sections: dict[str, DataFrame], trend: list[tuple[str, float]]) -> str:
    """A self-contained page."""
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>", trend_svg(trend)]
    for name, df in sections.items():
        rows = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(1_000).collect())
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>{rows}</table>")
    return "\n".join(out)


def sarif(findings: DataFrame) -> str:
    """Lint findings (rule, severity, location, object, message) as SARIF 2.1.0."""
    results = []
    for r in findings.collect():
        file, _, line = r.location.rpartition(":")
        where = {"artifactLocation": {"uri": file or r.location}, "region": {"startLine": int(line) if line.isdigit() else 1}}
        results.append({"ruleId": r.rule, "level": r.severity, "message": {"text": f"{r.object}: {r.message}"}, "locations": [{"physicalLocation": where}]})
    rules = [{"id": x} for x in sorted({r["ruleId"] for r in results})]
    run = {"tool": {"driver": {"name": "semaspark", "rules": rules}}, "results": results}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, indent=2)


def evidence(path: str | Path, frames: dict[str, DataFrame]) -> None:
    """A zip that is the same, byte for byte, for the same rows."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(frames):
            rows = sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in frames[name].collect())
            z.writestr(zipfile.ZipInfo(f"{name}.jsonl", (1980, 1, 1, 0, 0, 0)), "".join(f"{r}\n" for r in rows))
