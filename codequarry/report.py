"""Texts for people: reports of scores and timings, findings of rules, and report files.

Numbers are rounded here, in Python: Java's formatting rounds halves another way.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, Row

from .operators import scoring, timings


def scores(found: DataFrame, threshold: float = scoring.THRESHOLD, metric: str = "Risk") -> str:
    """All scores, ranked, and the verdict."""
    row = "{:<30} {:<35} {:>4} {:>7} {:>8}".format
    head = row("Method", "File", "CC", "Cov%", metric.upper())
    title = f"{metric} Report"
    lines = [title, "=" * len(title), head, "-" * len(head)]
    most = 0.0
    for r in scoring.ranked(found).toLocalIterator():
        share = "N/A" if r["coverage"] is None else f"{100 * r['coverage']:.1f}%"
        value = "N/A" if r["score"] is None else f"{r['score']:.1f}"
        most = max(most, r["score"] or 0.0)
        lines.append(row(r["method_name"], r["file"], r["complexity"], share, value))
    return "\n".join([*lines, "", f"Max {metric}: {most:.1f} (threshold {threshold:.1f}) \u2014 " + ("FAILED" if most > threshold else "passed")])


def mean_text(micros: float) -> str:
    """One decimal; a tilde where the cost of measuring outweighs what is measured."""
    return "~" * (micros < timings.OVERHEAD_MICROS) + f"{micros:.1f}"


def threshold_text(exceeding: int, millis: float) -> str:
    count = f"{exceeding} method{'s' * (exceeding > 1)} exceed" if exceeding else "all methods OK"
    return f"Threshold: {millis:.2f}ms \u2014 {count}"


def profile(entries: DataFrame, top: int | None = timings.TOP, millis: float | None = None) -> str:
    """The longest totals of attributed timings, and whether any is over so many milliseconds."""
    rows = timings.top(timings.with_share(entries), top).collect() if top is not None else list(timings.top(timings.with_share(entries), None).toLocalIterator())
    whole = entries.selectExpr("count(*) as n", "coalesce(sum(total), 0.0) as total").first()
    lines = [f"Profile Report ({whole['n']} methods, total {whole['total'] / 1000:.2f}ms)"]
    row = "{:>9} {:>7} {:>6} {:>9} {:>8} {:>10}  {:<24} {}".format
    lines.append(row("TOTAL(ms)", "%", "CALLS", "MEAN(\u00b5s)", "MAX(\u00b5s)", "@60fps(ms)", "METHOD", "FILE:LINE"))
    for r in rows:
        ms, frame = f"{r['total'] / 1000:.2f}", f"{r['mean'] * 60 / 1000:.2f}"
        lines.append(row(ms, f"{r['share']:.1f}%", r["calls"], mean_text(r["mean"]), int(r["most"] or 0), frame, r["key"], f"{r['file']}:{r['line']}"))
    if millis is not None:
        lines += ["", threshold_text(timings.over(entries, millis).first()["exceeding"], millis)]
    return "\n".join(lines)


def write_profile(entries: DataFrame, folder: str, millis: float | None = None) -> tuple[str, str]:
    """The whole profile as text and as JSON, named by the time; their paths."""
    os.makedirs(folder, exist_ok=True)
    stamp = f"{datetime.now():%Y%m%d-%H%M%S}"
    text, data = (os.path.join(folder, f"profile-{stamp}.{x}") for x in ("txt", "json"))
    with open(text, "w", encoding="utf-8") as f:
        f.write(profile(entries, None, millis) + "\n")
    rows = list(timings.top(entries, None).toLocalIterator())
    methods = [{"method": r["key"], "file": r["file"], "line": r["line"], "calls": r["calls"], "totalMicros": r["total"], "minMicros": r["least"] or 0.0, "maxMicros": r["most"] or 0.0} for r in rows]
    with open(data, "w", encoding="utf-8") as f:
        json.dump({"generated": stamp, "totalMicros": sum(m["totalMicros"] for m in methods), "methods": methods}, f, indent=2)
        f.write("\n")
    return text, data


#: For each rule: how its findings are ordered and told, and its summary with and without violations.
RULES = {
    "nesting": ("{file}:{line}: {message}", "{violations}/{checked} functions exceed nesting depth 5", "{checked} functions within nesting depth 5"),
    "class-size": ("{file}:{line}: {message}", "{violations}/{checked} classes over 25 methods/WMC 80", "{checked} classes within 25 methods/WMC 80"),
    "weight-of-class": ("{file}:{line}: class {name} data weight {ratio:.2f} ({fields} public fields of {members} public members) > 0.33", "{violations}/{checked} classes reveal more data than behavior", "{checked} classes within data weight 0.33"),
    "unused-code": ("{file}:{line}: {message}", "{violations} unused private declarations in {checked} files", "no unused private declarations in {checked} files"),
    "unused-files": ("{file}: {message}", "{violations}/{checked} files never imported", "{checked} files imported or exempt"),
    "banned-imports": ("{file}:{line}: {message}", "{violations} banned imports in {checked} files", "no banned imports in {checked} files"),
    "magic-constants": ("{file}:{line}: {message}", "{violations} magic constant(s) in {checked} files", "{checked} files free of magic constants"),
    "test-assertions": ("{file}:{line}: {message}", "{violations}/{checked} tests without assertions", "{checked} tests assert their expectations"),
    "folder-structure": ("{dir}: {message}", "{violations} directory(ies) with loose-file sprawl", "{checked} directories organized into packages"),
    "file-naming": ("{file}: {message}", "{violations}/{checked} files with mechanical names", "{checked} files have domain-meaningful names"),
}


def ordered(violations: DataFrame) -> DataFrame:
    """By path part by part, then as a file has them."""
    place = "split(dir, '/')" if "dir" in violations.columns else "split(file, '/')"
    return violations.selectExpr("*", f"{place} as _path").orderBy("_path", *(c for c in ("key", "ord", "nth", "name", "target") if c in violations.columns)).drop("_path")


def findings(rule: str, violations: Iterable[Row], summary: Row) -> list[str]:
    """A line for each violation, then the summary."""
    line, some, none = RULES[rule]
    return [*(line.format(**r.asDict()) for r in violations), (some if summary["violations"] else none).format(**summary.asDict())]
