"""The commands over a source tree: `python -m codequarry [command] [options] [paths]`.

Exit status: 0 in order, 1 for wrong use or unreadable input, 2 for violations or an exceeded threshold.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .functions import paths as P
from .operators import facts, rules, scoring, timings
from .sources import files, reports

WHOLE_ONLY = ("unused-code", "unused-files")
#: Commands that say so and end when nothing is selected; the others print a summary of nothing.
NEEDS_FILES = frozenset("file-naming magic-constants banned-imports weight-of-class class-size nesting".split())


class _Parser(argparse.ArgumentParser):
    """Wrong use exits with 1: 2 means violations."""

    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: {message}\n")


#: Options that may be repeated.
_MANY = {"action": "append", "default": []}


def parser(command: str | None) -> argparse.ArgumentParser:
    p = _Parser(prog=f"codequarry {command}" if command else "codequarry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    if command == "folder-structure":
        p.add_argument("--dir", **_MANY, dest="dirs", help="folder to check, relative to the root; may be repeated (default: package roots)")
        p.add_argument("--max", type=int, default=0, help="loose files that a folder may hold")
        return p
    p.add_argument("paths", nargs="*", help="files or folders (default: the whole tree)")
    if command is None:
        p.add_argument("--changed", action="store_true", help="only files that git says have changed")
        p.add_argument("--coverage", default="coverage.json")
        p.add_argument("--threshold", type=float, default=scoring.THRESHOLD)
    elif command == "banned-imports":
        p.add_argument("--from", **_MANY, dest="sources", metavar="GLOB")
        p.add_argument("--forbid", **_MANY, metavar="GLOB")
        p.add_argument("--message", **_MANY)
    elif command == "test-assertions":
        p.add_argument("--min", type=int, default=rules.MIN_ASSERTIONS)
    elif command == "profile":
        p.add_argument("--timings", required=True, help="JSON of aggregated timings: name to calls, totalMicros, minMicros, maxMicros")
        p.add_argument("--top", type=int, default=timings.TOP)
        p.add_argument("--name", help="only methods whose name holds this")
        p.add_argument("--threshold", type=float, help="milliseconds of one method's total that fail the run")
        p.add_argument("--reports", default="profile-reports")
    return p


COMMANDS = (*report.RULES, "profile")


def judge(spark: SparkSession, command: str, args: argparse.Namespace, root: str) -> rules.Outcome | None:
    """What a rule's command finds; None if there is no file to judge."""
    package = files.package_root(root)
    if command == "folder-structure":
        inventory = files.tree(spark, root)
        if args.dirs:
            folders = spark.createDataFrame([(d,) for d in args.dirs if os.path.isdir(os.path.join(root, d))], "dir string")
        else:
            folders = files.default_folders(inventory, package)
        return rules.folder_structure(folders, inventory, args.max)
    tests = command == "test-assertions"
    chosen = files.selected(spark, root, args.paths, tests) if args.paths else files.test_files(spark, root) if tests else files.source_files(spark, root)
    if command in NEEDS_FILES and chosen.isEmpty():
        return None
    if command == "file-naming":
        return rules.file_naming(chosen)
    kept = facts.facts(files.read(chosen if tests else chosen.where(~P.is_test_file(F.col("rel"))))).persist(StorageLevel.MEMORY_AND_DISK)
    for r in kept.where("parse_error is not null").select("rel", "parse_error").toLocalIterator():
        print(f"Warning: could not parse {r['rel']}: {r['parse_error']}", file=sys.stderr)
    if command == "unused-files":
        return rules.unused_files(kept, files.tree(spark, root), package)
    if command == "banned-imports":
        return rules.banned_imports(kept, files.tree(spark, root), rules.import_rules(args.sources, args.forbid, args.message), package)
    if command == "test-assertions":
        return rules.test_assertions(kept, args.min)
    simple = {"nesting": rules.nesting, "class-size": rules.class_size, "weight-of-class": rules.class_weight, "unused-code": rules.unused_code, "magic-constants": rules.magic_constants}
    return simple[command](kept)


def _scores(spark: SparkSession, args: argparse.Namespace, root: str) -> int:
    chosen = files.changed_files(spark, root) if args.changed else files.selected(spark, root, args.paths) if args.paths else files.source_files(spark, root)
    if chosen.isEmpty():
        print("No Python files to analyze.")
        return 0
    found = scores(spark, chosen, os.path.join(root, args.coverage), root).persist(StorageLevel.MEMORY_AND_DISK)
    print(report.scores(found, args.threshold))
    last = scoring.verdict(found, args.threshold).first()
    if last["failed"]:
        print(f"Threshold exceeded: {last['max_score']:.1f} > {args.threshold:.1f}", file=sys.stderr)
    return last["status"]


def scores(spark: SparkSession, chosen: DataFrame, coverage: str, root: str) -> DataFrame:
    return scoring.score(scoring.methods(facts.facts(files.read(chosen))), reports.load_coverage(spark, coverage, root))


def _profile(spark: SparkSession, args: argparse.Namespace, root: str) -> int:
    chosen = files.selected(spark, root, args.paths) if args.paths else files.source_files(spark, root)
    if chosen.isEmpty():
        print("No Python files to profile.")
        return 0
    known = timings.inventory(scoring.methods(facts.facts(files.read(chosen))))
    entries = timings.attribute(reports.load_timings(spark, os.path.join(root, args.timings)), known)
    if args.name:
        entries = entries.where(F.contains("key", F.lit(args.name)))
    entries = entries.persist(StorageLevel.MEMORY_AND_DISK)
    report.write_profile(entries, os.path.join(root, args.reports), args.threshold)
    print(report.profile(entries, args.top, args.threshold))
    if args.threshold is None:
        return 0
    last = timings.over(entries, args.threshold).first()
    if last["status"]:
        print(f"Profile threshold exceeded: {last['worst_ms']:.2f} > {args.threshold:.2f}ms", file=sys.stderr)
    return last["status"]


def main(argv: Sequence[str] | None = None, root: str | None = None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    command = argv.pop(0) if argv and argv[0] in COMMANDS else None
    args, root = parser(command).parse_args(argv), os.path.realpath(root or os.getcwd())
    if command is None and args.changed and args.paths:
        print("error: --changed can't be combined with paths", file=sys.stderr)
        return 1
    if command in WHOLE_ONLY and args.paths:
        print(f"{command}: not meaningful for a partial selection")
        return 0
    if command == "banned-imports":
        if len(args.sources) != len(args.forbid):
            print("error: --from and --forbid go in pairs", file=sys.stderr)
            return 1
        if not args.sources:
            print("No banned-import rules given — nothing to enforce.")
            return 0
    spark = spark or SparkSession.builder.appName("codequarry").getOrCreate()
    try:
        if command is None:
            return _scores(spark, args, root)
        if command == "profile":
            return _profile(spark, args, root)
        outcome = judge(spark, command, args, root)
    except (RuntimeError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    if outcome is None:
        print("No Python files to check.")
        return 0
    summary = outcome.summary.first()
    for line in report.findings(command, report.ordered(outcome.violations).toLocalIterator(), summary):
        print(line)
    return summary["status"]
