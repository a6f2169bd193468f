"""Structural rules over syntax facts.

Each rule gives what it found (file, line, message and the figures behind it) and a summary of one row: violations,
checked, status (2 if there are violations, else 0). What counts as checked differs: functions, classes, test bodies,
parsed files, or files. Rules but the two on imports and the one on folders work within a file's row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scores as S

MAX_NESTING, MAX_METHODS, MAX_WEIGHTED, MAX_WEIGHT = 5, 25, 80, 0.33
MIN_REPEATS, MIN_LENGTH, MIN_ASSERTIONS = 3, 4, 1


@dataclass(frozen=True)
class Outcome:
    violations: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class ImportRule:
    """Files that match from_glob may not import what matches forbid_glob."""

    from_glob: str
    forbid_glob: str
    message: str | None = None


def import_rules(from_globs: Sequence[str], forbid_globs: Sequence[str], messages: Sequence[str] = ()) -> list[ImportRule]:
    """Rules by position: as many from as forbid; messages go to the first ones."""
    if len(from_globs) != len(forbid_globs):
        raise ValueError("as many --from as --forbid are needed")
    return [ImportRule(*globs, message) for globs, message in zip_longest(zip(from_globs, forbid_globs), messages[: len(from_globs)])]


def _summary(rows: DataFrame, violations: Column, checked: Column) -> DataFrame:
    """The summary row, from one pass over rows."""
    counted = rows.agg(F.coalesce(violations, F.lit(0)).cast("long").alias("violations"), F.coalesce(checked, F.lit(0)).cast("long").alias("checked"))
    return counted.withColumn("status", F.when(F.col("violations") > 0, 2).otherwise(0))


def _items(rows: DataFrame) -> Outcome:
    """From all items judged, each with `violated`."""
    return Outcome(rows.where("violated").drop("violated"), _summary(rows, F.count_if("violated"), F.count("*")))


def _parsed(facts: DataFrame, tests: bool = False) -> DataFrame:
    """Files that parse; test files are left out unless asked for."""
    rows = facts.where("parse_error is null")
    return rows if tests else rows.where(~P.is_test_file(F.col("rel")))


def nesting_depths(facts: DataFrame) -> DataFrame:
    """(file, ord, line, function, depth) of every function outside tests."""
    rows = _parsed(facts).select(F.col("rel").alias("file"), F.explode("functions").alias("f"))
    return rows.select("file", "f.ord", F.col("f.start_line").alias("line"), F.col("f.name").alias("function"), F.array_max("f.levels").alias("depth"))


def nesting(facts: DataFrame) -> Outcome:
    """Functions whose blocks nest deeper than MAX_NESTING; checks functions."""
    text = F.concat("function", F.lit(" nesting depth "), "depth", F.lit(f" > {MAX_NESTING}"))
    return _items(nesting_depths(facts).withColumns({"message": text, "violated": F.col("depth") > MAX_NESTING}))


def class_totals(facts: DataFrame) -> DataFrame:
    """(file, ord, line, name, methods, weighted) of every class: its own functions, and the sum of their complexities."""
    rows = _parsed(facts).select(F.col("rel").alias("file"), F.explode("classes").alias("c"))
    weighted = F.aggregate("c.members", F.lit(0), lambda n, m: n + S.complexity(m["points"]))
    return rows.select("file", "c.ord", "c.line", "c.name", F.size("c.members").alias("methods"), weighted.alias("weighted"))


def class_size(facts: DataFrame) -> Outcome:
    """Classes of more than MAX_METHODS functions or MAX_WEIGHTED summed complexity; checks classes."""
    many, heavy = F.col("methods") > MAX_METHODS, F.col("weighted") > MAX_WEIGHTED
    reasons = F.concat_ws(", ", F.when(many, F.concat("methods", F.lit(f" methods (max {MAX_METHODS})"))), F.when(heavy, F.concat(F.lit("weighted methods "), "weighted", F.lit(f" (max {MAX_WEIGHTED})"))))
    return _items(class_totals(facts).withColumns({"message": F.concat(F.lit("class "), "name", F.lit(": "), reasons), "violated": many | heavy}))


def class_weights(facts: DataFrame) -> DataFrame:
    """(file, ord, line, name, fields, members, ratio) of every class. fields: distinct public attributes that instance
    methods assign to self; members: those and the public instance methods, same names as often as they occur."""
    rows = _parsed(facts).select(F.col("rel").alias("file"), F.explode("classes").alias("c"))
    fields = F.size(F.array_distinct(F.filter("c.stores", lambda a: ~a.startswith("_"))))
    methods = F.size(F.filter("c.members", lambda m: m["instance"] & ~m["name"].startswith("_")))
    rows = rows.select("file", "c.ord", "c.line", "c.name", fields.alias("fields"), methods.alias("methods"))
    return rows.select("file", "ord", "line", "name", "fields", (F.col("fields") + F.col("methods")).alias("members"), S.data_weight(F.col("fields"), F.col("methods")).alias("ratio"))


def class_weight(facts: DataFrame) -> Outcome:
    """Public classes with fields whose data weight is over MAX_WEIGHT; checks classes, private ones too."""
    return _items(class_weights(facts).withColumn("violated", ~F.col("name").startswith("_") & (F.col("fields") > 0) & (F.col("ratio") > MAX_WEIGHT)))


def unused_code(facts: DataFrame) -> Outcome:
    """Private names of a module that it never refers to, at their last declaration; checks parsed files."""
    private = F.filter("decls", lambda d: S.is_private(d["name"]))
    unused = F.array_sort(F.array_except(F.transform(private, lambda d: d["name"]), "refs"))
    last = F.transform("names", lambda n: F.struct(n.alias("name"), F.array_max(F.transform(F.filter("decls", lambda d: d["name"] == n), lambda d: d["line"])).alias("line")))
    rows = _parsed(facts).select(F.col("rel").alias("file"), "decls", unused.alias("names"))
    found = rows.select("file", F.explode(last).alias("u")).select("file", "u.line", "u.name", F.concat(F.lit("'"), "u.name", F.lit("' is never referenced")).alias("message"))
    return Outcome(found, _summary(rows, F.sum(F.size("names")), F.count("*")))


def _up(folder: Column, steps: Column) -> Column:
    """The folder so many steps above; null above the root."""
    depth = F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))
    return F.when(steps <= depth, F.array_join(F.slice(F.split(folder, "/"), F.lit(1), depth - steps), "/"))


def directives(facts: DataFrame, package: str = "") -> DataFrame:
    """(file, ord, line, names, dotted, base) of every import outside tests: what it names, the dotted names that may be
    files, and the folder they start from (null: outside the tree)."""
    rows = _parsed(facts).select(F.col("rel").alias("file"), F.explode("imports").alias("i"))
    module = F.when(F.col("i.module") != "", F.col("i.module"))
    within = F.transform("i.aliases", lambda a: F.concat(module, F.lit("."), a))
    dotted = F.when(module.isNull(), F.col("i.aliases")).otherwise(F.concat(F.array(module), within))
    names = F.when(module.isNull(), F.col("i.aliases")).otherwise(F.array(module))
    base = F.when(F.col("i.level") == 0, F.lit(package)).otherwise(_up(P.directory(F.col("file")), F.col("i.level") - 1))
    return rows.select("file", "i.ord", "i.line", names.alias("names"), dotted.alias("dotted"), base.alias("base"))


def resolved(imports: DataFrame, inventory: DataFrame) -> DataFrame:
    """(file, ord, line, target): the files of the inventory (rel) that directives() lead to, each once a directive."""
    stem = lambda d: F.concat(F.when(F.col("base") == "", F.lit("")).otherwise(F.concat("base", F.lit("/"))), F.translate(d, ".", "/"))
    candidates = F.flatten(F.transform("dotted", lambda d: F.array(F.concat(stem(d), F.lit(".py")), F.concat(stem(d), F.lit("/__init__.py")))))
    wanted = imports.where("base is not null").select("file", "ord", "line", F.explode(F.array_distinct(candidates)).alias("target"))
    return wanted.join(inventory.select(F.col("rel").alias("target")).distinct(), "target", "left_semi").select("file", "ord", "line", "target")


def unused_files(facts: DataFrame, inventory: DataFrame, package: str = "") -> Outcome:
    """Files outside tests that none of them imports; checks files, unparsable ones too. inventory: every file (rel)
    that imports may lead to, whatever is analyzed."""
    imported = resolved(directives(facts, package), inventory).select(F.col("target").alias("rel")).distinct()
    files = facts.where(~P.is_test_file(F.col("rel"))).select("rel")
    found = files.where(~P.is_setup_file(F.col("rel"))).join(imported, "rel", "left_anti")
    found = found.select(F.col("rel").alias("file"), F.lit("never imported by any analyzed source file").alias("message"))
    both = files.select(F.lit(0).alias("v"), F.lit(1).alias("c")).union(found.select(F.lit(1), F.lit(0)))
    return Outcome(found, _summary(both, F.sum("v"), F.sum("c")))


def _first_match(rules: Sequence[ImportRule], file: Column, target: Column) -> Column:
    """The place of the first rule that forbids target to file; null if none does. Rules are the caller's list, so they
    are part of the plan and each row stops at its first match."""
    fits = [F.when(file.rlike(P.glob_pattern(r.from_glob)) & target.rlike(P.glob_pattern(r.forbid_glob)), F.lit(i)) for i, r in enumerate(rules)]
    return F.coalesce(*fits) if fits else F.lit(None).cast("int")


def banned_imports(facts: DataFrame, inventory: DataFrame, rules: Sequence[ImportRule], package: str = "") -> Outcome:
    """Imports that a rule forbids, by what they name and by each file they lead to; checks parsed files."""
    file = F.col("file")
    some = [file.rlike(P.glob_pattern(r.from_glob)) for r in rules]
    applies = F.greatest(*some, F.lit(False)) if some else F.lit(False)
    imports = directives(facts, package).where(applies)
    named = imports.select("file", "ord", "line", F.posexplode("names").alias("nth", "target"))
    paths = resolved(imports, inventory).select("file", "ord", "line", F.lit(1 << 30).alias("nth"), "target")
    hits = named.union(paths).withColumn("rule", _first_match(rules, file, F.col("target"))).where("rule is not null")
    reason = F.get(F.array(*(F.lit(r.message or None).cast("string") for r in rules)), F.col("rule")) if rules else F.lit(None).cast("string")
    text = F.concat(F.lit("import '"), "target", F.lit("' is banned"), F.coalesce(F.concat(F.lit(" \u2014 "), reason), F.lit("")))
    found = hits.select("file", "ord", "line", "nth", "target", "rule", text.alias("message"))
    both = _parsed(facts).select(F.lit(0).alias("v"), F.lit(1).alias("c")).union(found.select(F.lit(1), F.lit(0)))
    return Outcome(found, _summary(both, F.sum("v"), F.sum("c")))


def repeats(literals: DataFrame) -> DataFrame:
    """Adds n, how often a file holds a key. Keys are spread over tasks by file and key."""
    counts = literals.groupBy("file", "key").agg(F.count("*").alias("n"))
    return literals.join(counts.where(F.col("n") >= MIN_REPEATS), ["file", "key"])


def magic_constants(facts: DataFrame) -> Outcome:
    """Hex colors, and literals of MIN_LENGTH characters that repeat MIN_REPEATS times, outside constants; checks parsed files."""
    colors = F.filter("literals", lambda x: x["free"] & x["hex"])
    again = F.filter("literals", lambda x: x["free"] & (x["n"] >= MIN_REPEATS) & (F.length(x["key"]) >= MIN_LENGTH))
    finding = lambda x, key, text: F.struct(key.alias("key"), x["ord"].alias("ord"), x["line"].alias("line"), text.alias("message"))
    text = lambda x: F.concat(F.lit("literal "), x["key"], F.lit(" repeats "), x["n"], F.lit(" times \u2014 extract a named constant"))
    found = F.concat(
        F.transform(colors, lambda x: finding(x, F.lit(""), F.lit("hex color outside a constant declaration"))),
        F.transform(again, lambda x: finding(x, x["key"], text(x))),
    )
    rows = _parsed(facts)
    violations = rows.select(F.col("rel").alias("file"), F.explode(found).alias("v")).select("file", "v.*")
    return Outcome(violations, _summary(rows, F.sum(F.size(colors) + F.size(again)), F.count("*")))


def assertion_counts(facts: DataFrame) -> DataFrame:
    """(file, ord, line, label, assertions) of every test body of the files given."""
    rows = _parsed(facts, tests=True).select(F.col("rel").alias("file"), F.explode("tests").alias("t"))
    return rows.select("file", "t.ord", "t.line", "t.label", F.size(F.filter("t.signals", S.is_assertion)).alias("assertions"))


def test_assertions(facts: DataFrame, least: int = MIN_ASSERTIONS) -> Outcome:
    """Test bodies of fewer than `least` assertions; checks test bodies. facts: of test files alone."""
    text = F.concat(F.lit("'"), "label", F.lit("' has "), "assertions", F.lit(" assertion(s) \u2014 a test without assertions verifies nothing"))
    return _items(assertion_counts(facts).withColumns({"message": text, "violated": F.col("assertions") < least}))


test_assertions.__test__ = False  # a rule, whatever its name looks like


def loose_files(folders: DataFrame, inventory: DataFrame) -> DataFrame:
    """(dir, loose): *.py files directly in each folder but those that set a package up; folders given twice count twice."""
    rel = F.col("rel")
    counts = inventory.where(rel.endswith(".py") & (P.base_name(rel) != ".py") & ~P.is_setup_file(rel)).groupBy(P.directory(rel).alias("dir")).agg(F.count("*").alias("loose"))
    return folders.join(counts, "dir", "left").select("dir", F.coalesce("loose", F.lit(0)).cast("long").alias("loose"))


def folder_structure(folders: DataFrame, inventory: DataFrame, most: int = 0) -> Outcome:
    """Folders (dir) with more than `most` loose files; checks folders."""
    text = F.concat("loose", F.lit(" loose .py files directly in "), "dir", F.lit(f" \u2014 group them into feature packages (max {most})"))
    return _items(loose_files(folders, inventory).withColumns({"message": text, "violated": F.col("loose") > most}))


def file_naming(files: DataFrame) -> Outcome:
    """Files (rel) with mechanical names; checks files outside tests. Nothing is parsed."""
    rows = files.where(~P.is_test_file(F.col("rel"))).select(F.col("rel").alias("file"), P.naming_message(F.col("rel")).alias("message"))
    return _items(rows.withColumn("violated", F.col("message").isNotNull()))
