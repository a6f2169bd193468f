"""Rules over small trees of files."""

import pytest
from codequarry.operators import facts, rules
from pyspark.sql import functions as F


@pytest.fixture
def of(spark):
    return lambda tree: facts.facts(spark.createDataFrame(list(tree.items()) or [], "rel string, content string")).persist()


def inventory(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "rel string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_nesting(of):
    deep = "def f():\n" + "".join("    " * i + "if a:\n" for i in range(1, 7)) + "    " * 7 + "pass\ndef g(): pass\n"
    out = rules.nesting(of({"a.py": deep, "tests/a.py": deep, "bad.py": "def ("}))
    assert rows(out.violations, "file", "line", "message") == [("a.py", 1, "f nesting depth 7 > 5")]
    assert out.summary.first()[:] == (1, 2, 2)


def test_class_size(of):
    many = "class A:\n" + "".join(f"    def m{i}(self): pass\n" for i in range(26))
    heavy = "class B:\n    def m(self):\n" + "        if a: pass\n" * 80
    both = "class C:\n" + "".join(f"    def m{i}(self):\n" + "        if a: pass\n" * 4 for i in range(26))
    out = rules.class_size(of({"a.py": many + heavy + both, "b.py": "class D:\n    pass\n"}))
    assert rows(out.violations, "message") == [("class A: 26 methods (max 25)",), ("class B: weighted methods 81 (max 80)",), ("class C: 26 methods (max 25), weighted methods 130 (max 80)",)]
    assert out.summary.first()[:] == (3, 4, 2)


def test_class_weight(of):
    out = rules.class_weight(of({"a.py": "class A:\n  def __init__(self):\n    self.x = self.y = 1\n  def m(self): pass\nclass _B:\n  def __init__(self): self.x = 1\nclass C:\n  def m(self): pass\n"}))
    assert rows(out.violations, "name", "fields", "members") == [("A", 2, 3)]
    assert out.summary.first()[:] == (1, 3, 2)


def test_unused_code(of):
    out = rules.unused_code(of({"a.py": "_x = 1\n_y = 2\n_x = 3\nprint(_y)\n_ = 0\n__all__ = ['_x']\ndef _f(): _f\n", "b.py": "z = 1\n"}))
    assert rows(out.violations, "line", "name") == [(3, "_x"), (5, "_")]
    assert out.summary.first()[:] == (2, 2, 2)


TREE = {
    "src/pkg/__init__.py": "from .a import x\n",
    "src/pkg/a.py": "import pkg.sub.b\nfrom . import c\n",
    "src/pkg/sub/b.py": "from ..d import y\nfrom ... import far\nfrom .... import beyond\nimport os, json\n",
    "src/pkg/c.py": "",
    "src/pkg/d.py": "import pkg.e\n",
    "src/pkg/e.py": "bad (",
    "src/pkg/f.py": "import pkg.f\n",
    "src/pkg/g.py": "",
    "src/pkg/__main__.py": "",
    "src/tests/t.py": "import pkg.g\n",
    "src/far.py": "",
}


def test_imports_and_unused_files(spark, of):
    everything = inventory(spark, *TREE)
    found = rules.resolved(rules.directives(of(TREE), "src"), everything)
    assert rows(found, "file", "target") == sorted(
        [("src/pkg/__init__.py", "src/pkg/a.py"), ("src/pkg/a.py", "src/pkg/sub/b.py"), ("src/pkg/a.py", "src/pkg/c.py"), ("src/pkg/sub/b.py", "src/pkg/d.py"), ("src/pkg/sub/b.py", "src/far.py"), ("src/pkg/d.py", "src/pkg/e.py"), ("src/pkg/f.py", "src/pkg/f.py")]
    )
    out = rules.unused_files(of(TREE), everything, "src")
    assert rows(out.violations, "file") == [("src/pkg/g.py",)]
    assert out.summary.first()[:] == (1, 10, 2)


def test_banned_imports(spark, of):
    tree = {"app/ui.py": "import db.core, os\nfrom db import core\nfrom . import ui\n", "app/x.py": "import db\n", "db/core.py": "", "db/__init__.py": ""}
    limits = rules.import_rules(["app/u*", "*"], ["db*", "*.py"], ["use a service"])
    out = rules.banned_imports(of(tree), inventory(spark, *tree), limits)
    assert rows(out.violations, "file", "line", "target", "rule") == sorted(
        [("app/ui.py", 1, "db.core", 0), ("app/ui.py", 1, "db/core.py", 0), ("app/ui.py", 2, "db", 0), ("app/ui.py", 2, "db/__init__.py", 0), ("app/ui.py", 2, "db/core.py", 0), ("app/ui.py", 3, "app/ui.py", 1), ("app/x.py", 1, "db/__init__.py", 1)]
    )
    assert {r["message"] for r in out.violations.where("target in ('db', 'app/ui.py')").collect()} == {"import 'db' is banned \u2014 use a service", "import 'app/ui.py' is banned"}
    assert out.summary.first()[:] == (7, 4, 2)
    assert rules.banned_imports(of(tree), inventory(spark, *tree), []).summary.first()[:] == (0, 4, 0)
    with pytest.raises(ValueError):
        rules.import_rules(["a"], [])


def test_magic_constants(of):
    source = "C = 0xAABBCC\nx = 0xAABBCC\ny = ['word', 'word', 'word', 'abc', 'abc', 'abc']\nD = 'word'; z = 'word'\n" + 'w = f"{x}word"\n'
    out = rules.magic_constants(of({"a.py": source, "b.py": "", "bad.py": "("}))
    assert rows(out.violations, "line", "message") == [(2, "hex color outside a constant declaration"), *[(n, "literal word repeats 4 times \u2014 extract a named constant") for n in (3, 3, 3, 5)]]
    assert out.summary.first()[:] == (5, 2, 2)


def test_summary_of_literals_parses_once_unkept(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    files = spark.createDataFrame([(f"m{i}.py", "x = 0xAABBCC, 'word', 'word', 'word'\n") for i in range(40)], "rel string, content string")
    out = rules.magic_constants(facts.facts(files.mapInArrow(counting, files.schema), only=["literals"]))
    assert out.summary.first()[:] == (160, 40, 2)
    assert calls.value == 40


def test_literals_are_judged_within_a_files_row(spark):
    # rows of one path are files of their own
    files = [("a.py", "x = 'word', 'word'\n"), ("a.py", "x = 'word', 'word', 'word', 0xAABBCC, 0xAABBCC, 0xAABBCC\n"), ("bad.py", "(")]
    out = rules.magic_constants(facts.facts(spark.createDataFrame(files, "rel string, content string"), only=["literals"]))
    color, text = "hex color outside a constant declaration", "literal {} repeats 3 times \u2014 extract a named constant"
    want = [*(("", n, color) for n in (3, 4, 5)), *(("0xAABBCC", n, text.format("0xAABBCC")) for n in (3, 4, 5)), *(("word", n, text.format("word")) for n in range(3))]
    assert rows(out.violations, "key", "ord", "message") == want
    assert out.summary.first()[:] == (9, 2, 2)
    plan = out.violations._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in ("Join", "Sort", "Aggregate", "Repartition") if x in plan]


def test_assertions(of):
    out = rules.test_assertions(of({"tests/test_a.py": "def test_a(): pass\ndef test_b(): assert 1\nclass T:\n  def test_c(self): self.check()\n"}))
    assert rows(out.violations, "label", "assertions") == [("T.test_c", 0), ("test_a", 0)]
    assert out.summary.first()[:] == (2, 3, 2)


def test_folders_and_names(spark):
    everything = inventory(spark, "p/a.py", "p/b.py", "p/__init__.py", "p/q/c.py", "p/test_a.py", "r/x.txt", "p/.py")
    out = rules.folder_structure(spark.createDataFrame([("p",), ("p",), ("r",)], "dir string"), everything, 2)
    assert rows(out.violations, "dir", "loose") == [("p", 3), ("p", 3)]
    assert out.summary.first()[:] == (2, 3, 2)
    names = rules.file_naming(inventory(spark, "p/utils.py", "p/fine.py", "tests/utils.py", "p/part2.py"))
    assert rows(names.violations, "file") == [("p/part2.py",), ("p/utils.py",)]
    assert names.summary.first()[:] == (2, 3, 2)


def test_a_hot_key_is_counted_whole(spark):
    df = spark.range(30_000).select(F.lit("a.py").alias("file"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    assert rules.repeats(df).groupBy("key").agg(F.max("n").alias("n"), F.count("*").alias("c")).collect()[0][:] == ("hot", 10_000, 10_000)
