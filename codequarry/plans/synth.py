"""Queries over Python source made from rows: every row becomes a file whose facts follow from its keys.

The whole way is run, parser included; the SQL beside each query has the closed form.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, rules, scoring
from .bound import table

RULES = [
    rules.ImportRule("pkg/m1*", "os*"),
    rules.ImportRule("pkg/*", "pkg/m?5.py", "ask the owners"),
    rules.ImportRule("*", "db.*", "go through services"),
]


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _times(n: Column, one: str) -> Column:
    return F.repeat(F.lit(one), n.cast("int"))


def _each(n: Column, one) -> Column:
    """one(i) for i from 1 to n, one after another; nothing for n = 0."""
    return F.when(n < 1, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), one), ""))


def _deep(n: Column, what: str, last: Column) -> Column:
    """n blocks within one another, then `last` at their depth."""
    return F.concat(_each(n, lambda i: F.concat(F.repeat(F.lit("    "), i), F.lit(what))), last)


def _files(df: DataFrame, rel: Column, content: Column) -> DataFrame:
    """Rows as files. Keys are spread over all cores before there is text: a small table is one task's scan, and parsing
    takes far longer than reading it."""
    spread = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return spread.select(rel.alias("rel"), content.alias("content"))


def _kept(files: DataFrame, *only: str) -> DataFrame:
    """The facts that several parts of a plan read, and no others: parsed once. What is kept may be dropped and is then
    parsed again."""
    return facts.facts(files, only=only).persist(StorageLevel.MEMORY_AND_DISK)


def _key(rel: str = "file") -> Column:
    return F.regexp_extract(rel, "([0-9]+)[.]py$", 1).cast("long")


def _rel(key: str, folder: str = "pkg") -> Column:
    return F.concat(F.lit(f"{folder}/m"), key, F.lit(".py"))


def _constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    source = _text(
        "def f(a, b):\n",
        _times(n % 5, "    if a:\n        b = 1\n"),
        "    x = a", _times(k % 4, " and b"), "\n",
        "    y = [i", _times(1 + n % 3, " for i in a"), "]\n",
        "    match a:\n", _times(1 + k % 2, "        case 1:\n            pass\n"), "        case _:\n            pass\n",
        "    z = lambda q: q if q else 0\n    for i in a:\n        pass\n    while a:\n        break\n    try:\n        pass\n",
        _times(1 + n % 4, "    except ValueError:\n        pass\n"),
    )
    return _files(table(spark, sf_dir, "part"), _rel("p_partkey"), source)


def complexity_by_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.methods(facts.facts(_constructs(spark, sf_dir))).select(_key().alias("p_partkey"), "complexity")


def score_from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report: source and coverage from the same rows. Lines 1 to p_size are executed, the next five missing."""
    files = _constructs(spark, sf_dir)
    lines = lambda a, b: F.sequence(a.cast("int"), b.cast("int"))
    coverage = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(_rel("p_partkey").alias("rel"), lines(F.lit(1), F.col("p_size")).alias("executed"), lines(F.col("p_size") + 1, F.col("p_size") + 5).alias("missing"))
    return scoring.score(scoring.methods(facts.facts(files)), coverage)


def method_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _text(
        _times(F.col("c_custkey") % 3, "# head\n"),
        "class A:\n    def m(self):\n        def inner():\n            pass\n        return inner\n\n    class B:\n        @property\n        def n(self):\n            pass\n\n",
        "if True:\n    def hidden():\n        pass\n\nasync def top():\n    class L:\n        def q(self):\n            pass\n",
    )
    found = scoring.methods(facts.facts(_files(table(spark, sf_dir, "customer"), _rel("c_custkey"), source)))
    return found.select(_key().alias("c_custkey"), "ord", "method_name", "start_line", "end_line")


def nested_def_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    source = _text(
        "def outer(a):\n", _times(k % 4, "    if a:\n        pass\n"),
        "    @dec(1 if a else 2)\n    def inner(p=1 if a else 2):\n        pass\n", _times(k % 6, "        if p:\n            pass\n"),
        "    class C:\n        x = 1 if a else 2\n        def m(self):\n            return 1 or 2\n",
    )
    found = scoring.methods(facts.facts(_files(table(spark, sf_dir, "supplier"), _rel("s_suppkey"), source)))
    return found.select(_key().alias("s_suppkey"), "method_name", "complexity")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size") % 9
    deepest = F.repeat(F.lit("    "), (n + 1).cast("int"))
    chain = _text("    if a:\n        pass\n", _times(n, "    elif a:\n        pass\n"))
    caught = _deep(n, "for i in a:\n", _text(deepest, "try:\n", deepest, "    pass\n", deepest, "except E:\n", deepest, "    pass\n"))
    body = F.when(k % 3 == 0, _deep(n, "if a:\n", _text(deepest, "pass\n"))).when(k % 3 == 1, chain).otherwise(caught)
    # every tenth file is a test, which isn't judged
    rel = F.when(k % 10 == 0, _rel("p_partkey", "tests")).otherwise(_rel("p_partkey"))
    return facts.facts(_files(table(spark, sf_dir, "part"), rel, _text("def f(a):\n", body)))


def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.nesting_depths(_nested(spark, sf_dir)).select(_key().alias("p_partkey"), "depth")


def nesting_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.nesting(_nested(spark, sf_dir)).violations.select("file", "line", "function", "depth", "message")


def nesting_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.nesting(_nested(spark, sf_dir)).summary


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    method = F.concat(F.lit("        def m(self):\n            pass\n"), _times(k % 5, "            if self:\n                pass\n"))
    static = F.concat(F.lit("        @staticmethod\n"), method)
    body = _each(k % 30, lambda i: F.when(i % 4 == 0, static).otherwise(method))
    return facts.facts(_files(table(spark, sf_dir, "supplier"), _rel("s_suppkey"), _text("if True:\n    class C:\n        x = 1\n", body)))


def class_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.class_size(_classes(spark, sf_dir)).violations.select("file", "line", "name", "methods", "weighted", "message")


def class_size_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.class_size(_classes(spark, sf_dir)).summary


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    source = _text(
        "class ", F.when(k % 5 == 0, "_C").otherwise("C"), ":\n    def __init__(self):\n        self._own = 0\n",
        _each(k % 6, lambda i: _text("        self.a", i.cast("string"), " = 1\n        self.a", i.cast("string"), " += 1\n")),
        "    @classmethod\n    def made(cls):\n        cls.b = 1\n    @staticmethod\n    def s(self):\n        self.c = 1\n",
        _each(k % 7, lambda i: _text("    def p", i.cast("string"), "(self):\n        pass\n")),
    )
    return facts.facts(_files(table(spark, sf_dir, "customer"), _rel("c_custkey"), source))


def class_weight_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.class_weight(_weights(spark, sf_dir)).violations.select("file", "line", "name", "fields", "members", "ratio")


def class_weight_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.class_weight(_weights(spark, sf_dir)).summary


def _privates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    declared = lambda i: _text("_v", i.cast("string"), F.when(i % 2 == 0, ": int = 0\n").otherwise(" = 0\n"))
    used = lambda i: F.when(i % 3 != 0, _text("print(_v", i.cast("string"), ")\n")).otherwise("")
    source = _text("__version__ = 1\nopen_ = 2\ndef _f():\n    pass\ndef _f():\n    pass\nclass _K:\n    pass\n_K()\n", _each(k % 10, lambda i: F.concat(declared(i), used(i))))
    return facts.facts(_files(table(spark, sf_dir, "supplier"), _rel("s_suppkey"), source))


def unused_private_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unused_code(_privates(spark, sf_dir)).violations


def unused_private_names_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unused_code(_privates(spark, sf_dir)).summary


def _importing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    source = _text(
        "import os, pkg.m", (k + 3).cast("string"), "\nfrom . import m", (k + 1).cast("string"), ", absent\n",
        "def f():\n    from pkg.m", (k + 2).cast("string"), " import x\n    from .. import pkg\nfrom ...far import y\n",
    )
    return _files(table(spark, sf_dir, "part"), _rel("p_partkey"), source)


def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _importing(spark, sf_dir)
    inventory = files.select("rel").union(spark.createDataFrame([("pkg/__init__.py",)], "rel string"))
    found = rules.resolved(rules.directives(facts.facts(files)), inventory)
    return found.select(_key("file").alias("p_partkey"), "line", "target")


def _doubles(spark: SparkSession, sf_dir: str) -> rules.Outcome:
    k = F.col("p_partkey")
    # module k imports module 2k; those that end in 3 are tests, whose imports don't count; every 50th doesn't parse
    rel = F.when(k % 10 == 3, _rel("p_partkey", "pkg/tests")).otherwise(_rel("p_partkey"))
    source = F.when(k % 50 == 0, "import (\n").otherwise(_text("import pkg.m", (2 * k).cast("string"), "\n"))
    files = _files(table(spark, sf_dir, "part"), rel, source).union(spark.createDataFrame([("pkg/__init__.py", "")], "rel string, content string"))
    return rules.unused_files(_kept(files, "imports"), files.select("rel"))


def unused_files_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(spark, sf_dir).violations


def unused_files_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(spark, sf_dir).summary


def _bans(spark: SparkSession, sf_dir: str) -> rules.Outcome:
    k = F.col("p_partkey")
    source = _text("import pkg.m", (k + 1).cast("string"), ", os.path\n", F.when(k % 3 == 0, "from db.core import session\n").otherwise("from dbx import session\n"))
    files = _files(table(spark, sf_dir, "part"), _rel("p_partkey"), source)
    return rules.banned_imports(_kept(files, "imports"), files.select("rel"), RULES)


def banned_imports_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bans(spark, sf_dir).violations.select("file", "line", "target", "rule", "message")


def banned_imports_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bans(spark, sf_dir).summary


def _constants(spark: SparkSession, sf_dir: str) -> rules.Outcome:
    k, n = F.col("p_partkey"), F.col("p_size")
    color = F.concat(F.lit("0x"), F.substring(F.lit("abcdef123"), F.lit(1), (5 + k % 5).cast("int")))
    source = _text(
        F.when(k % 2 == 0, "COLOR = ").otherwise("color = "), color, "\n",
        "x = [", _times(n % 6, "'word', "), "]\n",
        "d = {", _times(n % 4, "'field': 1000, "), "}\n",
        "y = d['field'], d['field'], d['field']\n",
        "class K:\n    LIST = ['inner', 'inner',\n        'inner']\n    seen = ['abc', 'abc', 'abc', True, None]\n",
    )
    return rules.magic_constants(facts.facts(_files(table(spark, sf_dir, "part"), _rel("p_partkey"), source), only=("literals",)))


def magic_constants_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _constants(spark, sf_dir).violations.select("file", "line", "message")


def magic_constants_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _constants(spark, sf_dir).summary


def _asserting(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    forms = F.array(*(F.lit(f"        {x}\n") for x in ("assert a", "self.assertTrue(a)", "pytest.raises(E)", "raises(E)", "fail()", "self.fail()")))
    other = "        self.check(a)\n        other.assertTrue(a)\n        self.raises(E)\n        print(a)\n"
    source = _text("class TestA:\n    def test_x(self):\n", other, _each(n % 3, lambda i: F.element_at(forms, (k % 6 + 1).cast("int"))), "    def helper(self):\n        pass\ndef test_y():\n    def test_inner():\n        pass\n")
    return facts.facts(_files(table(spark, sf_dir, "part"), F.concat(F.lit("tests/test_m"), "p_partkey", F.lit(".py")), source))


def test_assertion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.test_assertions(_asserting(spark, sf_dir)).violations.select("file", "line", "label", "assertions", "message")


def test_assertion_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.test_assertions(_asserting(spark, sf_dir), 2).summary


def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken files keep their row; whole ones beside them are read."""
    k = F.col("p_partkey")
    source = F.when(k % 4 == 0, "def f(:\n").when(k % 4 == 1, F.lit(None).cast("string")).when(k % 4 == 2, "").otherwise("def f(): pass\n")
    found = facts.facts(_files(table(spark, sf_dir, "part"), _rel("p_partkey"), source))
    return found.select(_key("rel").alias("p_partkey"), F.col("parse_error").isNotNull().alias("broken"), F.coalesce(F.size("functions"), F.lit(-1)).alias("n_functions"))


_SIZED = "WITH c AS (SELECT 'pkg/m' || s_suppkey || '.py' AS file, CAST(s_suppkey % 30 AS INTEGER) AS methods, CAST((s_suppkey % 30) * (1 + s_suppkey % 5) AS INTEGER) AS weighted FROM supplier) "
_DEPTHS = """
WITH n AS (
  SELECT p_partkey, 'pkg/m' || p_partkey || '.py' AS file, CAST(p_size % 9 + CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS depth
  FROM part WHERE p_partkey % 10 <> 0
)
"""
_MEMBERS = """
WITH w AS (
  SELECT c_custkey AS k, c_custkey % 6 AS f, c_custkey % 6 + c_custkey % 7 AS m FROM customer
), v AS (
  SELECT 'pkg/m' || k || '.py' AS file, 1 AS line, 'C' AS name, CAST(f AS INTEGER) AS fields, CAST(m AS INTEGER) AS members, CAST(f AS DOUBLE) / m AS ratio
  FROM w WHERE k % 5 <> 0 AND f > 0 AND CAST(f AS DOUBLE) / m > 0.33
)
"""
_UNUSED = """
WITH u AS (
  SELECT s_suppkey AS k, i FROM supplier, (SELECT unnest(range(1, 10)) AS i) WHERE i <= s_suppkey % 10 AND i % 3 = 0
), n AS (
  SELECT 'pkg/m' || k || '.py' AS file, CAST(9 + i + (i - 1) - (i - 1) // 3 AS INTEGER) AS line, '_v' || i AS name FROM u
  UNION ALL SELECT 'pkg/m' || s_suppkey || '.py', 5, '_f' FROM supplier
)
"""
_IMPORTED = """
WITH f AS (
  SELECT p_partkey AS k, p_partkey % 10 = 3 AS test, CASE WHEN p_partkey % 10 = 3 THEN 'pkg/tests/m' ELSE 'pkg/m' END || p_partkey || '.py' AS file FROM part
), u AS (
  SELECT file FROM f WHERE NOT test AND NOT EXISTS (SELECT 1 FROM f i WHERE NOT i.test AND i.k % 50 <> 0 AND 2 * i.k = f.k)
)
"""
_BANNED = r"""
WITH t AS (
  SELECT p_partkey AS k, 'pkg/m' || p_partkey || '.py' AS file, 1 AS line, 'pkg.m' || (p_partkey + 1) AS target FROM part
  UNION ALL SELECT p_partkey, 'pkg/m' || p_partkey || '.py', 1, 'os.path' FROM part
  UNION ALL SELECT p_partkey, 'pkg/m' || p_partkey || '.py', 2, CASE WHEN p_partkey % 3 = 0 THEN 'db.core' ELSE 'dbx' END FROM part
  UNION ALL SELECT a.p_partkey, 'pkg/m' || a.p_partkey || '.py', 1, 'pkg/m' || b.p_partkey || '.py' FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
), r AS (
  SELECT file, line, target, CASE WHEN starts_with(file, 'pkg/m1') AND starts_with(target, 'os') THEN 0
    WHEN regexp_full_match(target, 'pkg/m.5\.py') THEN 1 WHEN starts_with(target, 'db.') THEN 2 END AS rule FROM t
), v AS (
  SELECT *, 'import ''' || target || ''' is banned' || CASE rule WHEN 1 THEN ' — ask the owners' WHEN 2 THEN ' — go through services' ELSE '' END AS message
  FROM r WHERE rule IS NOT NULL
)
"""
_MAGIC = """
WITH p AS (
  SELECT 'pkg/m' || p_partkey || '.py' AS file, p_partkey AS k, p_size % 6 AS w, p_size % 4 AS f FROM part
), v AS (
  SELECT file, 1 AS line, 'hex color outside a constant declaration' AS message FROM p WHERE k % 2 = 1 AND 5 + k % 5 BETWEEN 6 AND 8
  UNION ALL SELECT file, 2, 'literal word repeats ' || w || ' times — extract a named constant' FROM p, (SELECT unnest(range(1, 6)) AS i) WHERE w >= 3 AND i <= w
  UNION ALL SELECT file, 3, 'literal 1000 repeats ' || f || ' times — extract a named constant' FROM p, (SELECT unnest(range(1, 4)) AS i) WHERE f >= 3 AND i <= f
)
"""
_STATUS = "SELECT {v} AS violations, {c} AS checked, CASE WHEN {v} > 0 THEN 2 ELSE 0 END AS status"
_COMPLEXITY = "CAST(1 + p_size % 5 + p_partkey % 4 + 1 + p_size % 3 + 2 + p_partkey % 2 + 3 + 1 + p_size % 4 AS INTEGER)"
_LAST = "CAST(1 + 2 * (p_size % 5) + 2 + 1 + 2 * (2 + p_partkey % 2) + 1 + 2 + 2 + 2 + 2 * (1 + p_size % 4) AS INTEGER)"

QUERIES = {
    "complexity_by_construct": (complexity_by_construct, f"SELECT p_partkey, {_COMPLEXITY} AS complexity FROM part"),
    "score_from_source": (
        score_from_source,
        f"""WITH p AS (SELECT p_partkey, {_COMPLEXITY} AS complexity, {_LAST} AS z, p_size AS n FROM part),
        c AS (SELECT *, CASE WHEN p_partkey % 10 <> 0 THEN CAST(least(n, z) AS DOUBLE) / least(n + 5, z) END AS coverage FROM p)
        SELECT 'f' AS method_name, 'pkg/m' || p_partkey || '.py' AS file, complexity, coverage,
          CAST(complexity AS DOUBLE) * complexity * ((1.0 - coverage) * (1.0 - coverage) * (1.0 - coverage)) + complexity AS score FROM c""",
    ),
    "method_inventory": (
        method_inventory,
        """SELECT c_custkey, ord, name AS method_name, CAST(c_custkey % 3 + a AS INTEGER) AS start_line, CAST(c_custkey % 3 + b AS INTEGER) AS end_line
        FROM customer, (VALUES (0, 'A.m', 2, 5), (1, 'm.inner', 3, 4), (2, 'A.B.n', 9, 10), (3, 'top', 16, 19), (4, 'top.L.q', 18, 19)) AS m(ord, name, a, b)""",
    ),
    "nested_def_isolation": (
        nested_def_isolation,
        """SELECT s_suppkey, 'outer' AS method_name, CAST(1 + s_suppkey % 4 + 1 AS INTEGER) AS complexity FROM supplier
        UNION ALL SELECT s_suppkey, 'outer.inner', CAST(1 + s_suppkey % 6 AS INTEGER) FROM supplier UNION ALL SELECT s_suppkey, 'outer.C.m', 2 FROM supplier""",
    ),
    "nesting_depth": (nesting_depth, _DEPTHS + "SELECT p_partkey, depth FROM n"),
    "nesting_gate": (nesting_gate, _DEPTHS + "SELECT file, 1 AS line, 'f' AS function, depth, 'f nesting depth ' || depth || ' > 5' AS message FROM n WHERE depth > 5"),
    "nesting_gate_summary": (nesting_gate_summary, _DEPTHS + _STATUS.format(v="count(*) FILTER (depth > 5)", c="count(*)") + " FROM n"),
    "class_size_gate": (
        class_size_gate,
        _SIZED + """SELECT file, 2 AS line, 'C' AS name, methods, weighted, 'class C: ' || concat_ws(', ', CASE WHEN methods > 25 THEN methods || ' methods (max 25)' END,
        CASE WHEN weighted > 80 THEN 'weighted methods ' || weighted || ' (max 80)' END) AS message FROM c WHERE methods > 25 OR weighted > 80""",
    ),
    "class_size_gate_summary": (class_size_gate_summary, _SIZED + _STATUS.format(v="count(*) FILTER (methods > 25 OR weighted > 80)", c="count(*)") + " FROM c"),
    "class_weight_gate": (class_weight_gate, _MEMBERS + "SELECT * FROM v"),
    "class_weight_gate_summary": (class_weight_gate_summary, _MEMBERS + _STATUS.format(v="(SELECT count(*) FROM v)", c="(SELECT count(*) FROM customer)")),
    "unused_private_names": (unused_private_names, _UNUSED + "SELECT *, '''' || name || ''' is never referenced' AS message FROM n"),
    "unused_private_names_summary": (unused_private_names_summary, _UNUSED + _STATUS.format(v="(SELECT count(*) FROM n)", c="(SELECT count(*) FROM supplier)")),
    "import_resolution": (
        import_resolution,
        """SELECT a.p_partkey, CASE b.p_partkey - a.p_partkey WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS line, 'pkg/m' || b.p_partkey || '.py' AS target
        FROM part a JOIN part b ON b.p_partkey - a.p_partkey IN (1, 2, 3) UNION ALL SELECT p_partkey, 5, 'pkg/__init__.py' FROM part""",
    ),
    "unused_files_gate": (unused_files_gate, _IMPORTED + "SELECT file, 'never imported by any analyzed source file' AS message FROM u"),
    "unused_files_gate_summary": (unused_files_gate_summary, _IMPORTED + _STATUS.format(v="(SELECT count(*) FROM u)", c="(SELECT count(*) + 1 FROM f WHERE NOT test)")),
    "banned_imports_gate": (banned_imports_gate, _BANNED + "SELECT * FROM v"),
    "banned_imports_gate_summary": (banned_imports_gate_summary, _BANNED + _STATUS.format(v="(SELECT count(*) FROM v)", c="(SELECT count(*) FROM part)")),
    "magic_constants_gate": (magic_constants_gate, _MAGIC + "SELECT * FROM v"),
    "magic_constants_gate_summary": (magic_constants_gate_summary, _MAGIC + _STATUS.format(v="(SELECT count(*) FROM v)", c="(SELECT count(*) FROM part)")),
    "test_assertion_gate": (
        test_assertion_gate,
        """WITH t AS (SELECT 'tests/test_m' || p_partkey || '.py' AS file, 2 AS line, 'TestA.test_x' AS label, CAST(p_size % 3 AS INTEGER) AS assertions FROM part
        UNION ALL SELECT 'tests/test_m' || p_partkey || '.py', CAST(9 + p_size % 3 AS INTEGER), 'test_y', 0 FROM part)
        SELECT *, '''' || label || ''' has ' || assertions || ' assertion(s) — a test without assertions verifies nothing' AS message FROM t WHERE assertions < 1""",
    ),
    "test_assertion_gate_summary": (test_assertion_gate_summary, _STATUS.format(v="count(*) FILTER (p_size % 3 < 2) + count(*)", c="2 * count(*)") + " FROM part"),
    "parse_errors": (parse_errors, "SELECT p_partkey, p_partkey % 4 < 2 AS broken, CASE p_partkey % 4 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE -1 END AS n_functions FROM part"),
}
