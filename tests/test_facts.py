"""Syntax facts: one construct a case."""

import ast
import textwrap

import pyarrow as pa
import pytest
from codequarry.functions import scores as S
from codequarry.operators import facts, rules, scoring
from hypothesis import given, settings
from hypothesis import strategies as st

WEIGHT = {"bool": lambda a: a - 1, "comprehension": lambda a: a}


def complexity(source, name="f"):
    found = {f["name"]: f for f in facts.extract(textwrap.dedent(source))["functions"]}
    return 1 + sum(WEIGHT.get(p["kind"], lambda a: 1)(p["arity"]) for p in found[name]["points"])


@pytest.mark.parametrize(
    "body, want",
    [
        ("pass", 1),
        ("if a: pass", 2),
        ("if a: pass\n    elif b: pass\n    else: pass", 3),
        ("for x in a: pass\n    else: pass", 2),
        ("while a: pass", 2),
        ("try: pass\n    except A: pass\n    except B: pass\n    finally: pass", 3),
        ("x = 1 if a else 2", 2),
        ("x = a and b and c or d", 4),
        ("x = [i for i in a for j in i if j]", 3),
        ("x = {i: 1 for i in a}; y = (i for i in a); z = {i for i in a}", 4),
        ("match a:\n        case 1: pass\n        case _: pass", 3),
        ("x = lambda q: q if q else 0", 2),
        ("with a: pass\n    assert a", 1),
        ("class K:\n        x = 1 if a else 2\n        def m(self):\n            if a: pass", 2),
        ("def g(p=1 if a else 2):\n        if a: pass", 1),
        ("async def g(): pass\n    async for x in a: pass", 2),
    ],
)
def test_complexity(body, want):
    assert complexity(f"async def f(a, b=None):\n    {body}\n") == want


@pytest.mark.parametrize(
    "body, want",
    [
        ("pass", 1),
        ("if a: pass", 2),
        ("if a: pass\n    elif b: pass", 3),
        ("if a: pass\n    elif b: pass\n    elif c: pass\n    else: pass", 4),
        ("try: pass\n    except E: pass", 3),
        ("try: pass\n    finally:\n        if a: pass", 3),
        ("try: pass\n    except* E: pass", 3),
        ("match a:\n        case 1:\n            if a: pass", 3),
        ("with a:\n        for x in a:\n            while x: pass", 4),
        ("def g():\n        if a:\n            if a: pass", 1),
        ("class K:\n        if a: pass", 1),
    ],
)
def test_depth(body, want):
    assert max(facts.extract(f"def f(a):\n    {body}\n")["functions"][0]["levels"]) == want


def test_names_of_functions():
    source = "class A:\n  class B:\n    def m(self):\n      def i():\n        class C:\n          def q(self): pass\nif 1:\n  def hidden(): pass\n@d\ndef t(): pass\n"
    got = [(f["name"], f["start_line"], f["end_line"]) for f in facts.extract(source)["functions"]]
    assert got == [("A.B.m", 3, 6), ("m.i", 4, 6), ("i.C.q", 6, 6), ("t", 10, 10)]


def test_classes_are_found_anywhere():
    source = "if 1:\n  class A:\n    def m(self):\n      self.x = 1\n      self.x += 1\n      self.y: int\n      other.z = 1\n      class B: pass\n    @staticmethod\n    def s(self): self.no = 1\n    @a.classmethod\n    def c(self): self._p = 1\n"
    a, b = facts.extract(source)["classes"]
    assert (a["name"], [m["name"] for m in a["members"]], [m["instance"] for m in a["members"]]) == ("A", ["m", "s", "c"], [True, False, True])
    assert sorted(a["stores"]) == ["_p", "x", "x", "y"] and b["name"] == "B"


def test_declared_and_used_names():
    got = facts.extract("_a = 1\n_b = _c = 2\n_d: int\n_e, _f = 1, 2\n_a = 3\ndef g():\n  _a = 1\n")
    assert [(d["name"], d["line"]) for d in got["decls"]] == [("_a", 1), ("_d", 3), ("_a", 5), ("g", 6)]
    assert got["refs"] == ["_a", "_e", "_f", "int"]


def test_imports_breadth_first():
    got = facts.extract("def f():\n  import a.b as c, d\nfrom .x import y\nfrom .. import z\nfrom p.q import *\n")["imports"]
    assert [(i["line"], i["plain"], i["module"], i["level"], i["aliases"]) for i in got] == [(3, False, "x", 1, ["y"]), (4, False, None, 2, ["z"]), (5, False, "p.q", 0, ["*"]), (2, True, None, 0, ["a.b", "d"])]


def test_literals_and_constant_spans():
    source = "A = f(\n 'wide',\n 0xABCDEF)\n_B: int = 1000\nc = 'é', 1e10, b'by\\n', True, None, ...\nd = {'key': x['index'], **e}\nmatch q:\n  case 'pat': pass\nx = 'a' 'b'\n"
    got = facts.extract(source)
    assert sorted((x["line"], x["key"], x["hex"]) for x in got["literals"]) == sorted([(2, "wide", False), (3, "0xABCDEF", True), (4, "1000", False), (5, "é", False), (5, "1e10", False), (5, "b'by\\n'", False), (5, "...", False), (9, "ab", False)])
    assert [(s["start"], s["end"]) for s in got["const_spans"]] == [(1, 3), (4, 4)]


def test_lexemes_over_lines():
    source = "x = (b'one'\r\n  b'two', 12345)\r\ny = 0xFFEEDD\x0c\n"
    assert [x["key"] for x in facts.extract(source)["literals"]] == ["0xFFEEDD", "b'one'\r\n  b'two'", "12345"]


def test_signals():
    source = "class T:\n  def test_a(self):\n    assert x\n    def inner(): self.assertX(1)\n    with pytest.raises(E): fail()\n  if 1:\n    def test_no(self): pass\ndef test_b(): raises(E)\n"
    got = facts.extract(source)["tests"]
    assert [(t["label"], t["line"], len(t["signals"])) for t in got] == [("T.test_a", 2, 4), ("test_b", 8, 1)]


@pytest.mark.parametrize("source", [None, "def f(:", "x = 1\x00", "(" * 5000, "-" * 200_000 + "1", "a" + ".b" * 30_000])
def test_what_cannot_be_parsed_is_told(source):
    got = facts.extract(source)
    assert got["parse_error"] or "functions" in got


def test_own_names_of_this_library_parse():
    assert facts.extract(open(facts.__file__, encoding="utf-8").read())["parse_error"] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["if a: pass", "x = a or b", "y = [i for i in a]", "for i in a: pass", "pass", "z = 1 if a else 2"]), max_size=12))
def test_points_add_up(lines):
    source = "def f(a, b):\n" + "".join(f"    {x}\n" for x in lines) + "    return\n"
    tree = ast.parse(source)
    count = sum(isinstance(n, (ast.If, ast.For, ast.IfExp, ast.BoolOp, ast.ListComp)) for n in ast.walk(tree))
    assert complexity(source) == 1 + count


def test_parsed_once_when_kept(spark):
    calls = spark.sparkContext.accumulator(0)
    plain = facts.extract

    files = spark.createDataFrame([(f"m{i}.py", "def f(): pass\n" if i % 4 else "def (") for i in range(40)], "rel string, content string")

    def counting(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    kept = facts.facts(files.mapInArrow(counting, files.schema)).persist()
    assert rules.nesting(kept).summary.first()["checked"] == 30
    assert rules.unused_code(kept).summary.first()["checked"] == 30
    assert scoring.methods(kept).count() == 30
    assert calls.value == 40
    assert plain("def f(): pass")["parse_error"] is None
    kept.unpersist()


def test_free_literals_are_counted_by_key():
    source = "A = ['word',\n 'word']\nx = ['word', 'word', 1000]\ndef f():\n  B = 'word'; return 1000, d['word']\n"
    got = facts.extract(source)["literals"]
    assert sorted((x["line"], x["key"], x["free"], x["n"]) for x in got) == [(1, "word", False, 0), (2, "word", False, 0), (3, "1000", True, 2), (3, "word", True, 3), (3, "word", True, 3), (5, "1000", True, 2), (5, "word", True, 3)]


def test_lone_surrogates_are_keys_of_their_own():
    got = facts.extract("x = ['\\ud800abc', '\\ud801abc', '\\ud801abc']\n")["literals"]
    assert [(x["key"], x["n"]) for x in got] == [("?abc", 1), ("?abc", 2), ("?abc", 2)]


def test_only_what_is_asked_for_is_gathered(spark, monkeypatch):
    whole, files = facts.extract("X = 1000\ny = X\n"), spark.createDataFrame([("a.py", "X = 1000\ny = X\n"), ("b.py", "(")], "rel string, content string")
    got = facts.facts(files, only=["refs", "literals"])
    assert got.columns == ["rel", "parse_error", "refs", "literals"]
    a, b = got.orderBy("rel").collect()
    assert (a["refs"], [x.asDict() for x in a["literals"]]) == (whole["refs"], whole["literals"]) and b["parse_error"] and b["literals"] is None
    monkeypatch.setattr(facts, "_functions", lambda tree: 1 / 0)
    assert facts.extract("X = 1000\n", ["literals"])["literals"] == facts.extract("X = 1000\n", ["const_spans"])["literals"]
    with pytest.raises(ValueError):
        facts.facts(files, only=["litterals"])


def test_columns_are_what_arrow_makes_of_dicts():
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.list_(pa.struct([("c", pa.string()), ("d", pa.bool_())])))]))
    for rows in ([], [None], [[], None, [{"a": 1, "b": []}, {"a": None, "b": None}], [{"a": 2, "b": [{"c": "x", "d": True}, {"c": None, "d": None}]}], None, []]):
        assert facts._column(rows, kind).equals(pa.array(rows, kind))


def test_nulls_and_empty_table(spark):
    schema = "rel string, content string, parse_error int"
    got = facts.facts(spark.createDataFrame([("a.py", None, 1), ("b.py", "", 1), ("b.py", "", 1)], schema))
    assert sorted((r["rel"], r["parse_error"]) for r in got.collect()) == [("a.py", "unreadable"), ("b.py", None), ("b.py", None)]
    empty = facts.facts(spark.createDataFrame([], schema))
    assert rules.nesting(empty).summary.first().asDict() == {"violations": 0, "checked": 0, "status": 0}
    assert rules.unused_code(empty).summary.first().asDict() == {"violations": 0, "checked": 0, "status": 0}
    assert scoring.verdict(scoring.score(scoring.methods(empty), spark.createDataFrame([], "rel string, executed array<int>, missing array<int>"))).first()["max_score"] == 0.0


def test_formulas(spark):
    from pyspark.sql import functions as F

    rows = [(5, 1.0, 5.0), (5, 0.0, 30.0), (8, 0.45, 18.648), (3, None, None)]
    df = spark.createDataFrame(rows, "cc int, cov double, want double").withColumn("got", S.risk_score(F.col("cc"), F.col("cov")))
    for r in df.collect():
        assert r["got"] == (None if r["want"] is None else pytest.approx(r["want"]))
    one = spark.range(1)
    span = lambda e, m, a, b: one.select(S.span_coverage(F.array(*map(F.lit, e)).cast("array<int>"), F.array(*map(F.lit, m)).cast("array<int>"), F.lit(a), F.lit(b))).first()[0]
    assert span([1, 2, 2], [3], 1, 3) == pytest.approx(2 / 3)
    assert span([1, 2], [2], 1, 2) == 1.0
    assert span([9], [8], 1, 3) is None and span([], [], 1, 3) is None and span([], [2], 1, 3) == 0.0
    assert one.select(S.data_weight(F.lit(0), F.lit(0)), S.mean_micros(F.lit(5.0), F.lit(0))).first()[:] == (0.0, 0.0)
