"""Predicates and projections on paths."""

import fnmatch

import pytest
from codequarry.functions import paths as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def each(spark, values, make):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(make(F.col("x")).alias("y")).collect()]


def test_selection(spark):
    names = ["a.py", "test_a.py", "a_test.py", "conftest.py", "tests/a.py", "tests.py", "src/test/b/c.py", "testing/a.py", "build/a.py", "x/.venv/a.py", "builds/a.py"]
    assert each(spark, names, P.is_test_file) == [False, True, True, True, True, False, True, False, False, False, False]
    assert each(spark, names, P.has_test_name) == [False, True, True, True] + [False] * 7
    assert each(spark, names, P.in_excluded_dir) == [False] * 8 + [True, True, False]


def test_parts(spark):
    assert each(spark, ["a/b.py", "b.py", "a/b.c/d.e.py", ".py", "a/.hidden", "x."], P.stem) == ["b", "b", "d.e", ".py", ".hidden", "x."]
    assert each(spark, ["a/b.py", "b.py", "a/b.c/d.py"], P.directory) == ["a", "", "a/b.c"]
    assert each(spark, ["a/b.py", "b.py", "a/b.c/d.py"], P.module_prefix) == ["a.b", "b", "a.b.c.d"]
    assert each(spark, ["/r/a.py", "/rr/a.py", "a.py", "/r"], lambda x: P.relative_to(x, "/r/")) == ["a.py", "/rr/a.py", "a.py", "/r"]


@pytest.mark.parametrize("name, kind", [("utils", "generic"), ("Types", "generic"), ("part2", "numeric"), ("v_2", "numeric"), ("Batch10", "numeric"), ("sha256", None), ("x86", None), ("UTF8", None), ("2020", None), ("b2b", None), ("a-1", None), ("md6", "numeric")])
def test_naming(spark, name, kind):
    (got,) = each(spark, [f"src/{name}.py"], P.naming_message)
    assert (got is None) if kind is None else (got.startswith(kind) and f'"{name}.py"' in got)


def test_all_families_are_allowed(spark):
    assert each(spark, [f"{s}.py" for s in P.NUMERIC_STEMS], P.naming_message) == [None] * len(P.NUMERIC_STEMS)
    assert len(P.NUMERIC_STEMS) == 46 and len(P.GENERIC_STEMS) == 16


def test_status_lines(spark):
    lines = [" M a.py", "R  a.py -> b/c.py", '?? "a b.py"', "??", "", 'R  "a b" -> "c d"', "A   x  "]
    assert each(spark, lines, P.status_path) == ["a.py", "b/c.py", "a b.py", None, None, "c d", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab*?[]!/.-^\\&|x")), max_size=8).map("".join), st.lists(st.sampled_from(list("ab/.-[]!^\\&|x")), max_size=6).map("".join))
def test_globs_as_python_has_them(glob, text):
    import re

    # the same expression for either engine, but for how the end is spelled
    pattern = P.glob_pattern(glob).replace("\\z", "\\Z")
    try:
        got = re.search(pattern, text) is not None
    except re.error:
        got = None  # a range that runs backwards
    if got is not None:
        assert got == fnmatch.fnmatchcase(text, glob), pattern


def test_globs_in_the_engine(spark):
    cases = [("src/*.py", "src/a/b.py", True), ("src/**/x?.py", "src/q/xy.py", True), ("[!a]*", "abc", False), ("[a-c]x", "bx", True), ("a[", "a[", True), ("*.PY", "a.py", False), ("a\nb*", "a\nbc\n", True), ("a&&b", "a&&b", True), ("[&&a]", "a", True)]
    for glob, text, want in cases:
        assert each(spark, [text], lambda x, g=glob: x.rlike(P.glob_pattern(g))) == [want], glob
