"""Commands over a tree on disk: selection, output, exit status."""

import json
import os
import subprocess

import pytest
from codequarry import cli
from codequarry.sources import files


@pytest.fixture
def tree(tmp_path):
    def write(**_):
        return tmp_path

    for name, text in {
        "src/pkg/__init__.py": "",
        "src/pkg/simple.py": "def simple():\n    return 1\n\n\ndef branchy(a):\n    if a:\n        return 1\n    if not a:\n        return 2\n",
        "src/pkg/utils.py": "from pkg.simple import simple\n_unused = 1\n",
        "src/pkg/broken.py": "def (\n",
        "src/pkg/test_simple.py": "def test_a():\n    pass\n",
        "src/build/skip.py": "x = 1\n",
        "src/tests/helpers.py": "def helper(): pass\n",
        "outside.py": "x = 1\n",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "coverage.json").write_text(json.dumps({"files": {"src/pkg/simple.py": {"executed_lines": [1, 2, 5, 6], "missing_lines": [7, 8, 9]}}}))
    return str(tmp_path)


def run(spark, root, *args):
    return cli.main(list(args), root, spark)


def rels(df):
    return sorted(r["rel"] for r in df.collect())


def test_selection(spark, tree):
    assert rels(files.source_files(spark, tree)) == ["src/pkg/__init__.py", "src/pkg/broken.py", "src/pkg/simple.py", "src/pkg/utils.py", "src/tests/helpers.py"]
    assert rels(files.test_files(spark, tree)) == ["src/pkg/test_simple.py", "src/tests/helpers.py"]
    assert rels(files.selected(spark, tree, ["outside.py", "outside.py", "coverage.json", "absent", "src/build"])) == ["coverage.json", "outside.py"]
    assert rels(files.selected(spark, tree, ["src", "outside.py"], tests=True)) == ["src/pkg/test_simple.py", "src/tests/helpers.py"]
    assert [r["dir"] for r in files.default_folders(files.tree(spark, tree), "src").collect()] == ["src/pkg"]
    assert files.package_root(tree) == "src" and files.package_root(os.path.join(tree, "src")) == ""


def test_score_report(spark, tree, capsys):
    assert run(spark, tree) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "Risk Report" and out[1] == "=" * 11
    assert out[4].split() == ["branchy", "src/pkg/simple.py", "3", "40.0%", "4.9"]
    assert out[5].split() == ["simple", "src/pkg/simple.py", "1", "100.0%", "1.0"]
    assert out[6].split() == ["helper", "src/tests/helpers.py", "1", "N/A", "N/A"]
    assert out[-1] == "Max Risk: 4.9 (threshold 8.0) \u2014 passed"
    assert run(spark, tree, "--threshold", "2") == 2
    assert run(spark, tree, "--changed", "x.py") == 1
    with pytest.raises(SystemExit) as e:
        run(spark, tree, "--nonsense")
    assert e.value.code == 1


@pytest.mark.parametrize(
    "args, status, told",
    [
        (["nesting"], 0, "2 functions within nesting depth 5"),
        (["class-size"], 0, "0 classes within 25 methods/WMC 80"),
        (["weight-of-class"], 0, "0 classes within data weight 0.33"),
        (["unused-code"], 2, "src/pkg/utils.py:2: '_unused' is never referenced"),
        (["unused-code", "src"], 0, "unused-code: not meaningful for a partial selection"),
        (["unused-files"], 2, "src/pkg/utils.py: never imported by any analyzed source file"),
        (["banned-imports", "--from", "src/*", "--forbid", "pkg.*", "--message", "no"], 2, "src/pkg/utils.py:1: import 'pkg.simple' is banned \u2014 no"),
        (["banned-imports"], 0, "No banned-import rules given \u2014 nothing to enforce."),
        (["banned-imports", "--from", "x"], 1, ""),
        (["magic-constants"], 0, "3 files free of magic constants"),
        (["test-assertions"], 2, "1/1 tests without assertions"),
        (["test-assertions", "--min", "0"], 0, "1 tests assert their expectations"),
        (["folder-structure"], 2, "src/pkg: 4 loose .py files directly in src/pkg \u2014 group them into feature packages (max 0)"),
        (["folder-structure", "--dir", "src/pkg", "--max", "4", "--dir", "absent"], 0, "1 directories organized into packages"),
        (["file-naming"], 2, "1/4 files with mechanical names"),
        (["nesting", "absent.py"], 0, "No Python files to check."),
    ],
)
def test_commands(spark, tree, capsys, args, status, told):
    assert run(spark, tree, *args) == status
    assert told in capsys.readouterr().out.splitlines() + [""]


def test_profile(spark, tree, capsys):
    with open(os.path.join(tree, "t.json"), "w") as f:
        json.dump({"src.pkg.simple.simple": {"calls": 2, "totalMicros": 9000, "minMicros": 1, "maxMicros": 8000}, "other.f": {"calls": 1, "totalMicros": 1}}, f)
    assert run(spark, tree, "profile", "--timings", "t.json", "--threshold", "5") == 2
    assert "src/pkg/simple.py:1" in capsys.readouterr().out
    assert len(os.listdir(os.path.join(tree, "profile-reports"))) == 2


def test_changed_files(spark, tree):
    git = lambda *a: subprocess.run(["git", "-C", tree, "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    with pytest.raises(RuntimeError, match="git status failed"):
        files.changed_files(spark, tree)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    os.rename(os.path.join(tree, "outside.py"), os.path.join(tree, "moved on.py"))
    open(os.path.join(tree, "src/pkg/simple.py"), "a").write("x = 1\n")
    os.remove(os.path.join(tree, "src/pkg/utils.py"))
    git("add", "-A")
    assert rels(files.changed_files(spark, tree)) == ["moved on.py", "src/pkg/simple.py"]
