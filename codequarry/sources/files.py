"""File tables (rel, content) of a source tree.

The driver lists names; executors read contents. Spark's own readers skip names that begin with an underscore, and with
them every package's `__init__.py`, so paths are a table and each is opened where it is needed (the tree has to lie
where all executors see it).
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

PATHS, FILES = "rel string, path string", "rel string, content string"


def package_root(root: str) -> str:
    """What absolute imports start from, relative to root: `src` if there is such a folder, else the root itself."""
    return "src" if os.path.isdir(os.path.join(root, "src")) else ""


def relative(path: str, root: str) -> str:
    """A path under root relative to it; any other as it is."""
    path, root = os.path.realpath(path), os.path.realpath(root)
    return path[len(root.rstrip("/")) + 1 :] if path.startswith(root.rstrip("/") + "/") else path


def _walk(base: str) -> Iterator[str]:
    for folder, folders, names in os.walk(base):
        # excluded folders lie under every base alike, so they are told by their path, later; .git alone is never worth a walk
        folders[:] = [d for d in folders if d != ".git"]
        yield from (os.path.join(folder, n) for n in (*names, *folders) if n.endswith(".py"))


def path_table(spark: SparkSession, root: str, found: Iterable[str]) -> DataFrame:
    rows = sorted({(relative(p, root), os.path.realpath(p)) for p in found})
    return spark.createDataFrame(rows, PATHS)


def tree(spark: SparkSession, root: str) -> DataFrame:
    """Paths of every *.py under root, tests and excluded folders too: what imports resolve against."""
    return path_table(spark, root, _walk(root))


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths under the package root that lie in no excluded folder and aren't named as tests."""
    found = path_table(spark, root, _walk(os.path.join(root, package_root(root))))
    return found.where(~P.in_excluded_dir(F.col("rel")) & ~P.has_test_name(F.col("rel")))


def test_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths under the package root that are tests by name or folder and lie in no excluded folder."""
    found = path_table(spark, root, _walk(os.path.join(root, package_root(root))))
    return found.where(~P.in_excluded_dir(F.col("rel")) & P.is_test_file(F.col("rel")))


def selected(spark: SparkSession, root: str, args: Iterable[str], tests: bool = False) -> DataFrame:
    """Explicit arguments: files stay whatever they are, folders give their source files, what doesn't exist is left out.
    tests: only test files, from folders too, and these from excluded folders as well."""
    files, under = [], []
    for a in args:
        p = os.path.join(root, a)
        if os.path.isdir(p):
            under += _walk(p)
        elif os.path.isfile(p):
            files.append(p)
    given, walked = path_table(spark, root, files), path_table(spark, root, under)
    rel = F.col("rel")
    if tests:
        return given.union(walked).where(P.is_test_file(rel)).distinct()
    return given.union(walked.where(~P.in_excluded_dir(rel) & ~P.has_test_name(rel))).distinct()


def changed_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of existing *.py files that git says have changed. Raises RuntimeError where git fails."""
    git = subprocess.run(("git", "status", "--porcelain"), cwd=root, encoding="utf-8", stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    if git.returncode:
        raise RuntimeError(f"git status failed: {git.stderr.strip()}")
    lines = spark.createDataFrame([(x,) for x in git.stdout.splitlines()], "line string")
    named = lines.select(P.status_path(F.col("line")).alias("rel")).where(F.col("rel").endswith(".py")).distinct()
    # what git names is bounded by the working tree, and whether a path exists is the driver's to know
    return path_table(spark, root, [p for r in named.collect() if os.path.exists(p := os.path.join(root, r["rel"]))])


def read(paths: DataFrame) -> DataFrame:
    """(rel, content) of a path table; content is null where a file can't be read as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel, path in zip(batch.column("rel").to_pylist(), batch.column("path").to_pylist()):
                try:
                    with open(path, encoding="utf-8") as f:
                        content = f.read()
                except (OSError, UnicodeDecodeError):
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([rel], pa.string()), pa.array([content], pa.string())], ["rel", "content"])

    return paths.select("rel", "path").mapInArrow(run, FILES)


def default_folders(inventory: DataFrame, package: str) -> DataFrame:
    """Folders directly under the package root that hold an `__init__.py` (column dir). inventory: rel."""
    rel = F.col("rel")
    folder = P.directory(rel)
    return inventory.where((P.base_name(rel) == "__init__.py") & (folder != package) & (P.directory(folder) == package)).select(folder.alias("dir")).distinct()
