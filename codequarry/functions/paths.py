"""Predicates and projections on slash-separated paths relative to the project's root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCLUDED_DIRS = ("build", "dist", "venv", ".venv", ".git", "__pycache__", "site-packages")
TEST_DIRS = ("tests", "test")
#: Files that set a package up; never unused, never loose.
SETUP_NAMES = ("__main__.py", "__init__.py")

GENERIC_STEMS = (
    "util utils utility utilities helper helpers "  # the usual drawers
    "temp tmp misc stuff various general common shared core types"
).split()
#: Technical names whose trailing digits carry meaning, by family.
NUMERIC_FAMILIES = {
    "uint": "8 16 32 64",
    "int": "8 16 32 64",
    "utf": "8 16 32",
    "f": "16 32 64",
    "sha": "1 256 384 512",
    "aes": "128 192 256",
    "crc": "8 16 32",
    "base": "32 64",
    "arm": "32 64",
    "h": "264 265",
    "http": "2 3",
    "oauth": "1 2",
    "ipv": "4 6",
    "x": "64 86 509",
    "md": "5",
    "webgl": "2",
}
NUMERIC_STEMS = [f + n for f, ns in NUMERIC_FAMILIES.items() for n in ns.split()] + ["i18n", "l10n", "a11y", "i2c", "w3c"]


def parts(rel: Column) -> Column:
    return F.split(rel, "/")


def base_name(rel: Column) -> Column:
    return F.element_at(parts(rel), -1)


def directory(rel: Column) -> Column:
    """The path up to the last slash; empty at the root."""
    return F.regexp_replace(rel, "/?[^/]*$", "")


def stem(rel: Column) -> Column:
    """The name without its last suffix; a leading dot starts no suffix, nor does a trailing one."""
    return F.regexp_replace(base_name(rel), r"(?<=.)\.[^.]+$", "")


def in_excluded_dir(rel: Column) -> Column:
    return F.arrays_overlap(parts(rel), F.array(*map(F.lit, EXCLUDED_DIRS)))


def has_test_name(rel: Column) -> Column:
    name = base_name(rel)
    return (name == "conftest.py") | name.startswith("test_") | name.endswith("_test.py")


def is_test_file(rel: Column) -> Column:
    """By its name, or by a test directory above it."""
    above = F.slice(parts(rel), 1, F.size(parts(rel)) - 1)
    return has_test_name(rel) | F.arrays_overlap(above, F.array(*map(F.lit, TEST_DIRS)))


def is_setup_file(rel: Column) -> Column:
    return base_name(rel).isin(*SETUP_NAMES)


def relative_to(path: Column, root: str) -> Column:
    """Absolute paths under root become relative; all others stay as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def module_prefix(rel: Column) -> Column:
    """`pkg/mod.py` as `pkg.mod`."""
    return F.translate(F.regexp_replace(rel, r"(?<=[^/])\.[^./]+$", ""), "/", ".")


def naming_message(rel: Column) -> Column:
    """Why a file's name is mechanical; null if it isn't."""
    own = stem(rel)
    lower = F.lower(own)
    generic = F.concat(F.lit('generic name "'), own, F.lit('.py" \u2014 split by domain instead of accumulating unrelated declarations'))
    numeric = F.concat(F.lit('numeric suffix in "'), own, F.lit('.py" \u2014 split by domain instead of numbered parts (batch1, part2, v2 ...)'))
    return F.when(lower.isin(*GENERIC_STEMS), generic).when(lower.rlike("[a-z_][0-9]+$") & ~lower.isin(*NUMERIC_STEMS), numeric)


def status_path(line: Column) -> Column:
    """The path of a line of `git status --porcelain`: a rename's destination, without quotes; null for short lines."""
    path = F.trim(F.substring(line, 4, 1 << 30), F.lit(" \t\r\n"))
    at = F.instr(path, " -> ")
    path = F.when(at > 0, F.substring(path, at + 4, F.lit(1 << 30))).otherwise(path)
    quoted = path.startswith('"') & path.endswith('"')
    # a lone quote is both its own start and end
    path = F.when(quoted, F.when(F.length(path) < 2, F.lit("")).otherwise(F.substring(path, F.lit(2), F.length(path) - 2))).otherwise(path)
    return F.when(F.length(line) >= 4, path)


def glob_pattern(glob: str) -> str:
    """A shell glob as a regular expression for rlike: `*` crosses slashes, `[!x]` is a negated set."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 1 + (glob[i : i + 1] == "!"))
            if end < 0:
                out.append("\\[")
                continue
            body, i = glob[i:end], end + 1
            negated, body = body[:1] == "!", body[body[:1] == "!" :]
            out.append("[" + "^" * negated + "".join(x if x == "-" or x.isalnum() else "\\" + x for x in body) + "]")
        else:
            out.append(c if c.isalnum() or c in "_/" or ord(c) > 127 else "\\" + c)
    return "(?s)\\A" + "".join(out) + "\\z"
