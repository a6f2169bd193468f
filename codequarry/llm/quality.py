"""Quality rules: distribution divergence from language references.

Base rules (length, repeated 8-word windows) come first. What they leave is compared with its language: a histogram of
character classes and one of common words, each against the language's reference, by Jensen-Shannon distance (the root
of the divergence in bits). Texts too short for a histogram to mean anything are not judged by it.

A reference is the mean of its documents' histograms, each with the same weight whatever its length, over documents
that pass the base rules; it is taken twice, the second time over those that the first one would keep, so that junk is
not measured against itself.

DataFrame expressions only. A text is read once: its counts are written to the shared folder, without the text unless
it is to be returned, and both references and verdicts come from there. The references are six rows at most (the four
languages with a word list, all others, and all together), so they return to the plan as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, words_of

COMMON_WORDS = {
    "en": "the of and to a in is that for it was on".split(),
    "de": "der die und in den von das zu mit sich des auf".split(),
    "fr": "de la le et les des en un du une que pour".split(),
    "es": "de la que el en y los del se las por un".split(),
}
OTHER = "other"
#: The bar has a class of its own: among all symbols a list of links looks like prose.
CLASSES = ("lower", "upper", "digit", "space", "symbol", "bar", "punctuation", "rest")


@dataclass(frozen=True)
class Limits:
    """max_chars_js: distance beyond which a text is rejected; max_words_part: the same for words, as a part of the
    distance that a text without any common word has to its reference; min_chars, min_hist_words: guards below which a
    histogram isn't used; min_documents: languages of fewer are judged by the characters of all, and not by words."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    min_chars: int = 200
    max_chars_js: float = 0.187
    min_hist_words: int = 50
    max_words_part: float = 0.837
    min_documents: int = 20


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def language() -> Column:
    return F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit(OTHER))


def features(docs: DataFrame, limits: Limits, carry: list[str]) -> DataFrame:
    """doc (a struct of the columns to carry), language, n_chars, chars (counts of CLASSES), common (counts of the
    language's common words, then of all other words), and the counts of the base rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.struct(*carry).alias("doc"), language().alias("language"), text.alias("text"), words_of(F.col("text")).alias("words"))
    # one long match for each stretch of small letters and spaces: what is left is a small part of most texts
    d = d.withColumns({"n_chars": F.length("text").cast("long"), "few": F.regexp_replace("text", "[a-z\\x20\\x09-\\x0D]+", ""), "word_chars": F.length(F.array_join("words", "")).cast("long"), "n_words": F.size("words").cast("long")})

    def only(keep: str) -> Column:
        return F.length(F.regexp_replace("few", f"[^{keep}]+", "")).cast("long")

    upper, digit, symbol, punctuation = (only(c) for c in ("A-Z", "0-9", "#*$%&<>", "!\"'()+,./:;=?@\\[\\\\\\]^_`{}~-"))
    bar = (F.length("few") - F.length(F.replace(F.col("few"), F.lit("|"), F.lit("")))).cast("long")
    d = d.withColumn("part", F.array(upper, digit, symbol, bar, punctuation))
    named = F.aggregate("part", F.lit(0).cast("long"), lambda a, b: a + b)
    space = F.col("n_chars") - F.col("word_chars")
    lower = F.col("n_chars") - F.length("few") - space
    at = lambda i: F.get("part", F.lit(i))
    chars = F.array(lower, at(0), at(1), space, at(2), at(3), at(4), F.length("few") - named)
    # the language's common words, twice separated, so that neighbours share no space when they are taken out
    listed = F.coalesce(*(F.when(F.col("language") == k, _among(v)) for k, v in COMMON_WORDS.items()), F.expr("cast(array() as array<string>)"))
    d = d.withColumns({"chars": chars, "found": listed}).withColumn("joined", F.concat(F.lit(" "), F.array_join("found", "  "), F.lit(" ")))
    words = F.coalesce(*(F.when(F.col("language") == k, F.array(*map(F.lit, v))) for k, v in COMMON_WORDS.items()), F.expr("cast(array() as array<string>)"))

    def times(word: Column) -> Column:
        gone = F.octet_length("joined") - F.octet_length(F.replace(F.col("joined"), F.concat(F.lit(" "), word, F.lit(" ")), F.lit("")))
        return (gone / (F.octet_length(word) + 2)).cast("long")

    common = F.concat(F.transform(words, times), F.array(F.col("n_words") - F.size("found")))
    d = d.withColumns({"common": common, "n_symbols": at(2) + at(3), "n_dup_lines": repeated_lines(F.col("text")), "n_repeat_words": repeated_words(F.col("words"), limits.window)})
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    return d.withColumn("base_failed", failed).select("doc", "language", "n_chars", "chars", "common", *BASE, "base_failed")


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ALL = "*"


def _among(listed: list[str]) -> Column:
    return F.filter("words", lambda w: w.isin(*listed))


def reference(counts: DataFrame, limits: Limits) -> dict[str, tuple[list[float], list[float] | None]]:
    """For each language, and for ALL, mean shares of CLASSES and of common words (None where it has no word list, or
    too few documents). counts: features() of the documents to learn from. At most len(COMMON_WORDS) + 2 rows return."""
    wide = max(map(len, COMMON_WORDS.values())) + 1
    mean = lambda c, i, n, guard: F.avg(F.when(guard, F.get(c, F.lit(i)) / n))
    long_, wordy = F.col("n_chars") >= limits.min_chars, F.col("n_words") >= limits.min_hist_words
    means = [mean("chars", i, F.col("n_chars"), long_).alias(f"c{i}") for i in range(len(CLASSES))]
    means += [mean("common", i, F.col("n_words"), wordy).alias(f"w{i}") for i in range(wide)]
    rows = counts.rollup("language").agg(F.count_if(long_).alias("long"), F.count_if(wordy).alias("wordy"), *means).collect()
    out = {}
    for r in rows:
        chars = [r[f"c{i}"] for i in range(len(CLASSES))]
        if r["language"] is None:
            if r["long"]:
                out[ALL] = chars, None
        elif r["long"] >= limits.min_documents:
            words = [r[f"w{i}"] for i in range(len(COMMON_WORDS.get(r["language"], [])) + 1)]
            out[r["language"]] = chars, words if r["language"] != OTHER and r["wordy"] >= limits.min_documents else None
    return out


def bare_divergence(common: list[float]) -> float | None:
    """The divergence in bits of a text without a common word to a reference of common words (the last: all others);
    None where the reference has no common word, as nothing then differs from it."""
    total, others = sum(common), common[-1]
    if total == others:
        return None
    q = others / total
    return (1 - q + math.log2(2 / (1 + q)) + (q * math.log2(2 * q / (1 + q)) if q else 0.0)) / 2


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two histograms of equal length; null if either is empty."""

    def total(h: Column) -> Column:
        return F.aggregate(h, F.lit(0.0), lambda a, b: a + b)

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    def share(h: Column, n: Column) -> Column:
        return F.transform(h, lambda x: x / n)

    def js(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: (term(a, b) + term(b, a)) / 2), F.lit(0.0), lambda a, b: a + b)

    return F.when((total(p) > 0) & (total(q) > 0), js(share(p, total(p)), share(q, total(q))))


def repeated_words(words: Column, window: int) -> Column:
    """Words in windows that occur twice or more in the text, the first included. Windows are compared by XXH64."""
    n = F.size(words)

    def doubled(hashes: Column, step: int) -> Column:
        """Hashes of twice as many words each, from hashes of `step` words."""
        later = F.slice(hashes, F.lit(step + 1), F.greatest(F.size(hashes) - step, F.lit(0)))
        earlier = F.slice(hashes, F.lit(1), F.size(later))
        return F.zip_with(earlier, later, lambda a, b: F.xxhash64(a, b))

    if window < 1 or window & (window - 1):
        raise ValueError("windows are a power of two of words")

    def windows(hashes: Column, step: int = 1) -> Column:
        return hashes if step == window else _let(hashes, lambda h: windows(doubled(h, step), 2 * step))

    hashes = F.when(n > window, windows(F.transform(words, lambda w: F.xxhash64(w))))

    def covered(sorted_: Column) -> Column:
        again = F.filter(sorted_, lambda e, i: (F.get(sorted_, i - 1)["h"] == e["h"]) | F.coalesce(F.get(sorted_, i + 1)["h"] == e["h"], F.lit(False)))
        at = F.array_sort(F.transform(again, lambda e: e["i"]))
        return _let(at, lambda p: F.aggregate(F.transform(p, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - s, F.lit(window)))), F.lit(0).cast("long"), lambda a, b: a + b))

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(pairs, covered))

    return F.coalesce(_let(hashes, lambda h: F.when(h.isNotNull(), count(h))), F.lit(0).cast("long"))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    kept = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    return _let(kept, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _verdicts(counts: DataFrame, references: dict, limits: Limits) -> DataFrame:
    """Adds chars_js, words_js and kept to features()."""

    def known(part: int) -> Column:
        rows = [F.when(F.col("language") == k, F.array(*map(F.lit, v[part]))) for k, v in sorted(references.items()) if k != ALL and v[part]]
        rest = [F.array(*map(F.lit, references[ALL][part]))] if ALL in references and references[ALL][part] else []
        return F.coalesce(*rows, *rest) if rows or rest else F.lit(None).cast("array<double>")

    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    d = counts.withColumns(
        {
            "chars_js": F.when(F.col("n_chars") >= limits.min_chars, F.sqrt(divergence(doubles("chars"), known(0)))),
            "words_js": F.when(F.col("n_words") >= limits.min_hist_words, F.sqrt(divergence(doubles("common"), known(1)))),
        }
    )
    bare = {k: b for k, v in sorted(references.items()) if v[1] and (b := bare_divergence(v[1])) is not None}
    most = F.coalesce(*(F.when(F.col("language") == k, F.lit(limits.max_words_part * math.sqrt(b))) for k, b in bare.items()), F.lit(None).cast("double"))
    odd = F.coalesce(F.col("chars_js") > limits.max_chars_js, F.lit(False)) | F.coalesce(F.col("words_js") > most, F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & ~odd)


def judge(docs: DataFrame, limits: Limits | None = None, references: dict | None = None, carry: list[str] | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars_js, words_js, base_failed, kept.

    docs has text and lang; the columns in `carry` stay (all, if None), but one of a result's name is replaced. Null
    text counts as empty and fails the base rules, as every text of fewer than min_words words does; a null or unknown
    lang is judged by the characters of all such documents and not by common words. A distance is null where its guard
    holds or there is no reference. Equal rows get equal results, whatever their number; an empty table gives an empty
    one. Very long texts are counted whole. What returns reads a table in the shared folder.
    """
    limits, scratch = limits or Limits(), Scratch(docs.sparkSession)
    new = [*BASE, "chars_js", "words_js", "base_failed", "kept"]
    own = [c for c in (docs.columns if carry is None else carry) if c not in new]
    # a struct needs a field
    counts = scratch.cut(features(docs, limits, own or ["lang"]), "quality")
    if references is None:
        passing = counts.where("not base_failed")
        references = reference(passing, limits)
        references = reference(_verdicts(passing, references, limits).where("kept"), limits)
    return _verdicts(counts, references, limits).select(*(F.col("doc")[c].alias(c) for c in own), *new)
