"""Queries in which columns of the test tables stand for facts, coverage lines, paths and timings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scores as S
from ..operators import rules, scoring, timings
from ..sources import reports
from ..streaming import timings as stream

RULES = [
    rules.ImportRule("page0*", "*example.com/en/*", "first"),
    rules.ImportRule("page[!2]*", "https://*/de/?[0-4]*"),
    rules.ImportRule("*", "*.org/*", "any"),
]
SIMILAR = ["utils", "Helper", "x86", "sha256", "part2", "v_3", "types", "b2b", "2020", "ipv4", "a.b1"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _module(key: str) -> Column:
    return F.concat(F.lit("src/m"), key, F.lit(".py"))


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    return table(spark, sf_dir, "orders").select(
        _module("o_orderkey").alias("file"),
        F.lit(0).alias("ord"),
        F.concat(F.lit("f"), "o_custkey").alias("method_name"),
        F.when(even, 1).otherwise(2).alias("start_line"),
        F.when(even, 4).otherwise(6).alias("end_line"),
        (1 + F.col("o_custkey") % 12).cast("int").alias("complexity"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("l_returnflag") == "N"
    return table(spark, sf_dir, "lineitem").select(_module("l_orderkey").alias("rel"), F.col("l_linenumber").alias("line"), hit.alias("executed"), (~hit).alias("missing"))


def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_by_lines(_methods(spark, sf_dir), _lines(spark, sf_dir))


def score_max_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.verdict(score_report(spark, sf_dir))


def score_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ranked(score_report(spark, sf_dir)).limit(20)


def _line_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by file; a file has at most seven lines."""
    rows = _lines(spark, sf_dir).groupBy("rel")
    return rows.agg(F.collect_set(F.when(F.col("executed"), F.col("line"))).alias("executed"), F.collect_set(F.when(F.col("missing"), F.col("line"))).alias("missing"))


def coverage_array_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_methods(spark, sf_dir), _line_arrays(spark, sf_dir))


def coverage_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a hundred neighbouring orders make up a report, so a report's size is fixed
    files = _line_arrays(spark, sf_dir).withColumn("part", F.floor(F.regexp_extract("rel", "[0-9]+", 0).cast("long") / 100))
    info = F.struct(F.col("executed").alias("executed_lines"), F.col("missing").alias("missing_lines"))
    root = F.when(F.col("part") % 2 == 0, F.concat(F.lit("/work/"), "rel")).otherwise(F.col("rel"))
    json = files.groupBy("part").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(root, info))).alias("files"))).alias("json"))
    back = reports.parse_coverage(json, root="/work")
    lines = reports.coverage_lines(back).groupBy("rel").agg(F.count_if("executed").alias("n_executed"), F.count_if("missing").alias("n_missing"), F.count("*").alias("n_lines"))
    return lines.select("rel", "n_executed", "n_missing", "n_lines")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    folder = F.element_at(F.array(*map(F.lit, ["src", "src/tests", "build", "lib/venv/x", "test", "a/b.c", ""])), (key % 7 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ["m", "test_m", "m_test", "conftest", "tests"])), (key % 5 + 1).cast("int"))
    name = F.when(key % 5 == 3, name).when(key % 5 == 2, F.concat(F.lit("m"), key, F.lit("_test"))).otherwise(F.concat(name, key))
    rel = F.concat_ws("/", F.when(folder != "", folder), F.concat(name, F.lit(".py")))
    return table(spark, sf_dir, "part").select(key, rel.alias("rel"))


def file_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.col("rel")
    full = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/root/"), rel)).otherwise(rel)
    rows = _paths(spark, sf_dir).select("p_partkey", P.relative_to(full, "/root").alias("rel"))
    return rows.select("p_partkey", "rel", P.is_test_file(rel).alias("is_test"), P.in_excluded_dir(rel).alias("excluded"), P.module_prefix(rel).alias("module"), (~P.in_excluded_dir(rel) & ~P.has_test_name(rel)).alias("selected"))


def git_status_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("src/m"), key, F.lit(".py"))
    lines = [F.concat(F.lit(" M "), path), F.concat(F.lit("R  old/"), key, F.lit(".py -> "), path), F.concat(F.lit('?? "a b/'), key, F.lit('.py"')), F.lit("??"), F.concat(F.lit("A   "), path, F.lit("  "))]
    line = F.element_at(F.array(*lines), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", P.status_path(line).alias("path"))


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.element_at(F.array(*map(F.lit, SIMILAR)), (F.col("p_partkey") % len(SIMILAR) + 1).cast("int"))
    first = F.regexp_replace("p_name", "[^A-Za-z0-9]", "_")
    rel = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("src/k"), "p_partkey", F.lit("/"), stem, F.lit(".py"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("src/k"), "p_partkey", F.lit("/"), first, F.lit(".py")))
    return table(spark, sf_dir, "part").select(F.coalesce(rel, F.concat(F.lit("tests/k"), "p_partkey", F.lit("/"), stem, F.lit(".py"))).alias("rel"))


def file_naming_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.file_naming(_stems(spark, sf_dir)).violations


def file_naming_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.file_naming(_stems(spark, sf_dir)).summary


def _loose(spark: SparkSession, sf_dir: str) -> rules.Outcome:
    part = table(spark, sf_dir, "part")
    folder = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")
    key = F.col("p_partkey")
    name = F.when(key % 11 == 0, "__init__.py").when(key % 3 == 0, F.concat(F.lit("m"), key, F.lit(".py"))).when(key % 3 == 1, F.concat(F.lit("m"), key, F.lit(".txt"))).otherwise(F.concat(F.lit("deep/m"), key, F.lit(".py")))
    files = part.select(F.concat(folder, F.lit("/"), name).alias("rel"))
    folders = part.select(folder.alias("dir")).distinct().union(part.sparkSession.createDataFrame([("empty",)], "dir string"))
    return rules.folder_structure(folders, files, 30)


def folder_loose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loose(spark, sf_dir).violations


def folder_loose_files_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loose(spark, sf_dir).summary


def banned_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("target"), F.concat(F.lit("page"), F.col("page_id") % 4, F.lit(".py")).alias("file"))
    return pages.select("page_id", rules._first_match(RULES, F.col("file"), F.col("target")).alias("rule")).where("rule is not null")


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("ord", "key"))
    return rules.repeats(lines.where("key <> ''")).select(F.col("file").alias("doc_id"), "ord", F.col("n"))


def _events(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    # whole numbers, so that sums are exact in any order
    return table(spark, sf_dir, "events").select(F.col(key).cast("string").alias("key"), F.floor(F.abs("value") * 1000).cast("double").alias("micros"), "user_id")


def timing_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timings.aggregate(_events(spark, sf_dir, "event_type")).withColumn("mean", S.mean_micros(F.col("total"), F.col("calls")))
    return out.withColumn("frame_ms", S.frame_millis(F.col("mean")))


def timing_partial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _events(spark, sf_dir, "event_type").groupBy("key", F.col("user_id") % 8).agg(*timings.measures())
    return timings.merge(parts.select("key", "calls", "total", "least", "most"))


def timing_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timings.with_share(timings.aggregate(_events(spark, sf_dir, "user_id")))


def timing_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timings.top(timing_share(spark, sf_dir))


def timing_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("key"), F.concat(F.lit("src/c"), F.col("c_custkey") % 10, F.lit(".py")).alias("file"), (F.col("c_custkey") % 97).cast("int").alias("line"), F.lit(0).alias("nth"))
    again = customers.withColumns({"file": F.lit("src/late.py"), "nth": F.lit(1)})
    known = timings.first_by(customers.union(again), "key", ["nth"]).drop("nth")
    return timings.attribute(timings.aggregate(_events(spark, sf_dir, "user_id")), known)


def timing_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timings.over(timings.aggregate(_events(spark, sf_dir, "user_id")), 5.0)


def timing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, name = f"{sf_dir}/events.parquet", f"timings_{uuid.uuid4().hex}"
    # a stream takes a folder or a pattern, and the table may be either a file or a folder
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")
    events = source.select(F.col("event_type").alias("key"), F.floor(F.abs("value") * 1000).cast("double").alias("micros"))
    return stream.finish(stream.write(stream.running(events), name).start(), spark, name)


_SCORES = """
WITH m AS (
  SELECT o_orderkey AS k, 'src/m' || o_orderkey || '.py' AS file, 'f' || o_custkey AS method_name, CAST(1 + o_custkey % 12 AS INTEGER) AS complexity,
    CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS s, CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 6 END AS e
  FROM orders
), l AS (
  SELECT l_orderkey AS k, l_linenumber AS line, bool_or(l_returnflag = 'N') AS hit FROM lineitem GROUP BY ALL
), c AS (
  SELECT m.k, file, method_name, complexity, count(line) AS n, count(*) FILTER (hit) AS h
  FROM m LEFT JOIN l ON m.k = l.k AND line BETWEEN s AND e GROUP BY ALL
), v AS (
  SELECT *, CASE WHEN n > 0 THEN CAST(h AS DOUBLE) / n END AS coverage FROM c
), r AS (
  SELECT method_name, file, complexity, coverage,
    CAST(complexity AS DOUBLE) * complexity * ((1.0 - coverage) * (1.0 - coverage) * (1.0 - coverage)) + complexity AS score
  FROM v
)
"""
_PATHS = """
WITH p AS (
  SELECT p_partkey, ['src/', 'src/tests/', 'build/', 'lib/venv/x/', 'test/', 'a/b.c/', ''][p_partkey % 7 + 1]
    || CASE p_partkey % 5 WHEN 0 THEN 'm' || p_partkey WHEN 1 THEN 'test_m' || p_partkey WHEN 2 THEN 'm' || p_partkey || '_test' WHEN 3 THEN 'conftest' ELSE 'tests' || p_partkey END || '.py' AS rel,
    p_partkey % 5 IN (1, 2, 3) AS named, p_partkey % 7 IN (1, 4) AS under, p_partkey % 7 IN (2, 3) AS excluded
  FROM part
)
"""
_STEMS = """
WITH s AS (
  SELECT p_partkey, p_size % 3 AS way,
    CASE WHEN p_size % 3 = 1 THEN regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g')
         ELSE ['utils', 'Helper', 'x86', 'sha256', 'part2', 'v_3', 'types', 'b2b', '2020', 'ipv4', 'a.b1'][p_partkey % 11 + 1] END AS stem
  FROM part
), f AS (
  SELECT 'src/k' || p_partkey || '/' || stem || '.py' AS file,
    CASE WHEN lower(stem) IN ('utils', 'helper', 'types') THEN 'generic name "' || stem || '.py" \u2014 split by domain instead of accumulating unrelated declarations'
         WHEN regexp_matches(lower(stem), '[a-z_][0-9]+$') AND lower(stem) NOT IN ('x86', 'sha256', 'ipv4') THEN 'numeric suffix in "' || stem || '.py" \u2014 split by domain instead of numbered parts (batch1, part2, v2 ...)' END AS message
  FROM s WHERE way <> 2
)
"""
_LOOSE = """
WITH p AS (
  SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS dir, p_partkey % 3 = 0 AND p_partkey % 11 <> 0 AS loose FROM part
), d AS (
  SELECT dir, count(*) FILTER (loose) AS loose FROM p GROUP BY dir UNION ALL SELECT 'empty', 0
)
"""
_EVENTS = "(SELECT CAST({key} AS VARCHAR) AS key, user_id, floor(abs(value) * 1000) AS micros FROM events)"
_MEASURES = "count(micros) AS calls, CAST(sum(micros) AS DOUBLE) AS total, min(micros) AS least, max(micros) AS most"
_BY_TYPE = f"SELECT key, {_MEASURES} FROM {_EVENTS.format(key='event_type')} GROUP BY key"
_BY_USER = f"SELECT key, {_MEASURES} FROM {_EVENTS.format(key='user_id')} GROUP BY key"
_SHARE = f"SELECT *, total / sum(total) OVER () * 100.0 AS share FROM ({_BY_USER})"

QUERIES = {
    "score_report": (score_report, _SCORES + "SELECT * FROM r"),
    "score_max_verdict": (score_max_verdict, _SCORES + "SELECT coalesce(max(score), 0.0) AS max_score, coalesce(max(score), 0.0) > 8.0 AS failed, CASE WHEN coalesce(max(score), 0.0) > 8.0 THEN 2 ELSE 0 END AS status FROM r"),
    "score_top_n": (score_top_n, _SCORES + "SELECT * FROM r ORDER BY score DESC NULLS LAST, file, method_name LIMIT 20"),
    "coverage_array_form": (coverage_array_form, _SCORES + "SELECT * FROM r"),
    "coverage_json": (
        coverage_json,
        """SELECT 'src/m' || l_orderkey || '.py' AS rel, count(DISTINCT l_linenumber) FILTER (l_returnflag = 'N') AS n_executed,
        count(DISTINCT l_linenumber) FILTER (l_returnflag <> 'N') AS n_missing, count(DISTINCT l_linenumber) AS n_lines FROM lineitem GROUP BY l_orderkey""",
    ),
    "file_selection": (file_selection, _PATHS + "SELECT p_partkey, rel, named OR under AS is_test, excluded, replace(left(rel, length(rel) - 3), '/', '.') AS module, NOT excluded AND NOT named AS selected FROM p"),
    "git_status_parse": (git_status_parse, "SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN 'a b/' || p_partkey || '.py' WHEN 3 THEN NULL ELSE 'src/m' || p_partkey || '.py' END AS path FROM part"),
    "file_naming_gate": (file_naming_gate, _STEMS + "SELECT * FROM f WHERE message IS NOT NULL"),
    "file_naming_gate_summary": (file_naming_gate_summary, _STEMS + "SELECT count(message) AS violations, count(*) AS checked, CASE WHEN count(message) > 0 THEN 2 ELSE 0 END AS status FROM f"),
    "folder_loose_files": (folder_loose_files, _LOOSE + "SELECT dir, loose, loose || ' loose .py files directly in ' || dir || ' \u2014 group them into feature packages (max 30)' AS message FROM d WHERE loose > 30"),
    "folder_loose_files_summary": (folder_loose_files_summary, _LOOSE + "SELECT count(*) FILTER (loose > 30) AS violations, count(*) AS checked, CASE WHEN count(*) FILTER (loose > 30) > 0 THEN 2 ELSE 0 END AS status FROM d"),
    "banned_targets": (
        banned_targets,
        """SELECT page_id, rule FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 AND contains(u, 'example.com/en/') THEN 0
          WHEN page_id % 4 <> 2 AND regexp_full_match(u, 'https://.*/de/.[0-4].*', 's') THEN 1 WHEN contains(u, '.org/') THEN 2 END AS rule
        FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)) WHERE rule IS NOT NULL""",
    ),
    "repeated_lines": (
        repeated_lines,
        """SELECT doc_id, CAST(ord - 1 AS INTEGER) AS ord, n FROM (SELECT doc_id, ord, count(*) OVER (PARTITION BY doc_id, key) AS n
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS key, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents) WHERE key <> '') WHERE n >= 3""",
    ),
    "timing_aggregate": (timing_aggregate, f"SELECT *, total / calls AS mean, (total / calls * 60.0) / 1000.0 AS frame_ms FROM ({_BY_TYPE})"),
    "timing_partial_merge": (timing_partial_merge, _BY_TYPE),
    "timing_share": (timing_share, _SHARE),
    "timing_top_n": (timing_top_n, f"SELECT * FROM ({_SHARE}) ORDER BY total DESC, key LIMIT 20"),
    "timing_attribution": (
        timing_attribution,
        f"""SELECT t.*, 'src/c' || c_custkey % 10 || '.py' AS file, CAST(c_custkey % 97 AS INTEGER) AS line, total / calls AS mean
        FROM ({_BY_USER}) t JOIN customer ON t.key = CAST(c_custkey AS VARCHAR) WHERE c_custkey % 2 = 0""",
    ),
    "timing_threshold": (timing_threshold, f"SELECT count(*) FILTER (total / 1000.0 > 5.0) AS exceeding, coalesce(max(total / 1000.0), 0.0) AS worst_ms, CASE WHEN count(*) FILTER (total / 1000.0 > 5.0) > 0 THEN 2 ELSE 0 END AS status FROM ({_BY_USER})"),
    "timing_stream": (timing_stream, _BY_TYPE),
}
