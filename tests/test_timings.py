"""Timings: batch and stream give the same, shares and order, attribution."""

import json

import pytest
from codequarry import report
from codequarry.operators import timings
from codequarry.sources import reports
from codequarry.streaming import timings as stream

EVENTS = [("a.f", 10.0), ("a.f", 30.0), ("a.g", 5.0), ("b.h", 100.0), ("b.h", None)]


@pytest.fixture
def events(spark):
    return spark.createDataFrame(EVENTS, "key string, micros double")


def as_dict(df):
    return {r["key"]: (r["calls"], r["total"], r["least"], r["most"]) for r in df.collect()}


WANT = {"a.f": (2, 40.0, 10.0, 30.0), "a.g": (1, 5.0, 5.0, 5.0), "b.h": (1, 100.0, 100.0, 100.0)}


def test_aggregate_and_merge(events):
    assert as_dict(timings.aggregate(events)) == WANT
    parts = timings.aggregate(events.where("micros > 20")).union(timings.aggregate(events.where("micros <= 20")))
    assert as_dict(timings.merge(parts)) == WANT


def test_stream_counts_once(spark, events, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for i, part in enumerate((events.limit(2), events.subtract(events.limit(2)))):
        part.write.mode("append").parquet(source)
        running = stream.running(spark.readStream.schema(events.schema).parquet(source))
        name = f"t{i}"
        # the second run begins from the first one's checkpoint
        query = running.writeStream.outputMode("complete").foreachBatch(lambda df, _, n=name: df.write.mode("overwrite").parquet(str(tmp_path / n))).trigger(availableNow=True).option("checkpointLocation", state).start()
        query.awaitTermination()
    assert as_dict(spark.read.parquet(str(tmp_path / "t1"))) == WANT
    memory = stream.finish(stream.write(stream.running(spark.readStream.schema(events.schema).parquet(source)), "whole").start(), spark, "whole")
    assert as_dict(memory) == WANT


def test_share_order_and_threshold(spark, events):
    entries = timings.aggregate(events)
    assert [(r["key"], round(r["share"], 3)) for r in timings.top(timings.with_share(entries), 2).collect()] == [("b.h", 68.966), ("a.f", 27.586)]
    assert timings.over(entries, 0.04).first()[:] == (1, 0.1, 2)
    assert timings.over(entries.where("false"), 1.0).first()[:] == (0, 0.0, 0)
    nothing = spark.createDataFrame([("x", 0.0)], "key string, total double")
    assert timings.with_share(nothing).first()["share"] == 0.0


def test_inventory_takes_the_first(spark):
    methods = spark.createDataFrame([("b/m.py", 1, "f", 9), ("b/m.py", 0, "f", 3), ("b.m.py", 0, "f", 1)], "file string, ord int, method_name string, start_line int")
    # by path part by part: b comes before b.m.py
    assert {r["key"]: (r["file"], r["line"]) for r in timings.inventory(methods).collect()} == {"b.m.f": ("b/m.py", 3)}


def test_reports(spark, events, tmp_path):
    known = spark.createDataFrame([("a.f", "a.py", 3), ("b.h", "b.py", 7)], "key string, file string, line int")
    entries = timings.attribute(timings.aggregate(events), known)
    text = report.profile(entries, 1, 0.05).splitlines()
    assert text[0] == "Profile Report (2 methods, total 0.14ms)"
    assert text[2].split() == ["0.10", "71.4%", "1", "100.0", "100", "6.00", "b.h", "b.py:7"]
    assert text[-1] == "Threshold: 0.05ms \u2014 1 method exceed"
    assert report.mean_text(29.94) == "~29.9" and report.mean_text(30) == "30.0"
    assert report.threshold_text(0, 1) == "Threshold: 1.00ms \u2014 all methods OK" and report.threshold_text(2, 1).endswith("2 methods exceed")
    _, path = report.write_profile(entries, str(tmp_path / "out"))
    data = json.load(open(path))
    assert [m["method"] for m in data["methods"]] == ["b.h", "a.f"] and data["totalMicros"] == 140.0


def test_timing_files(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"a.f": {"calls": 2, "totalMicros": 5, "minMicros": None, "maxMicros": 3}, "b": {}}))
    assert [tuple(r) for r in reports.load_timings(spark, str(path)).collect()] == [("a.f", 2, 5.0, None, 3.0, 0), ("b", 0, 0.0, None, 0.0, 1)]
    path.write_text("[1]")
    assert reports.load_timings(spark, str(path)).collect() == []
    with pytest.warns(UserWarning, match="no profiling data"):
        assert reports.load_timings(spark, str(tmp_path / "absent")).collect() == []


def test_coverage_files(spark, tmp_path):
    path = tmp_path / "c.json"
    root = str(tmp_path)
    path.write_text(json.dumps({"meta": 1, "files": {f"{root}/a.py": {"executed_lines": [1, 2], "missing_lines": [2, 3]}, "b.py": {}, "/else/c.py": {"executed_lines": [1]}}}))
    got = {r["rel"]: (r["executed"], r["missing"]) for r in reports.load_coverage(spark, str(path), root).collect()}
    assert got == {"a.py": ([1, 2], [2, 3]), "b.py": ([], []), "/else/c.py": ([1], [])}
    lines = reports.coverage_lines(reports.load_coverage(spark, str(path), root)).where("rel = 'a.py'")
    assert sorted(tuple(r)[1:] for r in lines.collect()) == [(1, True, False), (2, True, True), (3, False, True)]
    for none in ('{"files": null}', "{}"):
        path.write_text(none)
        assert reports.load_coverage(spark, str(path)).collect() == []
    with pytest.warns(UserWarning, match="coverage is unknown"):
        assert reports.load_coverage(spark, str(tmp_path / "absent")).collect() == []
