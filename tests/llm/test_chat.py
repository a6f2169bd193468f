"""op5: segments, places and masks against a plain rendering of each conversation."""

from collections import defaultdict

from codequarry.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role or "unknown", text or "", turn))
    out = []
    for conv, turns in talks.items():
        turns.sort(key=lambda t: t[:4])
        for who in {t[2] for t in turns} - {"system"}:
            at = 0
            for i, (_, _, speaker, text, turn) in enumerate(turns):
                name = "system" if speaker == "system" else "assistant" if speaker == who else f"user name={speaker}"
                head = f"<|im_start|>{name}\n"
                part = f"{head}{text}<|im_end|>\n"
                mask = (at + len(head), at + len(part) - 1) if speaker == who else (None, None)
                out.append((conv, who, i, turn, speaker, part, at, at + len(part), *mask))
                at += len(part)
    return out


def same(spark, rows):
    got = chat.rotate(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)
    return got


def test_multi_party(spark):
    same(spark, [(1, 0, "system", "be nice"), (1, 1, "ann", "hi é🙂"), (1, 2, "bob", "hello"), (1, 3, "cat", ""), (1, 4, "ann", None), (2, 0, "user", "q"), (2, 1, "assistant", "a")])


def test_nulls_ties_and_repeats(spark):
    same(spark, [(None, None, None, None), (None, None, "", "x"), (None, 1, "ann", "b"), (None, 1, "ann", "b"), (None, 1, "ann", "a"), (3, 1, "system", "alone"), (4, -300, "bob", "early"), (4, 5, "ann", "late")])


def test_blocks_of_a_long_conversation(spark):
    same(spark, [(7, t, ("ann", "bob", "cat")[t % 3], "word " * (t % 5)) for t in range(3 * chat.BLOCK + 11)] + [(7, 2, "ann", "long " * 20_000)])


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "ann", "x", 1, 2)], SCHEMA + ", segment int, salt int")
    assert chat.rotate(df).count() == 1
    assert chat.rotate(df.where("false")).collect() == []


def test_no_python_in_the_plan(spark):
    plan = chat.rotate(spark.createDataFrame([(1, 0, "ann", "x")], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("LogicalRDD", "")
