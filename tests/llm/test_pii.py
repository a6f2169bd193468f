"""op9: base spans against the expressions as written, held-out accuracy of the model, windows and edge cases."""

import re

import pytest
from codequarry.llm import pii
from hypothesis import given, settings
from hypothesis import strategies as st

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "@", ".", "-", "+", " ", "(", ")", "1", "23", "255", "256", "4111111111111111", "%", "_", "\n"]), max_size=25).map("".join))
def test_base_spans_are_those_of_the_expressions(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_of_the_table(spark):
    for (text,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert pii.base_spans(text or "") == brute(text or "")


def test_base_spans_are_linear():
    for part in ("1", "a", "1.", "@a", "+1 ", "1-", "a@b."):
        pii.base_spans(part * 300_000)


def test_held_out_accuracy():
    held = pii.labelled(1000, 12345)
    got = pii.find_all([t for t, _ in held], pii.trained(), [[] for _ in held])
    right = sum(len(set(g) & set(s)) for g, (_, s) in zip(got, held))
    assert right / sum(len(s) for _, s in held) > 0.9
    assert right / sum(map(len, got)) > 0.95


def test_windows_agree_with_reading_each_place():
    net, entity = pii.trained(), "(743) 555-3824"
    for before in range(0, 300, 7):
        text = ("lorem ipsum dolor " * 30)[:before] + " " + entity + " " + "lorem ipsum " * 20
        at = text.index(entity)
        assert pii.find_all([text], net, [[]])[0] == [("phone", at, at + len(entity))], before


def test_plain_text_has_no_window_and_base_spans_stay():
    assert list(pii._starts("no digit here " * 50)) == []
    text = "card 4111 1111 1111 1111 and more"
    base = pii.base_spans(text)
    assert base == [("card", 5, 24)]
    assert pii.find_all([text], pii.trained(), [base]) == [[]]


def test_reconcile_prefers_the_wider_margin():
    text = "call 743-555-3824 now"
    assert pii.reconcile([(2, "phone", 5, 12), (40, "phone", 5, 17)], [], text) == [("phone", 5, 17)]
    assert pii.reconcile([(9, "phone", 5, 17)], [("ip", 10, 12)], text) == []


def test_table_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "x.1@mail2.example.com 1.2.3.4", 5), (3, "x.1@mail2.example.com 1.2.3.4", 5), (None, "+1 (743) 555-3824" + " word" * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int")
    got = {(r["doc_id"], r["text"] and r["text"][:5]): r for r in pii.find(df).collect()}
    assert pii.find(df).columns == ["doc_id", "text", "base", "spans"]
    assert got[1, None]["spans"] == [] and got[2, ""]["base"] == []
    assert [tuple(s) for s in got[3, "x.1@m"]["spans"]] == [("email", 0, 21), ("ip", 22, 29)]
    assert [tuple(s) for s in got[None, "+1 (7"]["base"]] == [("phone", 0, 17)]
    assert pii.find(df).count() == 5
    assert pii.find(df.where("false")).collect() == []


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to x.1@mail2.example.com or +1 (743) 555-3824."), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()] == ["to <EMAIL> or <PHONE>.", None]


@pytest.mark.parametrize("spans, want", [([], "ab 12 cd"), ([("ip", 3, 5)], "ab <IP> cd"), ([("ip", 0, 4), ("card", 3, 5)], "<IP> cd")])
def test_redact_text(spans, want):
    assert pii.redact_text("ab 12 cd", spans) == want
