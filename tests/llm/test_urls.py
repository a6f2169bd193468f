"""op10: hosts, paths and rules by plain Python; the index loses no rule."""

import re

from codequarry.llm import urls
from hypothesis import given, settings
from hypothesis import strategies as st

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def split(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def brute(url, rules=tuple(urls.TERM_RULES)):
    host, path = split(url)
    fits = [(len(r), r, a) for r, a in RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if any(re.search(r.pattern, host + path, re.A) for r in rules) else "allow"


def judged(spark, values, rules=None):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(values)], "page_id int, url string")
    return [tuple(r) for r in urls.judge(df, rules).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]


CASES = [
    None, "", "no scheme", "://", "http://", "http://COM/en/", "http://a.com/en", "http://com/en/7", "http://www.Example.com/en/7x?y#z", "http://notexample.com/en/7", "http://example.net/de/8", "http://x.example.net/de/81",
    "http://example.net/de/9", "http://org/es/", "http://orgs/es/", "http://a.org/ES/", "http://a.b?c=://d/e", "http://a#b", "http://a/?q", "x://y://z/en/", "http://casino.example.test/", "http://x/my-casino-win", "http://x/mycasino",
    "http://ads-track.test/", "http://cdn.doubleclick.net/x", "http://doubleclick.net.evil/x", "http://x/setup.EXE", "http://x/exe", "http://10.0.0.1:80/a", "http://x/pagead/1", "http://ÀÉ.com/en/é", "http://x/a\nb",
]


def test_cases(spark):
    got = judged(spark, CASES)
    for url, g in zip(CASES, got):
        assert g == brute(url), url


def test_very_long_urls(spark):
    long_ = ["http://" + "a" * 2_000_000 + ".com/en/", "http://x/" + "casino/" * 20_000, "http://com/en/" + "b" * 300_000, "z" * 1_000_000]
    assert judged(spark, long_) == [brute(u) for u in long_]


def test_rules_of_all_shapes(spark):
    rules = [urls.pattern_rule("block", "^x[0-9]+/"), urls.term_rule("block", "foo-bar"), urls.UrlRule("y/", "allow", "^y/", (), 2), urls.UrlRule("y", "block", "^y", ("y",), 1)]
    got = judged(spark, ["http://x12/a", "http://q/foo-bar", "http://y/", "http://y", "http://foo.bar/"], rules + rules)
    assert [g[2:] for g in got] == [(None, "block"), (None, "block"), ("y/", "allow"), ("y", "block"), (None, "allow")]
    assert [g[2:] for g in judged(spark, ["http://com/en/"], [])] == [(None, "allow")]
    assert [g[3] for g in judged(spark, ["http://x1/", "http://z/"], rules[:1])] == ["block", "allow"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["com", "en", "example", "net", "/", ".", "7", "casino", "-", "xxx", "doubleclick", "A", "é", "?", "#", "://"]), max_size=10).map("".join))
def test_tokens_of_a_rule_are_in_all_that_it_matches(tail):
    host, path = split("h://" + tail)
    held = set(re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), host + path)))
    for r in urls.SITE_RULES + urls.TERM_RULES:
        if re.search(r.pattern, host + path, re.A):
            assert set(r.tokens) <= held, (r, tail)


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("http://com/en/x", 1, 2, 3, 4, 5, 6)], "url string, _rest int, _fit int, best int, page int, host int, fit int")
    got = urls.judge(df)
    assert got.columns == ["url", "_rest", "_fit", "best", "page", "fit", "host", "path", "rule", "verdict"]
    assert got.collect()[0][:] == ("http://com/en/x", 1, 2, 3, 4, 6, "com", "/en/x", "com/en/", "block")
    assert urls.judge(df.where("false")).collect() == []


def test_no_python_in_the_plan(spark):
    plan = urls.judge(spark.range(3).selectExpr("id as page_id", "concat('http://com/en/', id) as url"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
