"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over `host + path` plus the literal tokens
that any text it matches must hold as whole tokens (runs of a-z and 0-9 after
lower-casing A-Z). A rule is filed under the one of its tokens that the corpus
holds least often. A URL looks up its own tokens in that index, and only the
rules found there run their expression.

DataFrame expressions only: the index is a literal array of hash buckets (its
size follows the rule list, not the data), so judging a URL needs no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

BUCKETS = 64


@dataclass(frozen=True)
class UrlRule:
    """text: what is reported; weight: of the rules that fit, the heaviest wins; listed: reported as the rule."""

    text: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    listed: bool = True


def site_rule(action: str, host: str, path: str) -> UrlRule:
    """A rule for a host and its subdomains and for paths that begin with `path`.

    The last token of `path` counts as literal only if a separator ends it, as
    a prefix may stop within a token.
    """
    whole = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    pattern = r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path)
    return UrlRule(host + path, action, pattern, (*re.findall("[a-z0-9]+", host), *whole), len(host + path))


def term_rule(action: str, term: str) -> UrlRule:
    """A rule for a term that stands between separators anywhere in host or path, any case."""
    pattern = rf"(?i)(?:^|[^a-z0-9]){re.escape(term)}(?:[^a-z0-9]|$)"
    return UrlRule(term, action, pattern, tuple(re.findall("[a-z0-9]+", term)), 0, listed=False)


SITES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
SITE_RULES = [site_rule(*x) for x in SITES]


def host_rule(action: str, host: str) -> UrlRule:
    """A rule for a host and all its subdomains, any path."""
    return UrlRule(host, action, r"^(?:[^/]*\.)?" + re.escape(host) + r"(?:/|:|$)", tuple(re.findall("[a-z0-9]+", host)), 0, listed=False)


def pattern_rule(action: str, pattern: str, *tokens: str) -> UrlRule:
    """An expression over host and path, and the whole tokens that all its matches hold; none: every URL runs it."""
    return UrlRule(pattern, action, pattern, tokens, 0, listed=False)


#: The method's own verdict where no listed rule fits. By kind: hosts of advert and tracking networks; terms of adverts,
#: tracking, gambling, adult content, drug spam, pirated and malicious software, and phishing; and shapes of URLs.
NETWORKS = """
2mdn.net adcolony.com adform.net adnxs.com adroll.com adsrvr.org advertising.com amazon-adsystem.com appnexus.com
bidswitch.net bluekai.com casalemedia.com chartbeat.com contextweb.com criteo.com criteo.net demdex.net doubleclick.net
exoclick.com flashtalking.com googleadservices.com googlesyndication.com hotjar.com inmobi.com media.net moatads.com
mopub.com openx.net outbrain.com popads.net propellerads.com pubmatic.com quantserve.com revcontent.com rubiconproject.com
scorecardresearch.com serving-sys.com sharethrough.com smartadserver.com taboola.com teads.tv tradedoubler.com trafficjunky.net
tribalfusion.com yieldmo.com zedo.com
""".split()
TERMS = """
ad-server ad-track ads-track adclick adframe adserver adserv advert-click affiliate-click banner-ad click-track clicktrack
pixel-track popunder popup-ad sponsored-link track-click web-beacon
betting bookmaker casino free-bets free-spins jackpot online-poker poker roulette slot-machine sports-bet sportsbook
adult-dating camgirls escorts hardcore hentai milf nudes porn porno pornhub redtube sexcam xhamster xnxx xvideos xxx
buy-meds cheap-meds cheap-pills cialis online-pharmacy pills-online tramadol viagra xanax
crack-download cracked-apps keygen nulled serial-key torrent-download warez
account-verify bank-verify confirm-identity get-rich make-money-fast miracle-cure phishing secure-login-update
verify-account wallet-unlock weight-loss-miracle work-from-home-cash
""".split()
SHAPES = [
    pattern_rule("block", r"(?i)^[^/]*/(?:.*/)?wp-login\.php$", "wp", "login", "php"),
    pattern_rule("block", r"(?i)/(?:.*/)?pagead/", "pagead"),
    pattern_rule("block", r"(?i)/cgi-bin/(?:.*[^a-z0-9])?redirect(?:[^a-z0-9]|$)", "cgi", "bin", "redirect"),
    # programs to download and hosts that are bare addresses have no literal token
    pattern_rule("block", r"(?i)^[^/]+/.*\.(?:exe|scr|msi|apk|bat|jar|dmg|iso)$"),
    pattern_rule("block", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:/|$)"),
]
TERM_RULES = [*(host_rule("block", h) for h in NETWORKS), *(term_rule("block", t) for t in TERMS), *SHAPES]


def parse(pages: DataFrame) -> DataFrame:
    """Adds host and path. Host: after the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; path: then up to
    `?`, `#` or end. A null url and one without `://` have both empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    # of the rest, what comes before a question mark or hash: host and path, one after the other
    both = F.regexp_extract(rest, "^[^?#]*", 0)
    slash = F.locate("/", both)
    host = F.when(slash > 0, both.substr(F.lit(1), slash - 1)).otherwise(both)
    path = F.when(slash > 0, both.substr(slash, F.length(both))).otherwise("")
    return pages.withColumns({"host": ascii_lower(host), "path": path})


def tokens(longest: int) -> Column:
    """The distinct tokens of host and path, of at most so many characters: longer ones are no rule's."""
    return F.array_distinct(F.filter(F.split(ascii_lower(F.concat("host", "path")), "[^a-z0-9]+"), lambda t: F.length(t).between(1, longest)))


def rarest(parsed: DataFrame, rules: list[UrlRule]) -> dict[UrlRule, str]:
    """Each rule's token that the fewest URLs hold (ties: the first in order). Counted over all URLs; what comes to
    the driver is one row for each token of the rule list. A rule without tokens is filed under the empty one, which
    every URL looks up."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return dict.fromkeys(rules, "")
    found = parsed.select(F.explode(F.array_intersect(tokens(max(map(len, wanted))), F.array(*map(F.lit, wanted)))).alias("token"))
    counts = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="") for r in rules}


def index(filed: dict[UrlRule, str]) -> Column:
    """BUCKETS arrays of rules; a token's bucket is its hash modulo BUCKETS."""
    kind = "array<array<struct<token:string,pattern:string,weight:int,text:string,action:string,listed:boolean>>>"
    spark_hash = {t: _bucket(t) for t in set(filed.values())}
    rows = [[] for _ in range(BUCKETS)]
    for r, token in filed.items():
        rows[spark_hash[token]].append(F.struct(*(F.lit(v) for v in (token, r.pattern, r.weight, r.text, r.action, r.listed))))
    return F.array(*(F.array(*b) if b else F.expr("array()") for b in rows)).cast(kind)


def _bucket(token: str) -> int:
    return sum(b * 31**i for i, b in enumerate(token.encode())) % BUCKETS


def _bucket_of(token: Column) -> Column:
    """The same hash as _bucket, of a token of a-z and 0-9; 31**i modulo 64 repeats with i modulo 2 as 31 * 31 % 64 = 1."""
    codes = F.transform(F.split(token, ""), lambda c, i: F.ascii(c) * F.when(i % 2 == 0, 1).otherwise(31))
    return F.aggregate(codes, F.lit(0), lambda a, b: (a + b) % BUCKETS)


def judge(pages: DataFrame, rules: list[UrlRule] | None = None) -> DataFrame:
    """Adds host, path, rule and verdict to a table with a `url` column; other columns, whatever their names, stay, but
    for one that bears a result's name, which is replaced.

    The heaviest listed rule that fits gives rule and verdict (ties: the smaller text). Where none fits, rule is null
    and the verdict is `block` if an unlisted rule with that action fits, else `allow`. Null and empty URLs have an
    empty host and path; very long URLs are treated as all others; repeated rows give repeated results; an empty table
    gives an empty one. Rules whose texts and patterns are equal count once.
    """
    rules = list(dict.fromkeys(SITE_RULES + TERM_RULES if rules is None else rules))
    new = ("host", "path", "rule", "verdict")
    own = [c for c in pages.columns if c not in new]
    parsed = parse(pages.select(F.struct(*own).alias("page"), "url"))
    if not rules:
        judged = parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
        return judged.select(*(F.col("page")[c].alias(c) for c in own), *new)
    filed = rarest(parsed, rules)
    literal = index(filed)
    target = F.concat("host", "path")
    looked_up = F.concat(F.array(F.lit("")), tokens(max(map(len, filed.values()))))
    fetched = F.flatten(F.transform(looked_up, lambda t: F.filter(F.element_at(literal, _bucket_of(t) + 1), lambda r: r["token"] == t)))
    fitting = F.filter(fetched, lambda r: F.rlike(target, r["pattern"]))
    best = F.array_sort(
        F.filter(F.col("fit"), lambda r: r["listed"]),
        lambda a, b: F.when(a["weight"] != b["weight"], b["weight"] - a["weight"]).when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0),
    )
    first = F.get(F.col("best"), F.lit(0))
    blocked = F.exists(F.col("fit"), lambda r: ~r["listed"] & (r["action"] == "block"))
    out = parsed.withColumn("fit", fitting).withColumn("best", best)
    out = out.withColumns({"rule": first["text"], "verdict": F.coalesce(first["action"], F.when(blocked, "block").otherwise("allow"))})
    return out.select(*(F.col("page")[c].alias(c) for c in own), *new)


#: Host, path and the listed rules over the table `pages`, for DuckDB; the verdict is the listed rule's or that of TERM_RULES.
SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), r(host, path, action) AS (
  VALUES {sites}
), m AS (
  SELECT page_id, p.host, p.path, r.host || r.path AS rule, action,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC, r.host || r.path) AS nth
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
), o AS (
  SELECT page_id, bool_or(regexp_matches(host || path, pattern)) AS blocked FROM p, (SELECT unnest([{patterns}]) AS pattern) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, CASE WHEN o.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN o USING (page_id) LEFT JOIN m ON m.page_id = p.page_id AND nth = 1
"""


def sql() -> str:
    sites = ", ".join(f"('{h}', '{p}', '{a}')" for a, h, p in SITES)
    return SQL.format(sites=sites, patterns=", ".join(f"'{r.pattern}'" for r in TERM_RULES))
