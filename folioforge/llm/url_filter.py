"""URL filter from DataFrame functions only: pattern rules are found by their rarest literal token.

Each pattern rule names the literal tokens that any URL it fits must hold, and is filed under the one of them that is
rarest over all URLs. A URL's tokens fetch the rules filed under them, and only those rules' regular expressions run.
Host and path rules come before: the longest whose host is the URL's or a parent of it, and whose path begins the
URL's, decides alone. Otherwise a pattern rule decides (an allowing one over blocking ones); where none fits, the URL
is allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path and no host rule; pattern rules still
see its text. Repeated rows stay repeated, a null key passes through, other columns are not read, an empty table gives
no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class HostRule(NamedTuple):
    verdict: str
    host: str
    path: str


class PatternRule(NamedTuple):
    label: str
    verdict: str
    literals: tuple[str, ...]
    regex: str


#: The rules for hosts and paths that production runs with.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OPEN, _SHUT = "(?:^|[^a-z0-9])", "(?:[^a-z0-9]|$)"


def _rules(verdict: str, text: str) -> list[PatternRule]:
    """One rule a line: label, literal tokens, regular expression between token limits."""
    out = []
    for line in text.strip().splitlines():
        label, literals, regex = line.split(None, 2)
        out.append(PatternRule(label, verdict, tuple(literals.split(",")), f"{_OPEN}{regex}{_SHUT}"))
    return out


#: Hand-written pattern rules, over the URL with A-Z lower-cased.
PATTERN_RULES = _rules(
    "block",
    r"""
    spam-farm       spam,farm          spam[-_.]farm
    link-farm       farm               links?[-_.]farm
    cheap-pills     cheap,pills        cheap[-_.](?:[a-z0-9]+[-_.])?pills
    buy-pills       buy,pills          buy[-_.](?:[a-z0-9]+[-_.])?pills
    pharmacy-online online,pharmacy    (?:online[-_.]pharmacy|pharmacy[-_.]online)
    viagra          viagra             viagra
    cialis          cialis             cialis
    casino-win      casino,win         casino[-_.]win
    casino-bonus    casino,bonus       casino[-_.](?:[a-z0-9]+[-_.])?bonus
    online-casino   casino,online      (?:online[-_.]casino|casino[-_.]online)
    free-slots      free,slots         free[-_.]slots
    poker-bonus     poker,bonus        poker[-_.](?:[a-z0-9]+[-_.])?bonus
    bet-now         bet,now            bet[-_.]now
    sports-betting  betting            sports?[-_.]betting
    payday-loan     payday             payday[-_.]loans?
    quick-loan      loan,quick         quick[-_.]loan
    debt-relief     debt,relief        debt[-_.]relief
    forex-signals   forex,signals      forex[-_.]signals
    crypto-double   crypto,double      (?:crypto[-_.]double|double[-_.]crypto)
    free-bitcoin    bitcoin,free       free[-_.]bitcoin
    replica-watch   replica            replica[-_.]watch(?:es)?
    fake-id         fake,id            fake[-_.]id
    essay-writer    essay,writer       essay[-_.]writer
    buy-followers   buy,followers      buy[-_.](?:[a-z0-9]+[-_.])?followers
    buy-traffic     buy,traffic        buy[-_.](?:[a-z0-9]+[-_.])?traffic
    seo-backlinks   backlinks          backlinks
    adult-cams      cams               (?:adult|live|sex)[-_.]cams
    porn            porn               porn
    xxx             xxx                xxx
    escorts         escorts            escorts
    warez           warez              warez
    keygen          keygen             keygen
    crack-download  crack,download     (?:crack[-_.]download|download[-_.]crack)
    serial-keys     keys,serial        serial[-_.]keys
    torrent-file    torrent            [a-z0-9]+\.torrent
    free-movies     free,movies        free[-_.]movies
    watch-free      free,watch         watch[-_.](?:[a-z0-9]+[-_.])?free
    mp3-download    mp3,download       mp3[-_.]download
    phishing-verify account,verify     verify[-_.](?:your[-_.])?account
    phishing-login  login,secure       secure[-_.]login[-_.][a-z0-9]+
    lottery-winner  lottery,winner     lottery[-_.]winner
    prize-claim     claim,prize        claim[-_.](?:your[-_.])?prize
    gift-card-free  card,free,gift     free[-_.]gift[-_.]card
    survey-reward   reward,survey      survey[-_.]reward
    miracle-cure    cure,miracle       miracle[-_.]cure
    weight-loss     loss,weight        weight[-_.]loss[-_.](?:pills?|fast|now)
    doorway         doorway            doorway[-_.]pages?
    click-here      click,here         click[-_.]here
    ad-server       adserver           adserver
    double-click    doubleclick        doubleclick
    popunder        popunder           popunder
    tracker-pixel   pixel,tracker      tracker[-_./]pixel
    autogenerated   autogen            autogen[-_.][a-z0-9]+
    parked-domain   domain,parked      parked[-_.]domain
    domain-for-sale domain,sale        domain[-_.]for[-_.]sale
    executable      exe                [a-z0-9]+\.exe
    """,
) + _rules(
    "allow",
    r"""
    spam-research   research,spam      research[-_./]spam
    spam-report     report,spam        report[-_.]spam
    addiction-help  addiction,help     (?:casino|gambling|porn)[-_.]addiction[-_.]help
    fraud-warning   fraud,warning      fraud[-_.]warning
    """,
)


def lowered(url: Column) -> Column:
    return F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def tokens(url: Column) -> Column:
    return F.array_distinct(F.split(lowered(url), "[^a-z0-9]+"))


def literal_counts(df: DataFrame, rules=PATTERN_RULES, url: str = "url") -> dict[str, int]:
    """How many URLs hold each literal of the rules: as many numbers as the rules have literals, whatever the table's size."""
    literals = sorted({x for r in rules for x in r.literals})
    seen = df.select(F.explode(tokens(F.col(url))).alias("token")).where(F.col("token").isin(literals))
    return {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rule_index(rules, counts: dict[str, int]) -> dict[str, list[PatternRule]]:
    """Rules by their rarest literal."""
    index: dict[str, list[PatternRule]] = {}
    for r in rules:
        index.setdefault(min(r.literals, key=lambda x: (counts.get(x, 0), x)), []).append(r)
    return index


def _structs(rules) -> Column:
    return F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex")) for r in rules])


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> Column:
    """The longest fitting rule as a struct of rule and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judge(df: DataFrame, host_rules=HOST_RULES, rules=PATTERN_RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, labels): labels are those of the pattern rules that fit, sorted."""
    index = rule_index(rules, literal_counts(df, rules, url))
    filed = F.create_map(*[x for token, found in sorted(index.items()) for x in (F.lit(token), _structs(found))])
    host, path = host_and_path(F.col("url"))
    base = df.select(F.col(key).alias(key), F.col(url).cast("string").alias("url")).withColumns({"host": host, "path": path, "low": lowered(F.col("url"))})
    fetched = F.flatten(F.filter(F.transform(tokens(F.col("url")), lambda t: F.try_element_at(filed, t)), lambda x: x.isNotNull()))
    fitting = F.filter(fetched, lambda r: F.regexp_like(F.col("low"), r["regex"]))
    found = base.withColumns({"fitting": fitting, "hit": host_rule(F.col("host"), F.col("path"), host_rules)})
    allowed = F.exists("fitting", lambda r: r["verdict"] == "allow") | (F.size("fitting") == 0)
    return found.select(
        key, "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(allowed, "allow").otherwise("block")).alias("verdict"),
        F.array_join(F.array_sort(F.transform("fitting", lambda r: r["label"])), ",").alias("labels"),
    )


def judge_sql(host_rules=HOST_RULES, rules=PATTERN_RULES) -> str:
    """The same verdicts with every regular expression tried on every URL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"WHEN (host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)}) THEN {{}}" for r in sorted(host_rules, key=lambda r: -len(r.host + r.path)))
    ordered = sorted(host_rules, key=lambda r: -len(r.host + r.path))
    rule = f"CASE {whens.format(*[q(r.host + r.path) for r in ordered])} END"
    verdict = f"CASE {whens.format(*[q(r.verdict) for r in ordered])} END"
    fits = lambda kind: "[" + ", ".join(f"CASE WHEN regexp_matches(low, {q(r.regex)}) THEN {q(r.label)} END" for r in rules if kind in (r.verdict, "")) + "]"
    some = lambda kind: f"len(list_filter({fits(kind)}, lambda x: x IS NOT NULL))"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low FROM pages),
r AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, low, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, {rule} AS rule,
  coalesce({verdict}, CASE WHEN {some("allow")} > 0 OR {some("block")} = 0 THEN 'allow' ELSE 'block' END) AS verdict,
  array_to_string(list_sort(list_filter({fits("")}, lambda x: x IS NOT NULL)), ',') AS labels
FROM p"""
