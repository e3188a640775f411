"""URL filters: pattern rules indexed by their rarest literal token.

A rule's literal tokens are runs of letters, digits and hyphens that every matching URL must hold whole. The index
files each rule under the one that the fewest URLs of the corpus hold; a URL's tokens fetch the rules filed under them
and only those run their regular expressions. Rules without a literal token are run on every URL.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or the end.
Defined results: a null URL or one without "://" has an empty host and path, fits no rule and is allowed; the longest
of several fitting rules wins, and of equal ones the first in the list; repeated rows are judged each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, key_schema, table

#: Most rules that are sent to all executors.
MAX_RULES = 100_000
_TOKEN = re.compile(r"[a-z0-9-]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """verdict for URLs whose host and path, joined, pattern matches. name is None for patterns of the method itself,
    which only speak where no named rule fits. weight: how specific a rule is; literals: tokens a match must hold."""

    pattern: str
    verdict: str
    name: str | None = None
    weight: int = 0
    literals: tuple[str, ...] = ()


def host_path_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and its subdomains and paths that start with path."""
    whole = path if path.endswith("/") else path.rpartition("/")[0]  # a last piece may go on in the URL
    return Rule(rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", verdict, host + path, len(host + path), tuple(dict.fromkeys(_TOKEN.findall(f"{host}/{whole}".translate(_LOWER)))))


def label_rule(verdict: str, label: str) -> Rule:
    """A rule of the method for hosts with a label, at any depth but the last."""
    return Rule(rf"(?:[^/]*\.)?{re.escape(label)}\.", verdict, None, 0, (label,))


#: The rules to judge by, and host labels that the method blocks.
RULES = (
    host_path_rule("allow", "com", "/"),
    host_path_rule("block", "example.com", "/en/"),
    host_path_rule("allow", "www.example.com", "/en/"),
    host_path_rule("block", "net", "/es/"),
    host_path_rule("block", "net", "/fr/"),
)
BLOCKED_LABELS = ("spam-farm", "cheap-pills", "casino", "free-money", "xxx")
METHOD = tuple(label_rule("block", x) for x in BLOCKED_LABELS)


def split_url(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(f"{host}{path}".translate(_LOWER)))


def token_counts(urls: DataFrame, rules: tuple[Rule, ...], url: str) -> dict[str, int]:
    """Of how many URLs each literal of the rules is a token; no more rows than the rules have literals."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.literals})], "token string")  # as many as the rules have literals, so it is sent
    body = F.regexp_extract(F.col(f"`{url}`"), r"(?s)^.*?://([^?#]*)", 1)
    held = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit("([a-z0-9-]+)"), 1))).alias("token"))
    return {r.token: r["count"] for r in held.join(F.broadcast(wanted), "token").groupBy("token").count().collect()}


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str | None, list[int]]:
    index: dict[str | None, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t)) if r.literals else None, []).append(i)
    return index


def judge(urls: DataFrame, rules: tuple[Rule, ...], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to urls, whose other columns stay but for names that clash with these."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    keys = [c for c in urls.columns if c not in (url, "host", "path", "rule", "verdict")]
    index = build_index(rules, token_counts(urls, rules, url) if any(len(r.literals) > 1 for r in rules) else {})
    order = sorted(range(len(rules)), key=lambda i: (rules[i].name is None, -rules[i].weight, i))
    schema = T.StructType([*key_schema(urls, keys), T.StructField(url, T.StringType()), *T._parse_datatype_string("host string, path string, rule string, verdict string").fields])
    arrow = arrow_schema(schema)
    shipped = urls.sparkSession.sparkContext.broadcast((rules, index, {i: n for n, i in enumerate(order)}))

    def run(batches):
        rules, index, place = shipped.value
        compiled: dict[int, re.Pattern] = {}  # a rule is compiled when a URL first fetches it

        def fits(i: int, body: str) -> bool:
            if i not in compiled:
                compiled[i] = re.compile(rules[i].pattern)
            return bool(compiled[i].match(body))

        always = index.get(None, [])
        for batch in batches:
            out = []
            for value in batch.column(url).to_pylist():
                host, path = split_url(value)
                fetched = {i for t in url_tokens(host, path) for i in index.get(t, ())}
                best = next((i for i in sorted((*fetched, *always), key=place.__getitem__) if fits(i, host + path)), None) if host else None
                out.append((host, path, rules[best].name if best is not None else None, rules[best].verdict if best is not None else default))
            if out:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column(url), *(pa.array(c, type=pa.string()) for c in zip(*out, strict=True))], schema=arrow)

    return urls.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{url}`").cast("string").alias(url)).mapInArrow(run, schema)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES + METHOD).drop("url")


_RULE_ROWS = ", ".join(f"('{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.verdict}')" for r in RULES)
ORACLE = rf"""
with cut as (
  select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as n
  from cut
), rules(rule_host, rule_path, rule_verdict) as (values {_RULE_ROWS}
), fits as (
  select n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(rule_verdict, length(rule_host || rule_path)) as rule_verdict
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by n
)
select page_id, host, path, rule, coalesce(rule_verdict, case when regexp_matches(host, '(^|\.)({"|".join(BLOCKED_LABELS)})\.') then 'block' else 'allow' end) as verdict
from parts left join fits using (n)
"""
