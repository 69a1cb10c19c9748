"""URL filters with DataFrame functions only: pattern rules found by their rarest literal token.

Each rule names literal tokens that any URL it fits must hold whole. One count
over the URLs says how common those tokens are, and each rule is filed under
its rarest. The index is a hash table kept as a literal array: a URL's token
picks one cell, the cell's rules filed under that very token are the
candidates, and only they run their regular expression. So judging needs no
shuffle and no join. The index grows with the rules alone; ``MOST_RULES``
bounds it, and more are an error.

Defined cases: a null URL and one without ``://`` have empty host and path and
get the default verdict; an empty table gives an empty result; repeated rows
are judged alike; very long URLs are read whole; of rules of equal length the
first by rule string wins. Columns of the table are kept whatever their names,
but one that is named like a result is replaced by it.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import ASCII_LOWER, ASCII_UPPER

MOST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    rule: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    ranked: bool  # ranked rules: the longest decides; others only where none of those fits


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains, and paths that start with path."""
    host = host.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))
    whole = re.findall("[0-9a-z]+", host)
    parts = re.findall("[0-9A-Za-z]+|[^0-9A-Za-z]", path)
    if parts and re.match("[0-9A-Za-z]", parts[-1]):
        parts.pop()  # a URL's token may go on after the rule's end
    whole += [p.lower() for p in parts if re.fullmatch("[0-9A-Za-z]+", p)]
    return Rule(host + path, verdict, r"^(?:[^/]*\.)?" + _quoted(host) + _quoted(path), tuple(whole), True)


def word_rule(*words: str, verdict: str = "block") -> Rule:
    """A rule for host names in which the words stand one after another, parted by dashes or dots."""
    return Rule("-".join(words), verdict, r"^[^/]*(?<![0-9a-z])" + "[-.]".join(map(_quoted, words)) + r"(?![0-9a-z])", tuple(words), False)


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z/])", r"\\\1", text)


#: The rules of the contract, and the method's own for hosts that none of those decides.
HOST_RULES = (
    host_rule("com", "/en/", "block"),
    host_rule("example.com", "/en/7", "allow"),
    host_rule("net", "/de/", "allow"),
    host_rule("example.net", "/de/8", "block"),
    host_rule("org", "/es/", "block"),
)
WORD_RULES = (
    word_rule("ads", "track"), word_rule("spam", "farm"), word_rule("casino", "win"), word_rule("adult", "x"),
    word_rule("cheap", "pills"), word_rule("free", "bets"), word_rule("casino"), word_rule("adult"), word_rule("porn"),
)


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(_u, locate('://', _u) + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(_u, locate('://', _u) + 3)")).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def located(df: DataFrame, url: str = "url") -> DataFrame:
    """_row (a row of df), host, path, and _tokens: the lower-case alphanumeric runs of both."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("_u"))
    parts = whole.withColumn("host", host_of(F.col("_u"))).withColumn("path", path_of(F.col("_u"))).drop("_u")
    return parts.withColumn("_tokens", F.array_distinct(F.split(F.translate(F.concat("host", F.lit(" "), "path"), ASCII_UPPER, ASCII_LOWER), "[^0-9a-z]+")))


def token_counts(parts: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URLs hold each token that some rule names: at most as many counts as rules have tokens."""
    named = sorted({t for r in rules for t in r.tokens})
    if not named:
        return {}
    held = parts.select(F.explode(F.array_intersect("_tokens", F.array(*map(F.lit, named)))).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rarest(rule: Rule, counts: dict[str, int]) -> str | None:
    return min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None)


def _index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[Column, Column, int]:
    """The hash table, the rules without a token, and the number of cells."""
    cells = max(1, 2 * len(rules))
    table: list[list[dict]] = [[] for _ in range(cells)]
    loose = []
    for r in sorted(rules, key=lambda r: r.rule):
        token = rarest(r, counts)
        entry = {"token": token, "rule": r.rule, "verdict": r.verdict, "pattern": r.pattern, "rank": len(r.rule) if r.ranked else 0}
        (loose if token is None else table[zlib.crc32(token.encode()) % cells]).append(entry)
    kind = "array<struct<token:string,rule:string,verdict:string,pattern:string,rank:int>>"
    return F.from_json(F.lit(json.dumps(table)), f"array<{kind}>"), F.from_json(F.lit(json.dumps(loose)), kind), cells


def judge(df: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + WORD_RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """df with ``host``, ``path``, ``rule`` (of the longest ranked rule that fits, else null), ``matched`` (of whatever rule decided) and ``verdict``."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    parts = located(df, url)
    table, loose, cells = _index(rules, token_counts(parts, rules))
    fetched = F.flatten(F.transform("_tokens", lambda t: F.filter(F.get(table, F.pmod(F.crc32(t), F.lit(cells)).cast("int")), lambda r: r["token"] == t)))
    best = (
        parts.withColumn("_c", F.concat(fetched, loose))
        .withColumn("_hits", F.filter("_c", lambda r: F.rlike(F.concat("host", "path"), r["pattern"])))
        .withColumn("_best", F.reduce("_hits", F.lit(None).cast("struct<token:string,rule:string,verdict:string,pattern:string,rank:int>"),
                                      lambda a, r: F.when(a.isNull() | (r["rank"] > a["rank"]) | ((r["rank"] == a["rank"]) & (r["rule"] < a["rule"])), r).otherwise(a)))
    )
    results = {
        "host": F.col("host"), "path": F.col("path"), "rule": F.when(F.col("_best.rank") > 0, F.col("_best.rule")), "matched": F.col("_best.rule"),
        "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default)),
    }
    return best.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c not in results], *[v.alias(k) for k, v in results.items()])
