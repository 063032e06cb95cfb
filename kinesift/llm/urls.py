"""URL filters: host rules, and pattern rules that are indexed by their rarest literal token.

A pattern is literal text with ``*`` for anything, ``^`` for a separator or the end, ``|`` at either end for the
end of the URL, and ``||`` in front for the start of the host or of one of its labels. Its literal tokens are
the runs of letters and digits that a matching URL holds as whole tokens. Each rule is filed under the one of
them that the fewest URLs hold; a URL's tokens fetch the rules filed under them, and only those run their
regular expressions. Rules without such a token run on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
TOKEN = "[a-z0-9]+"
#: Rules travel with every task, so their number is bounded.
MOST_RULES = 100_000


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    action: str
    pattern: str

    @property
    def regex(self) -> str:
        body, head, tail = self.pattern.lower(), "", ""
        if body.startswith("||"):
            head, body = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:]
        elif body.startswith("|"):
            head, body = "^", body[1:]
        if body.endswith("|"):
            tail, body = "$", body[:-1]
        special = {"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}
        return "(?s)" + head + "".join(special.get(c) or re.escape(c) for c in body) + tail

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that a matching URL holds whole: both ends are fixed by the pattern."""
        body = self.pattern.lower()
        out = []
        for m in re.finditer(TOKEN, body):
            before, after = body[: m.start()][-1:], body[m.end() :][:1]
            if before and before != "*" and after and after != "*":
                out.append(m.group())
        return out


#: What a first crawl drops: feeds' tracking copies, list pages reached by reference links, trackers, sign-in pages.
HOST_RULES = [
    HostRule("block", "net"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
]
PATTERN_RULES = [
    PatternRule("block", "?utm_source=feed^"),
    PatternRule("block", "^utm_medium=email^"),
    PatternRule("block", "?page=*&ref=x^"),
    PatternRule("block", "||blog.*/es/"),
    PatternRule("block", "/login^"),
    PatternRule("block", "/tracker/"),
    PatternRule("block", "||ads."),
    PatternRule("block", "://m.*#top|"),
    PatternRule("allow", "||www.*/en/*?utm_source=feed|"),
    PatternRule("allow", "/fr/*.html|"),
]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, HOST, 1)), F.regexp_extract(u, PATH, 1)


def token_counts(pages: DataFrame, url: str, tokens: Iterable[str]) -> dict[str, int]:
    """How many rows hold each of the rules' tokens; as many numbers as there are tokens."""
    wanted = sorted(set(tokens))
    if not wanted:
        return {}
    held = F.array_intersect(F.regexp_extract_all(ascii_lower(F.col(url)), F.lit(TOKEN), 0), F.lit(wanted))
    rows = pages.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def filed(rules: list[PatternRule], counts: dict[str, int]) -> dict[str | None, list[PatternRule]]:
    """The rules by their rarest token; None holds those without one. Ties go by the token's text."""
    out: dict[str | None, list[PatternRule]] = {}
    for rule in rules:
        out.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=None), []).append(rule)
    return out


def judged(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    host_rules: list[HostRule] | None = None,
    pattern_rules: list[PatternRule] | None = None,
) -> DataFrame:
    """(key, url, host, path, rule, verdict) of every row.

    The longest fitting host rule decides; ties of length go to the first listed. Without one, pattern rules do:
    an allowing match outweighs blocking ones, and a URL that nothing blocks is allowed. Null URLs and those without
    ``://`` have empty host and path, fit no host rule and are allowed unless a pattern blocks them. Repeated
    rows repeat; an empty table gives an empty one.
    """
    host_rules = HOST_RULES if host_rules is None else host_rules
    pattern_rules = PATTERN_RULES if pattern_rules is None else pattern_rules
    if len(host_rules) + len(pattern_rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by_host: dict[str, list[HostRule]] = {}
    for r in sorted(host_rules, key=lambda r: -len(r.name)):
        by_host.setdefault(r.host.lower(), []).append(r)
    index = filed(pattern_rules, token_counts(pages, url, [t for r in pattern_rules for t in r.tokens]))
    ready = {t: [(r.action, re.compile(r.regex)) for r in rules] for t, rules in index.items()}
    always = ready.pop(None, [])
    lower = str.maketrans(UPPER, LOWER)

    def host_rule(host: str, path: str) -> HostRule | None:
        best = None
        at = 0
        while at >= 0 and host:
            for r in by_host.get(host[at:], ()):
                if path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
                    best = r
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best

    def pattern_verdict(raw: str | None) -> str:
        text = (raw or "").translate(lower)
        verdict = "allow"
        for rules in [always, *(ready[t] for t in set(re.findall(TOKEN, text)) if t in ready)]:
            for action, regex in rules:
                if regex.search(text):
                    if action == "allow":
                        return "allow"
                    verdict = "block"
        return verdict

    @F.pandas_udf("rule string, verdict string")
    def judge(raw: pd.Series, host: pd.Series, path: pd.Series) -> pd.DataFrame:
        out = []
        for u, h, p in zip(raw, host, path, strict=True):
            r = host_rule(h, p)
            out.append((r.name, r.action) if r else (None, pattern_verdict(u)))
        return pd.DataFrame(out, columns=["rule", "verdict"], dtype=object)

    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), host.alias("host"), path.alias("path"))
    done = rows.withColumn("_v", judge("_url", "host", "path"))
    return done.select(F.col("_key").alias(key), F.col("_url").alias(url), "host", "path", "_v.rule", "_v.verdict")


def judged_sql(key: str = "page_id", url: str = "url", pages: str = "pages") -> str:
    """DuckDB SQL for ``judged`` with the default rules; it runs every pattern on every URL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    fit = lambda r: f"(host = {quote(r.host)} OR ends_with(host, {quote('.' + r.host)})) AND starts_with(path, {quote(r.path)})"
    ordered = sorted(HOST_RULES, key=lambda r: -len(r.name))
    rule = " ".join(f"WHEN {fit(r)} THEN {quote(r.name)}" for r in ordered)
    action = " ".join(f"WHEN {fit(r)} THEN {quote(r.action)}" for r in ordered)
    match = lambda a: " OR ".join(f"regexp_matches(u, {quote(r.regex)})" for r in PATTERN_RULES if r.action == a)
    return f"""
    WITH cut AS (
        SELECT {key}, {low(f"coalesce({url}, '')")} AS u, {low(f"regexp_extract(coalesce({url}, ''), {quote(HOST)}, 1)")} AS host,
               regexp_extract(coalesce({url}, ''), {quote(PATH)}, 1) AS path
        FROM {pages}
    )
    SELECT {key}, host, path, CASE {rule} END AS rule,
           CASE {action} WHEN {match("allow")} THEN 'allow' WHEN {match("block")} THEN 'block' ELSE 'allow' END AS verdict
    FROM cut
    """
