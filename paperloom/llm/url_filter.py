"""URL filter rules looked up by their rarest literal token.

A rule is (host, path, verdict): it fits its host and all subdomains when the
URL's path starts with the rule's path; the longest rule wins. Every rule is
filed under the one of its whole tokens (host labels, closed path segments)
that the corpus's URLs show least. A URL's tokens fetch the rules filed under
them, and only those run their regular expression. All of it is one
projection over the URLs, with no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def _literal_tokens(rule_host: str, rule_path: str) -> list[str]:
    """Tokens that every URL which the rule fits has."""
    return [f"h:{x}" for x in rule_host.split(".")] + [f"p:{x}" for x in rule_path.split("/")[1:-1]]


def _url_tokens(h: Column, p: Column) -> Column:
    return F.array_distinct(F.concat(F.transform(F.split(h, r"\."), lambda x: F.concat(F.lit("h:"), x)), F.transform(F.split(p, "/"), lambda x: F.concat(F.lit("p:"), x))))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (host and path of the rule, else null) and verdict (the rule's, else default).

    Columns of pages that have one of these names give way. A null or empty
    url has an empty host and path and fits no rule; repeated urls are judged
    each; an empty table gives an empty one. Of equally long rules the greater text wins, of equal ones block.
    rules is configuration that the plan carries, so some thousands at most.
    """
    known = sorted({t for h, p, _ in rules for t in _literal_tokens(h, p)})
    parsed = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    seen = parsed.select(F.explode(F.filter(_url_tokens(F.col("host"), F.col("path")), lambda t: t.isin(known))).alias("token"))
    count = dict(seen.groupBy("token").count().collect()) if known else {}  # a row for each token of a rule at most
    filed: dict[str, list[Column]] = {}
    for h, p, verdict in rules:
        token = min(_literal_tokens(h, p), key=lambda t: (count.get(t, 0), t))
        pattern = rf"(?s)^([^/]*\.)?{re.escape(h + p)}"
        filed.setdefault(token, []).append(F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(pattern).alias("pattern")))
    if not filed:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    index = F.create_map(*[x for t, r in filed.items() for x in (F.lit(t), F.array(*r))])
    at = F.filter(_url_tokens(F.col("host"), F.col("path")), lambda t: t.isin(list(filed)))
    candidates = F.flatten(F.transform(at, lambda t: index[t]))
    whole = F.concat("host", "path")
    fits = F.filter(candidates, lambda r: F.rlike(whole, r["pattern"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["length"], r["rule"], r["verdict"])))
    return parsed.withColumns({"rule": best["rule"], "verdict": F.coalesce(best["verdict"], F.lit(default))})
