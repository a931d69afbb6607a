"""URL filters: rules indexed by their rarest literal token, native expressions only.

A rule is (verdict, 'host/path'). Its tokens are the host's labels and the path's complete segments;
it is filed under the one that the fewest rules have. A URL's own tokens fetch candidate rules from
that index, and only those run their regular expression. The index is a constant inside the plan
(hash slots of small arrays), so rows are judged where they are read: no shuffle, no Python.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testimony.llm.common import LOWER, UPPER

#: Rules in one constant index; a longer list is applied in blocks of so many.
RULES_PER_INDEX = 5_000
_ENTRY = "array<array<struct<token:string,len:int,rule:string,verdict:string,pattern:string>>>"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _tokens(rule: str) -> list[str]:
    host, _, path = rule.partition("/")
    # The text after the last slash is the start of a segment, not all of one.
    return [t for t in [*host.split("."), *path.split("/")[:-1]] if t] or [""]


def rule_index(rules: Sequence[tuple[str, str]]) -> list[list[dict]]:
    """Hash slots of rule entries, each under the token that the fewest rules have (then the longest).

    The slot is the token's length and first and last code points, so that Spark's expressions and
    this function agree without a shared hash.
    """
    common = Counter(t for _, r in rules for t in set(_tokens(r)))
    slots: list[list[dict]] = [[] for _ in range(_SLOTS)]
    for verdict, rule in rules:
        token = min(_tokens(rule), key=lambda t: (common[t], -len(t), t))
        host, _, path = rule.partition("/")
        pattern = r"^(?:[^/]*\.)?" + re.escape(host) + re.escape("/" + path)
        slots[_slot(token)].append({"token": token, "len": len(rule), "rule": rule, "verdict": verdict, "pattern": pattern})
    return slots


_SLOTS = 1021


def _slot(token: str) -> int:
    return (len(token) * 131 + (ord(token[0]) * 31 + ord(token[-1]) if token else 0)) % _SLOTS


def _fetch(index: Column):
    def entries(t: Column) -> Column:
        ends = F.when(F.length(t) > 0, F.ascii(t) * 31 + F.ascii(F.right(t, F.lit(1)))).otherwise(0)
        return F.filter(F.element_at(index, F.pmod(F.length(t) * 131 + ends, F.lit(_SLOTS)) + 1), lambda e: e.token == t)

    return entries


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    *,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, n_candidates.

    A rule fits its host and all subdomains of it when the path starts with the rule's path. The
    longest fitting rule decides; of equally long ones the last by code point. Without one, rule is
    null and verdict is ``default``.

    A null or odd URL has empty host and path and gets the default. Repeated rows and equal ids
    are judged one by one. An empty table gives an empty result; an empty rule list gives the default
    everywhere. Other columns are ignored.
    """
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    text = F.concat("host", "path")
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split("host", r"\."), F.split("path", "/")))
    best, tried = F.lit(None).cast("struct<len:int,rule:string,verdict:string>"), F.lit(0)
    for at in range(0, len(rules), RULES_PER_INDEX):
        index = F.from_json(F.lit(json.dumps(rule_index(rules[at : at + RULES_PER_INDEX]))), _ENTRY)
        found = F.flatten(F.transform(tokens, _fetch(index)))
        fits = F.filter(found, lambda e: F.rlike(text, e.pattern))
        top = F.array_max(F.transform(fits, lambda e: F.struct(e.len.alias("len"), e.rule.alias("rule"), e.verdict.alias("verdict"))))
        best, tried = F.greatest(best, top) if at else top, tried + F.size(found)
    return urls.withColumn("_best", best).select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"), tried.cast("int").alias("n_candidates"),
    )
