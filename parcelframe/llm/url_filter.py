"""Verdicts on urls by a list of (host, path) rules: a blocked Bloom filter, then an exact hash join.

A rule's canonical url is its host and path joined (hosts hold no slash, so the
text is unambiguous). It fits a url whose host is the rule's host or below it
and whose path starts with the rule's path. For every url, the canonical texts
that could be listed are its host suffixes joined with its path prefixes, of
just the (labels, path length) shapes that occur in the list. The Bloom filter
drops nearly all that aren't listed; a hash join on the full text decides the
rest, so false positives never reach the result. The longest fitting rule wins
(of equally long ones, that with the longer host).

The filter (see ``bloom``) is a bounded table whatever the list's size: a longer
list only lets more false positives through to the join. Everything is
DataFrame operations.

Defined results: a null url, or one without ``://``, has empty host and path
and no rule; a url that no rule fits is allowed; repeated rows each get a row;
other columns are ignored. Of a rule that is listed with both verdicts, block wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom

#: The contract's rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; rules: host, path, verdict."""
    listed = (rules.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"),
                           F.length("path").alias("n"), F.length("host").alias("host_n"), "verdict")
              .groupBy("key").agg(F.max("labels").alias("labels"), F.max("n").alias("n"), F.max("host_n").alias("host_n"),
                                  F.max("verdict").alias("verdict")))
    shapes = listed.select("labels", "n").distinct().orderBy("labels", "n").collect()  # bounded by the lengths of a url
    blocks = bloom.blocks_for(listed.count())
    held = bloom.build(listed, "key", blocks)

    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not shapes:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    shape = F.array(*[F.struct(F.lit(s.labels).alias("labels"), F.lit(s.n).alias("n")) for s in shapes])
    split = F.split("host", r"\.")
    could = F.transform(F.filter(shape, lambda s: (s["labels"] <= F.size(split)) & (s["n"] <= F.length("path"))),
                        lambda s: F.concat(F.array_join(F.slice(split, F.size(split) - s["labels"] + 1, s["labels"]), "."),
                                           F.substring("path", F.lit(1), s["n"])))
    asked = urls.where("host != ''").select("host", "path", F.explode(could).alias("key"))
    possible = bloom.may_hold(asked, F.col("key"), held, blocks)
    fits = possible.join(listed, "key")
    longest = F.max_by(F.struct(F.col("key").alias("rule"), "verdict"), F.struct(F.length("key").alias("a"), F.col("host_n").alias("b")))
    best = fits.groupBy("host", "path").agg(longest.alias("best"))
    return (urls.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")))


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {_RULE_ROWS}),
rest AS (SELECT page_id, url, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0
                THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, row_number() OVER () AS r,
         translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT r, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
         FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) AND host <> '')
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN best b ON u.r = b.r AND b.k = 1
"""
