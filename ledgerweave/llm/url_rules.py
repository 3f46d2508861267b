"""URL filter as a sort-merge range join of page keys and rule intervals (operator 6).

A host is written back to front (``news.example.net`` -> ``net.example.news.``), so a rule's host and all its
subdomains are one interval of sorted keys, and rule intervals are nested or apart. Pages are dealt to ranges of
(reversed host, path, salt); a rule is copied to every range its interval meets. Each range is then swept once in
order with a stack of the rules open at that key; of those whose path starts the page's path the longest host+path
wins. Neither side is broadcast or collected: the driver sees only the range bounds, drawn from a hash sample of
``SAMPLE`` keys for each range and cut to the shortest texts that still part their neighbours. The salt lets one host,
or one url, spread over many ranges.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or
the end. A null url or one without ``://`` has both empty.

Defined results: a page that no rule fits gets a null rule and ``default`` as verdict; repeated pages come back as
often as they occur; of equal rules ``allow`` wins over ``block``; rules with a null host or path are not used; an
empty page table gives no rows, an empty rule table gives the default everywhere; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm.common import partitions_of

#: host, path, verdict
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER = "\U0010ffff"
SAMPLE = 16


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels back to front, each closed by a dot, so that a host's key starts every subdomain's key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _parting(low: str, high: str) -> str:
    """The shortest start of ``high`` that sorts after ``low``."""
    same = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return high[: same + 1]


def _bounds(keys: DataFrame, ranges: int) -> list[str]:
    """Sorted cut points of the key space: one key for each of ``SAMPLE * ranges`` hash classes reaches the driver."""
    drawn = keys.groupBy(F.pmod("salt", F.lit(SAMPLE * ranges)).alias("class")).agg(F.min_by("key", "salt").alias("key"))
    rows = sorted(r.key for r in drawn.collect())
    cuts = [len(rows) * i // ranges for i in range(1, ranges)]
    return sorted({_parting(rows[i - 1], rows[i]) for i in cuts if i and rows[i - 1] < rows[i]})


def _range_of(bounds: list[str]):
    @F.pandas_udf(T.IntegerType())
    def place(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in keys:
            yield pd.Series([bisect_right(bounds, k) for k in batch], dtype="int32")

    return place


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (pid, rev, kind): rules before the pages under them."""
    pid, open_rules = None, []  # (reversed host, host, path, verdict)
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("pid", "rev", "kind", "page_id", "host", "path", "verdict")]
        ids, hosts, paths, rules, verdicts = [], [], [], [], []
        for p, rev, kind, page, host, path, verdict in zip(*cols, strict=True):
            if p != pid:
                pid, open_rules = p, []
            while open_rules and not rev.startswith(open_rules[-1][0]):
                open_rules.pop()
            if kind == 0:
                open_rules.append((rev, host, path, verdict))
                continue
            fit = max((r for r in open_rules if path.startswith(r[2])), key=lambda r: (len(r[1]) + len(r[2]), r[3] == "allow"), default=None)
            ids.append(page)
            hosts.append(host)
            paths.append(path)
            rules.append(fit and fit[1] + fit[2])
            verdicts.append(fit and fit[3])
        yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))], names=["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for ``pages(page_id, url)`` under ``rules(host, path, verdict)``."""
    n = partitions_of(pages.sparkSession)
    asked = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.xxhash64("page_id", "url").alias("salt"))
    asked = asked.withColumn("rev", reversed_host(F.col("host"))).withColumn("key", F.concat("rev", F.lit("\x00"), "path", F.lit("\x00"), F.hex("salt")))
    bounds = _bounds(asked.select("key", "salt"), n)
    place = _range_of(bounds)
    empty = F.lit(None).cast("long")
    known = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host is not null and path is not null")
    known = known.withColumn("rev", reversed_host(F.col("host")))
    spans = known.withColumn("lo", place("rev")).withColumn("hi", place(F.concat("rev", F.lit(AFTER))))
    copies = spans.withColumn("pid", F.explode(F.sequence("lo", "hi"))).select("pid", "rev", F.lit(0).alias("kind"), empty.alias("page_id"), "host", "path", "verdict")
    urls = asked.select(place("key").alias("pid"), "rev", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    both = urls.unionByName(copies).repartitionById(n, F.col("pid")).sortWithinPartitions("pid", "rev", "kind", "path")
    out = both.mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op6_url_rules(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path, rhost, rpath, v FROM parts LEFT JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path,
       arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
       coalesce(arg_max(v, length(rhost || rpath)), 'allow') AS verdict
FROM fits GROUP BY page_id, host, path
"""
