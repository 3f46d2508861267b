"""WARC not-modified revisits resolved by an as-of join (operator 8).

A revisit record (a 304 answer) holds no body. It is matched to the latest strictly earlier full response of the same
canonical URL; when the validators agree, its own permitted headers are laid over the stored ones (RFC 9111, 3.2) and
the stored body is taken over. Outcomes: ``etag`` or ``last_modified`` (agreed), ``unvalidated`` (neither record has a
validator), ``mismatch`` (validators differ, or only one side has any), ``no_response`` (nothing earlier). The first
three are resolved.

As-of join: records are range-sorted by (url, time), each range carries the last response forward over its own rows,
and the at most two urls that a range shares with its neighbours get the last response of earlier ranges from a table
of one row for each range and shared url. So one url may hold most records. Bodies are joined only afterwards, by
record id; a response that very many revisits share is split there by Spark's skew join.

Defined results: of responses at one time the largest record id wins; a response at the revisit's own time is not
earlier; records with a null url, time or id are matched to nothing (a revisit of that kind gives ``no_response``);
repeated revisits come back as often as they occur; repeated responses of one id count as one, with the largest body;
null header maps are empty; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import freeze, with_place

#: Headers that a 304 answer may not change in the stored response.
KEPT_HEADERS = (
    "content-encoding", "content-length", "content-md5", "content-range", "content-type", "connection", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default ports, fragment and trailing slashes dropped; host lower-cased; parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))).otherwise(""))


def _lower_keys(headers: Column) -> Column:
    """Header names lower-cased; of names that then clash the last in name order counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def merged_headers(stored: Column, answer: Column) -> Column:
    """Stored headers with the permitted headers of the 304 answer laid over them."""
    old, new = _lower_keys(stored), F.map_filter(_lower_keys(answer), lambda k, _: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Revisits of ``records(record_id, url, ts, kind, etag, last_modified, headers, body)`` with their stored response.

    kind is ``response`` or ``revisit``; ts is a long (epoch seconds). Returns record_id, canonical, ts, response_id,
    outcome, resolved, headers (merged if resolved, the revisit's own if not) and body (null if not resolved).
    """
    light = records.where("kind in ('response', 'revisit')").select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "ts", (F.col("kind") == "response").cast("int").alias("full"), _weak(F.col("etag")).alias("etag"), "last_modified"
    )
    ok = F.col("canonical").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    # at one time revisits come first, so that a response then is not earlier
    placed = with_place(light.where(ok), [F.col("canonical"), F.col("ts"), F.col("full"), F.col("record_id")], "revisit-rows")
    stored = F.when(F.col("full") == 1, F.struct(F.col("record_id").alias("response_id"), F.col("etag").alias("etag"), F.col("last_modified").alias("last_modified")))
    own = F.last(stored, ignorenulls=True).over(Window.partitionBy("pid", "canonical").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    ranges = placed.groupBy("canonical", "pid").agg(F.max_by(stored, F.when(F.col("full") == 1, F.col("at"))).alias("latest"))
    over = ranges.groupBy("canonical").agg(F.count("*").alias("ranges")).where("ranges > 1").select("canonical")
    earlier = F.last("latest", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    carried = freeze(ranges.join(over.hint("merge"), "canonical").select("canonical", "pid", earlier.alias("carried")).where("carried is not null"), "revisit-carried")
    matched = placed.withColumn("own", own).where("full = 0")
    # at most one row for each range and url that crosses its start: a proven bound
    matched = matched.join(F.broadcast(carried), ["canonical", "pid"], "left").withColumn("r", F.coalesce("own", "carried"))
    matched = matched.select("record_id", "canonical", "ts", "etag", "last_modified", "r")
    lost = light.where(~ok & (F.col("full") == 0)).select("record_id", "canonical", "ts", "etag", "last_modified", F.lit(None).cast(matched.schema["r"].dataType).alias("r"))
    pairs = matched.unionByName(lost)
    e, m = F.col("r.etag"), F.col("r.last_modified")
    outcome = (
        F.when(F.col("r").isNull(), "no_response")
        .when(e.isNotNull() & F.col("etag").isNotNull(), F.when(e == F.col("etag"), "etag").otherwise("mismatch"))
        .when(m.isNotNull() & F.col("last_modified").isNotNull(), F.when(m == F.col("last_modified"), "last_modified").otherwise("mismatch"))
        .when(F.coalesce(e, m, "etag", "last_modified").isNull(), "unvalidated")
        .otherwise("mismatch")
    )
    good = F.col("outcome").isin("etag", "last_modified", "unvalidated")
    pairs = freeze(pairs.select("record_id", "canonical", "ts", F.col("r.response_id").alias("response_id"), outcome.alias("outcome")).withColumn("resolved", good), "revisit-pairs")
    answers = records.where("kind = 'revisit'").groupBy("record_id").agg(F.max(F.struct(F.to_json("headers").alias("j"))).alias("a")).select(F.col("record_id").alias("aid"), F.from_json("a.j", "map<string,string>").alias("answer"))
    used = records.where("kind = 'response' and record_id is not null").select(F.col("record_id").alias("sid"), F.col("headers").alias("stored"), "body")
    need = pairs.where("resolved").select(F.col("response_id").alias("sid")).distinct()
    used = used.join(need.hint("merge"), "sid", "left_semi")
    used = used.groupBy("sid").agg(F.max_by(F.struct("stored", "body"), F.struct(F.length("body"), "body")).alias("s"))
    out = pairs.join(answers.hint("merge"), F.col("record_id") == F.col("aid"), "left")
    names = ["record_id", "canonical", "ts", "response_id", "outcome", "resolved"]
    # only resolved revisits meet stored bodies: the others would all share one null key
    whole = out.where("resolved").join(used.hint("merge"), F.col("response_id") == F.col("sid"), "left")
    whole = whole.select(*names, merged_headers(F.col("s.stored"), F.col("answer")).alias("headers"), F.col("s.body").alias("body"))
    bare = out.where("not resolved").select(*names, _lower_keys(F.col("answer")).alias("headers"), F.lit(None).cast(whole.schema["body"].dataType).alias("body"))
    return whole.unionByName(bare)


DAY = 86_400


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records that pages give by rule: a response, a later revisit, and for every third page a changed response
    and a second revisit; a page without page_id has no record id and gives none. Every fourth page has Last-Modified instead of ETag; every eleventh answers with a foreign
    validator; the first revisit of every fifth page comes before its response."""
    p = pages.select("page_id", "url", "html").where("page_id is not null")
    html = F.coalesce("html", F.lit(""))
    k = F.col("k")
    rows = p.withColumn("k", F.explode(F.when(F.col("page_id") % 3 == 0, F.array(*map(F.lit, range(4)))).otherwise(F.array(F.lit(0), F.lit(1)))))
    full = k % 2 == 0
    version = F.when(k >= 2, F.concat(html, F.lit("<!-- v2 -->"))).otherwise(html)
    first = F.lit(1_700_000_000) + F.pmod(F.col("page_id") * 7919, F.lit(DAY))
    ts = first + F.when(k == 1, (F.pmod("page_id", F.lit(5)) - 1) * DAY + F.when(F.pmod("page_id", F.lit(5)) == 1, 60).otherwise(0)).when(k == 2, 10 * DAY).when(k == 3, 11 * DAY).otherwise(0)
    dated = F.pmod("page_id", F.lit(4)) == 0
    foreign = ~full & (F.pmod("page_id", F.lit(11)) == 0)
    # the validator is that of the version in force; a page's second validator differs from its first
    etag = F.when(~dated, F.concat(F.lit('"'), F.when(foreign, F.lit("x")).otherwise(F.lit("")), F.md5(F.concat(F.col("url"), F.when(k >= 2, F.lit("2")).otherwise(F.lit("1")))), F.lit('"')))
    modified = F.when(dated, F.concat(F.when(foreign, F.lit("x")).otherwise(F.lit("d")), F.when(k >= 2, F.lit("2")).otherwise(F.lit("1"))))
    headers = F.when(
        full, F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length(version).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"))
    ).otherwise(F.create_map(F.lit("cache-control"), F.lit("max-age=120"), F.lit("Content-Length"), F.lit("0"), F.lit("Date"), ts.cast("string")))
    return rows.select(
        (F.col("page_id") * 4 + k).alias("record_id"), "url", ts.cast("long").alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"), etag.alias("etag"),
        modified.alias("last_modified"), headers.alias("headers"), F.when(full, version).alias("body"),
    )


def op8_revisit_resolution(spark, sf_dir: str) -> DataFrame:
    out = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return out.select(
        "record_id", "canonical", "ts", "response_id", "outcome", "resolved", listed.alias("headers"), F.length("body").cast("long").alias("body_chars"), F.md5("body").alias("body_md5")
    )


ORACLE_SQL = r"""
WITH base AS (
  SELECT page_id, url, coalesce(html, '') AS html, 1700000000 + (page_id * 7919) % 86400 AS t0,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages WHERE page_id IS NOT NULL),
named AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), ':(80|443)$', ''), '^www\.', '')
            || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
            || CASE WHEN regexp_extract(rest, '\?(.*)$', 1) <> ''
                    THEN '?' || array_to_string(list_sort(string_split(regexp_extract(rest, '\?(.*)$', 1), '&')), '&') ELSE '' END AS canonical
  FROM base),
rec AS (
  SELECT page_id, page_id * 4 + k AS record_id, url, canonical, k, k % 2 = 0 AS is_full,
         t0 + CASE k WHEN 1 THEN (page_id % 5 - 1) * 86400 + CASE WHEN page_id % 5 = 1 THEN 60 ELSE 0 END WHEN 2 THEN 864000 WHEN 3 THEN 950400 ELSE 0 END AS ts,
         CASE WHEN page_id % 4 <> 0 THEN '"' || CASE WHEN k % 2 = 1 AND page_id % 11 = 0 THEN 'x' ELSE '' END || md5(url || CASE WHEN k >= 2 THEN '2' ELSE '1' END) || '"' END AS etag,
         CASE WHEN page_id % 4 = 0 THEN CASE WHEN k % 2 = 1 AND page_id % 11 = 0 THEN 'x' ELSE 'd' END || CASE WHEN k >= 2 THEN '2' ELSE '1' END END AS lm,
         CASE WHEN k >= 2 THEN html || '<!-- v2 -->' ELSE html END AS body
  FROM named, (VALUES (0), (1), (2), (3)) AS ks(k) WHERE k < 2 OR page_id % 3 = 0),
pairs AS (
  SELECT r.record_id, arg_max(s.record_id, (s.ts, s.record_id)) AS response_id
  FROM rec r JOIN rec s ON s.canonical = r.canonical AND s.is_full AND s.ts < r.ts
  WHERE NOT r.is_full GROUP BY r.record_id),
judged AS (
  SELECT r.record_id, r.canonical, r.ts, p.response_id, s.body,
         CASE WHEN p.response_id IS NULL THEN 'no_response'
              WHEN s.etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN s.etag = r.etag THEN 'etag' ELSE 'mismatch' END
              WHEN s.lm IS NOT NULL AND r.lm IS NOT NULL THEN CASE WHEN s.lm = r.lm THEN 'last_modified' ELSE 'mismatch' END
              ELSE 'mismatch' END AS outcome
  FROM rec r LEFT JOIN pairs p USING (record_id) LEFT JOIN rec s ON s.record_id = p.response_id
  WHERE NOT r.is_full)
SELECT record_id, canonical, ts, response_id, outcome, outcome IN ('etag', 'last_modified') AS resolved,
       CASE WHEN outcome IN ('etag', 'last_modified')
            THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || length(body) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts
            ELSE 'cache-control: max-age=120' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts END AS headers,
       CASE WHEN outcome IN ('etag', 'last_modified') THEN length(body) END AS body_chars,
       CASE WHEN outcome IN ('etag', 'last_modified') THEN md5(body) END AS body_md5
FROM judged
"""
