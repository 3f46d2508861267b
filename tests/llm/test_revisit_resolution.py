import random

import pytest

from ledgerweave.llm import revisit_resolution as R

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, body string, sid string"


def brute(rows):
    out = []
    for r in rows:
        if r["kind"] != "revisit":
            continue
        full = [] if None in (r["url"], r["ts"], r["record_id"]) else [s for s in rows if s["kind"] == "response" and s["url"] == r["url"] and s["ts"] is not None and s["ts"] < r["ts"]]
        s = max(full, key=lambda s: (s["ts"], s["record_id"]), default=None)
        if s is None:
            outcome = "no_response"
        else:
            e, f = (x.get("etag") and x["etag"].removeprefix("W/") for x in (s, r))
            m, n = s.get("last_modified"), r.get("last_modified")
            if e and f:
                outcome = "etag" if e == f else "mismatch"
            elif m and n:
                outcome = "last_modified" if m == n else "mismatch"
            else:
                outcome = "mismatch" if e or f or m or n else "unvalidated"
        good = outcome in ("etag", "last_modified", "unvalidated")
        own = {k.lower(): v for k, v in (r.get("headers") or {}).items()}
        head = own
        if good:
            head = {k.lower(): v for k, v in (s.get("headers") or {}).items()} | {k: v for k, v in own.items() if k not in R.KEPT_HEADERS}
        out.append((r["record_id"], s and s["record_id"], outcome, good, tuple(sorted(head.items())), s.get("body") if good else None))
    return sorted(out, key=str)


def frame(spark, rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)


def got(df):
    return sorted(((r.record_id, r.response_id, r.outcome, r.resolved, tuple(sorted(r.headers.items())), r.body) for r in R.resolve(df).collect()), key=str)


def test_random_histories_match_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(900):
        url = rnd.choice(["hot.example/a"] * 5 + [f"h{j}.example/x" for j in range(60)])
        kind = rnd.choice(["response", "revisit", "revisit"])
        rows.append({"record_id": i, "url": url, "ts": rnd.randrange(300), "kind": kind, "etag": rnd.choice([None, '"1"', 'W/"1"', '"2"']), "last_modified": rnd.choice([None, "a", "b"]),
                     "headers": rnd.choice([None, {"Date": "d", "Content-Length": "0", "X": "1"}, {"cache-control": "no"}, {"Content-Type": "t", "X": "2"}]), "body": f"body {i}" if kind == "response" else None})
    rows += [{"record_id": 1000 + i, "url": u, "ts": t, "kind": "revisit"} for i, (u, t) in enumerate([(None, 4), ("hot.example/a", None), ("never.example", 7)])]
    assert got(frame(spark, rows)) == brute(rows)
    assert R.resolve(frame(spark, rows).limit(0)).count() == 0


def test_repeated_records(spark):
    one = {"record_id": 1, "url": "a.b", "ts": 1, "kind": "response", "body": "x"}
    again = {"record_id": 2, "url": "a.b", "ts": 2, "kind": "revisit"}
    assert [r[5] for r in got(frame(spark, [one, one, {**one, "body": "longer"}, again, again]))] == ["longer"] * 2


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://WWW.Example.com:80/A/?b=2&a=1#f", "example.com/A?a=1&b=2"), ("https://x.org", "x.org"), ("x.org/", "x.org"), (None, None), ("http://a?z", "a?z")],
)
def test_canonical_url(spark, url, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(url,)], "u string").select(R.canonical_url(F.col("u"))).first()[0] == want


def test_sql_gives_the_same_rows(spark):
    import duckdb

    c = duckdb.connect()
    c.sql("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    rel = c.sql(R.ORACLE_SQL)
    want = sorted(map(str, rel.fetchall()))
    out = R.op8_revisit_resolution(spark, "/root/testdata/sf0.01").select(*rel.columns)
    assert sorted(str(tuple(r)) for r in out.collect()) == want
    assert {r.outcome for r in out.collect()} == {"etag", "last_modified", "mismatch", "no_response"}
