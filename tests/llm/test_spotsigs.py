import hashlib
import re

from ledgerweave.llm import spotsigs as S

ANCHORS = set(S.ANCHORS)


def brute_spots(text):
    """Readable signatures of a text."""
    w = [x for x in re.split(r"[^\w]+|_+", text.lower()) if x]
    c = [i for i, x in enumerate(w) if x not in ANCHORS]
    spots = {(w[p - 1], w[p], w[c[j + 1]]) for j, p in enumerate(c[:-1]) if p and w[p - 1] in ANCHORS}
    return spots or {(w[p], w[c[j + 1]]) for j, p in enumerate(c[:-1])} or {text}


def like(a, b):
    return len(a & b) / len(a | b)


def brute(rows):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    out = []
    pairs = [(a, order[(i + 1) % len(order)]) for i, a in enumerate(order)] + [(r, r) for r in rows if r[0] is None]
    for a, b in pairs:
        t, nxt = a[1] or "", b[1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        s = brute_spots(t)
        out.append((a[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(s, brute_spots(edited)), 12), round(like(s, brute_spots(nxt)), 12), len(s)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12), r.n_signatures) for r in frame.collect()), key=str)


def test_small_rows_match_brute_force(spark):
    rows = [(1, "The cat of a big house and the dog in it."), (2, None), (3, ""), (4, "..."), (5, "words only here"), (7, "Größe für den Hund, é ist das große Haus 7."), (7, "a b"), (7, "a b"), (40, "the the the"),
            (41, "x" * 9), (42, "to be or not to be, that is the question of the day"), (None, "the lone row of it all"), (43, "  of sea and sky\n\nof sea and sky "), (44, "\U0001f600 the \U0001f600 cat sat down" * 3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sigs int")
    assert got(S.fingerprints(df)) == brute(rows)
    assert S.fingerprints(df.limit(0)).count() == 0
    one = S.fingerprints(df.where("doc_id = 42")).first()
    assert one.near_next == 1.0
    prints = S.fingerprints(df).where("doc_id = 7").collect()
    assert len(prints) == 3 and len({r.fingerprint for r in prints}) == 2
    assert all(len(r.fingerprint) == 8 * r.n_signatures for r in prints)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(S.op7_spotsigs(spark, "/root/testdata/sf0.001")) == want


def test_pruned_jaccard_only_drops_what_is_below_the_floor(spark):
    df = spark.range(1, 60).selectExpr("sequence(1, id) a").crossJoin(spark.range(1, 60).selectExpr("sequence(1, id) b"))
    from pyspark.sql import functions as F

    rows = df.select(S.jaccard(F.col("a"), F.col("b")).alias("full"), S.jaccard(F.col("a"), F.col("b"), 0.8).alias("cut")).collect()
    assert all(r.cut == r.full if r.full >= 0.8 else r.cut in (0.0, r.full) for r in rows)


def test_no_python_in_the_plan(spark):
    df = S.op7_spotsigs(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
