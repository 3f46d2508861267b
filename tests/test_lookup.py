"""Article lookups past the broadcast limit: the same answers, every line moved once."""

import itertools

from pyspark.sql import functions as F

from ledgerweave.functions import codes
from ledgerweave.operators import reconcile as R


def _lines(spark):
    some = ["", " ", "300001", "300002", "399999", "pf00000001", "PF00000009", "X1"]
    rows = [(i, *c) for i, c in enumerate(itertools.product(some, repeat=3))]
    return spark.createDataFrame(rows, "id int, code string, pct string, art string").withColumn("codes", codes.resolved(F.col("code"), F.col("pct"), F.col("art")))


def _dim(spark):
    raw = [(1, "300001"), (2, "300002"), (3, "PF00000001"), (4, "x1"), (5, "300001 ")]
    return R.articles(spark.createDataFrame([(i, c, "N", 1.0) for i, c in raw], "IDArticle long, Code string, LibProd string, PrixAchat double"))


def test_large_lookup_gives_the_rows_of_the_broadcast_one(spark):
    found = lambda most: {r.id: r[1:] for r in R.looked_up(_lines(spark), _dim(spark), most).select("id", "ref.IDArticle", "mp_found", "article_found", "codes").collect()}
    small, large = found(100), found(0)
    assert len(large) == 512
    assert large == small


def test_lines_move_once(spark):
    """One exchange holds whole lines, however many kinds of codes there are."""
    lines = _lines(spark).withColumn("payload", F.concat(F.lit("p"), F.rand(7)))
    plan = R.looked_up(lines, _dim(spark), 0)._jdf.queryExecution().optimizedPlan().toString()
    joined = [x for x in plan.splitlines() if "Join LeftOuter" in x]
    holders = [i for i, x in enumerate(plan.splitlines()) if "Join LeftOuter" in x and "payload" in "".join(plan.splitlines()[i:i + 3])]
    assert len(joined) == 4 and len(holders) == 1


def test_money_texts_are_written_once(spark):
    """The grouped text of m1 is one column, not written out again inside every rule that reads it."""
    from ledgerweave import registry

    plan = registry.queries()["m1_money_texts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=\\d)(?=(\\d{3})+,)") == 1
