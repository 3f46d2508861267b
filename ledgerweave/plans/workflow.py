"""Registered queries: submission, approval, posting and notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.fixtures import ctes, frame
from ledgerweave.operators import workflow as W
from ledgerweave.operators.reconcile import Settings, articles
from ledgerweave.plans.reconciliation import JUDGED, reconciled
from ledgerweave.registry import query
from ledgerweave.sources.scratch import shared_folder

EVENTS = "(SELECT event_id, user_id AS submission_id, ts AS event_at, CASE WHEN event_type = 'signup' THEN 'pending' WHEN event_type = 'view' THEN 'held' WHEN event_type = 'purchase' THEN 'posted' ELSE 'pending' END AS state FROM {events})"


def _events(spark, sf_dir):
    return spark.sql("SELECT * FROM " + EVENTS, events=frame(spark, sf_dir, "events"))


@query(
    "w6_current_state",
    f"SELECT submission_id, arg_max(state, event_id) AS state, max(event_at) AS event_at, count(*) AS n_events FROM {EVENTS.format(events='events')} GROUP BY submission_id",
)
def w6(spark, sf_dir):
    return W.current_state(_events(spark, sf_dir))


@query(
    "r8_judged_moves",
    f"""SELECT event_id, submission_id, state, before, (before IS NULL AND state = 'pending') OR coalesce((before = 'pending' AND state IN ('held', 'posted')) OR (before = 'held' AND state IN ('pending', 'held', 'posted')), false) AS legal
FROM (SELECT *, lag(state) OVER (PARTITION BY submission_id ORDER BY event_at, event_id) AS before FROM {EVENTS.format(events='events')})""",
)
def r8(spark, sf_dir):
    return W.judged_moves(_events(spark, sf_dir)).select("event_id", "submission_id", "state", "before", "legal")


@query(
    "f17_approval_check",
    ctes("f_submission") + """ SELECT submission_id, workflow_status IN ('pending', 'held') AND (review_score_pct >= 85 OR submission_id % 6 = 0) AS can_approve,
      CASE WHEN workflow_status NOT IN ('pending', 'held') THEN 'not in an active state: ' || workflow_status
           WHEN review_score_pct < 85 AND submission_id % 6 <> 0 THEN 'score ' || CAST(CAST(review_score_pct AS INT) AS STRING) || '% below minimum 85%' END AS reason FROM f_submission""",
)
def f17(spark, sf_dir):
    ok, reason = W.approval(Settings(), F.col("submission_id") % 6 == 0)
    return frame(spark, sf_dir, "f_submission").select("submission_id", ok.alias("can_approve"), reason.alias("reason"))


BATCH = ctes("f_submission") + """,
posted AS (SELECT DISTINCT lib_facture FROM f_submission WHERE workflow_status = 'posted' AND submission_id % 3 = 0),
active AS (SELECT DISTINCT lib_facture FROM f_submission WHERE workflow_status IN ('pending', 'held') AND submission_id % 3 = 1),
batch AS (SELECT *, row_number() OVER (PARTITION BY lib_facture ORDER BY submission_id) AS rn FROM f_submission WHERE submission_id % 3 = 2),
judged AS (SELECT b.*, CASE WHEN p.lib_facture IS NOT NULL THEN 'already posted' WHEN a.lib_facture IS NOT NULL THEN 'active submission exists' WHEN rn > 1 THEN 'active submission exists' END AS reason
  FROM batch b LEFT JOIN posted p ON p.lib_facture = b.lib_facture LEFT JOIN active a ON a.lib_facture = b.lib_facture)"""


def _batch(spark, sf_dir):
    s = frame(spark, sf_dir, "f_submission")
    return W.submitted(s.where("submission_id % 3 = 2"), s.where("workflow_status = 'posted' and submission_id % 3 = 0"), s.where("submission_id % 3 = 1").withColumnRenamed("workflow_status", "state"))


@query("j4_j5_submission_rejects", BATCH + " SELECT submission_id, lib_facture, reason FROM judged WHERE reason IS NOT NULL")
def j4(spark, sf_dir):
    return _batch(spark, sf_dir)[1].select("submission_id", "lib_facture", "reason")


@query(
    "r5_submission_batch",
    BATCH + """ SELECT submission_id AS notification_id, submitted_by AS username, 'submission' AS type, 'Invoice ' || lib_facture || ' submitted' AS title,
    submitted_by || ' sent ' || lib_facture || ' for review (score ' || CAST(CAST(review_score_pct AS INT) AS STRING) || '.0%)' AS message FROM judged WHERE reason IS NULL""",
)
def r5(spark, sf_dir):
    return W.notifications(_batch(spark, sf_dir)[0])


@query(
    "j4_j5_collated_rejects",
    ctes("f_submission") + """, b AS (SELECT submission_id, lower(lib_facture) AS k, CASE submission_id % 3 WHEN 0 THEN lower(lib_facture) WHEN 1 THEN replace(lib_facture, 'O', 'Ó') ELSE lib_facture END AS lib_facture,
  submission_id % 5 = 0 AS posted, submission_id % 5 = 1 AS active FROM f_submission), p AS (SELECT DISTINCT k FROM b WHERE posted), c AS (SELECT DISTINCT k FROM b WHERE active),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY submission_id) AS rn FROM b WHERE NOT posted AND NOT active)
SELECT submission_id, r.lib_facture, CASE WHEN p.k IS NOT NULL THEN 'already posted' WHEN c.k IS NOT NULL OR rn > 1 THEN 'active submission exists' ELSE 'accepted' END AS decision FROM r LEFT JOIN p ON p.k = r.k LEFT JOIN c ON c.k = r.k""",
)
def j4_collated(spark, sf_dir):
    """Keys in three spellings: OCR-1, ocr-1 and with an accent are one invoice."""
    k = F.col("submission_id")
    s = frame(spark, sf_dir, "f_submission").withColumn("lib_facture", F.when(k % 3 == 0, F.lower("lib_facture")).when(k % 3 == 1, F.replace("lib_facture", F.lit("O"), F.lit("Ó"))).otherwise(F.col("lib_facture")))
    accepted, rejected = W.submitted(s.where(k % 5 > 1), s.where(k % 5 == 0), s.where(k % 5 == 1).withColumn("state", F.lit("held")))
    return accepted.select("submission_id", "lib_facture", F.lit("accepted").alias("decision")).unionByName(rejected.select("submission_id", "lib_facture", F.col("reason").alias("decision")))


SEQUENCE = ctes("f_submission") + """,
posted AS (SELECT DISTINCT lib_facture FROM f_submission WHERE workflow_status = 'posted' AND submission_id % 3 = 0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY lib_facture ORDER BY {order}) AS rn FROM f_submission),
judged AS (SELECT f.*, CASE WHEN p.lib_facture IS NOT NULL THEN 'already posted' WHEN rn > 1 THEN 'active submission exists' END AS reason FROM firsts f LEFT JOIN posted p ON p.lib_facture = f.lib_facture)"""


def _recorded_batches(spark, sf_dir):
    """Three batches one after the other, the second one twice, then moves of some submissions."""
    root = shared_folder(spark, "submissions")
    s = frame(spark, sf_dir, "f_submission")
    posted = s.where("workflow_status = 'posted' and submission_id % 3 = 0")
    for batch in (0, 1, 1, 2):
        W.record_submissions(spark, root, f"b{batch}", s.where(F.col("submission_id") % 3 == batch), posted)
    at = F.lit("2030-01-01").cast("timestamp")
    moves = s.where("submission_id % 5 = 0").select("submission_id", at.alias("event_at"), F.when(F.col("submission_id") % 2 == 0, "held").otherwise("pending").alias("state"))
    later = s.where("submission_id % 10 = 0").select("submission_id", (at + F.expr("interval 1 day")).alias("event_at"), F.lit("posted").alias("state"))
    W.record_moves(spark, root, "m0", moves.unionByName(later))
    return W.recorded(spark, root)


@query(
    "r5_recorded_batches",
    SEQUENCE.format(order="submission_id % 3, submission_id") + """ SELECT submission_id, lib_facture, 'b' || CAST(submission_id % 3 AS STRING) AS batch, CASE WHEN submission_id % 10 = 0 THEN 'posted' ELSE 'pending' END AS state,
    CAST(CASE WHEN submission_id % 10 = 0 THEN 3 ELSE 1 END AS BIGINT) AS n_events, CAST(1 AS BIGINT) AS n_notes FROM judged WHERE reason IS NULL""",
)
def r5_recorded(spark, sf_dir):
    """S9, S11, R8, W6, R12 read back what was recorded: a move to where a submission already is, is not legal."""
    t = _recorded_batches(spark, sf_dir)
    state = W.current_state(t["event"])
    notes = W.unread(t["notification"], t["notification"].where("false")).groupBy(F.col("notification_id").alias("submission_id")).agg(F.count("*").alias("n_notes"))
    out = t["submission"].select("submission_id", "lib_facture", "batch").join(state.hint("merge"), "submission_id").join(notes.hint("merge"), "submission_id")
    return out.select("submission_id", "lib_facture", "batch", "state", "n_events", "n_notes")


@query("j4_j5_recorded_rejects", SEQUENCE.format(order="submission_id % 3, submission_id") + " SELECT submission_id, lib_facture, reason FROM judged WHERE reason IS NOT NULL")
def j4_recorded(spark, sf_dir):
    return _recorded_batches(spark, sf_dir)["reject"].select("submission_id", "lib_facture", "reason")


POSTED = JUDGED + """,
done AS (SELECT invoice_id FROM f_invoice WHERE invoice_id % 10 = 0),
own AS (SELECT * FROM rec WHERE invoice_id NOT IN (SELECT invoice_id FROM done)),
sums AS (SELECT invoice_id, sum(qty * CAST(CAST(coalesce(display_price, 0) AS DECIMAL(12,3)) AS DOUBLE)) AS lt, count(*) FILTER (status = 'PRICE_MISMATCH') AS n_mismatch, avg(score) AS ms FROM own GROUP BY invoice_id),
fac AS (SELECT i.LibFacture AS lib_facture, coalesce(n_mismatch, 0) AS nm, ms, CAST(round(CASE WHEN i.invoice_id % 2 = 0 THEN CAST(TotalHT AS DOUBLE) ELSE coalesce(lt, 0) END, 3) AS DECIMAL(12,3)) AS ht
  FROM f_invoice i LEFT JOIN sums s ON s.invoice_id = i.invoice_id WHERE i.invoice_id NOT IN (SELECT invoice_id FROM done))"""


def _posting(spark, sf_dir):
    inv = frame(spark, sf_dir, "f_invoice")
    heads = inv.select("invoice_id", F.col("LibFacture").alias("lib_facture"), F.when(F.col("invoice_id") % 2 == 0, F.col("TotalHT").cast("double")).otherwise(0.0).alias("stated_total"))
    return W.posted_tables(heads, reconciled(spark, sf_dir), articles(frame(spark, sf_dir, "f_article")), heads.where("invoice_id % 10 = 0"))


@query(
    "r6_posted_invoices",
    POSTED + " SELECT lib_facture, CAST(ht AS DOUBLE) AS total_ht, CAST(CAST(ht * 0.19 AS DECIMAL(12,3)) AS DOUBLE) AS total_tva, CAST(CAST(ht * 1.19 AS DECIMAL(12,3)) AS DOUBLE) AS total_ttc, nm AS n_mismatch FROM fac",
)
def r6(spark, sf_dir):
    f = _posting(spark, sf_dir)["facture"]
    return f.select(
        "lib_facture", F.col("TotalHT").cast("double").alias("total_ht"), F.col("TotalTVA").cast("double").alias("total_tva"), F.col("TotalTTC").cast("double").alias("total_ttc"),
        F.coalesce("n_mismatch", F.lit(0)).alias("n_mismatch"),
    )


@query(
    "s8_posted_lines",
    POSTED + """ SELECT i.LibFacture AS lib_facture, o.line_no AS ordre, coalesce(o.IDArticle, 0) AS id_article, o.code, o.qty AS quantite, CAST(CAST(coalesce(o.display_price, 0) AS DECIMAL(12,3)) AS DOUBLE) AS prix
  FROM own o JOIN f_invoice i ON i.invoice_id = o.invoice_id""",
)
def s8(spark, sf_dir):
    t = _posting(spark, sf_dir)
    out = t["lignefac"].join(t["facture"].select("IDFacture", "lib_facture"), "IDFacture")
    return out.select("lib_facture", F.col("Ordre").alias("ordre"), F.col("IDArticle").alias("id_article"), F.col("Code").alias("code"), F.col("Quantite").cast("double").alias("quantite"), F.col("PrixVente").cast("double").alias("prix"))


@query(
    "r7_approval_batch",
    ctes("f_submission") + """ SELECT CASE WHEN workflow_status NOT IN ('pending', 'held') THEN 'refused' WHEN review_score_pct >= 85 THEN 'posted' WHEN submission_id % 6 = 0 THEN 'forced' ELSE 'refused' END AS decision,
  validation_status, count(*) AS n, CAST(sum(total_ht) AS DOUBLE) AS total_ht FROM f_submission GROUP BY ALL""",
)
def r7(spark, sf_dir):
    s = frame(spark, sf_dir, "f_submission")
    ok, _ = W.approval(Settings(), F.col("submission_id") % 6 == 0)
    plain, _ = W.approval(Settings(allow_override=False), F.lit(False))
    decision = F.when(plain, "posted").when(ok, "forced").otherwise("refused")
    return s.groupBy(decision.alias("decision"), "validation_status").agg(F.count("*").alias("n"), F.sum("total_ht").cast("double").alias("total_ht"))


@query(
    "r7_posted_states",
    JUDGED + ",\n" + ctes("f_submission").removeprefix("WITH ") + """,
sub AS (SELECT *, workflow_status IN ('pending', 'held') AND (review_score_pct >= 85 OR submission_id % 6 = 0) AS ok FROM f_submission),
win AS (SELECT submission_id, row_number() OVER (PARTITION BY lib_facture ORDER BY submission_id) AS rn FROM sub WHERE ok AND lib_facture NOT IN (SELECT lib_facture FROM sub WHERE workflow_status = 'posted')),
lt AS (SELECT invoice_id, sum(qty * CAST(CAST(coalesce(display_price, 0) AS DECIMAL(12,3)) AS DOUBLE)) AS lt FROM rec GROUP BY invoice_id)
SELECT s.submission_id, CASE WHEN rn = 1 THEN 'posted' ELSE workflow_status END AS state,
  CASE WHEN rn = 1 THEN CAST(CAST(round(CASE WHEN s.submission_id % 2 = 0 THEN CAST(total_ht AS DOUBLE) ELSE coalesce(lt, 0) END, 3) AS DECIMAL(12,3)) AS DOUBLE) END AS posted_ht
FROM sub s LEFT JOIN win w ON w.submission_id = s.submission_id LEFT JOIN lt ON lt.invoice_id = s.submission_id""",
)
def r7_states(spark, sf_dir):
    """State of every submission after the approval of all that may be approved."""
    s = frame(spark, sf_dir, "f_submission").withColumn("invoice_id", F.col("submission_id"))
    s = s.withColumn("stated_total", F.when(F.col("submission_id") % 2 == 0, F.col("total_ht").cast("double")).otherwise(0.0))
    ok, _ = W.approval(Settings(), F.col("submission_id") % 6 == 0)
    _, events = W.approved_batch(s, ok, reconciled(spark, sf_dir), articles(frame(spark, sf_dir, "f_article")), s.where("workflow_status = 'posted'"))
    after = s.select("submission_id", "workflow_status").join(events.select("submission_id", "state", "TotalHT"), "submission_id", "left")
    return after.select("submission_id", F.coalesce("state", "workflow_status").alias("state"), F.col("TotalHT").cast("double").alias("posted_ht"))


@query(
    "r12_unread_notifications",
    "SELECT user_id AS username, count(*) AS n_unread, max(event_id) AS newest FROM events WHERE event_id NOT IN (SELECT event_id + 2 FROM events WHERE event_type = 'view') GROUP BY user_id",
)
def r12(spark, sf_dir):
    e = frame(spark, sf_dir, "events")
    notes = e.select(F.col("event_id").alias("notification_id"), F.col("user_id").alias("username"))
    receipts = e.where("event_type = 'view'").select((F.col("event_id") + 2).alias("notification_id"))
    return W.unread(notes, receipts).groupBy("username").agg(F.count("*").alias("n_unread"), F.max("notification_id").alias("newest"))
