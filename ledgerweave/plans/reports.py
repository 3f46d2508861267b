"""Registered queries: KPIs, volume, listings, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.fixtures import ctes, frame
from ledgerweave.operators import reports as P
from ledgerweave.operators import rollup
from ledgerweave.plans.reconciliation import JUDGED, reconciled
from ledgerweave.registry import query


@query(
    "a3_kpi_metrics",
    ctes("f_run") + """ SELECT count(*) FILTER (status = 'SUCCESS' AND page_count > 0) AS n_runs, round(avg(CASE WHEN status = 'SUCCESS' AND page_count > 0 THEN CAST(duration_ms AS DOUBLE) / nullif(page_count, 0) END) / 1000, 1) AS seconds_a_page,
    round(CAST(sum(valid_count) AS DOUBLE) / sum(line_count) * 100, 1) AS valid_pct,
    (SELECT count(*) FROM orders) AS n_invoices, (SELECT count(*) FROM lineitem WHERE l_partkey % 7 = 0) AS open_alerts FROM f_run""",
)
def a3(spark, sf_dir):
    return P.kpis(frame(spark, sf_dir, "f_run"), frame(spark, sf_dir, "orders"), frame(spark, sf_dir, "lineitem").where("l_partkey % 7 = 0"))


@query("a4_daily_volume", ctes("f_run") + " SELECT CAST(run_at AS DATE) AS day, count(*) AS n_runs FROM f_run WHERE CAST(run_at AS DATE) >= DATE '2024-01-06' GROUP BY 1")
def a4(spark, sf_dir):
    return P.volume(frame(spark, sf_dir, "f_run"), "2024-01-20")


@query(
    "a5_validation_breakdown",
    ctes("f_run") + " SELECT CAST(sum(valid_count) AS BIGINT) AS valid, CAST(sum(low_conf_count) AS BIGINT) AS low_conf, CAST(sum(price_mismatch_count) AS BIGINT) AS price_mismatch, CAST(sum(unknown_count) AS BIGINT) AS unknown FROM f_run",
)
def a5(spark, sf_dir):
    return P.breakdown(frame(spark, sf_dir, "f_run"))


def payloads(spark, sf_dir):
    """Metadata rows: the reconciled lines of each invoice as JSON."""
    lines = reconciled(spark, sf_dir).groupBy("invoice_id").agg(F.to_json(F.struct(F.collect_list(F.struct("validation_status")).alias("product_lines"))).alias("j"))
    broken = F.when(F.col("invoice_id") % 50 == 3, F.substring("j", 1, 9)).otherwise(F.col("j"))
    return lines.select("invoice_id", F.col("invoice_id").alias("IDMeta"), (F.col("invoice_id") % 1000).alias("created_at"), broken.alias("raw_json"))


COUNTS = "count(*) FILTER (status = 'VALID') AS n_valid, count(*) FILTER (status = 'LOW_CONFIDENCE') AS n_low_confidence, count(*) FILTER (status = 'PRICE_MISMATCH') AS n_price_mismatch, count(*) FILTER (status = 'UNKNOWN_PRODUCT') AS n_unknown_product"


@query(
    "a6_payload_breakdown",
    JUDGED + f""",
last AS (SELECT invoice_id FROM (SELECT DISTINCT invoice_id FROM rec) ORDER BY invoice_id % 1000 DESC, invoice_id DESC LIMIT 50)
SELECT count(*) AS n_lines, {COUNTS}, CAST(0 AS BIGINT) AS n_unchecked FROM rec WHERE invoice_id IN (SELECT invoice_id FROM last) AND invoice_id % 50 <> 3""",
)
def a6(spark, sf_dir):
    return P.breakdown_of_payloads(payloads(spark, sf_dir))


@query(
    "r10_history",
    JUDGED + f""",
c AS (SELECT invoice_id, {COUNTS} FROM rec WHERE invoice_id % 50 <> 3 GROUP BY invoice_id),
a AS (SELECT l_orderkey AS invoice_id, count(*) AS open_alerts FROM lineitem WHERE l_partkey % 7 = 0 AND l_suppkey % 2 = 0 GROUP BY 1)
SELECT i.invoice_id, LibFacture AS lib_facture, owner, coalesce(open_alerts, 0) AS open_alerts, coalesce(n_valid, 0) AS n_valid, coalesce(n_low_confidence, 0) AS n_low_confidence,
  coalesce(n_price_mismatch, 0) AS n_price_mismatch, coalesce(n_unknown_product, 0) AS n_unknown_product,
  CASE WHEN coalesce(open_alerts, 0) + coalesce(n_price_mismatch, 0) > 0 THEN 'DISCREPANCY' WHEN coalesce(n_low_confidence, 0) + coalesce(n_unknown_product, 0) > 0 THEN 'NEEDS_REVIEW' ELSE 'VALIDATED' END AS invoice_status
FROM f_invoice i LEFT JOIN c ON c.invoice_id = i.invoice_id LEFT JOIN a ON a.invoice_id = i.invoice_id WHERE owner IN ('user1', 'user4')""",
)
def r10(spark, sf_dir):
    alerts = frame(spark, sf_dir, "lineitem").where("l_partkey % 7 = 0").select(F.col("l_orderkey").alias("invoice_id"), (F.col("l_suppkey") % 2 == 1).alias("is_resolved"))
    out = P.history(frame(spark, sf_dir, "f_invoice"), payloads(spark, sf_dir), alerts, ["USER1", "usér4"])
    return out.select("invoice_id", F.col("LibFacture").alias("lib_facture"), "owner", "open_alerts", "n_valid", "n_low_confidence", "n_price_mismatch", "n_unknown_product", "invoice_status")


@query("l1_history_page", ctes("f_invoice") + " SELECT invoice_id, LibFacture AS lib_facture, DateFacture AS d FROM f_invoice WHERE owner = 'user2' ORDER BY CAST(DateFacture AS STRING) DESC, invoice_id DESC LIMIT 20 OFFSET 10")
def l1(spark, sf_dir):
    own = frame(spark, sf_dir, "f_invoice").where("owner = 'user2'")
    return P.page(own, [F.col("DateFacture").cast("string").desc(), F.col("invoice_id").desc()], 20, 10).select("invoice_id", F.col("LibFacture").alias("lib_facture"), F.col("DateFacture").alias("d"))


@query(
    "f18_submission_search",
    ctes("f_submission") + " SELECT submission_id, lib_facture, client, workflow_status FROM f_submission WHERE workflow_status = 'pending' AND submitted_by = 'user3' AND (lib_facture ILIKE '%r-1_3%' OR client ILIKE '%r-1_3%' OR validation_status ILIKE '%r-1_3%')",
)
def f18(spark, sf_dir):
    s = frame(spark, sf_dir, "f_submission").where("workflow_status = 'pending' and submitted_by = 'user3'")
    return P.searched(s, "r-1_3", ["lib_facture", "client", "validation_status"]).select("submission_id", "lib_facture", "client", "workflow_status")


@query(
    "l2_submission_pages",
    ctes("f_submission") + """ SELECT submitted_by, submission_id, total, rn FROM (SELECT submitted_by, submission_id, count(*) OVER (PARTITION BY submitted_by) AS total,
    row_number() OVER (PARTITION BY submitted_by ORDER BY submitted_at DESC, submission_id DESC) AS rn FROM f_submission) WHERE rn <= 25""",
)
def l2(spark, sf_dir):
    out = P.paged_with_total(frame(spark, sf_dir, "f_submission"), ["submitted_by"], [F.desc("submitted_at"), F.desc("submission_id")], 25)
    return out.select("submitted_by", "submission_id", "total", F.col("rn").cast("long").alias("rn"))


@query("l3_notification_page", "SELECT event_id, user_id, ts FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 30")
def l3(spark, sf_dir):
    e = frame(spark, sf_dir, "events").where("user_id = 7").select("event_id", "user_id", "ts")
    return P.page(e, [F.desc("ts"), F.desc("event_id")], 30)


def _raw_logs(spark, sf_dir):
    log = frame(spark, sf_dir, "f_log")
    entry = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "level", "message", F.from_json("context", "map<string,string>").alias("context")))
    bad = F.when(F.col("log_id") % 40 == 1, "").when(F.col("log_id") % 40 == 2, "{broken").otherwise(entry)
    return log.select("log_id", bad.alias("value"))


@query(
    "r13_log_audit",
    ctes("f_log") + " SELECT log_id, level, message FROM f_log WHERE log_id % 40 NOT IN (1, 2) AND level = 'WARN' AND context LIKE '%5%' ORDER BY log_id DESC LIMIT 50",
)
def r13(spark, sf_dir):
    """The search text is looked for in the context, as timestamps hold every digit."""
    rows = P.audited(P.log_rows(_raw_logs(spark, sf_dir)), "warn", "signup")
    hit = F.exists(F.map_values("context"), lambda v: F.contains(v, F.lit("5")))
    return P.page(rows.where(hit), [F.desc("log_id")], 50).select("log_id", "level", "message")


@query("s5_log_levels", ctes("f_log") + " SELECT level, count(*) AS n FROM f_log WHERE log_id % 40 NOT IN (1, 2) GROUP BY level")
def s5(spark, sf_dir):
    return P.log_rows(_raw_logs(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"))


@query(
    "f22_history_panel",
    ctes("f_submission") + " SELECT workflow_status, validation_status, count(*) AS n FROM f_submission WHERE workflow_status = 'held' OR validation_status = 'DISCREPANCY' GROUP BY ALL HAVING count(*) > 0",
)
def f22(spark, sf_dir):
    s = frame(spark, sf_dir, "f_submission").where("workflow_status = 'held' or validation_status = 'DISCREPANCY'")
    return s.groupBy("workflow_status", "validation_status").agg(F.count("*").alias("n"))


@query(
    "s10_run_records",
    JUDGED + f" SELECT invoice_id, count(*) AS n_lines, {COUNTS}, CAST(0 AS BIGINT) AS n_unchecked FROM rec GROUP BY invoice_id",
)
def s10(spark, sf_dir):
    return rollup.status_counts(reconciled(spark, sf_dir))


def _metrics_sql(valid: str) -> str:
    counts = (("valid", "n_valid"), ("low_conf", "n_low_confidence"), ("price_mismatch", "n_price_mismatch"), ("unknown", "n_unknown_product"))
    status = " ".join(f"UNION ALL SELECT 'status', '{c}', CAST(CASE WHEN (SELECT sum({valid}) FROM f_run) = 0 THEN {p} ELSE (SELECT sum({c}_count * ({valid} > 0)::INT) FROM f_run) END AS DOUBLE) FROM pay" for c, p in counts)
    return JUDGED + ",\n" + ctes("f_run").removeprefix("WITH ") + f""",
last AS (SELECT invoice_id FROM (SELECT DISTINCT invoice_id FROM rec) ORDER BY invoice_id % 1000 DESC, invoice_id DESC LIMIT 50),
pay AS (SELECT {COUNTS} FROM rec WHERE invoice_id IN (SELECT invoice_id FROM last) AND invoice_id % 50 <> 3)
SELECT 'kpi' AS section, 'n_runs' AS name, CAST(count(*) FILTER (status = 'SUCCESS' AND page_count > 0) AS DOUBLE) AS value FROM f_run
UNION ALL SELECT 'kpi', 'seconds_a_page', round(avg(CASE WHEN status = 'SUCCESS' AND page_count > 0 THEN CAST(duration_ms AS DOUBLE) / nullif(page_count, 0) END) / 1000, 1) FROM f_run
UNION ALL SELECT 'kpi', 'valid_pct', CASE WHEN sum({valid}) = 0 THEN 0 ELSE round(CAST(sum(valid_count) AS DOUBLE) / sum(line_count) * 100, 1) END FROM f_run
UNION ALL SELECT 'kpi', 'n_invoices', CAST(count(*) AS DOUBLE) FROM orders
UNION ALL SELECT 'kpi', 'open_alerts', CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_partkey % 7 = 0 {status}
UNION ALL SELECT 'day', strftime(CAST(run_at AS DATE), '%Y-%m-%d'), CAST(count(*) AS DOUBLE) FROM f_run WHERE CAST(run_at AS DATE) >= DATE '2024-01-06' GROUP BY 2"""


def _metrics(spark, sf_dir, runs):
    kpi = P.kpis(runs, frame(spark, sf_dir, "orders"), frame(spark, sf_dir, "lineitem").where("l_partkey % 7 = 0"))
    return P.metrics(kpi, P.volume(runs, "2024-01-20"), P.breakdown(runs), P.breakdown_of_payloads(payloads(spark, sf_dir)))


@query("r14_metrics", _metrics_sql("(valid_count + low_conf_count + price_mismatch_count + unknown_count + 1)"))
def r14(spark, sf_dir):
    return _metrics(spark, sf_dir, frame(spark, sf_dir, "f_run"))


@query("r14_metrics_of_payloads", _metrics_sql("(valid_count * 0)"))
def r14_payloads(spark, sf_dir):
    """Runs that counted nothing: the status counts come from the newest payloads."""
    zero = {c: F.lit(0).cast("long") for c in ("valid_count", "low_conf_count", "price_mismatch_count", "unknown_count")}
    return _metrics(spark, sf_dir, frame(spark, sf_dir, "f_run").withColumns(zero))
