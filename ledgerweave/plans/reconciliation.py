"""Registered queries: reference tables, reconciliation of lines and documents, supplier matching, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.fixtures import ctes, frame
from ledgerweave.functions import codes, numbers, text
from ledgerweave.operators import reconcile as R
from ledgerweave.operators import rollup
from ledgerweave.registry import query


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their invoice's document type, in the shape that reconciliation reads."""
    return shaped(frame(spark, sf_dir, "f_typed_line"))


def shaped(lines: DataFrame) -> DataFrame:
    none = F.lit(None)
    return lines.withColumns(
        {"code_pct": F.lit(""), "code_article": F.lit(""), "price_unit": none.cast("double"), "confidence": none.cast("double"), "field_confidence": none.cast("map<string,double>"), "invoice_family": F.lit("")}
    )


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reconcile(raw_lines(spark, sf_dir), R.articles(frame(spark, sf_dir, "f_article")))


JUDGED = (
    ctes("f_line", "f_invoice", "f_article")
    + """,
judged AS (
  SELECT l.invoice_id, l.line_no, l.code, l.designation, l.quantite, l.prix_unitaire, l.line_confidence, i.doc_type,
         i.doc_type = 'Bon de Commande' AS bc, a.IDArticle IS NOT NULL AS known, CAST(a.PrixAchat AS DOUBLE) AS erp, a.LibProd, a.IDArticle,
         CASE WHEN l.quantite = '' THEN 0.0 ELSE CAST(CASE WHEN l.quantite = '' THEN '0' ELSE l.quantite END AS DOUBLE) END AS qty
  FROM f_line l JOIN f_invoice i ON i.invoice_id = l.invoice_id LEFT JOIN f_article a ON a.Code = l.code),
rec AS (
  SELECT *, CASE WHEN prix_unitaire IS NULL AND known THEN erp ELSE prix_unitaire END AS display_price,
         CASE WHEN NOT known THEN 'UNKNOWN_PRODUCT'
              WHEN prix_unitaire IS NOT NULL AND abs(prix_unitaire - erp) > 0.001 THEN 'PRICE_MISMATCH'
              WHEN designation = '' OR qty <= 0 THEN 'LOW_CONFIDENCE' ELSE 'VALID' END AS status,
         CASE WHEN designation = '' THEN 0.0 WHEN qty <= 0 THEN CASE WHEN bc THEN 0.68 ELSE 0.55 END
              WHEN known THEN 0.95 ELSE line_confidence END AS score
  FROM judged)"""
)

RECONCILED = JUDGED + """
SELECT invoice_id, line_no, code, status AS validation_status, round(score, 3) AS score, erp AS erp_price, prix_unitaire AS ocr_price,
       display_price, prix_unitaire IS NULL AND known AS price_from_db, qty, CASE WHEN qty > 0 AND display_price IS NOT NULL THEN round(qty * display_price, 3) END AS computed_montant,
       CASE WHEN known THEN 'mp_found,article_found' ELSE 'mp_missing' END || CASE WHEN qty > 0 THEN ',qty_present' ELSE ',qty_missing' END
         || CASE WHEN designation = '' THEN ',designation_empty' ELSE ',designation_present' END AS flags
FROM rec"""


@query("r2_reconcile_lines", RECONCILED)
def r2(spark, sf_dir):
    out = reconciled(spark, sf_dir)
    return out.select(
        "invoice_id", "line_no", "code", "validation_status", "score", "erp_price", "ocr_price", "display_price", "price_from_db", "qty", "computed_montant", F.array_join("flags", ",").alias("flags")
    )


@query(
    "a2_invoice_status",
    JUDGED + """
SELECT invoice_id, count(*) AS n_lines, count(*) FILTER (status = 'VALID') AS n_valid, count(*) FILTER (status = 'LOW_CONFIDENCE') AS n_low_confidence,
       count(*) FILTER (status = 'PRICE_MISMATCH') AS n_price_mismatch, count(*) FILTER (status = 'UNKNOWN_PRODUCT') AS n_unknown_product, CAST(0 AS BIGINT) AS n_unchecked,
       CASE WHEN count(*) FILTER (status = 'PRICE_MISMATCH') > 0 THEN 'DISCREPANCY'
            WHEN count(*) FILTER (status IN ('LOW_CONFIDENCE', 'UNKNOWN_PRODUCT')) > 0 THEN 'NEEDS_REVIEW' ELSE 'VALIDATED' END AS invoice_status
FROM rec GROUP BY invoice_id""",
)
def a2(spark, sf_dir):
    return rollup.with_status(rollup.status_counts(reconciled(spark, sf_dir)))


@query(
    "s1_article_dimension",
    """SELECT key, max(IDArticle) AS IDArticle, arg_max(LibProd, IDArticle) AS LibProd, arg_max(price, IDArticle) AS price
FROM (SELECT 'Z' || CAST(p_partkey % 500 AS STRING) AS key, p_partkey AS IDArticle, p_name AS LibProd, p_retailprice AS price FROM part WHERE p_partkey % 500 <> 7)
GROUP BY key""",
)
def s1(spark, sf_dir):
    part = frame(spark, sf_dir, "part")
    code = F.when(F.col("p_partkey") % 500 == 7, " ").otherwise(F.concat(F.lit(" z"), (F.col("p_partkey") % 500).cast("string")))
    raw = part.select(F.col("p_partkey").alias("IDArticle"), code.alias("Code"), F.col("p_name").alias("LibProd"), F.col("p_retailprice").alias("PrixAchat"))
    return R.articles(raw).select("key", "a.IDArticle", "a.LibProd", "a.price")


@query(
    "s2_supplier_dimension",
    ctes("f_supplier") + " SELECT IDFournisseur, upper(Nom) AS nom, MF FROM f_supplier",
)
def s2(spark, sf_dir):
    return frame(spark, sf_dir, "f_supplier").select("IDFournisseur", F.upper("Nom").alias("nom"), "MF")


@query(
    "j1_article_lookup",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  CASE WHEN l_partkey % 3 = 0 THEN CAST(300000 + l_partkey AS STRING) ELSE '' END AS mp,
  CASE WHEN l_partkey % 4 = 0 THEN 'PF' || lpad(CAST(l_suppkey AS STRING), 9, '0') ELSE '' END AS art,
  CASE WHEN l_partkey % 2 = 0 THEN CAST(300000 + l_suppkey AS STRING) ELSE '' END AS code FROM lineitem),
d AS (SELECT CAST(300000 + p_partkey AS STRING) AS k, p_partkey AS id FROM part UNION ALL SELECT 'PF' || lpad(CAST(s_suppkey AS STRING), 9, '0'), s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 2 = 0)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, coalesce(a.id, p.id, m.id) AS found_id, coalesce(a.id, p.id) IS NOT NULL AS article_found,
       coalesce(m.id, p2.id) IS NOT NULL AS mp_found
FROM l LEFT JOIN d a ON a.k = l.art LEFT JOIN d p ON p.k = coalesce(nullif(l.code, ''), nullif(l.art, ''), nullif(l.mp, ''))
LEFT JOIN d m ON m.k = CASE WHEN l.mp <> '' THEN l.mp ELSE l.code END
LEFT JOIN d p2 ON p2.k = coalesce(nullif(l.code, ''), nullif(l.art, ''), nullif(l.mp, '')) AND left(p2.k, 2) <> 'PF'""",
)
def j1(spark, sf_dir):
    line, s = frame(spark, sf_dir, "lineitem"), lambda c: F.col(c).cast("string")
    pf = lambda c: F.concat(F.lit("pf"), F.lpad(s(c), 9, "0"))
    rows = line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(F.col("l_partkey") % 3 == 0, (F.col("l_partkey") + 300000).cast("string")).otherwise("").alias("pct"),
        F.when(F.col("l_partkey") % 4 == 0, pf("l_suppkey")).otherwise("").alias("art"), F.when(F.col("l_partkey") % 2 == 0, (F.col("l_suppkey") + 300000).cast("string")).otherwise("").alias("code"),
    )
    part = frame(spark, sf_dir, "part").select(F.col("p_partkey").alias("IDArticle"), (F.col("p_partkey") + 300000).cast("string").alias("Code"), F.lit("").alias("LibProd"), F.lit(0.0).alias("PrixAchat"))
    sup = frame(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 1_000_000).alias("IDArticle"), pf("s_suppkey").alias("Code"), F.lit("").alias("LibProd"), F.lit(0.0).alias("PrixAchat"))
    out = R.looked_up(rows.withColumn("codes", codes.resolved(F.col("code"), F.col("pct"), F.col("art"))), R.articles(part.unionAll(sup)))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("ref.IDArticle").alias("found_id"), "article_found", "mp_found")


SUPPLIED = """,
inv AS (SELECT o_orderkey AS invoice_id,
  CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'Ste ' || lower(s_name) || ' & Co' WHEN o_orderkey % 5 = 2 THEN s_name ELSE 'nobody at all' END AS supplier_name,
  CASE WHEN o_orderkey % 5 = 3 THEN lower(lpad(CAST(s_suppkey AS STRING), 7, '0') || 'A/P/M/000') ELSE '' END AS supplier_mf, s_suppkey
  FROM {orders} JOIN {supplier} ON s_suppkey = o_custkey % 97)"""


@query(
    "j2_match_suppliers",
    ctes("f_supplier") + SUPPLIED.replace("{orders}", "orders").replace("{supplier}", "supplier") + """,
b AS (SELECT invoice_id, CASE WHEN invoice_id % 5 IN (1, 2) THEN 0 WHEN invoice_id % 5 = 3 THEN s_suppkey END AS sid FROM inv)
SELECT b.invoice_id, sid AS IDFournisseur, Nom AS erp_supplier_name, CASE WHEN sid IS NULL THEN 'SUPPLIER_UNKNOWN' ELSE 'SUPPLIER_MATCH' END AS supplier_status
FROM b LEFT JOIN f_supplier ON IDFournisseur = sid""",
)
def j2(spark, sf_dir):
    """Every supplier's name begins with the word "Supplier", so a read name that holds it takes the first supplier."""
    inv = spark.sql("SELECT * FROM (" + SUPPLIED.strip(", \n").removeprefix("inv AS ").strip()[1:-1] + ")", orders=frame(spark, sf_dir, "orders"), supplier=frame(spark, sf_dir, "supplier"))
    return R.matched_suppliers(inv, frame(spark, sf_dir, "f_supplier")).select("invoice_id", "IDFournisseur", "erp_supplier_name", "supplier_status")


@query(
    "a9_invoice_summary",
    JUDGED + """,
sums AS (SELECT invoice_id, count(*) AS n_lines, round(avg(score) * 100, 1) AS review_score_pct, round(sum(qty * coalesce(display_price, 0)), 3) AS lines_total,
  count(*) FILTER (status = 'PRICE_MISMATCH') AS n_price_mismatch FROM rec GROUP BY invoice_id)
SELECT i.invoice_id, LibFacture AS lib_facture, DateFacture AS invoice_date, n_lines, review_score_pct, n_price_mismatch,
       round(CASE WHEN i.invoice_id % 2 = 0 THEN CAST(TotalHT AS DOUBLE) ELSE lines_total END, 2) AS total_ht
FROM sums s JOIN f_invoice i ON i.invoice_id = s.invoice_id""",
)
def a9(spark, sf_dir):
    heads = frame(spark, sf_dir, "f_invoice").select(
        "invoice_id", F.col("LibFacture").alias("numero"), F.date_format("DateFacture", "dd/MM/yyyy").alias("date"), F.when(F.col("invoice_id") % 2 == 0, F.col("TotalHT").cast("double")).otherwise(0.0).alias("stated_total")
    )
    out = rollup.summaries(reconciled(spark, sf_dir), heads)
    return out.select("invoice_id", "lib_facture", "invoice_date", "n_lines", "review_score_pct", "n_price_mismatch", F.round("total_ht", 2).alias("total_ht"))


@query(
    "a11_price_alerts",
    JUDGED + """,
s AS (SELECT invoice_id, sum(CASE WHEN status = 'PRICE_MISMATCH' THEN abs(prix_unitaire - erp) * qty ELSE 0 END) AS gap, sum(qty * coalesce(display_price, 0)) AS total,
  count(*) FILTER (status = 'PRICE_MISMATCH') AS n FROM rec GROUP BY invoice_id)
SELECT invoice_id, n AS n_mismatch, round(gap, 3) AS impact, round(gap / total * 100, 4) AS impact_pct FROM s WHERE n > 0 AND total > 0 AND gap / total * 100 >= 0.05""",
)
def a11(spark, sf_dir):
    out = rollup.price_alerts(reconciled(spark, sf_dir), R.Settings(alert_threshold_pct=0.05))
    return out.select("invoice_id", "n_mismatch", F.round("impact", 3).alias("impact"), F.round("impact_pct", 4).alias("impact_pct"))


@query(
    "a12_upload_warnings",
    JUDGED + """
SELECT invoice_id, count(*) FILTER (status = 'PRICE_MISMATCH') || ' price mismatch(es), ' || count(*) FILTER (status = 'UNKNOWN_PRODUCT') || ' unknown product(s)' AS message
FROM rec GROUP BY invoice_id HAVING count(*) FILTER (status IN ('PRICE_MISMATCH', 'UNKNOWN_PRODUCT')) > 0""",
)
def a12(spark, sf_dir):
    return rollup.upload_warnings(rollup.status_counts(reconciled(spark, sf_dir)))


@query(
    "r9_alert_details",
    JUDGED + """,
m AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY line_no) AS rn FROM rec WHERE status = 'PRICE_MISMATCH')
SELECT invoice_id, count(*) AS n_mismatch, string_agg(code || ' ' || CAST(CAST(abs(prix_unitaire - erp) AS DECIMAL(12,3)) AS STRING), '; ' ORDER BY line_no) FILTER (rn <= 10) AS first_details FROM m GROUP BY invoice_id""",
)
def r9(spark, sf_dir):
    return rollup.alert_details(reconciled(spark, sf_dir), 10)


@query(
    "a25_dashboard_tile",
    JUDGED + """ SELECT doc_type, count(*) AS n_lines, count(*) FILTER (status = 'VALID') AS n_valid, CAST(floor(avg(score) * 100 + 0.5) AS BIGINT) AS confidence_pct FROM rec GROUP BY doc_type""",
)
def a25(spark, sf_dir):
    return rollup.dashboard_tile(reconciled(spark, sf_dir), ["doc_type"])


@query(
    "r17_revalidate_edits",
    JUDGED + """
SELECT invoice_id, line_no, CASE WHEN NOT known THEN 'UNKNOWN_PRODUCT' WHEN e IS NOT NULL AND abs(e - erp) > 0.001 THEN 'PRICE_MISMATCH'
            WHEN designation = '' OR qty <= 0 THEN 'LOW_CONFIDENCE' ELSE 'VALID' END AS validation_status, e AS ocr_price
FROM (SELECT *, CASE WHEN line_no % 3 = 0 THEN CASE WHEN invoice_id % 2 = 0 AND known THEN erp ELSE 7.5 END ELSE prix_unitaire END AS e FROM rec)""",
)
def r17(spark, sf_dir):
    first = reconciled(spark, sf_dir)
    new = F.when((F.col("invoice_id") % 2 == 0) & F.col("erp_price").isNotNull(), F.col("erp_price")).otherwise(7.5)
    none = F.lit(None).cast("string")
    # repeated (invoice, line) pairs cannot occur: line numbers come from row_number
    edits = first.where("line_no % 3 = 0").select("invoice_id", "line_no", none.alias("designation"), none.alias("quantite"), new.alias("price_unit"))
    again = R.edited_lines(first, edits, ["invoice_id", "line_no"])
    return R.reconcile(again, R.articles(frame(spark, sf_dir, "f_article"))).select("invoice_id", "line_no", "validation_status", "ocr_price")


@query(
    "p1_canonical_lines",
    ctes("f_line") + """ SELECT invoice_id, line_no, CASE WHEN line_no % 2 = 0 THEN '' ELSE designation END AS designation,
    CASE WHEN line_no % 3 = 0 THEN quantite WHEN quantite = '' THEN 'n/a' ELSE quantite END AS quantite, coalesce(CAST(CAST(prix_unitaire AS DECIMAL(12,3)) AS STRING), '') AS prix_unitaire FROM f_line""",
)
def p1(spark, sf_dir):
    odd = F.col("line_no") % 2 == 1
    third = F.col("line_no") % 3 == 0
    rows = frame(spark, sf_dir, "f_line").select(
        "invoice_id", "line_no", F.when(odd & third, F.col("designation")).otherwise("  ").alias("designation"), F.when(odd, F.col("designation")).alias("designation_article"),
        F.when(third, F.concat(F.lit(" "), F.col("quantite"), F.when(F.col("quantite") != "", ",00").otherwise(""))).otherwise("").alias("quantite"),
        F.when(F.col("quantite") == "", "n/a").otherwise(F.col("quantite")).alias("qty0"), F.lit("").alias("code"), F.col("prix_unitaire").cast("decimal(12,3)").cast("string").alias("unit_price_ht"), F.lit("").alias("prix_unitaire"),
    )
    rows = rows.withColumn("qty", F.when(third, F.lit(None).cast("string")).otherwise(F.col("qty0"))).drop("qty0")
    return R.canonical_lines(rows).select("invoice_id", "line_no", "designation", "quantite", "prix_unitaire")


@query(
    "w1_line_order",
    ctes("f_line") + " SELECT invoice_id, line_no, row_number() OVER (PARTITION BY invoice_id ORDER BY line_no) AS ordre FROM f_line WHERE quantite <> ''",
)
def w1(spark, sf_dir):
    return R.numbered(frame(spark, sf_dir, "f_line").where("quantite <> ''")).select("invoice_id", "line_no", F.col("ordre").cast("long").alias("ordre"))
