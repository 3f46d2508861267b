"""Registered queries: scalar rules over columns of the given tables, and document reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.fixtures import ctes, frame
from ledgerweave.functions import numbers, text
from ledgerweave.operators import lines as L
from ledgerweave.operators import reconcile as R
from ledgerweave.operators import rollup
from ledgerweave.operators import tables as T
from ledgerweave.plans.reconciliation import JUDGED, SUPPLIED, raw_lines
from ledgerweave.plans.reports import COUNTS
from ledgerweave.registry import query

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
NAMES = ", ".join(KEYS)


@query(
    "n23_quantity_repairs",
    f"SELECT {NAMES}, CASE l_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) WHEN 2 THEN '5' || CAST(CAST(l_quantity AS INT) AS STRING) ELSE CAST(CAST(l_quantity AS INT) AS STRING) || ' ND' END AS quantity FROM lineitem",
)
def n23(spark, sf_dir):
    """ND, quotes before the number, a section sign for a five, and a text that stays."""
    own, k = frame(spark, sf_dir, "lineitem"), F.col("l_partkey") % 4
    q = F.col("l_quantity").cast("int").cast("string")
    read = F.when(k == 0, " nd ").when(k == 1, F.concat(F.lit("\"'"), q, F.lit(" "))).when(k == 2, F.concat(F.lit("§"), q)).otherwise(F.concat(q, F.lit(" ND")))
    return own.select(*KEYS, text.quantity_repaired(read).alias("quantity"))


@query(
    "m6_bounded_numbers",
    f"SELECT {NAMES}, CASE WHEN l_partkey % 9 = 0 OR l_extendedprice > 30000 THEN NULL ELSE round(l_extendedprice, 2) END AS bounded FROM lineitem",
)
def m6(spark, sf_dir):
    """M6: prices as texts with a comma; every ninth one below zero."""
    own = frame(spark, sf_dir, "lineitem")
    read = F.concat(F.when(F.col("l_partkey") % 9 == 0, "-").otherwise(""), F.replace(F.format_string("%.2f", "l_extendedprice"), F.lit("."), F.lit(",")))
    return own.select(*KEYS, numbers.bounded_float(read, 30_000.0).alias("bounded"))


@query(
    "f5_plausible_quantities",
    f"""SELECT {NAMES}, num > 0 AND NOT num BETWEEN 1900 AND 2100 AND num <= CASE WHEN l_suppkey % 5 = 0 THEN 5000 WHEN l_returnflag = 'R' THEN 10000 ELSE 6000 END AND l_partkey % 7 <> 0 AS plausible
    FROM (SELECT *, CAST(l_quantity AS INT) * (l_partkey % 300) AS num FROM lineitem)""",
)
def f5(spark, sf_dir):
    """quantities of many sizes under the caps of document type and vendor; every seventh beside a total."""
    own = frame(spark, sf_dir, "lineitem")
    num = F.col("l_quantity").cast("int") * (F.col("l_partkey") % 300)
    kind = F.when(F.col("l_returnflag") == "R", "Facture Proforma").otherwise("Facture")
    vendor = F.when(F.col("l_suppkey") % 5 == 0, "pharmasud_medis").otherwise("bc_avenir")
    label = F.when(F.col("l_partkey") % 7 == 0, "Montant global").otherwise("AMOX 500")
    return own.select(*KEYS, L.plausible_in_document(num, label, kind, vendor).alias("plausible"))


@query("c4_json_spans", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN '{\"id\": ' || event_id || ', \"kind\": {\"of\": \"' || event_type || '\"}}' END AS span FROM events")
def c4(spark, sf_dir):
    """C4: objects inside other text; every fifth reply holds none."""
    own = frame(spark, sf_dir, "events")
    reply = F.when(F.col("event_id") % 5 == 0, "no object").otherwise(F.format_string('Here:\n{"id": %d, "kind": {"of": "%s"}}\nDone.', "event_id", "event_type"))
    return own.select("event_id", text.json_between_braces(reply).alias("span"))


NAMES = """SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN p_name WHEN 1 THEN 'Total ' || p_name WHEN 2 THEN p_name || repeat('0', p_partkey % 120) WHEN 3 THEN 'Bon de  commande n° ' || p_name WHEN 4 THEN 'see WWW.' || p_name
    WHEN 5 THEN 'Page ' || p_name WHEN 6 THEN 'Pages ' || p_name WHEN 7 THEN ' x' || CAST(p_partkey % 100 AS STRING) WHEN 8 THEN repeat(p_name || ' ', 9) ELSE 'MDN-PRE ' || p_name END AS name FROM {part}"""


@query(
    "f8_company_names",
    f"""WITH n AS ({NAMES.format(part="part")}), t AS (SELECT p_partkey, trim(name) AS s, length(regexp_replace(name, '[^A-Za-z]', '', 'g')) AS letters FROM n)
SELECT p_partkey, length(s) >= 3 AND letters >= greatest(3, length(s) * 0.25) AND NOT regexp_matches(lower(s), 'https?://|www\\.|stat\\s+ventes|statistiques') AND NOT regexp_matches(lower(s), 'proforma\\s*n[°o]|mdn-pre|mdn-prf|bon\\s+de\\s+commande\\s+n')
  AND NOT regexp_matches(lower(s), '^\\s*(page|cer)\\s') AS is_name FROM t""",
)
def f8(spark, sf_dir):
    """F8: part names as they are, behind headings and web marks, among digits, too short, and very long."""
    return spark.sql(NAMES, part=frame(spark, sf_dir, "part")).select("p_partkey", text.is_company_name(F.col("name")).alias("is_name"))


@query(
    "a22_cell_scores",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN length(CAST(l_partkey AS STRING)) BETWEEN 4 AND 6 THEN 1.0 WHEN length(CAST(l_partkey AS STRING)) BETWEEN 7 AND 8 THEN 0.95 ELSE 0.2 END
    WHEN 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 1.0 ELSE 0.3 END WHEN 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN l_suppkey % 3 = 0 THEN 0.0 ELSE 1.0 END END AS DOUBLE) AS fit FROM lineitem""",
)
def a22(spark, sf_dir):
    """Codes, whole numbers, amounts and dates in cells that hold them or something else."""
    own, k = frame(spark, sf_dir, "lineitem"), F.col("l_linenumber") % 4
    kind = F.when(k == 0, "code").when(k == 1, "integer").when(k == 2, "money").otherwise("date")
    number = F.col("l_quantity").cast("int").cast("string")
    value = (
        F.when(k == 0, F.col("l_partkey").cast("string")).when(k == 1, F.when(F.col("l_partkey") % 2 == 0, number).otherwise(F.concat(number, F.lit(" pcs"))))
        .when(k == 2, F.when(F.col("l_suppkey") % 2 == 0, F.format_string("%.2f", "l_extendedprice")).otherwise("none")).otherwise(F.when(F.col("l_suppkey") % 3 == 0, "soon").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")))
    )
    return own.select(*KEYS, T.cell_score(value, kind).alias("fit"))


@query(
    "n12_n13_designations",
    ctes("f_line") + """, n AS (SELECT invoice_id, line_no, regexp_replace(upper(p_name), '^[A-Z]{1,3} ', '') || ' 10 MG B/30 COMP' AS whole FROM f_line l JOIN part ON CAST(300000 + p_partkey AS STRING) = l.code)
SELECT invoice_id, line_no, CASE WHEN line_no % 4 = 2 THEN replace(whole, ' 10 MG B/30 COMP', ' 10 MG') ELSE whole END AS shown, CASE WHEN line_no % 4 IN (0, 2) THEN 0.95 ELSE 0.72 END AS confidence FROM n""",
)
def n12(spark, sf_dir):
    """Read texts that equal the reference, are another product's, leave out the pack, or show noise."""
    article = frame(spark, sf_dir, "f_article").select(F.col("Code").alias("code"), F.col("LibProd").alias("lib"))
    own, k = frame(spark, sf_dir, "f_line").select("invoice_id", "line_no", "code").join(article.hint("merge"), "code"), F.col("line_no") % 4
    read = F.when(k == 0, F.col("lib")).when(k == 1, "ZZZYX QQQ 999 ML").when(k == 2, F.replace("lib", F.lit(" B/30 COMP"), F.lit(""))).otherwise(F.concat(F.lit("#7 "), "lib"))
    rows = own.withColumns({"read": read, "quantity": F.lit("")})
    return R.displayed(rows, "read", "lib", "quantity").select("invoice_id", "line_no", "shown", F.col("match_confidence").alias("confidence"))


@query(
    "r4_reconciled_documents",
    JUDGED + ctes("f_supplier").removeprefix("WITH").join((",", "")) + SUPPLIED.replace("{orders}", "orders").replace("{supplier}", "supplier") + f""",
b AS (SELECT invoice_id, CASE WHEN invoice_id % 5 IN (1, 2) THEN 0 WHEN invoice_id % 5 = 3 THEN s_suppkey END AS sid FROM inv),
c AS (SELECT invoice_id, count(*) AS n_lines, {COUNTS} FROM rec GROUP BY invoice_id)
SELECT b.invoice_id, Nom AS erp_supplier_name, CASE WHEN sid IS NULL THEN 'SUPPLIER_UNKNOWN' ELSE 'SUPPLIER_MATCH' END AS supplier_status, c.* EXCLUDE (invoice_id)
FROM b LEFT JOIN f_supplier ON IDFournisseur = sid LEFT JOIN c ON c.invoice_id = b.invoice_id""",
)
def r4(spark, sf_dir):
    """Every document with its supplier and the statuses of its lines, which take the document's type."""
    given = spark.sql("SELECT * FROM (" + SUPPLIED.strip(", \n").removeprefix("inv AS ").strip()[1:-1] + ")", orders=frame(spark, sf_dir, "orders"), supplier=frame(spark, sf_dir, "supplier"))
    types = frame(spark, sf_dir, "f_invoice").select("invoice_id", F.col("doc_type").alias("document_type"), F.lit("").alias("invoice_family"))
    documents = given.join(types.hint("merge"), "invoice_id", "left")
    lines = raw_lines(spark, sf_dir).withColumn("doc_type", F.lit(""))
    heads, judged = R.reconciled_documents(documents, lines, frame(spark, sf_dir, "f_supplier"), R.articles(frame(spark, sf_dir, "f_article")))
    counts = rollup.status_counts(judged).drop("n_unchecked")
    return heads.select("invoice_id", "erp_supplier_name", "supplier_status").join(counts.hint("merge"), "invoice_id", "left")
