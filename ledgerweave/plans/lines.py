"""Registered queries: body text to line items, scalar rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.fixtures import ctes, frame
from ledgerweave.functions import codes, dates, fuzzy, numbers, text
from ledgerweave.operators import lines as L
from ledgerweave.registry import query


def bodies(spark, sf_dir, render=None):
    """f_body: one text per invoice, a line for each item with a designation."""
    own = frame(spark, sf_dir, "f_line").where("designation <> ''")
    line = render if render is not None else F.concat_ws(" ", "code", F.nullif(F.col("quantite"), F.lit("")), "designation")
    parts = F.sort_array(F.collect_list(F.struct("line_no", line.alias("t"))))
    return own.groupBy("invoice_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


def body_lines(spark, sf_dir, render=None):
    return L.page_lines(bodies(spark, sf_dir, render), ["invoice_id"])


@query(
    "t5_simple_order_lines",
    ctes("f_line") + """, o AS (SELECT *, code || ' ' || quantite || ' ' || designation AS k FROM f_line WHERE designation <> '' AND quantite <> '')
SELECT invoice_id, code, quantite, designation, CAST(0.72 AS DOUBLE) AS line_confidence FROM (SELECT DISTINCT invoice_id, code, quantite, designation FROM o)""",
)
def t5(spark, sf_dir):
    """Round trip: the parsed lines are the source rows."""
    own = body_lines(spark, sf_dir, F.when(F.col("quantite") != "", F.concat_ws(" ", "code", "quantite", "designation")))
    return L.simple_order_lines(own, "invoice_id").select("invoice_id", "code", "quantite", "designation", "line_confidence")


@query(
    "t6_dated_order_lines",
    ctes("f_line") + """ SELECT DISTINCT invoice_id, 'AB' || CAST(1000 + line_no AS STRING) AS code_pct, upper(designation) AS designation, quantite AS quantite_commande, '2' AS nb_cartons, '24' AS unite_carton,
  strftime(shipped, '%d/%m/%Y') AS date_peremption, CAST(0.88 AS DOUBLE) AS line_confidence FROM (SELECT invoice_id, line_no, 'DRUG NAME' AS designation, quantite, shipped FROM f_line WHERE quantite <> '' AND designation <> '')""",
)
def t6(spark, sf_dir):
    code = F.concat(F.lit("AB"), (F.col("line_no") + 1000).cast("string"))
    line = F.when(F.col("quantite") != "", F.concat_ws("  ", code, F.lit("DRUG NAME"), "quantite", F.lit("2"), F.date_format("shipped", "dd/MM/yyyy"), F.lit("24")))
    return L.dated_order_lines(body_lines(spark, sf_dir, line), "invoice_id").select("invoice_id", "code_pct", "designation", "quantite_commande", "nb_cartons", "unite_carton", "date_peremption", "line_confidence")


@query(
    "t7_proforma_lines",
    ctes("f_line") + """ SELECT DISTINCT invoice_id, code AS code_pct, 'PF' || lpad(CAST(l_suppkey AS STRING), 9, '0') AS code_article, 'DMAX U UML' AS designation, quantite,
  CASE WHEN quantite = '' THEN '' ELSE '1234,56' END AS prix_unitaire, CASE WHEN quantite = '' THEN '' ELSE CAST(CAST(quantite AS BIGINT) + 10 AS STRING) || '567,89' END AS montant, CAST(CASE WHEN quantite = '' THEN 0.28 ELSE 0.85 END AS DOUBLE) AS line_confidence
FROM f_line WHERE designation <> ''""".replace("CAST(quantite AS BIGINT)", "CAST('0' || quantite AS BIGINT)"),
)
def t7(spark, sf_dir):
    pf = F.concat(F.lit("PF"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    money = F.when(F.col("quantite") != "", F.concat_ws(" ", "quantite", F.lit("1 234,56"), (F.col("quantite").try_cast("int") + 10).cast("string"), F.lit("567,89")))
    own = body_lines(spark, sf_dir, F.concat_ws(" ", "code", pf, F.lit("DMAX U UML"), money))
    return L.proforma_lines(own, "invoice_id").select("invoice_id", "code_pct", "code_article", "designation", "quantite", "prix_unitaire", "montant", "line_confidence")


@query(
    "t8_unknown_lines",
    ctes("f_line") + " SELECT invoice_id, code, count(*) AS n FROM f_line WHERE designation <> '' GROUP BY ALL",
)
def t8(spark, sf_dir):
    return L.unknown_lines(body_lines(spark, sf_dir)).groupBy("invoice_id", "code").agg(F.count("*").alias("n"))


@query(
    "t9_quantity_recovery",
    ctes("f_line") + """ SELECT invoice_id, line_no, CASE WHEN quantite = '' THEN NULL WHEN line_no % 3 = 2 AND CAST('0' || quantite AS INT) BETWEEN 1900 AND 2100 THEN NULL ELSE quantite END AS quantity,
  CASE WHEN quantite = '' THEN '' WHEN line_no % 3 = 0 AND length(code) = 6 THEN 'mp_code_prefix' WHEN line_no % 3 < 2 THEN 'qty_positional_prefix' ELSE 'qty_positional_suffix' END AS source,
  CAST(CASE WHEN quantite = '' THEN 0.0 WHEN line_no % 3 = 0 AND length(code) = 6 THEN 0.89 WHEN line_no % 3 < 2 THEN 0.86 ELSE 0.88 END AS DOUBLE) AS score FROM f_line""",
)
def t9(spark, sf_dir):
    own = frame(spark, sf_dir, "f_line")
    name = F.lit("AMLODIPINE FORTE COMP")
    q = F.nullif(F.col("quantite"), F.lit(""))
    raw = F.when(F.col("line_no") % 3 == 0, F.concat_ws(" ", "code", q, name)).when(F.col("line_no") % 3 == 1, F.concat_ws(" ", F.lit("PF00012"), F.lit("="), q, name)).otherwise(F.concat_ws(" ", F.lit("PF00012"), name, q))
    own = own.withColumn("raw_line", raw).withColumn("code", F.when(F.col("line_no") % 3 == 0, F.col("code")).otherwise("PF00012"))
    return L.with_quantity(own).select("invoice_id", "line_no", "q.quantity", "q.source", "q.score")


@query(
    "t10_recovered_quantities",
    ctes("f_line") + """, u AS (SELECT invoice_id, code FROM f_line WHERE designation <> '' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT f.invoice_id, f.line_no, f.quantite FROM f_line f JOIN u ON u.invoice_id = f.invoice_id AND u.code = f.code WHERE designation <> '' AND quantite <> ''""",
)
def t10(spark, sf_dir):
    """Quantities are blanked in half of the items and read back from the body."""
    own = frame(spark, sf_dir, "f_line").where("designation <> ''")
    once = own.groupBy("invoice_id", "code").agg(F.count("*").alias("n")).where("n = 1").select("invoice_id", "code")
    items = own.join(once, ["invoice_id", "code"]).withColumn("quantite", F.when(F.col("line_no") % 2 == 0, "").otherwise(F.col("quantite"))).withColumn("raw_line", F.concat_ws(" ", "code", "designation"))
    return L.recovered(items, body_lines(spark, sf_dir), "invoice_id").where("quantite <> ''").select("invoice_id", "line_no", "quantite")


@query(
    "t1_family_routing",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'avenir_medis' WHEN 1 THEN 'omnipharm_medis' WHEN 2 THEN 'pharmasud_medis' WHEN 3 THEN 'modele_proforma' WHEN 4 THEN 'avenir_medis' END AS profile,
  CASE o_orderkey % 6 WHEN 0 THEN 'bc_avenir' WHEN 1 THEN 'bc_omnipharm' WHEN 2 THEN 'bc_pharmasud' WHEN 3 THEN 'proforma_modele' WHEN 4 THEN 'bc_avenir' ELSE 'unknown' END AS invoice_family,
  CASE WHEN o_orderkey % 6 = 5 THEN 'Document' WHEN o_orderkey % 6 = 3 THEN 'Proforma' ELSE 'Bon de Commande' END AS doc_type, CAST(CASE WHEN o_orderkey % 6 < 5 THEN 0.7 END AS DOUBLE) AS profile_score FROM orders""",
)
def t1(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    head = F.when(k == 0, "AVENIR  Rekik").when(k == 1, "OmniPharm Medis").when(k == 2, "Pharmasud\nMEDIS").when(k == 3, "Modele PROFORMA").when(k == 4, "medis").otherwise("Nothing known")
    own = frame(spark, sf_dir, "orders").select("o_orderkey", head.alias("h"), F.when(k == 5, "a text").when(k == 3, "proforma n° 1").otherwise("Bon de commande").alias("b"))
    own = own.withColumns({"profile": L.vendor_profile(F.col("h"), F.col("b"), F.lit("")), "doc_type": text.document_type(F.col("b"))})
    return own.select("o_orderkey", "profile", L.invoice_family(F.col("profile"), F.col("doc_type"), F.col("h"), F.col("b"), F.lit("")).alias("invoice_family"), "doc_type", L.profile_score(F.col("profile"), F.col("doc_type")).alias("profile_score"))


@query(
    "n16_text_lines",
    r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\n|\r')) AS line FROM documents),
s AS (SELECT doc_id, trim(line, ' ' || chr(9)) AS s FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (a >= 3 AND 1 - a / (length(s) + 1e-5) <= 0.60 AND regexp_matches(s, '[A-Za-z]{3,}|\d')) AS n_text
FROM (SELECT doc_id, s, length(regexp_replace(s, '[^A-Za-z0-9]', '', 'g')) AS a FROM s WHERE s <> '') GROUP BY doc_id""",
)
def n16(spark, sf_dir):
    own = L.page_lines(frame(spark, sf_dir, "documents"), ["doc_id"])
    return own.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(text.is_text_line(F.col("raw_line"))).alias("n_text"))


@query(
    "n21_contacts",
    r"""SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}', 0), '') AS email FROM documents WHERE regexp_matches(text, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}')""",
)
def n21(spark, sf_dir):
    return frame(spark, sf_dir, "documents").select("doc_id", text.email(F.col("text")).alias("email")).where("email is not null")


@query(
    "n1_code_repairs",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'PF' || lpad(CAST(l_partkey AS STRING), 9, '0') AS normalized, 'OCR-' || left(CAST(l_orderkey AS STRING) || CAST(l_partkey AS STRING) || '777777777777', 12) AS invoice_key,
  lpad(CAST(l_suppkey AS STRING), 7, '0') || 'A/P/M/000' AS tax_id, CASE WHEN l_partkey % 3 = 0 THEN lpad(CAST(10000 + l_suppkey AS STRING), 6, '0') ELSE 'PF' || lpad(CAST(l_partkey AS STRING), 9, '0') END AS product FROM lineitem""",
)
def n1(spark, sf_dir):
    own = frame(spark, sf_dir, "lineitem")
    pf = F.translate(F.concat(F.lit("ff-"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")), "0158", "oisb")
    mf = F.concat(F.lpad(F.col("l_suppkey").cast("string"), 7, "0"), F.lit(" a / p-m | ooo"))
    return own.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", codes.normalized_code(pf).alias("normalized"),
        codes.invoice_key(F.concat(F.lit("N° "), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit("-777777777777"))).alias("invoice_key"),
        codes.tax_id(F.regexp_replace(mf, "ooo", "000")).alias("tax_id"), codes.product_code(F.when(F.col("l_partkey") % 3 == 0, (F.col("l_suppkey") + 10000).cast("string")).otherwise(pf)).alias("product"),
    )


@query(
    "m1_money_texts",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_extendedprice > 99999 THEN NULL ELSE l_extendedprice END AS price, l_extendedprice AS any_locale,
  CASE WHEN l_extendedprice >= 1000 THEN l_extendedprice END AS french, CAST(CAST(l_extendedprice AS DECIMAL(12,3)) AS DOUBLE) AS millimes,
  CAST(CAST(l_quantity AS INT) AS STRING) AS quantity, CAST(CAST(l_quantity AS INT) AS STRING) || '.5' AS money FROM lineitem""",
)
def m1(spark, sf_dir):
    def two_decimals(c):
        return F.col(c).cast("decimal(18,2)").cast("string")

    # each text is a column, written once for all rules that read it
    own = frame(spark, sf_dir, "lineitem").withColumn("comma", F.replace(two_decimals("l_extendedprice"), F.lit("."), F.lit(",")))
    own = own.withColumn("grouped", F.regexp_replace("comma", r"(?<=\d)(?=(\d{3})+,)", " "))
    comma, grouped = F.col("comma"), F.col("grouped")
    us = F.replace(F.replace(grouped, F.lit(","), F.lit(".")), F.lit(" "), F.lit(","))
    return own.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", numbers.price_of_text(grouped).alias("price"), numbers.float_any_locale(us).alias("any_locale"),
        F.when(F.col("l_extendedprice") >= 1000, numbers.french_money(grouped)).alias("french"), numbers.millimes(F.concat(comma, F.lit(" TND"))).cast("double").alias("millimes"),
        numbers.coerced_quantity(two_decimals("l_quantity")).alias("quantity"), numbers.money_text(F.floor("l_quantity") + 0.5).alias("money"),
    )


@query(
    "d1_date_texts",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, strftime(o_orderdate, '%d/%m/%Y') AS repaired,
  CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN year(o_orderdate) > 1997 THEN NULL ELSE strftime(o_orderdate, '%m/%d/%Y') END AS validated FROM orders""",
)
def d1(spark, sf_dir):
    """D1-D3 for every order; a month-first text is set right only where the day shows the order (above 12),
    whatever its year; other dates may lie in the next year at most."""
    own = frame(spark, sf_dir, "orders")
    formats = [F.date_format("o_orderdate", f) for f in ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy")]
    written = F.element_at(F.array(*formats), (F.col("o_orderkey") % 3 + 1).cast("int"))
    noisy = F.translate(F.date_format("o_orderdate", "dd-MM-yyyy"), "015", "OIS")
    swapped = F.date_format("o_orderdate", "MM/dd/yyyy")
    return own.select("o_orderkey", dates.invoice_date(written).alias("parsed"), dates.repaired_date(noisy).alias("repaired"), dates.validated_date(swapped, F.lit("1996-12-31").cast("date")).alias("validated"))


@query(
    "f9_noise_patterns",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
t AS (SELECT doc_id, regexp_replace(raw, '^[\s\v]+|[\s\v]+$', '', 'g') AS t FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (t <> '' AND (regexp_matches(t, '^[\s\d"''#<>.,;:!?~`]') OR regexp_matches(t, '[\s"''#<>.,;:!?~`]$') OR regexp_matches(t, '[<>~`]|"[^"]*$')
  OR (regexp_matches(t, '^\d{1,5}\s+[A-Z].+$') AND NOT regexp_matches(t, '(?i)^\d+\s*MG\b')) OR regexp_matches(t, '^[^A-Z]{1,3}\s+[A-Z]'))) AS n_noisy FROM t GROUP BY doc_id""",
)
def f9(spark, sf_dir):
    """noisy ones among the lines of every whole text."""
    own = frame(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("raw"))
    return own.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(text.has_noise(F.col("raw"))).alias("n_noisy"))


@query("n14_label_similarity")
def n14(spark, sf_dir):
    """Similarity of distinct part names to their labels with a word dropped; brute-forced in the tests."""
    p = frame(spark, sf_dir, "part").select("p_partkey", "p_name").withColumn("other", F.regexp_replace("p_name", r"^\S+ ", ""))
    return p.select("p_partkey", F.round(fuzzy.similarity(F.col("p_name"), F.col("other")), 6).alias("token_set"), F.round(fuzzy.partial_similarity(F.col("p_name"), F.col("other")), 6).alias("partial"))


@query(
    "n11_clean_designations",
    ctes("f_line") + " SELECT invoice_id, line_no, regexp_replace(designation, '^[A-Z]{1,3} ', '') AS designation FROM f_line WHERE designation <> '' AND quantite <> ''",
)
def n11(spark, sf_dir):
    """Designations with code, quantity and marks in front come back clean; a first word of up to three letters counts as noise."""
    own = frame(spark, sf_dir, "f_line").where("designation <> '' and quantite <> ''")
    noisy = F.concat(F.lit("## "), "code", F.lit(" "), "quantite", F.lit(" "), "designation", F.lit(" ~~"))
    return own.select("invoice_id", "line_no", fuzzy.clean_designation(noisy, F.col("quantite"), F.lit(True), F.col("code")).alias("designation"))


@query(
    "u6_merge_keys",
    ctes("f_line") + """ SELECT pct, article, amount, count(*) AS n FROM (SELECT CASE WHEN line_no % 2 = 0 THEN code ELSE '' END AS pct, CASE WHEN line_no % 2 = 1 THEN 'PF' || code ELSE '' END AS article,
  coalesce(printf('%.4f', prix_unitaire), '') AS amount FROM f_line) GROUP BY ALL""",
)
def u6(spark, sf_dir):
    own = frame(spark, sf_dir, "f_line")
    code = F.when(F.col("line_no") % 2 == 0, F.col("code")).otherwise(F.concat(F.lit("pf"), "code"))
    key = codes.merge_key(code, F.lit(""), F.lit(""), F.col("prix_unitaire"), F.lit("d"), F.lit("r"))
    return own.select(key.alias("k")).groupBy("k.pct", "k.article", "k.amount").agg(F.count("*").alias("n"))
