"""Registered queries: header fields, totals and zones of rendered documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.fixtures import ctes, frame
from ledgerweave.functions.fuzzy import fuzzy_type
from ledgerweave.operators import headers as H
from ledgerweave.operators import lines as L
from ledgerweave.registry import query


def texts(spark, sf_dir):
    """f_header: a header, two item lines and totals for each invoice."""
    inv = frame(spark, sf_dir, "f_invoice")
    n = F.col("invoice_id").cast("string")
    def money(c):
        return F.replace(F.format_string("%.3f", c), F.lit("."), F.lit(","))

    ht = F.col("TotalHT").cast("double")
    tva = F.floor(F.round(ht * 100) * 19 / 100) / 100
    rows = [
        F.concat(F.lit("STE "), F.upper(F.translate("Client", "#", " ")), F.lit(" PHARMA")), F.concat(F.lit("M.F: "), F.lpad(n, 7, "0"), F.lit("A/P/M/000")), F.concat(F.lit("12 rue numero "), n), F.lit("Immeuble du lac"),
        F.lit("Bon de commande"), F.concat(F.lpad(n, 6, "9"), F.lit(" / 2024")), F.concat(F.lit("Date : "), F.date_format("DateFacture", "dd/MM/yyyy")), F.concat(F.lit("Tel: 71 "), F.lpad(n, 6, "2")),
        F.lit("Code  Designation  Qte  Prix"), F.lit("300001 12 SOME DRUG 10 MG"), F.lit("300002 7 OTHER DRUG B/30 COMP"),
        F.concat(F.lit("Total HT : "), money(ht)), F.concat(F.lit("TVA : "), money(tva)), F.concat(F.lit("Total TTC : "), money(ht + tva)),
    ]
    return inv.select("invoice_id", F.array_join(F.array(*rows), "\n").alias("text"))


@query(
    "t15_header_fields",
    ctes("f_invoice") + """ SELECT invoice_id, lpad(CAST(invoice_id AS STRING), 6, '9') || '/2024' AS numero, strftime(DateFacture, '%d/%m/%Y') AS date, 'STE ' || upper(replace(Client, '#', ' ')) || ' PHARMA' AS fournisseur_nom,
    '12 rue numero ' || invoice_id || ' — Immeuble du lac' AS adresse, '71' || lpad(CAST(invoice_id AS STRING), 6, '2') AS tel, lpad(CAST(invoice_id AS STRING), 7, '0') || 'A/P/M/000' AS supplier_mf FROM f_invoice""",
)
def t15(spark, sf_dir):
    out = H.header_fields(L.page_lines(texts(spark, sf_dir), ["invoice_id"]), "invoice_id")
    return out.select("invoice_id", "numero", "date", "fournisseur_nom", "adresse", "tel", "supplier_mf")


@query(
    "t17_totals",
    ctes("f_invoice") + """, t AS (SELECT invoice_id, CAST(TotalHT AS DOUBLE) AS ht, floor(round(CAST(TotalHT AS DOUBLE) * 100) * 19 / 100) / 100 AS tv FROM f_invoice)
SELECT invoice_id, CASE WHEN ht >= 500 AND NOT ht BETWEEN 1900 AND 2100 THEN round(ht, 2) END AS total_ht, CASE WHEN tv >= 100 AND NOT tv BETWEEN 1900 AND 2100 THEN round(tv, 2) END AS tva,
  CASE WHEN ht + tv >= 500 AND NOT ht + tv BETWEEN 1900 AND 2100 THEN round(ht + tv, 2) END AS total_ttc FROM t""",
)
def t17(spark, sf_dir):
    out = H.totals(L.page_lines(texts(spark, sf_dir), ["invoice_id"]), "invoice_id")
    return out.select("invoice_id", *[F.round(c, 2).alias(c) for c in ("total_ht", "tva", "total_ttc")])


@query("t22_zones", ctes("f_invoice") + " SELECT zone, n * (SELECT count(*) FROM f_invoice) AS n_lines FROM (VALUES ('header', 8), ('body', 3), ('footer', 3)) AS v(zone, n)")
def t22(spark, sf_dir):
    return H.zones(L.page_lines(texts(spark, sf_dir), ["invoice_id"]), "invoice_id").groupBy("zone").agg(F.count("*").alias("n_lines"))


def _heads(spark, sf_dir):
    """Header fields of the rendered documents, some of them damaged."""
    own = texts(spark, sf_dir)
    heads = H.header_fields(L.page_lines(own, ["invoice_id"]), "invoice_id").join(own.hint("merge"), "invoice_id")
    n, k = F.col("invoice_id"), F.col("invoice_id") % 5
    day = F.try_to_date("date", "dd/MM/yyyy")
    date = F.when(k == 1, F.date_format(day, "yyyy")).when(k == 2, F.concat(F.date_format(day, "MM/"), F.lit("25/"), F.date_format(day, "yyyy"))).when(k == 3, F.concat(F.date_format(day, "d-M-"), F.lit("2999"))).when(k == 4, None).otherwise(F.col("date"))
    return heads.withColumns({
        "date": date, "numero": F.when(n % 4 == 1, F.lit("BCN-26-2024")).when(n % 4 == 2, F.lit("AB-CD-123456")).when(n % 4 == 3, F.lit("no 7")).otherwise(F.col("numero")),
        "tel": F.when(n % 3 == 1, F.concat(F.lit("00"), "tel")).when(n % 3 == 2, F.lit("71")).otherwise(F.col("tel")), "email": F.when(n % 3 == 0, F.lit("a.b@c-d.com")).when(n % 3 == 1, F.lit("a.b@c")).otherwise(F.lit("")),
        "client_mf": F.when(n % 2 == 0, F.lit("12/A")).otherwise(F.lit(None)), "adresse": F.when(n % 7 == 0, F.lit(" ")).otherwise(F.col("adresse")), "total_ht": F.when(n % 6 != 0, F.lit(1.0)),
        "type": F.when(n % 3 == 0, "Document").when(n % 3 == 1, "Bon de Commande").otherwise("Facture"),
    })


@query(
    "t19_field_scores",
    ctes("f_invoice") + """, d AS (SELECT *, strftime(DateFacture, '%d/%m/%Y') AS dd, strftime(DateFacture, '%m') AS mm, CAST(year(DateFacture) AS STRING) AS yy, CAST(day(DateFacture) AS STRING) AS d1, CAST(month(DateFacture) AS STRING) AS m1 FROM f_invoice),
s AS (SELECT invoice_id, CASE invoice_id % 5 WHEN 0 THEN dd WHEN 1 THEN yy WHEN 2 THEN '25/' || mm || '/' || yy WHEN 3 THEN d1 || '-' || m1 || '-2999' END AS date, CASE invoice_id % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.3 WHEN 2 THEN 0.92 WHEN 3 THEN 0.3 ELSE 0.0 END AS date_score,
  CASE invoice_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.97 WHEN 2 THEN 0.95 ELSE 0.7 END AS numero_score, CASE invoice_id % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 ELSE 0.5 END AS tel_score,
  CASE invoice_id % 3 WHEN 0 THEN 0.97 WHEN 1 THEN 0.5 ELSE 0.7 END AS email_score, CASE WHEN invoice_id % 2 = 0 THEN 0.55 ELSE 0.0 END AS client_mf_score, CASE WHEN invoice_id % 7 = 0 THEN 0.7 ELSE 0.75 END AS adresse_score,
  CASE WHEN invoice_id % 6 = 0 THEN 0.0 ELSE 0.9 END AS total_ht_score, CASE WHEN invoice_id % 5 = 2 THEN 1 ELSE 0 END + CASE WHEN invoice_id % 5 IN (1, 3) THEN 1 ELSE 0 END + CASE WHEN invoice_id % 2 = 0 THEN 1 ELSE 0 END AS n_warnings FROM d)
SELECT *, 'Bon de Commande' AS type, 1.0 AS type_score, 0.98 AS supplier_mf_score, 0.7 AS fournisseur_nom_score, concat_ws(',', CASE WHEN client_mf_score < 0.55 THEN 'client_mf' END, CASE WHEN date_score < 0.55 THEN 'date' END, CASE WHEN email_score < 0.55 THEN 'email' END,
  CASE WHEN tel_score < 0.55 THEN 'tel' END, CASE WHEN total_ht_score < 0.55 THEN 'total_ht' END) AS ambiguous FROM s""",
)
def t19(spark, sf_dir):
    out = H.scored_fields(_heads(spark, sf_dir), "text", F.lit("2024-06-01").cast("date"))
    scores = [F.col("scores")[c].alias(f"{c}_score") for c in ("date", "numero", "tel", "email", "client_mf", "adresse", "total_ht", "type", "supplier_mf", "fournisseur_nom")]
    ambiguous = F.array_join(F.array_sort(F.filter("ambiguous", lambda a: a != "invoice_id")), ",")
    return out.select("invoice_id", "date", "type", *scores, F.size("warnings").alias("n_warnings"), ambiguous.alias("ambiguous"))


@query(
    "f14_unresolved_lines",
    ctes("f_line") + """ SELECT invoice_id, line_no FROM f_line WHERE quantite = '' AND designation <> '' AND line_no % 4 <> 1""",
)
def f14(spark, sf_dir):
    """Designations keep their dosage, or lose every number; lines without code never count."""
    own = frame(spark, sf_dir, "f_line")
    bare = F.when(F.col("line_no") % 4 == 1, F.regexp_replace("designation", r"\d", "")).otherwise(F.col("designation"))
    return H.unresolved_lines(own.withColumn("designation", bare)).select("invoice_id", "line_no")


@query("n15_document_types")
def n15(spark, sf_dir):
    """Types of openings with damaged headings, by partial similarity."""
    return document_openings(spark, sf_dir).select("invoice_id", fuzzy_type("text").alias("t")).select("invoice_id", "t.type", "t.score")


def document_openings(spark, sf_dir):
    inv, k = frame(spark, sf_dir, "f_invoice"), F.col("invoice_id") % 8
    heading = F.element_at(F.array(*map(F.lit, ("FACTURE No", "FACTUR nurnero", "BON DE COMANDE", "Bon  commande", "PRO-F0RMA", "Statistique", "VENTES et chifre", "invoic"))), (k + 1).cast("int"))
    words = F.concat_ws(" ", F.col("LibFacture"), heading, "Client", F.date_format("DateFacture", "dd/MM/yyyy"))
    return inv.select("invoice_id", F.when(F.col("invoice_id") % 50 == 0, F.substring(words, 1, 4)).otherwise(words).alias("text"))


@query(
    "t18_proforma_summary",
    ctes("f_invoice") + """ SELECT invoice_id, round(CAST(TotalHT AS DOUBLE) + 1000, 2) AS total_brut_ht, CAST(5 AS DOUBLE) AS remise_pct, round(CAST(TotalHT AS DOUBLE) + 500, 2) AS total_ht, round(CAST(TotalHT AS DOUBLE) + 300.5, 2) AS tva,
  CAST(7.5 AS DOUBLE) AS transport, CAST(1 AS DOUBLE) AS timbre_fiscal, round(CAST(TotalHT AS DOUBLE) + 2000, 2) AS total_ttc FROM f_invoice""",
)
def t18(spark, sf_dir):
    def money(c):
        return F.replace(F.format_string("%.3f", c), F.lit("."), F.lit(","))

    ht = F.col("TotalHT").cast("double")
    rows = [
        F.concat(F.lit("Total Brut HT : "), money(ht + 1000)), F.lit("Total Remise : (5 %)"), F.concat(F.lit("Total Net HT : "), money(ht + 500)),
        F.concat(F.lit("% 19,00 100,000 "), money(ht + 200)), F.concat(F.lit("% 7,00 100,000 "), money(F.lit(100.5))), F.lit("Transport : 7,500"), F.lit("Timbre Fiscal : 1,000"), F.concat(F.lit("Total TTC : "), money(ht + 2000)),
    ]
    docs = frame(spark, sf_dir, "f_invoice").select("invoice_id", F.array_join(F.array(*rows), "\n").alias("text"))
    out = H.proforma_summary(docs, "text")
    return out.select("invoice_id", *[F.round(c, 2).alias(c) for c in ("total_brut_ht", "remise_pct", "total_ht", "tva", "transport", "timbre_fiscal", "total_ttc")])
