"""Registered queries: projections of open documents and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.fixtures import ctes, frame
from ledgerweave.operators import projections as P
from ledgerweave.registry import query


@query(
    "p3_alias_lookup",
    ctes("f_line") + """ SELECT invoice_id, line_no, CASE WHEN line_no % 3 = 0 THEN CAST(line_no AS STRING) ELSE nullif(quantite, '') END AS quantity, code, nullif(designation, '') AS label FROM f_line""",
)
def p3(spark, sf_dir):
    """Lines as open maps: every third one has a second quantity key, blank in the others."""
    own = frame(spark, sf_dir, "f_line")
    extra = F.when(F.col("line_no") % 3 == 0, F.col("line_no").cast("string")).otherwise("")
    record = F.create_map(F.lit(" QTE"), extra, F.lit("Quantite "), "quantite", F.lit("CODE"), "code", F.lit("dESIGNATION"), "designation")
    return own.select("invoice_id", "line_no", P.picked(record, "qte", "quantite").alias("quantity"), P.picked(record, "code_pct", "code").alias("code"), P.picked(record, "designation").alias("label"))


DOCS = ctes("f_invoice") + ", d AS (SELECT invoice_id, LibFacture, Client, doc_type, strftime(DateFacture, '%d/%m/%Y') AS day, CASE WHEN invoice_id % 4 = 0 THEN '' ELSE owner || '@mail' END AS email, CAST(TotalHT AS DOUBLE) AS total FROM f_invoice)"


def _documents(spark, sf_dir):
    day, mail = F.date_format("DateFacture", "dd/MM/yyyy"), F.when(F.col("invoice_id") % 4 == 0, "").otherwise(F.concat("owner", F.lit("@mail")))
    return frame(spark, sf_dir, "f_invoice").select("invoice_id", "LibFacture", "Client", "doc_type", day.alias("day"), mail.alias("email"), F.col("TotalHT").cast("double").alias("total"))


@query(
    "p4_general_info",
    DOCS + """ SELECT invoice_id, LibFacture AS invoice_number, day AS invoice_date, Client AS supplier_name, '' AS supplier_mf, '' AS address, '' AS tel, '' AS fax, email, doc_type AS document_type,
    CASE WHEN invoice_id % 2 = 0 THEN 'bc_avenir' ELSE '' END AS invoice_family FROM d""",
)
def p4(spark, sf_dir):
    document = F.create_map(F.lit("numero"), "LibFacture", F.lit("date"), "day", F.lit("fournisseur_nom"), "Client", F.lit("type"), "doc_type", F.lit("email"), "email", F.lit("unknown"), "Client")
    family = F.when(F.col("invoice_id") % 2 == 0, "bc_avenir")
    return _documents(spark, sf_dir).select("invoice_id", P.general_info(document, family).alias("h")).select("invoice_id", "h.*")


@query("p5_typed_metadata", DOCS + " SELECT invoice_id, LibFacture AS numero, day AS date, Client AS fournisseur_nom, nullif(email, '') AS email, CAST(NULL AS STRING) AS fax, total AS total_ht FROM d")
def p5(spark, sf_dir):
    document = F.to_json(F.struct(F.col("LibFacture").alias("numero"), F.col("day").alias("date"), F.col("Client").alias("fournisseur_nom"), "email", F.col("total").alias("total_ht"), F.col("Client").alias("unknown")))
    fields = {"numero": "string", "date": "string", "fournisseur_nom": "string", "email": "string", "fax": "string", "total_ht": "double"}
    return _documents(spark, sf_dir).select("invoice_id", P.typed_metadata(document, fields).alias("m")).select("invoice_id", "m.*")


@query(
    "p8_candidates",
    ctes("f_line") + """ SELECT invoice_id, line_no - 1 AS i, CASE WHEN line_no % 3 <> 0 THEN code ELSE '' END AS code_pct, CASE WHEN line_no % 3 = 0 THEN 'PF' || code ELSE '' END AS code_article, designation AS designation_article,
    CASE WHEN quantite = '' THEN 0.0 ELSE CAST(nullif(quantite, '') AS DOUBLE) + 0.5 END AS quantite, coalesce(prix_unitaire, 0.0) AS prix_unitaire, CAST(0 AS DOUBLE) AS montant FROM f_line""",
)
def p8(spark, sf_dir):
    """Every third line has an article code; quantities have a decimal comma."""
    own = frame(spark, sf_dir, "f_line")
    code = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("PF"), "code")).otherwise(F.col("code"))
    q = F.when(F.col("quantite") == "", "").otherwise(F.concat("quantite", F.lit(",5")))
    blank = {c: F.lit("") for c in ("code_pct", "code_article", "montant")}
    return P.candidates(own.withColumns({"code": code, "quantite": q, **blank}), "invoice_id")


@query(
    "p12_coerced_values",
    ctes("f_line") + """ SELECT invoice_id, line_no, 'quantite' AS field, CASE WHEN quantite = '' THEN '' ELSE quantite || '.5' END AS value FROM f_line
    UNION ALL SELECT invoice_id, line_no, 'date_peremption', CASE WHEN line_no = 2 THEN '' ELSE strftime(shipped, '%d/%m/%Y') END FROM f_line
    UNION ALL SELECT invoice_id, line_no, 'code_article', 'PF' || code FROM f_line UNION ALL SELECT invoice_id, line_no, 'designation', designation FROM f_line""",
)
def p12(spark, sf_dir):
    own = frame(spark, sf_dir, "f_line")
    read = {
        "quantite": F.when(F.col("quantite") == "", " ").otherwise(F.concat("quantite", F.lit(",5"))),
        "date_peremption": F.concat(F.date_format("shipped", "dd-MM-"), F.when(F.col("line_no") == 2, "2999").otherwise(F.date_format("shipped", "yyyy"))),
        "code_article": F.concat(F.lit("ff."), "code"), "designation": F.concat(F.lit("  "), "designation", F.lit("\t")),
    }
    each = own.select("invoice_id", "line_no", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in read.items()])))
    return each.select("invoice_id", "line_no", "field", P.coerced(F.col("field"), F.col("value"), F.lit("2026-01-01").cast("date")).alias("value"))


@query(
    "u5_merged_aliases",
    """WITH base AS (SELECT r_name AS canon, n_nationkey AS place, n_name AS alias FROM nation JOIN region ON r_regionkey = n_regionkey),
hint AS (SELECT r_name AS canon, s_suppkey AS place, CASE WHEN s_suppkey % 2 = 0 THEN lower(n_name) WHEN s_suppkey % 3 = 0 THEN 'DEPT ' || s_suppkey % 10 ELSE 'Dept ' || s_suppkey % 10 END AS alias
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
new AS (SELECT canon, min(place) AS place, arg_min(alias, place) AS alias FROM hint h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.canon = h.canon AND lower(b.alias) = lower(h.alias)) GROUP BY canon, lower(alias))
SELECT canon, CAST(row_number() OVER (PARTITION BY canon ORDER BY side, place) AS INT) AS place, alias FROM (SELECT canon, 0 AS side, place, alias FROM base UNION ALL SELECT canon, 1, place, alias FROM new)""",
)
def u5(spark, sf_dir):
    region, nation, supplier = (frame(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    named = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    dept = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "DEPT ").otherwise("Dept "), (F.col("s_suppkey") % 10).cast("string"))
    base = named.select(F.col("r_name").alias("canon"), F.col("n_nationkey").cast("long").alias("place"), F.col("n_name").alias("alias"))
    hints = supplier.join(named, F.col("s_nationkey") == F.col("n_nationkey"))
    hints = hints.select(F.col("r_name").alias("canon"), F.col("s_suppkey").cast("long").alias("place"), F.when(F.col("s_suppkey") % 2 == 0, F.lower("n_name")).otherwise(dept).alias("alias"))
    return P.merged_aliases(base, hints)


@query(
    "c5_words_left",
    ctes("f_line") + """ SELECT invoice_id, line_no, CASE WHEN quantite <> '' THEN designation WHEN designation = '' THEN '' ELSE substr(designation, instr(designation, ' ') + 1) END AS words FROM f_line""",
)
def c5(spark, sf_dir):
    """The first word after the code is taken: the quantity, or where it is missing a word of the designation."""
    rest = F.concat_ws("   ", F.nullif(F.col("quantite"), F.lit("")), "designation")
    return frame(spark, sf_dir, "f_line").select("invoice_id", "line_no", P.words_left(rest, F.array(F.lit(0))).alias("words"))
