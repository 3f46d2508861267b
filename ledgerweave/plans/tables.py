"""Registered queries: table cells, word boxes, vendors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.fixtures import ctes, frame
from ledgerweave.operators import provenance as V
from ledgerweave.operators import tables as T
from ledgerweave.registry import query


GRID = """SELECT invoice_id, line_no AS row_idx, CASE line_no % 4 WHEN 3 THEN '' WHEN 0 THEN '' ELSE code END AS pct, CASE line_no % 4 WHEN 0 THEN '' ELSE 'PF' || lpad(CAST(line_no AS STRING), 9, '0') END AS art,
    CASE line_no % 4 WHEN 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'suite' ELSE 'suite 12,50' END ELSE designation END AS name, CASE line_no % 4 WHEN 2 THEN '' WHEN 0 THEN '' ELSE quantite END AS qte,
    CASE line_no % 4 WHEN 1 THEN '12,50' WHEN 2 THEN '1 000.25' ELSE '' END AS price, CASE line_no % 4 WHEN 2 THEN quantite WHEN 0 THEN 'x' ELSE '' END AS obs, CASE line_no % 4 WHEN 3 THEN '7,125' ELSE '' END AS note FROM {f_line}"""
HEADER = ("Code PCT", "Code Article", "Désignation", "Qté", "P.U.", "Obs", "Note")


def cells(spark, sf_dir):
    """A table for each invoice: a header row and a row for each line. Of four rows one is in order, one has its quantity
    and one its price in a column without a name, and one has no code."""
    rows = spark.sql(GRID, f_line=frame(spark, sf_dir, "f_line"))
    body = rows.select("invoice_id", "row_idx", F.posexplode(F.array("pct", "art", "name", "qte", "price", "obs", "note")).alias("col_idx", "text"))
    head = rows.select("invoice_id").distinct().select("invoice_id", F.lit(0).alias("row_idx"), F.posexplode(F.array(*map(F.lit, HEADER))).alias("col_idx", "text"))
    return head.unionByName(body)


GRIDS = ctes("f_line") + f""", g AS ({GRID.format(f_line="f_line")}), a AS (SELECT *, CASE row_idx % 4 WHEN 2 THEN obs ELSE qte END AS q, CASE row_idx % 4 WHEN 3 THEN note ELSE price END AS p FROM g),
s AS (SELECT *, CASE WHEN pct = '' THEN 0.0 WHEN length(pct) <= 6 THEN 1.0 WHEN length(pct) <= 8 THEN 0.95 ELSE 0.2 END AS s0, CASE WHEN art = '' THEN 0.0 ELSE 1.0 END AS s1, CASE WHEN name = '' THEN 0.0 ELSE 1.0 END AS s2, CASE WHEN q = '' THEN 0.0 ELSE 1.0 END AS s3, CASE WHEN p = '' THEN 0.0 ELSE 1.0 END AS s4 FROM a)"""


@query("a22_row_alignment", GRIDS + " SELECT invoice_id, row_idx, pct AS code_pct, q AS quantity, p AS unit_price, round((s0 + s1 + s2 + s3 + s4) / 5, 3) AS alignment FROM s")
def a22_rows(spark, sf_dir):
    own = cells(spark, sf_dir)
    out = T.realigned(own, ["invoice_id"], T.mapped_headers(own, ["invoice_id"]))
    return out.select("invoice_id", "row_idx", *[F.col("named")[c].alias(c) for c in ("code_pct", "quantity", "unit_price")], "alignment")


#: Codes of seven digits and more are no item codes: their rows are no lines, hand on no code, and go to the line before.
TABLE_LINES = GRIDS + r""", l AS (SELECT *, last_value(CASE WHEN length(pct) BETWEEN 4 AND 6 THEN pct END IGNORE NULLS) OVER (PARTITION BY invoice_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  concat_ws(' ', pct, art, name, qte, price, obs, note) AS txt, art <> '' AND length(pct) <= 6 AS line FROM s),
m AS (SELECT *, CASE WHEN pct <> '' THEN pct ELSE coalesce(before, '') END AS own, max(CASE WHEN line THEN row_idx END) OVER (PARTITION BY invoice_id ORDER BY row_idx) AS head FROM l),
n AS (SELECT *, NOT line AND head IS NOT NULL AND length(name) >= 3 AND NOT regexp_matches(name, '\d[\d\s]*[,.]\d{2,3}') AS goes_on FROM m)"""


@query(
    "t14_table_lines",
    TABLE_LINES + """, more AS (SELECT invoice_id, head, string_agg(name, ' ' ORDER BY row_idx) AS more FROM n WHERE goes_on GROUP BY invoice_id, head),
k AS (SELECT n.*, more, CASE WHEN name <> '' THEN name WHEN pct <> '' THEN trim(substr(txt, length(pct) + 1)) WHEN own = '' THEN trim(substr(trim(txt), length(art) + 1)) ELSE trim(txt) END AS shown FROM n LEFT JOIN more ON more.invoice_id = n.invoice_id AND more.head = n.row_idx WHERE line)
SELECT invoice_id, row_idx AS line_no, coalesce(nullif(own, ''), art) AS code, 'table_structured' AS code_source, 0.95 AS code_score, nullif(own, '') AS code_pct, CASE WHEN pct <> '' THEN 'table_structured' WHEN own <> '' THEN 'inherited_pct' END AS code_pct_source, CASE WHEN pct <> '' THEN 0.92 WHEN own <> '' THEN 0.65 END AS code_pct_score,
  concat_ws(' ', shown, more) AS designation, 'table_structured' AS designation_source, 0.85 AS designation_score, nullif(q, '') AS quantite, CASE WHEN q <> '' THEN 'table_structured' END AS quantite_source, CASE WHEN q <> '' THEN 0.88 END AS quantite_score,
  CASE row_idx % 4 WHEN 1 THEN '12.5' WHEN 2 THEN '1000.25' ELSE '7.125' END AS prix_unitaire, 'table_structured' AS prix_unitaire_source, 0.9 AS prix_unitaire_score, q <> '' AS locked, txt AS raw_line FROM k""",
)
def t14(spark, sf_dir):
    lines, _ = T.table_lines(cells(spark, sf_dir), ["invoice_id"])
    return V.flat(lines, ["code", "code_pct", "designation", "quantite", "prix_unitaire"], ["invoice_id", "line_no", "locked", "raw_line"])


@query("t14_rejected_rows", TABLE_LINES + " SELECT invoice_id, row_idx, CASE WHEN goes_on THEN 'continuation_merged' ELSE 'invalid_code' END AS reason FROM n WHERE NOT line")
def t14_rejects(spark, sf_dir):
    return T.table_lines(cells(spark, sf_dir), ["invoice_id"])[1]


@query(
    "j20_header_mapping",
    GRIDS + """, f AS (SELECT invoice_id, count(*) AS n, sum(CAST(s0 AS DOUBLE)) AS h0, sum(CASE WHEN art = '' THEN 0 ELSE 1.0 END) AS h1, sum(CASE WHEN name = '' THEN 0 ELSE 1.0 END) AS h2, sum(CASE WHEN qte = '' THEN 0 ELSE 1.0 END) AS h3, sum(CASE WHEN price = '' THEN 0 ELSE 1.0 END) AS h4
  FROM s WHERE row_idx <= 4 GROUP BY invoice_id)
SELECT invoice_id, v.col_idx, v.name, round(CAST(1 + least(0.12, v.h / n * 0.04) AS DOUBLE), 4) AS score FROM f, LATERAL (VALUES (0, 'code_pct', h0), (1, 'code_article', h1), (2, 'designation', h2), (3, 'quantity', h3), (4, 'unit_price', h4)) AS v(col_idx, name, h)""",
)
def j20(spark, sf_dir):
    return T.mapped_headers(cells(spark, sf_dir), ["invoice_id"])


@query(
    "t20_word_rows",
    ctes("f_line") + """ SELECT invoice_id, 100 + line_no * 15 AS bin, v.lane, CASE v.lane WHEN 'code_pct' THEN code WHEN 'designation' THEN 'SOME DRUG' ELSE '7' END AS cell
  FROM f_line, (VALUES ('code_pct'), ('designation'), ('quantite')) AS v(lane)""".replace("100 +", "105 +"),
)
def t20(spark, sf_dir):
    own = frame(spark, sf_dir, "f_line")

    def word(left, t):
        return F.struct(F.lit(left).alias("left"), (F.lit(105 + 4) + F.col("line_no") * 15).cast("int").alias("top"), t.alias("text"))

    words = own.select("invoice_id", F.explode(F.array(word(60, F.col("code")), word(330, F.lit("SOME")), word(380, F.lit("DRUG")), word(700, F.lit("7")), word(2000, F.lit("far")))).alias("w")).select("invoice_id", "w.*")
    heads = own.select("invoice_id").distinct()
    top = heads.select("invoice_id", F.explode(F.array(*[F.struct(F.lit(x).alias("left"), F.lit(107).alias("top"), F.lit(t).alias("text")) for x, t in ((50, "Code"), (340, "Désignation"), (690, "Qté"))])).alias("w")).select("invoice_id", "w.*")
    return T.word_rows(top.unionByName(words), ["invoice_id"])


@query(
    "t21_layout_lines",
    ctes("f_line") + " SELECT invoice_id, line_no AS line, code || ' SOME ' || quantite AS line_text, CAST(190 AS DOUBLE) AS centre FROM f_line WHERE quantite <> ''",
)
def t21(spark, sf_dir):
    own = frame(spark, sf_dir, "f_line").where("quantite <> ''")
    words = F.array(*[F.struct(F.lit(x).alias("left"), F.lit(40).alias("width"), t.alias("text")) for x, t in ((300, F.col("quantite")), (40, F.col("code")), (120, F.lit("SOME")))])
    boxes = own.select("invoice_id", F.lit(1).alias("block"), F.lit(1).alias("par"), F.col("line_no").alias("line"), F.explode(words).alias("w")).select("invoice_id", "block", "par", "line", "w.*")
    return T.layout_lines(boxes, ["invoice_id"]).select("invoice_id", "line", "line_text", "centre")


@query(
    "a26_vendor_discovery",
    ctes("f_supplier") + " SELECT MF AS tax_id, 'Version 2 of ' || Nom AS name FROM f_supplier",
)
def a26(spark, sf_dir):
    s = frame(spark, sf_dir, "f_supplier")
    def version(k):
        return s.select(F.concat(F.lit(f"123\n Version {k} of "), "Nom", F.lit("\nM.F : "), F.regexp_replace("MF", "/", " / "), F.lit("\n")).alias("text"), F.concat(F.lit(f"file{k}-"), "Code").alias("file"))

    return T.discovered_vendors(version(2).unionAll(version(1)))


@query(
    "j16_known_vendors",
    ctes("f_supplier") + " SELECT IDFournisseur AS doc_id, CASE WHEN IDFournisseur % 5 <> 4 THEN Nom END AS vendor FROM f_supplier",
)
def j16(spark, sf_dir):
    """Tax ids of six, seven and eight digits; every fifth document shows none."""
    n = F.col("IDFournisseur")
    digits = F.when(n % 3 == 0, F.concat(F.lit("9"), F.lpad(n.cast("string"), 7, "0"))).when(n % 3 == 1, F.lpad(n.cast("string"), 6, "0")).otherwise(F.concat(F.lit("8"), F.lpad(n.cast("string"), 6, "0")))
    s = frame(spark, sf_dir, "f_supplier").withColumn("id", F.concat(digits, F.lit("A/P/M/000")))
    read = s.select(n.alias("doc_id"), F.concat(F.lit("MF:"), F.when(n % 5 != 4, F.col("id")).otherwise("0"), F.lit(" x")).alias("read_id"))
    return T.known_vendor(read, s.select(F.col("id").alias("tax_id"), F.col("Nom").alias("name"))).select("doc_id", "vendor")
