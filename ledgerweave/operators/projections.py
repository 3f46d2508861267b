"""Projections of open documents and lines: aliases, headers, typed metadata, candidates, coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import codes, dates, numbers, text

#: Header fields and the keys of a document that hold them.
HEADER = (
    ("invoice_number", "numero"), ("invoice_date", "date"), ("supplier_name", "fournisseur_nom"), ("supplier_mf", "supplier_mf"), ("address", "adresse"),
    ("tel", "tel"), ("fax", "fax"), ("email", "email"), ("document_type", "type"),
)
#: Line fields that hold numbers.
NUMERIC = ("quantite", "nb_crt", "u_crt", "prix_unitaire", "montant")


def picked(record: Column, *aliases: str) -> Column:
    """Value of the first alias that a map holds with something in it; case and outer blanks of its keys do not
    matter, and of keys that read alike the last counts."""

    def of(alias: str) -> Column:
        found = F.filter(F.map_entries(record), lambda e: F.lower(F.trim(e["key"])) == alias.lower().strip())
        return F.nullif(F.try_element_at(found, F.lit(-1))["value"], F.lit(""))

    return F.coalesce(*map(of, aliases))


def general_info(document: Column, family: Column) -> Column:
    """Struct of the header fields of a document map, blank where it has none, and the invoice family."""
    return F.struct(*[F.coalesce(F.try_element_at(document, F.lit(key)), F.lit("")).alias(name) for name, key in HEADER], F.coalesce(family, F.lit("")).alias("invoice_family"))


def typed_metadata(document: Column, fields: dict[str, str]) -> Column:
    """P5: JSON object as a struct of ``fields`` (name: type); unknown keys are ignored, blank texts are null."""
    read = F.from_json(document, ", ".join(f"{n} {t}" for n, t in fields.items()))
    return F.struct(*[(F.nullif(read[n], F.lit("")) if t == "string" else read[n]).alias(n) for n, t in fields.items()])


def candidates(lines: DataFrame, doc: str, most: int = 120) -> DataFrame:
    """Compact rows of a document's first lines. The code goes by its shape: five digits or more are a local
    code, PF in front makes an article code; numbers that cannot be read are 0."""
    at = F.row_number().over(Window.partitionBy(doc).orderBy("line_no")) - 1
    own = lines.withColumn("i", at).where(F.col("i") < most)
    pct, article = F.trim(F.coalesce("code_pct", F.lit(""))), F.trim(F.coalesce("code_article", F.lit("")))
    code = F.trim(F.coalesce(F.nullif(F.col("code"), F.lit("")), F.nullif(pct, F.lit("")), article))
    number = {c: F.coalesce(numbers.float_any_locale(F.col(c).cast("string")), F.lit(0.0)).alias(c) for c in ("quantite", "prix_unitaire", "montant")}
    return own.select(
        doc, "i", F.when((pct == "") & code.rlike(r"^\d{5,}$"), code).otherwise(pct).alias("code_pct"),
        F.when((article == "") & F.startswith(F.upper(code), F.lit("PF")), code).otherwise(article).alias("code_article"),
        text.stripped(F.coalesce("designation", F.lit(""))).alias("designation_article"), *number.values(),
    )


def coerced(field: Column, value: Column, as_of: Column) -> Column:
    """A value as its field wants it, as text: a number, a valid date, a normalised code; blank when it is none."""
    raw = text.stripped(F.coalesce(value, F.lit("")))
    return F.coalesce(
        F.when(raw == "", "").when(field.isin(*NUMERIC), numbers.float_any_locale(raw).cast("string"))
        .when(field == "date_peremption", dates.validated_date(dates.repaired_date(raw), as_of)).when(field.isin("code", "code_article"), codes.normalized_code(raw)).otherwise(raw),
        F.lit(""),
    )


def merged_aliases(base: DataFrame, hints: DataFrame) -> DataFrame:
    """Aliases ``(canon, place, alias)`` of both tables, a hint only where neither the base nor an earlier hint has
    it in any case; ``place`` counts on after the base."""
    known = base.select("canon", F.lower("alias").alias("low")).distinct()
    new = hints.withColumn("low", F.lower("alias")).join(known, ["canon", "low"], "left_anti").groupBy("canon", "low").agg(F.min(F.struct("place", "alias")).alias("h"))
    both = base.select("canon", F.lit(0).alias("side"), "place", "alias").unionAll(new.select("canon", F.lit(1), "h.place", "h.alias"))
    return both.select("canon", F.row_number().over(Window.partitionBy("canon").orderBy("side", "place", "alias")).alias("place"), "alias")


def words_left(after_code: Column, consumed: Column) -> Column:
    """Words after the code, currency marks dropped, without those at the ``consumed`` positions (from 0)."""
    words = F.filter(F.split(text.line_cleaned(after_code), r"\s+"), lambda w: w != "")
    return F.array_join(F.filter(words, lambda _, i: ~F.array_contains(consumed, i)), " ")
