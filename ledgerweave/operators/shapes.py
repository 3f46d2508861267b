"""Row shapes of exports: mirrored quantities, family shapes, pruned columns, assembled documents, vendor grammars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import dates, numbers, text


def mirrored(rows: DataFrame) -> DataFrame:
    """The first quantity of three columns, whole numbers without decimals, in ``quantite`` and ``qty``."""
    first = F.coalesce(*[numbers.blank_to_null(F.col(c)) for c in ("quantite", "quantite_commande", "qty")], F.lit(""))
    q = numbers.coerced_quantity(F.col("__first"))
    # exploding a one-element array keeps a second pass from being written out inside the first, rule by rule
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("quantite", "qty")], F.explode(F.array(first)).alias("__first")).select(
        *[F.col(f"`{c}`") for c in rows.columns if c not in ("quantite", "qty")], F.explode(F.array(q)).alias("quantite")
    ).withColumn("qty", F.col("quantite"))


def family_shape(family: Column, rows: DataFrame) -> DataFrame:
    """Canonical rows under the column names of their family; columns of other families are null."""
    proforma, dated = family == "proforma_modele", family == "bc_pharmasud"
    return rows.select(
        "*", F.when(proforma, F.col("designation")).alias("designation_article"), F.when(dated, F.col("quantite")).alias("quantite_commande"),
        F.when(proforma | dated, F.col("code")).alias("code_pct"), F.when(~proforma & ~dated, F.col("code")).alias("code_simple"),
    )


def used_columns(rows: DataFrame, order: tuple[str, ...]) -> list[str]:
    """Columns that are not blank in some row: those of ``order`` first, then the others by name."""
    flags = rows.agg(*[F.max(F.coalesce(text.stripped(F.col(c).cast("string")) != "", F.lit(False))).alias(c) for c in rows.columns]).first()
    used = [c for c in rows.columns if flags[c]]
    return [c for c in order if c in used] + sorted(c for c in used if c not in order)


def positional(parsed: DataFrame, gate: DataFrame, original: DataFrame, doc: str) -> DataFrame:
    """By position, the gate's quantity unless the parsed one is locked, then the parsed one, then the
    original; where it came from is recorded."""
    g = gate.select(doc, "line_no", F.nullif(F.col("quantite"), F.lit("")).alias("g"))
    o = original.select(doc, "line_no", F.nullif(F.col("quantite"), F.lit("")).alias("o"))
    out = parsed.join(g, [doc, "line_no"], "left").join(o, [doc, "line_no"], "left")
    own = F.nullif(F.col("quantite"), F.lit(""))
    source = F.when(F.col("locked") & own.isNotNull(), "locked").when(F.col("g").isNotNull(), "gate").when(own.isNotNull(), "parser").when(F.col("o").isNotNull(), "original").otherwise("")
    q = F.coalesce(F.when(F.col("locked"), own), "g", own, "o", F.lit(""))
    return out.withColumns({"source": source, "quantite": q}).drop("g", "o")


def assembled(heads: DataFrame, lines: DataFrame, doc: str) -> DataFrame:
    """One export document for each header, its lines in order (none is an empty list)."""
    item = F.struct("line_no", "code", "quantite", "designation")
    items = lines.groupBy(doc).agg(F.sort_array(F.collect_list(item)).alias("line_items"))
    empty = F.array().cast("array<struct<line_no:int,code:string,quantite:string,designation:string>>")
    out = heads.join(items, doc, "left").withColumn("line_items", F.coalesce("line_items", empty))
    return out.withColumn("payload", F.to_json(F.struct(F.lit(2).alias("schema_version"), "line_items")))


DATE = r"[0-9OIlS]{2}[/.\-][0-9OIlS]{2}[/.\-][0-9OIlS]{4}"


def vendor_row(rest: Column, profile: Column) -> Column:
    """struct(designation, quantite, date_peremption, nb_crt) of what follows the code, by the vendor's row form."""

    def part(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(rest, pattern, i), F.lit(""))

    def row(d: Column, q: Column, date: Column | None = None, n: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        day = none if date is None else F.when(date.isNotNull(), dates.repaired_date(date))
        return F.struct(d.alias("designation"), q.alias("quantite"), day.alias("date_peremption"), (none if n is None else n).alias("nb_crt"))

    barred = rf"^(.+?)\s*\|\s*(\d{{1,5}})\s*\|\s*({DATE})\s*\|?\s*(\d{{1,5}})?\s*$"
    spaced = rf"^(.+?)\s+(\d{{2,5}})\s+({DATE})\s*(\d{{1,5}})?$"
    first, last = r"^(\d{1,5})\s+(?:[Xx×]\s*)?(.+)$", r"^(.+?)\s+(\d{1,5}(?:[,.]\d{1,3})?)\s*$"

    def has(pattern: str) -> Column:
        return F.regexp_like(rest, F.lit(pattern))

    return (
        F.when((profile == "pharmasud_medis") & has(barred), row(part(barred, 1), part(barred, 2), part(barred, 3), part(barred, 4)))
        .when((profile == "pharmasud_medis") & has(spaced), row(part(spaced, 1), part(spaced, 2), part(spaced, 3), part(spaced, 4)))
        .when(profile.isin("omnipharm_medis", "avenir_medis") & has(first), row(part(first, 2), part(first, 1)))
        .when((profile == "modele_proforma") & has(last), row(part(last, 1), part(last, 2)))
    )
