"""Per-invoice aggregates of reconciled lines. One grouped aggregate each, with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import codes, dates
from ledgerweave.operators.reconcile import Settings

STATUSES = ("VALID", "LOW_CONFIDENCE", "PRICE_MISMATCH", "UNKNOWN_PRODUCT")


def status_aggregates(status: Column) -> list[Column]:
    """A1: one count for each status; anything else counts as unchecked."""
    named = [F.count_if(status == s).alias(f"n_{s.lower()}") for s in STATUSES]
    return [F.count("*").alias("n_lines"), *named, F.count_if(~F.coalesce(status, F.lit("")).isin(*STATUSES)).alias("n_unchecked")]


def status_counts(lines: DataFrame, key: str = "invoice_id") -> DataFrame:
    return lines.groupBy(key).agg(*status_aggregates(F.col("validation_status")))


def invoice_status(open_alerts: Column | None = None) -> Column:
    """A2: open alerts or price gaps first, then lines of low confidence or of unknown products; unchecked lines hold nothing up."""
    wrong = F.col("n_price_mismatch") > 0
    if open_alerts is not None:
        wrong = wrong | (open_alerts > 0)
    return F.when(wrong, "DISCREPANCY").when((F.col("n_low_confidence") > 0) | (F.col("n_unknown_product") > 0), "NEEDS_REVIEW").otherwise("VALIDATED")


def with_status(counts: DataFrame) -> DataFrame:
    return counts.withColumn("invoice_status", invoice_status())


def review_score(score: Column) -> Column:
    """Mean confidence as a percentage with one decimal; scores above 1 are percentages already."""
    mean = F.avg(F.coalesce(score, F.lit(0.0)))
    return F.coalesce(F.round(F.when(mean <= 1, mean * 100).otherwise(mean), 1), F.lit(0.0))


def summaries(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """One row for each invoice: key, date, total (stated unless zero), score, counts."""
    sums = lines.groupBy("invoice_id").agg(
        *status_aggregates(F.col("validation_status")), review_score(F.col("score")).alias("review_score_pct"), F.sum(F.col("qty") * F.coalesce("display_price", F.lit(0.0))).alias("lines_total")
    )
    out = heads.join(sums, "invoice_id")
    total = F.coalesce(F.nullif(F.col("stated_total"), F.lit(0.0)), F.round("lines_total", 3))
    return out.withColumns({"lib_facture": codes.invoice_key(F.col("numero")), "invoice_date": dates.invoice_date(F.col("date")), "total_ht": total}).drop("numero", "date", "stated_total", "lines_total")


def price_alerts(lines: DataFrame, settings: Settings) -> DataFrame:
    """Invoices whose price gaps reach the threshold share of their total."""
    bad = F.col("validation_status") == "PRICE_MISMATCH"
    sums = lines.groupBy("invoice_id").agg(
        F.count_if(bad).alias("n_mismatch"),
        F.sum(F.when(bad, F.abs(F.col("ocr_price") - F.col("erp_price")) * F.col("qty")).otherwise(0.0)).alias("impact"),
        F.sum(F.col("qty") * F.coalesce("display_price", F.lit(0.0))).alias("total"),
    )
    pct = F.col("impact") / F.col("total") * 100
    hit = F.lit(settings.alert_enabled) & (F.col("n_mismatch") > 0) & (F.col("total") > 0)
    return sums.where(hit).withColumn("impact_pct", pct).where(F.col("impact_pct") >= settings.alert_threshold_pct)


def upload_warnings(counts: DataFrame) -> DataFrame:
    """A12."""
    message = F.format_string("%d price mismatch(es), %d unknown product(s)", "n_price_mismatch", "n_unknown_product")
    return counts.where("n_price_mismatch > 0 or n_unknown_product > 0").select("invoice_id", message.alias("message"))


def alert_details(lines: DataFrame, most: int = 10) -> DataFrame:
    """Mismatch lines of an invoice, the first ten in line order spelled out."""
    from pyspark.sql import Window

    bad = lines.where("validation_status = 'PRICE_MISMATCH'").withColumn("rn", F.row_number().over(Window.partitionBy("invoice_id").orderBy("line_no")))
    gap = F.abs(F.col("ocr_price") - F.col("erp_price")).cast("decimal(12,3)").cast("string")
    detail = F.struct("rn", F.concat_ws(" ", "code", gap).alias("d"))
    listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= most, detail))), lambda x: x["d"])
    return bad.groupBy("invoice_id").agg(F.count("*").alias("n_mismatch"), F.array_join(listed, "; ").alias("first_details"))


def dashboard_tile(lines: DataFrame, keys: list[str]) -> DataFrame:
    """A25."""
    return lines.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("validation_status") == "VALID").alias("n_valid"), F.floor(F.avg("score") * 100 + 0.5).alias("confidence_pct")
    )
