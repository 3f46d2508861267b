"""KPIs, listings and log audit over run, submission and log tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import codes
from ledgerweave.operators import rollup


def kpis(runs: DataFrame, n_invoices: DataFrame, open_alerts: DataFrame) -> DataFrame:
    """A3: one row: successful runs that have pages and their mean seconds a page, the share of valid lines in the lines of
    all runs, and 0 where there is nothing to divide. Each input is aggregated to one row first, so the cross joins below
    join single rows."""
    good = (F.col("status") == "SUCCESS") & (F.col("page_count") > 0)
    none = F.lit(0.0)
    r = runs.agg(
        F.count_if(good).alias("n_runs"),
        F.coalesce(F.round(F.avg(F.when(good, F.col("duration_ms") / F.nullif(F.col("page_count"), F.lit(0)))) / 1000, 1), none).alias("seconds_a_page"),
        F.coalesce(F.round(F.sum("valid_count") / F.nullif(F.sum("line_count"), F.lit(0)) * 100, 1), none).alias("valid_pct"),
    )
    return r.crossJoin(n_invoices.agg(F.count("*").alias("n_invoices"))).crossJoin(open_alerts.agg(F.count("*").alias("open_alerts")))


def volume(runs: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """A4: runs of each day from ``days`` before ``as_of`` on, that day included, ascending."""
    day = F.to_date("run_at")
    recent = runs.where(day >= F.date_sub(F.lit(as_of).cast("date"), days))
    return recent.groupBy(day.alias("day")).agg(F.count("*").alias("n_runs")).orderBy("day")


def breakdown(runs: DataFrame) -> DataFrame:
    """A5: totals of the four status columns."""
    return runs.agg(*[F.coalesce(F.sum(f"{c}_count"), F.lit(0)).alias(c) for c in ("valid", "low_conf", "price_mismatch", "unknown")])


def breakdown_of_payloads(metadata: DataFrame, newest: int = 50) -> DataFrame:
    """Status counts in the JSON of the newest rows; broken JSON counts as no lines."""
    last = metadata.orderBy(F.desc("created_at"), F.desc("IDMeta")).limit(newest)
    lines = F.from_json("raw_json", "struct<product_lines:array<struct<validation_status:string>>>")["product_lines"]
    status = last.select(F.explode(lines).alias("l")).select(F.col("l.validation_status").alias("validation_status"))
    return status.agg(*rollup.status_aggregates(F.col("validation_status")))


def metrics(kpi: DataFrame, by_day: DataFrame, by_status: DataFrame, of_payloads: DataFrame) -> DataFrame:
    """(section, name, value) of the key figures, the daily volume and the status counts; runs without any count
    give way to the counts of the payloads. All but the volume are single rows."""

    def rows(df: DataFrame, section: str, named: dict[str, Column]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in named.items()])
        return df.select(F.lit(section).alias("section"), F.inline(pairs))

    other = {"valid": "n_valid", "low_conf": "n_low_confidence", "price_mismatch": "n_price_mismatch", "unknown": "n_unknown_product"}
    none = sum((F.col(c) for c in other), F.lit(0)) == 0
    status = by_status.crossJoin(of_payloads)
    return (
        rows(kpi, "kpi", {c: F.col(c) for c in kpi.columns}).unionAll(rows(status, "status", {c: F.when(none, F.col(p)).otherwise(F.col(c)) for c, p in other.items()}))
        .unionAll(by_day.select(F.lit("day"), F.date_format("day", "yyyy-MM-dd"), F.col("n_runs").cast("double")))
    )


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """L1-L4: one page; ``order`` has to end in a unique key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def searched(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """case-insensitive LIKE over columns; % and _ of the search text stay wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.ilike(F.col(c), F.lit(f"%{text}%")), F.lit(False))
    return df.where(hit)


def log_rows(raw: DataFrame) -> DataFrame:
    """Parsed rows of JSON lines (column value, and log_id as order); blank and malformed lines are skipped."""
    parsed = F.from_json("value", "struct<timestamp:string,level:string,message:string,context:map<string,string>>")
    return raw.withColumn("e", parsed).where(F.coalesce("e.timestamp", "e.level", "e.message").isNotNull()).select("log_id", F.col("value").alias("raw"), "e.*")


def audited(logs: DataFrame, severity: str | None, search: str) -> DataFrame:
    """severity exactly, free text over the whole serialised entry."""
    out = logs.where(F.upper("level") == severity.upper()) if severity else logs
    return out.where(F.contains(F.lower("raw"), F.lit(search.lower()))) if search else out


def history(invoices: DataFrame, metadata: DataFrame, alerts: DataFrame, owners: list[str]) -> DataFrame:
    """Invoices of the owners with their metadata rows (one or more), open alerts and status counts. Owners
    compare without regard to case and accents (Q5)."""
    open_alerts = alerts.where("not is_resolved").groupBy("invoice_id").agg(F.count("*").alias("open_alerts"))
    own = invoices.where(functools.reduce(lambda a, o: a | (codes.collated("owner") == codes.collated(F.lit(o))), owners, F.lit(False)))
    out = own.join(metadata, "invoice_id", "left").join(open_alerts, "invoice_id", "left")
    statuses = F.coalesce(F.transform(F.from_json("raw_json", "struct<product_lines:array<struct<validation_status:string>>>")["product_lines"], lambda l: l["validation_status"]), F.array().cast("array<string>"))
    out = out.withColumn("statuses", statuses).withColumn("open_alerts", F.coalesce("open_alerts", F.lit(0)))

    def held(status: str) -> Column:
        return F.size(F.filter("statuses", lambda x: x == status)).cast("long")

    counts = {f"n_{s.lower()}": held(s) for s in rollup.STATUSES}
    out = out.withColumns(counts | {"n_unchecked": F.size(F.filter("statuses", lambda x: x.isNull() | ~x.isin(*rollup.STATUSES))).cast("long")})
    return out.withColumn("invoice_status", rollup.invoice_status(F.col("open_alerts"))).drop("statuses", "raw_json")


def paged_with_total(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """Page totals next to the first page of each group."""
    w = Window.partitionBy(*keys)
    return df.withColumn("total", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(*order))).where(F.col("rn") <= size)
