"""File sources and sinks with declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_FIELDS = (
    "code", "code_pct", "code_article", "designation", "designation_article", "unite_mesure", "quantite", "qty", "prix_unitaire", "montant", "quantite_commande", "nb_cartons",
    "unite_carton", "date_peremption", "raw_line",
)
EXPORT = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()), T.StructField("invoice_family", T.StringType()),
        T.StructField("document_metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("line_items", T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in LINE_FIELDS] + [T.StructField("line_confidence", T.DoubleType())]))),
    ]
)


def extraction_exports(spark: SparkSession, path: str) -> DataFrame:
    """S3: one row for each line of extraction exports (one JSON object a file, either version)."""
    docs = spark.read.schema(EXPORT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    return docs.select("file", F.coalesce("schema_version", F.lit(1)).alias("schema_version"), "invoice_family", "document_metadata", F.posexplode_outer("line_items").alias("line_no", "l")).select("file", "schema_version", "invoice_family", "document_metadata", "line_no", "l.*")


def write_exports(lines: DataFrame, keys: list[str], path: str) -> None:
    """Version-2 exports, nulls left out, a folder for each family."""
    item = F.struct("line_no", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in lines.columns if c in LINE_FIELDS], "line_confidence")
    docs = lines.groupBy(*keys, "invoice_family").agg(F.sort_array(F.collect_list(item)).alias("line_items"))
    docs.select("invoice_family", F.to_json(F.struct(F.lit(2).alias("schema_version"), *keys, F.col("invoice_family").alias("family"), "line_items")).alias("value")).write.partitionBy("invoice_family").text(path)


def write_extraction(tables: dict[str, DataFrame], root: str, batch: str) -> None:
    """Tables of one batch, each in its folder for the batch; the metadata table comes last as commit marker,
    so readers take only batches that have one."""
    for name in sorted(tables, key=lambda n: n == "metadata"):
        tables[name].write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def write_report(metrics: DataFrame, path: str) -> None:
    """A metric report, a row for each metric, as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of a table whose batch has its commit marker."""
    done = spark.read.parquet(f"{root}/metadata").select("batch").distinct()
    return spark.read.parquet(f"{root}/{name}").join(done, "batch", "left_semi")


def committed_or_empty(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """``committed`` with a declared schema and the batch as text; no rows where nothing was ever written."""
    kind = T.StructType.fromDDL(f"{schema}, batch string")
    try:
        done = spark.read.schema("batch string").parquet(f"{root}/metadata").distinct()
        return spark.read.schema(kind).parquet(f"{root}/{name}").join(done.hint("merge"), "batch", "left_semi").select(*kind.fieldNames())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def document_texts(pages: DataFrame, doc: str) -> DataFrame:
    """Page texts of each zone in page order: headers and full texts apart by a blank line, bodies by a line end."""
    parts = F.sort_array(F.collect_list(F.struct("page", "text")))
    joined = pages.groupBy(doc, "zone").agg(F.transform(parts, lambda p: p["text"]).alias("t"))
    return joined.select(doc, "zone", F.array_join("t", "\n").alias("tight"), F.array_join("t", "\n\n").alias("apart")).select(doc, "zone", F.when(F.col("zone") == "body", F.col("tight")).otherwise(F.col("apart")).alias("text"))
