"""SimHash near-duplicates through deletion variants of fingerprint halves (operator 4).

Fingerprint: words are runs outside ``[\\x20\\x09-\\x0D]`` of the text with A-Z lower-cased; every 3-word shingle
(repeats included; all words when there are fewer) is hashed by XXH64, seed 42; a bit is 1 when it is set in over
half of the hashes. No words: fingerprint 0, linked like any other.

Links: two fingerprints link at Hamming distance 2 or less. A 64-bit fingerprint is cut into two halves, so one
half differs by at most one bit. For each half and each bit place, the half with that bit deleted is an index key;
fingerprints that share a key are joined by equality and verified. A key shared by more than ``crowd`` fingerprints
is not paired out: its members instead meet at their one-bit neighbours (two fingerprints are within two bits exactly
when they share a neighbour or one is the other's), each neighbour linking its members to the smallest of them.
That costs 65 rows for a member however large the crowd, and loses no component.

Defined results: null text counts as empty; repeated rows come back as often as they occur; a row without doc_id is
linked like others but never names a component (the component_id is null when no member has an id); extra columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm.common import connected_components, freeze, lane_join, partitions_of
from ledgerweave.llm.jaccard_links import near_copies

HALF = (1 << 32) - 1


def fingerprint_words(words: list[bytes], width: int = 3, step: int = 1 << 15) -> int:
    """Majority bits of the shingle hashes, as a signed 64-bit integer; shingles are read in pieces of ``step``."""
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, step):
        h = np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(at, min(n, at + step))), dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint_words(t.encode().lower().split()) if t else 0 for t in batch], dtype="int64")


def deletion_keys(fp: Column) -> Column:
    """64 keys: for each half and bit place, the half without that bit, tagged by half and place."""
    def key(k: Column) -> Column:
        part = F.call_function("shiftrightunsigned", fp, F.lit(32) * (k >= 32).cast("int")).bitwiseAND(F.lit(HALF))
        i = k % 32
        low = part.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i) - 1)
        high = F.call_function("shiftleft", F.call_function("shiftright", part, i + 1), i)
        return high.bitwiseOR(low).bitwiseOR(F.call_function("shiftleft", k.cast("long"), F.lit(32)))

    return F.transform(F.sequence(F.lit(0), F.lit(63)), key)


def neighbours(fp: Column) -> Column:
    flipped = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(F.array(fp), flipped)


def links(fps: DataFrame, crowd: int = 8) -> DataFrame:
    """Edges (a, b) between the distinct values of ``fps(fp)`` whose components are those of all links."""
    # a fingerprint gives 64 keys: the small table is dealt out row by row before it grows
    spread = freeze(fps.select("fp"), "simhash-distinct").repartition(partitions_of(fps.sparkSession))
    variants = spread.select("fp", F.explode(deletion_keys(F.col("fp"))).alias("key"))
    shared = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = freeze(variants.join(shared.hint("merge"), "key"), "simhash-members")
    small = members.where(F.col("n") <= crowd).select("key", F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = small.hint("merge").join(small.withColumnRenamed("a", "b"), "key").where("a < b").where(near).select("a", "b")
    met = members.where(F.col("n") > crowd).select("fp").distinct().select("fp", F.explode(neighbours(F.col("fp"))).alias("z"))
    first = met.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("z", "a")
    hubs = met.join(first.hint("merge"), "z").select("a", F.col("fp").alias("b")).where("a < b").where(near)
    return pairs.unionAll(hubs).distinct()


def near_duplicates(docs: DataFrame, crowd: int = 8) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``."""
    prints = freeze(docs.select("doc_id", simhash("text").alias("fp"), F.monotonically_increasing_id().alias("row")), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(links(distinct.select("fp"), crowd))
    grouped = distinct.join(parts.select(F.col("node").alias("fp"), "component").hint("merge"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    grouped = freeze(grouped.select("fp", "root", "least"), "simhash-groups")
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    # a large component, and a fingerprint of many documents (all empty texts), are looked up in lanes
    of = freeze(lane_join(grouped, named, "root", F.col("fp")).select("fp", "component_id"), "simhash-named")
    return lane_join(prints, of, "fp", F.struct("doc_id", "row")).select("doc_id", "fp", "component_id")


def op4_simhash_deletion_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies stays (``jaccard_links``: five-word shingles, 0.8).

    Of a group stays the row with the smallest doc_id, null only where the whole group has none; then a null text and
    the hash of the text decide, and for equal rows the hash of all columns. Groups with the same or no doc_id are apart.
    Other columns pass through whatever their names.
    """
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    of = near_copies(docs.select("doc_id", row.alias("row"), "text"), ["doc_id"], links)
    kept = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")).select(F.col("best.row").alias("row"))
    out = docs.select(row.alias("row"), whole.alias("doc")).join(kept.hint("merge"), "row", "left_semi").groupBy("row").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return out.select("doc.*")
