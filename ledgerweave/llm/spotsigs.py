"""SpotSigs document fingerprints in DataFrame functions only (operator 7).

A spot is a common word (anchor) directly before a content word; its signature is a 32-bit hash of the anchor and
the chain of the two content words that follow, anchors between them skipped. An anchor followed by another anchor
leaves the spot to the later one. The fingerprint is the sorted set of a text's signatures, written as 8 hex digits
each. A text without spots is signed by the chains of its content words, and one without such chains by itself, so no
set is empty and only equal sets print alike.

Likeness is the Jaccard index of two sets. Sets fall into length classes whose bounds grow by 1 / floor; classes more
than one apart cannot reach ``floor``, nor can sizes whose ratio is below it, and both are settled without looking at
the sets. With floor 0 every pair is measured.

The next document comes from ranges of doc_id: bounds are quantiles, each range is sorted once, and the first row of a
range is copied to the end of the range before it, so no task sees all rows.

Defined results: null text is empty; repeated doc_ids follow each other by text; a row without doc_id has no place in
that order and is its own next document; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import partitions_of

#: Frequent function words of English, German, French and Spanish.
ANCHORS = (
    "the of and to a in is that it for was on with be by as this are at from "
    "der die und in den von zu das mit sich auf des für ist nicht dem im ein als eine "
    "de la le et les des en un du une que pour est qui par dans sur au pas avec "
    "de la que el en y los se del las por un no con su una es para al lo"
).split()


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and gives it to ``body``."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit signatures (as long) of a text."""
    anchors = sorted(set(ANCHORS))

    def sign(*parts: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*parts), 32)

    def of_words(w: Column) -> Column:
        content = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: ~F.get(w, i).isin("", *anchors))
        return let(content, lambda c: of_content(w, c))

    def of_content(w: Column, c: Column) -> Column:
        def spot(p: Column, j: Column) -> Column:
            anchored = (F.coalesce(F.get(c, j - 1), F.lit(-1)) < p - 1) & (F.get(w, p - 1) != "") & F.get(c, j + 1).isNotNull()
            return F.when(anchored, sign(F.get(w, p - 1), F.get(w, p), F.get(w, F.get(c, j + 1))))

        def chain(p: Column, j: Column) -> Column:
            return F.when(F.get(c, j + 1).isNotNull(), sign(F.get(w, p), F.get(w, F.get(c, j + 1))))

        return let(F.array_compact(F.transform(c, spot)), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array_compact(F.transform(c, chain))))

    found = let(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), of_words)
    return let(found, lambda s: F.when(F.size(s) > 0, F.sort_array(F.array_distinct(s))).otherwise(F.array(sign(text))))


def printed(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def length_class(sigs: Column, floor: float) -> Column:
    return F.floor(F.log(F.size(sigs).cast("double")) / F.lit(-math.log(floor)))


def jaccard(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Likeness of two signature sets; 0 where length alone shows that it is below ``floor``."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    full = let(shared, lambda s: s / (F.size(a) + F.size(b) - s))
    if not floor:
        return full
    apart = F.abs(length_class(a, floor) - length_class(b, floor)) > 1
    short = F.least(F.size(a), F.size(b)) < F.greatest(F.size(a), F.size(b)) * floor
    return F.when(apart | short, F.lit(0.0)).otherwise(full)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the key, looked up in two steps."""
    step = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    heads = [r[0] for r in rows[1:]]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= key))

    empty = F.array().cast("array<bigint>")
    row = below(F.array(*[F.lit(h).cast("long") for h in heads]) if heads else empty)
    table = F.array(*[F.array(*[F.lit(b).cast("long") for b in r]) if r else empty for r in rows])
    return (row * step + below(F.get(table, row))).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): ascending doc_id, the first following the last."""
    # more ranges than tasks, so that tasks come out even
    n = 4 * partitions_of(docs.sparkSession)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = base.where("doc_id is not null")
    cuts = placed.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    placed = placed.withColumn("bucket", _bucket(F.col("doc_id"), sorted(set(cuts))))
    # one id for each range
    firsts = {r.bucket: r.first for r in placed.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect()}
    used = sorted(firsts)
    before = {firsts[b]: used[i - 1] for i, b in enumerate(used)}
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    copies = placed.where(F.col("doc_id").isin(*before)).withColumn("bucket", to[F.col("doc_id")]) if before else placed
    rows = placed.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))
    order = Window.partitionBy("bucket").orderBy("copy", "doc_id", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("sigs", signatures(F.col("text")))
    rows = rows.withColumn("next_sigs", F.lead("sigs").over(order)).where("copy = 0")
    alone = base.where("doc_id is null").withColumn("next_text", F.col("text")).withColumn("sigs", signatures(F.col("text"))).withColumn("next_sigs", F.col("sigs"))
    names = ["doc_id", "text", "sigs", "next_text", "next_sigs"]
    return rows.select(*names).unionByName(alone.select(*names))


def fingerprints(docs: DataFrame, floor: float = 0.0) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that of the next document."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sigs")).alias("fingerprint"),
        printed(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs"), floor).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs"), floor).alias("near_next"),
        F.size("sigs").alias("n_signatures"),
    )


def op7_spotsigs(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
