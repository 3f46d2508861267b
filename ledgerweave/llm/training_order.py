"""Training-order materialisation of token sequences (operator 2).

Token ids are UTF-8 bytes, one byte each; 0xFF (never in UTF-8) ends a document and 0xFE pads. The documents of an input
partition are packed end to end into sequences of ``TOKENS`` ids; only a partition's last one is padded. All sequences
are numbered in input order (counts of each input partition, then the place
in it), and a keyed Feistel permutation with cycle-walking gives each number a global slot: a pseudo-random order that
needs no sort by a random key and can be recomputed or inverted for any single sequence.

Shard i holds slots [i * per_shard, (i + 1) * per_shard). Sequences go straight to the partition of their shard, are
sorted by slot and written by Spark's committed text writer, whose line separator closes each record. So all records
have the same stride and the record of a slot starts at ``slot % per_shard * STRIDE`` of shard ``slot // per_shard``:
reading is sequential and resumes at any slot. A lost task is rewritten whole; the layout is written last.

Record: doc_id of the document its first id belongs to (8 bytes, big-endian), that id's place in the document (4),
number of ids (2, top bit: no doc_id), ids, separator. ``path-docs`` holds all documents of each record, as (doc_id,
start) by slot; it is kept beside the shards because thousands of short documents can meet in one record.

Defined results: null text is empty; an empty text is its end mark; repeated rows are documents of their own; extra columns are
not read; an empty table gives no shards. ``docs`` is scanned three times and must come in the same partitions and order
each time, as stored tables do (freeze other inputs first): the numbering is then fixed by the input files and the split
size, so reruns and retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import freeze, scratch_path

STRIDE, HEAD = 2048, 14
TOKENS = STRIDE - HEAD - 1
PAD, STOP = b"\xfe", b"\xff"


ROUNDS, WALKS = 6, 96


def _widths(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits - bits // 2, bits // 2


def _pass(x: Column, n: int, key: int) -> Column:
    """One Feistel pass over the next power of two; halves of unequal width swap places in each of six rounds."""
    wide, narrow = _widths(n)
    half = F.struct(F.shiftrightunsigned(x, narrow).alias("l"), x.bitwiseAND(F.lit((1 << narrow) - 1)).alias("r"))
    rounds = F.array(*[F.struct(F.lit(key + k).cast("long").alias("k"), F.lit((1 << (narrow if k % 2 else wide)) - 1).cast("long").alias("m")) for k in range(ROUNDS)])
    step = F.aggregate(rounds, half, lambda h, q: F.struct(h["r"].alias("l"), h["l"].bitwiseXOR(F.xxhash64(q["k"], h["r"]).bitwiseAND(q["m"])).alias("r")))
    return F.transform(F.array(step), lambda h: F.shiftleft(h["l"], narrow).bitwiseOR(h["r"]))[0]


def slot_of(index: Column, n: int, key: int) -> Column:
    """Slot of 0 <= index < n: passes are repeated until the value falls below n (under two on average; the chance
    that ``WALKS`` do not suffice is below 2**-96, and is an error)."""
    walked = F.aggregate(F.array(*[F.lit(0)] * WALKS), _pass(index, n, key), lambda y, _: F.when(y < n, y).otherwise(_pass(y, n, key)))
    return F.transform(F.array(walked), lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle-walking did not end")).cast("long")))[0]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents end to end to records of ``TOKENS`` ids; only a partition's last record is padded.

    A batch is held with what the one before left over, so memory is that of an Arrow batch.
    """
    rest, ids, starts = b"", [], np.zeros(0, dtype=np.int64)  # bytes left, and the documents in them

    def records(data: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        k = len(counts)
        doc = np.searchsorted(starts, np.arange(k) * TOKENS, side="right") - 1
        out = np.empty((k, HEAD + TOKENS), dtype=np.uint8)
        known = np.array([ids[d] is not None for d in doc], dtype=bool)
        out[:, 0:8] = np.array([ids[d] or 0 for d in doc], dtype=">i8").view(np.uint8).reshape(k, 8)
        out[:, 8:12] = (np.arange(k) * TOKENS - starts[doc]).astype(">i4").view(np.uint8).reshape(k, 4)
        out[:, 12:14] = (counts + np.where(known, 0, 1 << 15)).astype(">u2").view(np.uint8).reshape(k, 2)
        out[:, HEAD:] = data.reshape(k, TOKENS)
        ends = np.arange(k + 1, dtype=np.int32) * (HEAD + TOKENS)
        return pa.record_batch([pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(ends), pa.py_buffer(out.reshape(-1))])], names=["record"])

    for batch in batches:
        texts = [(t or b"") + STOP for t in batch.column("text").cast(pa.binary()).to_pylist()]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate([starts, len(rest) + np.cumsum(sizes) - sizes])
        ids += batch.column("doc_id").to_pylist()
        data = rest + b"".join(texts)
        k = len(data) // TOKENS
        if k:
            yield records(np.frombuffer(data, dtype=np.uint8, count=k * TOKENS), np.full(k, TOKENS))
        rest = data[k * TOKENS :]
        first = max(0, int(np.searchsorted(starts, k * TOKENS, side="right")) - 1)
        ids, starts = ids[first:], starts[first:] - k * TOKENS
    if rest:
        yield records(np.frombuffer(rest.ljust(TOKENS, PAD), dtype=np.uint8), np.array([len(rest)]))


def packed(docs: DataFrame) -> DataFrame:
    """(record, number) with number = input partition << 33 | place in it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack, "record binary")
    return rows.withColumn("number", F.monotonically_increasing_id())


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, doc_id, start) for every record of the partition and document with ids in it."""
    at = 0
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        begin = at + np.cumsum(sizes) - sizes
        at += int(sizes.sum())
        first = begin // TOKENS
        n = (begin + sizes - 1) // TOKENS - first + 1
        row = np.repeat(np.arange(len(n)), n)
        place = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield pa.record_batch([pa.array(place), batch.column("doc_id").take(pa.array(row)), pa.array(begin[row] - place * TOKENS)], names=["place", "doc_id", "start"])


SPLIT = "the input was split otherwise in another scan of it; write again"


def write_shards(docs: DataFrame, path: str, key: int = 31, shard_bytes: int = 32 << 20) -> dict:
    """Writes ``docs(doc_id, text)`` in training order under ``path``; returns the layout, also kept in ``path-layout``.

    The input is scanned three times. If Spark splits it otherwise in one of them (other cores, changed files), the counts
    of partitions no longer fit and the call raises instead of writing shards with wrong slots.
    """
    spark = docs.sparkSession
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    counts = freeze(docs.groupBy(F.spark_partition_id().alias("pid")).agg(F.ceil(F.sum(size) / TOKENS).cast("long").alias("n")), "shard-counts")
    n = counts.agg(F.sum("n")).first()[0] or 0
    upto = F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, 0))
    # one row of two numbers for each input partition: a proven bound for the broadcast
    ahead = F.broadcast(counts.select("pid", (upto - F.col("n")).alias("ahead"), "n"))

    def index(place: Column) -> Column:
        """Number of a record; every place below its partition's count, so records that are n in all have n numbers."""
        return F.when(place < F.col("n"), F.col("ahead") + place).otherwise(F.raise_error(F.lit(SPLIT)).cast("long"))

    shards = max(1, -(-n * STRIDE // shard_bytes))
    per = max(1, -(-n // shards))
    layout = {"path": path, "n": n, "per_shard": per, "stride": STRIDE, "key": key}
    rows = packed(docs).withColumn("pid", F.shiftright("number", 33).cast("int")).join(ahead, "pid", "left")
    rows = rows.withColumn("index", index(F.coalesce("number", F.lit(0)).bitwiseAND(F.lit((1 << 33) - 1))))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("size"))
    within = sized.mapInArrow(_places, "place long, doc_id long, start long").withColumn("pid", F.spark_partition_id())
    within = within.join(ahead, "pid", "left").withColumn("index", index(F.col("place")))
    held = within.groupBy("index").agg(F.sort_array(F.collect_list(F.struct("start", "doc_id"))).alias("d"))
    lists = F.transform("d", lambda d: F.struct(d["doc_id"].alias("doc_id"), d["start"].alias("start")))
    held.select(slot_of(F.col("index"), max(n, 1), key).alias("slot"), lists.alias("documents")).write.parquet(f"{path}-docs")
    rows = rows.select(slot_of(F.col("index"), max(n, 1), key).alias("slot"), "record")
    placed = rows.repartitionById(max(1, -(-n // per)), (F.col("slot") / per).cast("int")).sortWithinPartitions("slot")
    placed.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)
    written = spark.read.format("binaryFile").load(path).where(F.regexp_like("path", F.lit(r"part-\d+[^/]*$"))).agg(F.sum("length")).first()[0] or 0
    if written != n * STRIDE:
        raise RuntimeError(SPLIT)
    spark.createDataFrame([tuple(layout.values())], "path string, n long, per_shard long, stride int, key long").coalesce(1).write.json(f"{path}-layout")
    return layout


def _split_shards(per: int, stride: int):
    """Arrow function: whole shards to records, a slice of at most 64k records at a time."""
    names = ["slot", "shard", "offset", "doc_id", "doc_offset", "n_tokens", "tokens"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                rows = np.frombuffer(content.as_buffer(), dtype=np.uint8).reshape(-1, stride)
                for at in range(0, len(rows), 1 << 16):
                    r = rows[at : at + (1 << 16)]
                    place = np.arange(at, at + len(r), dtype=np.int64)
                    doc, seq, count = (np.ascontiguousarray(r[:, a:b]).view(t)[:, 0] for a, b, t in ((0, 8, ">i8"), (8, 12, ">i4"), (12, 14, ">u2")))
                    n = (count & 0x7FFF).astype(np.int32)
                    tokens = pa.array([x[:k] for x, k in zip(np.ascontiguousarray(r[:, HEAD : HEAD + TOKENS]).view(f"V{TOKENS}")[:, 0].tolist(), n.tolist(), strict=True)], pa.binary())
                    doc_ids = pa.array(doc.astype(np.int64), mask=count >= 0x8000)
                    numbers = (place + shard * per, np.full(len(r), shard, dtype=np.int64), place * stride)
                    yield pa.record_batch([*map(pa.array, numbers), doc_ids, pa.array(seq.astype(np.int32)), pa.array(n), tokens], names=names)

    return split


def read_shards(spark: SparkSession, layout: dict, first: int = 0) -> DataFrame:
    """Records from slot ``first`` on: slot, shard, offset, doc_id, doc_offset, n_tokens, tokens (bytes). Earlier shards
    are not opened."""
    per, stride = layout["per_shard"], layout["stride"]
    files = spark.read.format("binaryFile").load(layout["path"])
    shard = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1)
    files = files.where(F.regexp_like("path", F.lit(r"part-\d+[^/]*$")) & (F.col("length") > 0)).withColumn("shard", shard.cast("long")).where(F.col("shard") >= first // per)
    rows = files.select("shard", "content").mapInArrow(_split_shards(per, stride), "slot long, shard long, offset long, doc_id long, doc_offset int, n_tokens int, tokens binary")
    return rows.where(F.col("slot") >= first)


def record_documents(spark: SparkSession, layout: dict) -> DataFrame:
    """(slot, documents): the documents with ids in the record, in order. ``start`` is the place in the record of the
    document's first id, below 0 when it began in an earlier sequence."""
    return spark.read.schema("slot long, documents array<struct<doc_id: long, start: long>>").parquet(f"{layout['path']}-docs")


def op2_training_order(spark, sf_dir: str) -> DataFrame:
    layout = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "shards"))
    read = read_shards(spark, layout).withColumn("tokens_md5", F.md5("tokens")).drop("tokens")
    return read.join(record_documents(spark, layout).hint("merge"), "slot", "left")
