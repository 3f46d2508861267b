"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables (operator 9).

1. Equal vectors of a label fold into one representative with a multiplicity, so copies are never paired out.
2. A rotation is learned by iterative quantisation on at most ``sample_rows`` representatives (those with the
   smallest seeded hashes): principal axes, then alternating sign codes and orthogonal Procrustes steps; each bit is
   cut at its sample median, which balances it. Sample vectors close to an earlier one are left out of the fit. Every representative is coded with it.
3. The code is cut into 8 bytes; each of the 28 pairs of bytes is a hash table. Vectors that share two bytes meet.
   All pairs within Hamming distance 6 are met for certain, and most beyond.
4. Vectors that meet are compared by their original components in double precision. Buckets above ``block`` rows are
   dealt to block pairs, so no task holds a hot bucket. A pair counts in the first table where it meets. Tasks emit a
   link count for each vector and a spanning forest, never the pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
label, link with nothing; vectors of different lengths do not link; every row is a vector of its own, so repeated
rows link with each other; a null vec_id names a component only if no member has an id; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm.common import connected_components, freeze, lane_join

TABLES = list(combinations(range(8), 2))
#: byte-equality mask -> the first table in which such a pair meets, or -1
FIRST = np.array([next((t for t, (i, j) in enumerate(TABLES) if m >> i & 1 and m >> j & 1), -1) for m in range(256)], dtype=np.int16)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def thinned(x: np.ndarray, close: float = 0.9, step: int = 1024) -> np.ndarray:
    """Drops vectors close to an earlier one, so that a dense cluster neither turns the axes nor draws the cuts."""
    keep = np.ones(len(x), dtype=bool)
    for at in range(0, len(x), step):
        near = x[at : at + step] @ x[: at + step].T >= close
        keep[at : at + step] = ~np.tril(near, at - 1).any(axis=1)
    return x[keep]


def fit_rotation(x: np.ndarray, bits: int = 64, rounds: int = 40, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Projection (d x bits) and cut points from unit vectors; bits past the dimension use seeded random directions."""
    x = thinned(x)
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    k = min(d, bits)
    centred = x - x.mean(axis=0)
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :k]
    v = centred @ axes
    turn = np.linalg.qr(rng.normal(size=(k, k)))[0]
    for _ in range(rounds):
        codes = np.where(v @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ v)
        turn = (left @ right).T
    w = np.hstack([axes @ turn, rng.normal(size=(d, bits - k))])
    return w, np.median(x @ w, axis=0)


def encode(x: np.ndarray, w: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.packbits(unit(x) @ w > cut, axis=1, bitorder="little").view("<i8")[:, 0]


def _rotations(reps: DataFrame, sample_rows: int, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A learned rotation for the most frequent vector length (driver data: at most sample_rows vectors)."""
    sizes = reps.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out = {}
    for r in sizes:
        pick = reps.where(F.size("embedding") == r.d).orderBy(F.xxhash64(F.lit(seed), "embedding"), "rid").limit(sample_rows)
        x = np.array([v[0] for v in pick.select("embedding").collect()], dtype=np.float64)
        out[r.d] = fit_rotation(unit(x), seed=seed)
    return out


def _coder(rotations: dict, seed: int):
    @F.pandas_udf(T.LongType())
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = dict(rotations)
        for vectors in batches:
            out = np.zeros(len(vectors), dtype=np.int64)
            sizes = vectors.map(len).to_numpy()
            for d in np.unique(sizes):
                if d not in known:  # a rare length: seeded random directions
                    known[d] = (np.random.default_rng([seed, int(d)]).normal(size=(d, 64)), np.zeros(64))
                at = np.flatnonzero(sizes == d)
                out[at] = encode(np.stack(vectors.iloc[at].to_list()), *known[d])
            yield pd.Series(out)

    return code


def table_keys(code: Column) -> Column:
    def byte(i: int) -> Column:
        return F.shiftrightunsigned(code, 8 * i).bitwiseAND(F.lit(255))

    return F.array(*[(F.lit(t << 16) + F.shiftleft(byte(i), 8) + byte(j)).cast("int") for t, (i, j) in enumerate(TABLES)])


def _compare(group: np.ndarray, rows: dict, threshold: float, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Links and spanning labels of rows sorted by group; only pairs of one group are compared."""
    n = len(group)
    counts, lab = np.zeros(n, dtype=np.int64), np.arange(n)
    ends = np.searchsorted(group, group, side="right")
    later = ends - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(later)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + step, side="right")) - 1)
        left = np.repeat(np.arange(at, to), later[at:to])
        right = left + 1 + np.arange(len(left)) - np.repeat(total[at:to] - total[at], later[at:to])
        same = (np.ascontiguousarray(rows["code"][left] ^ rows["code"][right]).view(np.uint8).reshape(-1, 8) == 0) if len(left) else np.zeros((0, 8), bool)
        first = FIRST[np.packbits(same, axis=1, bitorder="little")[:, 0]] if len(left) else np.zeros(0, int)
        ok = (first == rows["table"][left]) & (rows["cross"][left] == (rows["block"][left] != rows["block"][right]))
        left, right = left[ok], right[ok]
        near = np.einsum("ij,ij->i", rows["x"][left], rows["x"][right]) >= threshold
        left, right = left[near], right[near]
        np.add.at(counts, left, rows["m"][right])
        np.add.at(counts, right, rows["m"][left])
        found.append((left, right))
        at = to
    left, right = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, int) for i in (0, 1))
    while len(left):
        low = np.minimum(lab[left], lab[right])
        before = lab.copy()
        np.minimum.at(lab, left, low)
        np.minimum.at(lab, right, low)
        lab = lab[lab]
        if (lab == before).all():
            break
    return counts, lab


def _matcher(threshold: float):
    schema = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def one(table: pa.Table) -> pa.RecordBatch:
        rid = table["rid"].to_numpy()
        group = table["g"].to_numpy()
        _, group = np.unique(group, return_inverse=True)  # rows come sorted by g, so this keeps their order
        vectors = table["embedding"].combine_chunks()
        d = len(vectors[0])
        x = unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(rid), d))
        rows = {k: table[k].to_numpy() for k in ("code", "table", "block", "m")} | {"cross": table["bi"].to_numpy() != table["bj"].to_numpy(), "x": x}
        counts, lab = _compare(group, rows, threshold)
        on = np.flatnonzero(counts)
        return pa.record_batch([pa.array(rid[on]), pa.array(counts[on]), pa.array(rid[lab[on]])], schema=schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts the sorted stream at group ends; a group is at most two blocks long."""
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows:
                # one vector length at a time: the sort key begins with it
                sizes, g = held["d"].to_numpy(), held["g"].to_numpy()
                end = int(np.argmax(sizes != sizes[0])) or held.num_rows
                if end == held.num_rows:
                    end = int(np.argmax(g == g[-1]))  # the last group may go on in the next batch
                    if not end:
                        break
                yield one(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield one(held)

    return match


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = 512, sample_rows: int = 8192, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, label)``."""
    rows = vectors.select("vec_id", "label", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    nonzero = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & finite & nonzero, F.lit(False))
    # equal vectors of a label are known by a 128-bit hash
    good = rows.where(usable).withColumn("twin", F.struct(F.xxhash64("label", "embedding").alias("h"), F.xxhash64(F.lit(seed), "embedding", "label").alias("k")))
    light = freeze(good.select("vec_id", "twin", F.monotonically_increasing_id().alias("row")), "itq-rows")
    reps = good.groupBy("twin").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("rid", F.monotonically_increasing_id())
    reps = freeze(reps, "itq-vectors")
    code = _coder(_rotations(reps, sample_rows, seed), seed)
    coded = freeze(reps.select("rid", "label", "m", "embedding", code("embedding").alias("code")), "itq-codes")

    entries = coded.select("rid", "label", F.size("embedding").alias("d"), "code", F.explode(table_keys(F.col("code"))).alias("key"))
    full = entries.groupBy("label", "d", "key").agg(F.count("*").alias("n")).where("n > 1")
    meet = entries.join(full.hint("merge"), ["label", "d", "key"]).withColumn("blocks", F.ceil(F.col("n") / block))
    meet = meet.withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
    dealt = meet.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    dealt = dealt.select(
        "rid", "label", "d", "key", "block", F.shiftright("key", 16).alias("table"),
        F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
    )
    dealt = dealt.join(coded.select("rid", "m", "code", "embedding").hint("merge"), "rid")
    dealt = dealt.withColumn("g", F.xxhash64("label", "d", "key", "bi", "bj"))
    sort = ["d", "g"]
    placed = dealt.repartition("d", "g").sortWithinPartitions(*sort)
    found = freeze(placed.select("rid", "d", "g", "code", "table", "block", "bi", "bj", "m", "embedding").mapInArrow(_matcher(threshold), "rid long, links long, root long"), "itq-links")

    parts = connected_components(found.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    named = reps.select("rid", "twin", "least", "m")
    named = named.join(links.hint("merge"), "rid", "left").join(parts.withColumnRenamed("node", "rid").hint("merge"), "rid", "left")
    named = freeze(named.select("twin", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("root")), "itq-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # a large component, and a vector with very many copies, are looked up in lanes
    of = freeze(lane_join(named, least, "root", F.col("twin")).select("twin", "n_links", "component_id"), "itq-twins")
    linked = lane_join(light, of, "twin", F.col("row")).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_itq_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
