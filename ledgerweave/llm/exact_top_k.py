"""Exact top-k search by tiled matrix products (operator 13).

A vector becomes the integers floor(scale * x), x in double precision, and the score of two vectors is the inner product
of their integers. Queries (rows whose vec_id is a multiple of ``every``) are held in blocks of at most ``block`` rows;
all rows are dealt to cells by hash. A task holds one block of queries and streams the rows of its cell past it: each
Arrow batch is a tile whose products with the block are one matrix product, of which only the best k of every query are
selected and merged into its running list. The lists of a query then meet in a tree, ``FAN`` at a time.

Products run in double precision where the sizes of the components show that every sum is exact, and on Python integers
otherwise; a score beyond the range of long stops at its end.

Defined results: vectors that are null, empty, or hold null or non-finite components (also after scaling) take no part.
Vectors of different lengths are not scored against each other. A row is never its own candidate, but a repeated row is
a candidate like any other, and a repeated query is answered as often as it occurs. Ties go to the smaller vec_id, a null
vec_id last; a row without vec_id is no query. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import freeze, partitions_of

FAN = 16
EXACT = 1 << 49
TOP = "array<struct<down: long, unnamed: boolean, vec_id: long, row: long>>"


def integers(flat: np.ndarray, n: int, scale: float) -> np.ndarray:
    return np.floor(scale * flat.astype(np.float64)).reshape(n, -1)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of q and c, as long."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = [np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape) for x in (q, c)]
    limits = np.iinfo(np.int64)
    return np.clip(whole[0] @ whole[1].T, limits.min + 1, limits.max).astype(np.int64)


class Best:
    """The best k candidates of each query of a block so far."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, k: int):
        self.rows, self.q, self.k = rows, vectors, k
        none = np.zeros((len(rows), 0), dtype=np.int64)
        self.down, self.unnamed, self.vec_id, self.row = none, none.astype(bool), none, none

    def meet(self, c: np.ndarray, vec_id: np.ndarray, unnamed: np.ndarray, row: np.ndarray) -> None:
        """Scores a tile of candidates; ties within it go by their order."""
        order = np.lexsort((row, vec_id, unnamed))
        down = -products(self.q, c[order])
        vec_id, unnamed, row = vec_id[order], unnamed[order], row[order]
        n = len(row)
        own = row[None] == self.rows[:, None]
        take = min(self.k + 1, n)
        if n > take and np.abs(down).max(initial=0) < EXACT:
            # score and place in one number, so that the selection settles ties; one more, as the query itself may be among them
            mixed = down * n + np.arange(n)
            at = np.argpartition(mixed, take - 1, axis=1)[:, :take]
        elif n > take:
            at = np.argsort(down, axis=1, kind="stable")[:, :take]
        else:
            at = np.broadcast_to(np.arange(n), down.shape)
        parts = [np.take_along_axis(down, at, 1), unnamed[at], vec_id[at], row[at]]
        own = np.take_along_axis(own, at, 1)
        held = [self.down, self.unnamed, self.vec_id, self.row]
        down, unnamed, vec_id, row = (np.concatenate([a, b], axis=1) for a, b in zip(held, parts, strict=True))
        own = np.concatenate([np.zeros(self.down.shape, dtype=bool), own], axis=1)
        best = np.lexsort((row, vec_id, unnamed, down, own), axis=1)[:, : self.k]
        # a query's own row comes last; it is in the list only while there are fewer than k others
        self.down, self.unnamed, self.vec_id, self.row = (np.take_along_axis(x, best, 1) for x in (down, unnamed, vec_id, row))

    def lists(self) -> list[list[dict]]:
        out = []
        for r, *cols in zip(self.rows.tolist(), self.down.tolist(), self.unnamed.tolist(), self.vec_id.tolist(), self.row.tolist(), strict=True):
            out.append([{"down": d, "unnamed": u, "vec_id": None if u else v, "row": w} for d, u, v, w in zip(*cols, strict=True) if w != r])
        return out


def _searched(k: int, scale: float, step: int = 1 << 9):
    """Rows sorted by cell, the queries of a cell before its candidates, to (query_id, query, cell, top)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, vectors, best = None, [], [], [], []

        def block() -> list[Best]:
            x, r = np.concatenate(vectors), np.concatenate(rows)
            return [Best(r[i : i + step], x[i : i + step], k) for i in range(0, len(r), step)]

        def done() -> Iterator[pa.RecordBatch]:
            at = 0
            for b in best:
                names = np.concatenate(ids)[at : at + len(b.rows)]
                at += len(b.rows)
                cols = [pa.array(names), pa.array(b.rows), pa.array(np.full(len(b.rows), key[2], dtype=np.int32)), pa.array(b.lists(), pa.list_(pa.struct([("down", pa.int64()), ("unnamed", pa.bool_()), ("vec_id", pa.int64()), ("row", pa.int64())])))]
                yield pa.record_batch(cols, names=["query_id", "query", "node", "top"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(c).to_numpy() for c in ("d", "block", "cell", "kind")], axis=1).astype(np.int64)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(cell)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                now, part = tuple(cell[i, :3].tolist()), batch.slice(i, j - i)
                if now != key:
                    if key is not None:
                        yield from done()
                    key, ids, rows, vectors, best = now, [], [], [], []
                x = integers(part.column("embedding").flatten().to_numpy(zero_copy_only=False), j - i, scale)
                row = part.column("row").to_numpy()
                unnamed = np.asarray(part.column("vec_id").is_null())
                vec_id = part.column("vec_id").fill_null(0).to_numpy()
                if not cell[i, 3]:
                    ids.append(vec_id)
                    rows.append(row)
                    vectors.append(x)
                    continue
                best = best or (block() if rows else [])
                for b in best:
                    for t in range(0, len(x), 1 << 11):
                        b.meet(x[t : t + (1 << 11)], vec_id[t : t + (1 << 11)], unnamed[t : t + (1 << 11)], row[t : t + (1 << 11)])
        if key is not None:
            yield from done()

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, block: int = 1 << 14, cell: int = 1 << 12) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors(vec_id, embedding)``, rank from 1.

    ``block`` is the most queries a task holds; a cell gets about ``cell`` rows until there are four for each partition.
    """
    x = F.col("embedding")
    usable = F.size(x) > 0
    usable &= F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(usable, F.lit(False)))
    rows = freeze(rows.select("vec_id", "embedding", F.size(x).alias("d"), F.monotonically_increasing_id().alias("row")), "topk-rows")
    asked = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    n, queries = rows.agg(F.count("*"), F.count_if(asked)).first()
    blocks = max(1, -(-2 * queries // block)) if queries > block else 1
    parts = partitions_of(vectors.sparkSession)
    cells = max(1, min(4 * parts, -(-n // cell)), -(-n // (1 << 20)))
    spread = F.xxhash64(F.lit(5), "row")
    q = rows.where(asked).select("*", F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(0).alias("kind"))
    c = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(spread, F.lit(cells)).cast("int").alias("cell"), F.lit(1).alias("kind"))
    order = ["d", "block", "cell", "kind"]
    met = q.unionByName(c).repartition(max(parts, min(4096, blocks * cells)), "d", "block", "cell").sortWithinPartitions(*order)
    tops = met.mapInArrow(_searched(k, scale), f"query_id long, query long, node int, top {TOP}")
    while cells > 1:
        cells = (cells - 1) // FAN + 1
        merged = F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k)
        tops = tops.groupBy("query_id", "query", F.expr(f"node div {FAN}").cast("int").alias("node")).agg(merged.alias("top"))
    ranked = tops.select("query_id", F.posexplode("top").alias("pos", "t"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.down")).alias("score"))


def op13_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH whole AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, c.r AS other,
    list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM whole q, whole c WHERE q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, r ORDER BY score DESC, vec_id NULLS LAST, other)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
