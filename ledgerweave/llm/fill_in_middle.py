"""Fill-in-the-middle transformation by block rotations inside one buffer (operator 11).

A text of n code points has two cuts, h1 % (n + 1) and h2 % (n + 1), the smaller first, where h1 to h4 are the first
four 8-digit groups of the hex sha256 of ``<salt>:<doc_id>``. Prefix, middle and suffix are what they part. A text
that is empty or holds a sentinel stays plain, as does one with h3 % 100 >= ``plain_from``; otherwise
h4 % 100 < ``spm_below`` makes it spm, else psm.

The UTF-8 bytes go into a bytearray. One scan over the lead bytes finds where the cuts lie, the sentinels are inserted
(``<P>`` prefix ``<M>`` middle ``<S>`` suffix), and neighbouring segments are exchanged in place: each is reversed and
then both together, in swaps of at most ``STEP`` bytes. psm exchanges middle and suffix; spm prefix and middle with
the suffix. ``restored`` finds the sentinels in the output, undoes the same rotation and takes the sentinels out, so
it needs nothing but output and form.

Defined results: null text counts as empty; a null doc_id hashes as ``<salt>:``; repeated rows come out alike, once
each; other columns of the table are not read, whatever their names; an empty table gives no rows. Bytes that are not
UTF-8 are kept as they are, each lead byte one code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

P, S, M = b"<P>", b"<S>", b"<M>"
STEP = 1 << 16
SLICE = 4 << 20


def reverse(buf: np.ndarray, lo: int, hi: int) -> None:
    """Turns buf[lo:hi] round in place."""
    while hi - lo > 1:
        k = min(STEP, (hi - lo) // 2)
        left = buf[lo : lo + k].copy()
        buf[lo : lo + k] = buf[hi - k : hi][::-1]
        buf[hi - k : hi] = left[::-1]
        lo, hi = lo + k, hi - k


def rotate(raw: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchanges raw[lo:mid] with raw[mid:hi] by three reversals."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    reverse(buf, lo, mid)
    reverse(buf, mid, hi)
    reverse(buf, lo, hi)


def leads(raw: bytes | bytearray) -> np.ndarray:
    """Whether each byte begins a code point."""
    return (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80


def draws(doc_id, salt: int) -> list[int]:
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12)]


def apply(text: bytes, doc_id, salt: int = 1, plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    lead = leads(text)
    n = int(np.count_nonzero(lead))
    h1, h2, h3, h4 = draws(doc_id, salt)
    if not n or h3 % 100 >= plain_from or P in text or S in text or M in text:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = np.flatnonzero(lead)
    i, j = (int(at[k]) if k < n else len(text) for k in (first, second))
    raw = bytearray(text)
    raw[j:j] = S
    raw[i:i] = M
    raw[0:0] = P
    i, j = i + len(P), j + len(P) + len(M)
    form = "spm" if h4 % 100 < spm_below else "psm"
    rotate(raw, i if form == "psm" else 0, j, len(raw))
    return n, form, first, second - first, bytes(raw)


def invert(output: bytes, form: str) -> bytes:
    """The text that ``apply`` made the output of."""
    if form == "plain":
        return output
    raw = bytearray(output)
    if form == "psm":
        lo, mid = raw.index(S), raw.index(M)
    else:
        lo, mid = 0, raw.index(P)
    rotate(raw, lo, mid, len(raw))
    for mark in (S, M, P):  # from the last to the first
        k = raw.index(mark)
        del raw[k : k + len(mark)]
    return bytes(raw)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``SLICE`` bytes of a column."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        turn = np.cumsum(size, dtype=np.int64) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(i, j - i)


def _applied(salt: int, plain_from: int, spm_below: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            found = [apply(t or b"", d, salt, plain_from, spm_below) for t, d in zip(batch.column("text").to_pylist(), ids, strict=True)]
            n, form, prefix, middle, out = zip(*found, strict=True) if found else ((),) * 5
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())]
            yield pa.record_batch(cols, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, "output"):
        texts = [invert(o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
        yield pa.record_batch([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "restored"])


def fill_in_middle(docs: DataFrame, salt: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = read.mapInArrow(_applied(salt, plain_from, spm_below), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(rows: DataFrame) -> DataFrame:
    """Adds ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    names = [c for c in rows.columns if c != "restored"]
    kinds = ", ".join(f"`{c}` {'binary' if c == 'output' else rows.schema[c].dataType.simpleString()}" for c in names)
    read = rows.select(*[F.col(f"`{c}`").cast("binary").alias(c) if c == "output" else F.col(f"`{c}`") for c in names])
    out = read.mapInArrow(_inverted, f"{kinds}, restored binary")
    return out.withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    rows = restored(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE_SQL = """
WITH read AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, ('0x' || substr(h, 1, 8))::UBIGINT % (n + 1)::UBIGINT AS c1, ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1)::UBIGINT AS c2,
    ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS r3, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS r4 FROM read),
cut AS (SELECT doc_id, t, n, least(c1, c2)::BIGINT AS i, greatest(c1, c2)::BIGINT AS j,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= 90 THEN 'plain' WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, i) AS p, substr(t, i + 1, j - i) AS m, substr(t, j + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
