from pyspark.sql import functions as F

from ledgerweave.llm import training_order as O


def test_every_document_of_a_record_is_listed(spark, tmp_path):
    rows = [(i, "ab " * (i * 37 % 150)) for i in range(300)] + [(None, "no id"), (5, None), (7, "")] + [(900 + i, "") for i in range(2500)] + [(-7, "x" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    parts = [[(r.doc_id, (r.text or "").encode() + O.STOP) for r in p] for p in df.rdd.glom().collect()]
    layout = O.write_shards(df, str(tmp_path / "s"), shard_bytes=40_000)
    slots = [r[0] for r in spark.range(layout["n"]).select(O.slot_of(F.col("id"), layout["n"], layout["key"])).collect()]
    got = {r.slot: [tuple(d) for d in r.documents] for r in O.record_documents(spark, layout).collect()}
    want, ahead = {}, 0
    for part in parts:
        at = 0
        for doc, ids in part:
            for k in range(at // O.TOKENS, (at + len(ids) - 1) // O.TOKENS + 1):
                want.setdefault(slots[ahead + k], []).append((doc, at - k * O.TOKENS))
            at += len(ids)
        ahead += -(-at // O.TOKENS)
    assert got == want and ahead == layout["n"]


def test_query_names_every_document(spark):
    sf = "/root/testdata/sf0.001"
    out = O.op2_training_order(spark, sf).collect()
    assert all(r.documents[0].doc_id == r.doc_id and -r.documents[0].start == r.doc_offset for r in out)
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {d.doc_id for r in out for d in r.documents} == ids
