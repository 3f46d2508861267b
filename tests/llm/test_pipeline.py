import corpus_pipeline
from ledgerweave.llm import gam_quality as G
from ledgerweave.llm import piece_sampling as P
from ledgerweave.llm import sainte_lague_mix as M
from test_jaccard_links import brute_groups

SF = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        before, after = docs.collect(), out.collect()
        if name == "gam_quality":
            model = G.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            import numpy as np

            good = model.score(np.array([G.features(r.text) for r in before])) >= 0.5
            assert {r.doc_id for r in after} == {r.doc_id for r, g in zip(before, good, strict=True) if g}
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            clean = [i for i, q in labels.items() if q == 1]
            assert sum(i in {r.doc_id for r in after} for i in clean) >= 0.95 * len(clean)
        elif name == "simhash_near_dedup":
            before.sort(key=lambda r: r.doc_id)
            comp = brute_groups([r.text for r in before])
            assert {r.doc_id for r in after} == {before[c].doc_id for c in comp} and len(after) == len(set(comp))
        elif name == "sainte_lague_mix":
            plan = {r.doc_id: r.taken for r in M.taken_words(docs).collect()}
            words = {}
            for r in after:
                words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
            assert words == {i: t for i, t in plan.items() if t}
        else:
            pieces = P.load_pieces()
            assert len(after) == len(before)
            assert all(P.decode(r.pieces, pieces) == r.text and r.lossless for r in after)
        if name != "piece_sampling":
            assert out.columns == docs.columns
        kept[name] = len(after)
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == kept["piece_sampling"]
