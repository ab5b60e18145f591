import corpus_pipeline

from tidelog.llm import near
from tidelog.llm.common import documents, labels, stored

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = documents(spark, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in labels(spark, SF).filter("toxic = 1").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stored(stage(spark, docs, SF), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns and after.count() <= docs.count()
            kept = {r["doc_id"] for r in after.collect()}
            if name == "exact_dedup":
                assert len({" ".join(texts[i].split()) for i in kept}) == len(kept)
            if name == "near_dedup":
                sets = {i: set(near.shingles(texts[i]).tolist()) for i in kept}
                ids = sorted(kept)
                assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b)
        else:
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == kept
        docs = after
    assert len(kept) > 0.5 * len(texts) and len(kept & toxic) < len(toxic)
