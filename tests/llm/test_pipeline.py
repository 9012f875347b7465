import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from strandlake.llm import common, decontaminate, mixing, near_duplicates, quality_pu

SF = "/root/testdata/sf0.001"


def test_each_stage_takes_effect_and_keeps_the_columns(spark):
    docs = common.table(spark, SF, "documents")
    columns, before = docs.columns, docs
    scores = {r.doc_id: r.predicted for r in quality_pu.quality(docs, common.table(spark, SF, "labels")).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.saved(stage(spark, before, SF))
        assert after.columns == columns and [t for _, t in after.dtypes] == [t for _, t in docs.dtypes], name
        old, new = ({r.doc_id: r.text for r in d.collect()} for d in (before, after))
        if name == "quality":
            assert set(new) == {k for k in old if scores[k]}
        elif name == "near_duplicates":
            assert set(new) == {r.doc_id for r in near_duplicates.near_duplicates(before).collect() if r.doc_id == r.component_id}
        elif name == "decontamination":
            assert not decontaminate.search(after, common.table(spark, SF, "benchmark")).where("n_hit > 0").count()
            hit = {r.doc_id for r in decontaminate.search(before, common.table(spark, SF, "benchmark")).where("n_hit > 0").collect()}
            assert hit and all(new[k] == old[k] for k in old if k not in hit)
        else:
            taken = {r.doc_id for r in mixing.mix(before).collect() if r.taken}
            assert set(new) == taken
        before = after
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = sorted((r.doc_id, r.text) for r in before.collect())
    out = corpus_pipeline.write_tokens(spark, before, SF).orderBy("start").collect()
    at = 0
    for (doc_id, text), r in zip(texts, out, strict=True):
        n = len(t.encode(text, add_special_tokens=False).ids) + 1
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, at, n)
        at += n


def test_run_and_empty_table(spark, tmp_path):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 20
    for t in ("documents", "labels", "benchmark"):
        common.table(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
