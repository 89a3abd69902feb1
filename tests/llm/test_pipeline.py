"""The pipeline against a brute-force version of its decisions, stage by stage
on what the stage before kept, and on edge rows."""

import corpus_pipeline
from labelsift.llm import fertility, mixing, secretscan, simhash
from labelsift.llm.common import table, written
from tests.conftest import SF01
from tests.llm.data import docs, edge_rows
from tests.llm.test_op5_bpe import wanted
from tests.llm.test_op7_simhash import plain_fp, roots


def test_every_stage_against_brute_force(spark):
    from tokenizers import Tokenizer
    from labelsift.llm import bpe
    d = table(spark, SF01, "documents")
    outs, cur = [], d
    for name, stage in corpus_pipeline.STAGES:
        cur = written(stage(spark, cur, SF01), name)
        outs.append(cur)
    for o in outs[:-1]:
        assert o.schema.simpleString() == d.schema.simpleString()
    text = {r.doc_id: r.text for r in d.collect()}
    # 1: the rules of op6
    good = {r.doc_id for r in fertility.judge(d).collect() if r.kept}
    assert sorted(r.doc_id for r in outs[0].collect()) == sorted(good)
    # 2: all pairs of what is left
    ids = sorted(good)
    root = roots([plain_fp(text[k]) for k in ids])
    firsts = [ids[r] for r in sorted(set(root))]
    assert sorted(r.doc_id for r in outs[1].collect()) == firsts
    # 3: spans replaced
    clean = {r.doc_id: r.text for r in outs[2].collect()}
    assert clean == {k: secretscan.redacted(text[k]) for k in firsts}
    assert all(not secretscan.scan_text(t)[0] for t in clean.values())
    # 4: rates
    rated = {r.doc_id: r for r in mixing.mix(outs[2], mixing.quality_domains(spark, SF01)).collect()}
    times = {r.doc_id: r["count"] for r in outs[3].groupBy("doc_id").count().collect()}
    for k, r in rated.items():
        assert abs(times.get(k, 0) - r.rate) <= 1 and (times.get(k) or r.domain in mixing.REDUCED)
    # 5: the library's ids
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    last = outs[4].collect()
    assert len(last) == sum(times.values())
    for r in last:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(lib, clean[r.doc_id])
        assert len(r.ids) == r.n_tokens


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF01)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_edge_rows_and_empty_tables(spark):
    for df in (docs(spark, edge_rows(), clash=True), docs(spark, edge_rows()).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF01)
            if name != "tokens":
                assert out.columns == df.columns
            assert out.count() >= 0
    assert simhash.keep_one_per_component(docs(spark, edge_rows())).count() > 0
