import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from twinscope.llm import bpe, langid, quality, shared, simhash


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(shared.materialize(stage(spark, out[-1], sf), f"test-{name}"))
    return out


def test_each_stage_is_brute_force_on_its_input(spark, sf, stages):
    docs, named, good, exact, near, packed = ({tuple(r): r for r in s.collect()} if i < 5 else s.collect() for i, s in enumerate(stages))
    for s in stages[:5]:
        assert s.columns == stages[0].columns
    pred = {r.doc_id: r for r in langid.predict_languages(stages[0]).collect()}
    assert set(named) == {k for k, r in docs.items() if pred[r.doc_id].lang_pred != "und" and pred[r.doc_id].score >= 0.5}
    kept = {r.doc_id for r in quality.assess(stages[1], spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert set(good) == {k for k, r in named.items() if r.doc_id in kept}
    last = {}
    for r in good.values():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert set(exact) == {k for k, r in good.items() if last[r.text] == r.doc_id}
    # texts link if their fingerprints share a block of 16 bits and differ in few enough bits
    rows = sorted(exact.values(), key=lambda r: r.doc_id)
    fps = np.frombuffer(b"".join(simhash.fingerprint(r.text.encode(), 5, 512) for r in rows), "<u8").reshape(-1, 8)
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    blocks = fps.view(np.uint16)
    link = (far <= 82) & (blocks[:, None] == blocks[None]).any(axis=2)
    label = np.arange(len(rows))
    for _ in rows:  # the least label spreads until it rests
        label = np.where(link, label[None, :], len(rows)).min(axis=1)
    gone = {r.doc_id for i, r in enumerate(rows) if label[i] != i}
    assert set(near) == {k for k, r in exact.items() if r.doc_id not in gone}
    library = Tokenizer.from_file(bpe.default_path("byte_bpe_50k.json"))
    for r in near.values():
        own = sorted((p.start, bytes(p.ids)) for p in packed if p.doc_id == r.doc_id)
        assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == library.encode(r.text, add_special_tokens=False).ids + [0]


def test_run_is_the_stages(spark, sf, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(stages[-1])


def test_the_bound_is_that_of_a_similarity_of_eight_tenths():
    assert simhash.wide_bound(0.8) == 82


def test_stages_take_null_ids_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text, "en", 1, 2, 3, "a"), (None, text + " x y", "en", 1, 2, 3, "b"), (5, text + " q", None, 1, 2, 3, "c"), (5, "z " + text * 2, "en", 1, 2, 3, "d"), (6, None, None, 1, 2, 3, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __text int, __words int, row_digest int, __task string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or (out.columns == docs.columns and set(map(tuple, out.collect())) <= set(rows))
        assert out.count()


def test_stages_take_odd_rows(spark, tmp_path, odd_docs, no_docs):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            out.count()
