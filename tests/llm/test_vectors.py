"""Lattice hashing against all pairs, and the pipeline end to end."""

import os

import numpy as np
import pytest

from factweave.llm import embedding_dedup


def test_e8_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) * 2
    point = embedding_dedup.nearest_e8(x)
    around = embedding_dedup.neighbours_e8()
    assert len(around) == 240 and np.allclose((around**2).sum(1), 2)
    near = ((x - point) ** 2).sum(1)
    assert (near <= 1 + 1e-9).all()  # the covering radius
    for v in around:
        assert (near <= ((x - point - v) ** 2).sum(1) + 1e-9).all()


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32))
    x = np.concatenate([c + rng.normal(size=(8, 32)) * s for c, s in zip(centres, np.linspace(0.01, 0.4, 30), strict=True)]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(500, rows[0][1], 1), (501, [2 * v for v in rows[0][1]], 1), (502, None, 0), (503, [0.0] * 32, 0), (504, [float("nan")] + [1.0] * 31, 0), (505, [None] + [1.0] * 31, 0), (506, [], 0), (507, [1.0] * 5, 0), (508, [1.0] * 5, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, weight int")
    got = {r.vec_id: r for r in embedding_dedup.dedup(df).collect()}
    assert len(got) == len(rows)
    full = np.concatenate([x, x[:1], 2 * x[:1]]).astype(np.float64)
    ids = [*range(len(x)), 500, 501]
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.99 * near.sum() and all(got[i].n_links <= n for i, n in zip(ids, near.sum(1), strict=True))
    assert got[500].component_id == got[501].component_id == got[0].component_id == 0
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(502, 507))
    assert (got[507].n_links, got[508].component_id) == (1, 507)
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_pipeline(spark):
    import corpus_pipeline
    from factweave.llm import minhash_dedup, secret_scan, sentencepiece_codec
    from factweave.llm._shared import materialize, table

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, d), "test")
        if k < 4:
            assert out.columns == names
        if k == 1:
            kept = {r.doc_id for r in minhash_dedup.dedup(docs).where("kept").collect()}
            assert {r.doc_id for r in out.collect()} == kept and out.count() == len(kept)
        if k == 2:
            assert {r.doc_id: r.text for r in out.collect()} == {r.doc_id: secret_scan.blank_out(r.text) for r in docs.collect()}
        if k == 3:
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        if k == 4:
            c = sentencepiece_codec.codec(corpus_pipeline.tokenizer_path("piece_bpe_32k.model"))
            want = sorted(len(c.library.encode(r.text or "")) + 1 for r in docs.collect())
            assert sorted(r.n_tokens for r in out.collect()) == want
        docs = out


def test_doubles_beyond_single_numbers_keep_their_links(spark):
    rows = [(1, [1e-50, 1e-50]), (2, [1.0, 1.0]), (3, [1e300, 2.0]), (4, [1e39, 1.0]), (5, [0.0, 0.0]), (6, [-1.0, 1.0]), (7, None)]
    got = embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


def test_rows_of_one_id_have_links_of_their_own(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0, 0.01]), (4, [0.0, 1.0, 0.0]), (1, [0.0, 1.0, 0.01]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 2.0])]
    got = embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id) == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 1)]
    assert [r.n_links for r in got if r.vec_id is None] == [1, 1]


def test_large_cells_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=32) + rng.normal(size=(600, 32)) * 0.08).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    whole = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup(df).collect()}
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup(df).collect()} == whole
    assert sum(n for n, _ in whole.values()) > 300_000
