"""The registered queries over tables of edge cases: nulls, empty and very long texts, repeated rows, further columns; and over empty tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factweave.llm.queries import QUERIES

LONG = "A very long text, with $1 and words that go on. " * 30_000 + "\n".join(f"line {k} token = abcdefgh{k}" for k in range(3000))
GOOD = "good plain words about nothing in particular, then " + " ".join(f"item{k} is here" for k in range(20))
TEXTS = [None, "", " ", "\n\n", "one", "two words", LONG, LONG + " end", "same text of more than five words here", "same text of more than five words here", "Ünïcödé ñandú 日本語の文章 😀", "x" * 50_000, "<|endoftext|> ▁mark", "a\x00b   c", "password = hunter2hunter2 " * 50, GOOD, "BUY $$ NOW ### " * 40]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, signature string, word string, rate double"
PAGES = "page_id long, url string, html string, host int, text string, slice string"


def write(spark, where, texts):
    long_id = 1 << 40
    rows = [(k if k else None, t, "en" if k % 3 else None, None, None if t is None else len(t), True, "s", "w", 0.5) for k, t in enumerate(texts)]
    rows += rows[3:6] + ([(long_id, GOOD, "fr", "s", 5, None, None, None, None)] if texts else [])
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{where}/documents.parquet")
    html = [(k if k else None, u, h, 1, "t", "s") for k, (u, h) in enumerate([(None, None), ("", ""), ("http://a.org/1", "<p>x"), ("http://a.org/1", "<p>x"), ("http://a.org/2", "<article>" + "<p>long line</p>" * 20_000), ("nothing", "<" * 5000), ("HTTP://EXAMPLE.org/es/é?q", "<div>" * 3000)] if texts else [])]
    spark.createDataFrame(html + html[2:4], PAGES).write.parquet(f"{where}/pages.parquet")
    labels = [(k, k % 2 if k != 5 else None, 0 if k != 4 else 1, "x") for k in range(len(texts))] + ([(None, 1, 1, "x"), (15, 1, 0, "x"), (15, 1, 0, "x"), (16, 0, 0, "x"), (10**9, 1, 0, "x")] if texts else [])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{where}/labels.parquet")
    vectors = [(k if k else None, v, 1) for k, v in enumerate([None, [], [0.0] * 8, [float("nan")] * 8, [1.0] * 8, [1.0] * 8, [2.0] * 8, [1e-30] * 8, [1e30] * 8, [None, *[1.0] * 7], [1.0] * 3, [-1.0] * 8] if texts else [])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{where}/embeddings.parquet")
    return rows, html + html[2:4], vectors


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("edges")
    return str(where), write(spark, where, TEXTS)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("nothing")
    write(spark, where, [])
    return str(where)


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "op11_phrase_mining"])
def test_every_row_has_one_result(spark, edges, name):
    where, (docs, pages, vectors) = edges
    got = QUERIES[name](spark, where).collect()
    n = int(name[2:].split("_")[0])
    table = pages if n in (2, 4) else vectors if n == 7 else docs
    assert len(got) == len(table)
    key = {2: "page_id", 4: "page_id", 7: "vec_id"}.get(n, "doc_id")
    assert sorted(str(r[key]) for r in got) == sorted(str(r[0]) for r in table)
    by: dict = {}
    for r in got:
        x = r.asDict()
        x.pop("start", None)
        by.setdefault(r[key], []).append(x)
    for twice in (3, 4, 5) if n not in (2, 4, 7) else ():
        assert len(by[twice]) == 2 and str(by[twice][0]) == str(by[twice][1])  # equal rows, equal results
    if n == 1:
        assert all(r.n_tokens == len((docs[r.doc_id][1] or "").split()) for r in got if r.doc_id and 0 < r.doc_id < 12)
        assert all(r.rate >= 0 and (r.copies >= r.rate - 1) for r in got)
    if n == 3:
        c = __import__("sentencepiece").SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        for r in got:
            ids = c.encode(docs[r.doc_id][1] or "", add_eos=True) if r.doc_id and r.doc_id < 20 else None
            assert ids is None or (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    if n == 4:
        assert {r.page_id: r.n_chars for r in got if r.page_id} == {1: 0, 2: 1, 3: 1, 4: 20_000 * 11 - 2, 5: 5000, 6: 0}
    if n == 6:
        at = {r.doc_id: r for r in got if r.doc_id is not None}
        assert at[7].component_id == 6 and at[9].component_id == 8 and at[1].n_shingles == 0 and at[4].n_shingles == 1
    if n == 7:
        at = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id}
        assert [at[k] for k in range(1, 12)] == [(0, 1), (0, 2), (0, 3), *[(4, 4)] * 5, (0, 9), (0, 10), (0, 11)]
    if n == 8:
        assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3) or r.doc_id is None} == {"und"} and all(0 <= r.score <= 1 for r in got)
    if n == 9:
        assert all(r.base_failed and not r.kept for r in got if r.doc_id in (1, 2, 3, 4, 5)) and next(r for r in got if r.doc_id == 15).kept
    if n == 10:
        e = __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
            if r.doc_id and r.doc_id < 20:
                assert r.ids_crc32 == zlib.crc32(np.array([*e.encode(docs[r.doc_id][1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables_give_empty_results(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


def test_phrases_over_edges(spark, edges):
    got = {(r.lang, r.phrase): r for r in QUERIES["op11_phrase_mining"](spark, edges[0]).collect()}
    assert {g for g, _ in got} <= {"en", "fr", "und"} and any(g == "und" for g, _ in got)
    assert all(r.a >= 10 and r.l >= r.a and r.r >= r.a and r.score <= 1_000_000 for r in got.values())


def test_pipeline_with_columns_of_the_names_it_uses(spark, edges, tmp_path):
    docs = spark.read.parquet(f"{edges[0]}/documents.parquet")
    for name in ("kept_id", "mixed_id", "copies", "copy", "row", "col"):
        docs = docs.withColumn(name, F.lit(7))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        docs = stage(spark, docs, edges[0])
        assert docs.columns[-6:] == ["kept_id", "mixed_id", "copies", "copy", "row", "col"]
        assert all(tuple(r)[-6:] == (7,) * 6 for r in docs.collect())


def test_pipeline_over_edges(spark, edges, nothing):
    where, (docs, _, _) = edges
    kept = {r.doc_id for r in corpus_pipeline.run(spark, where).collect()}
    # What the base rules reject or repeats another document is gone; the plain good text stays once.
    assert kept <= {r[0] for r in docs} and not kept & {1, 2, 3, 4, 5, 7} and 15 in kept and 1 << 40 not in kept
    assert corpus_pipeline.run(spark, nothing).count() == 0
