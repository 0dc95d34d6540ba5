"""The dealt methods against brute force: differencing, mixing, alignment, forests, parsing, record files."""

import base64
import itertools
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from factweave.llm import html_text, language_id, minhash_dedup, record_files, secret_scan, sentencepiece_codec, source_mixing, url_filter


# ---- differencing


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def is_within(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


@pytest.mark.parametrize("bits", [1 << 26, 8])
def test_common_lines_are_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(html_text, "ALIGN_BITS", bits)
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        at = html_text.common_lines(a, b)
        assert at == sorted(set(at)) and len(at) == longest(a, b) and is_within([a[k] for k in at], b), (a, b, at)


def test_long_pages_are_quick():
    began = time.perf_counter()
    assert len(html_text.common_lines(["x", "y"] * 6000, ["y", "x", "x"] * 4000)) >= 8000
    html_text.Lines.of("<div>" * 20000 + "</i>" * 20000 + "<b>" * 20000 + "<p>x" * 20000)
    html_text.Lines.of("<div class=a>" * 20000 + "text" + "</div>" * 20000)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("page", ['<body class="post has-sidebar"><p>Own</p></body>', '<article class="post comments-open"><p>Own</p></article>', '<div class="page-with-sidebar"><article>Own</article></div>', '<main id="search">Own</main>', '<html class="no-ads"><body>Own<div class="ad-box">Buy</div>'])
def test_names_of_states_and_whole_pages_drop_nothing(page):
    assert html_text.difference(html_text.Lines.of(page), None)[0] == "Own"


def site_pages():
    rng = random.Random(8)
    rows = []
    for i in range(60):
        host = "a.org" if i % 3 else "b.org"
        lines = [f"Head of {host}", *(f"own {i} line {k} {rng.random()}" for k in range(rng.randrange(1, 5))), "Contact us today", "Fine print"]
        rows.append((i, f"http://{host}/{rng.choice('pq')}/{rng.randrange(40)}", "<body>" + "".join(f"<div>{x}</div>" for x in lines)))
    return rows + rows[:3] + [(None, None, None), (None, None, "<p>x"), (70, "http://a.org/p/1", None)]


def test_pages_meet_their_neighbours_whatever_the_partitions(spark):
    rows = site_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    mark = {(r.page_id, r.url, r.html): r.m for r in pages.withColumn("m", F.xxhash64("html")).collect()}
    split = lambda u: ("", "") if not u else (u.split("/")[2], "/" + "/".join(u.split("/")[3:]))
    order = sorted(rows, key=lambda r: (*split(r[1]), mark[r], r[0] is not None, r[0] or 0))
    want = []
    for k, r in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and split(order[j][1])[0] == split(r[1])[0]]
        near.sort(key=lambda x: -html_text._prefix(split(x[1])[1], split(r[1])[1]))
        text, shared = html_text.difference(html_text.Lines.of(r[2]), *(html_text.Lines.of(x[2]) for x in near))
        want.append((str(r[0]), str(r[1]), text, shared))
    assert sum(w[3] for w in want) > 60
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = [(str(r.page_id), str(r.url), r.text, r.n_shared_lines) for r in html_text.extract(pages).collect()]
            assert sorted(got) == sorted(want), parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "kept"),
    [
        ('<div class="content-sidebar-wrap"><main><article><p>text</p></article></main></div>', ["text"]),
        ('<div class="content-sidebar-wrap"><article><p>text</p></article></div>', ["text"]),
        ('<div class="comments"><article>no</article></div><article>yes</article>', ["yes"]),
        ('<div id="sidebar"><article>teaser</article></div><article>yes</article>', ["yes"]),
        ('<article><h2 id="search-trees">A</h2><h2 id="related-work">B</h2><section id="comments-on-the-draft"><p>C</p></section><p class="share-price">D</p></article>', list("ABCD")),
        ('<article>A<div class="share-buttons">no</div><section class="comments">no</section><div id="related-posts">no</div></article>', ["A"]),
        ('a < b &amp; c<br>d<p title="x>y">e<p>f<!-- no > --> g', ["a < b & c d", "e", "f g"]),
    ],
)
def test_names_drop_blocks_and_nothing_else(html, kept):
    assert [t for t, _, named in html_text.Lines.of(html) if not named] == kept


@pytest.mark.parametrize("bad", ['<a href="', "<!--", '<a x="1>" ', "<", "</", "<script>", "<a b='\">"])
def test_bad_markup_takes_linear_time(bad):
    began = time.time()
    html_text.Lines.of(bad * 30_000)
    html_text.Lines.of(bad * 30_000 + ">")
    assert time.time() - began < 2


def test_differencing_decides_where_markup_names_nothing(spark):
    menu, foot = "".join(f"<div>Section {k}</div>" for k in range(5)), "<div>All rights are ours.</div>"
    own = {k: [f"Page {k} says this.", f"And {k} says that."] for k in range(40)}
    rows = [(k, f"http://h.org/a/{k:02d}", menu + "".join(f"<div>{x}</div>" for x in lines) + foot) for k, lines in own.items()]
    rows += [(100 + k, "http://copies.org/x", "<div>One and the same.</div><div>Two lines.</div>") for k in range(9)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].text == "\n\n".join(lines) and got[k].n_shared_lines == 6 for k, lines in own.items())
    assert all(got[100 + k].text == "One and the same.\n\nTwo lines." for k in range(9))


# ---- mixing


def reference_fit(p, t, weights):
    """Coordinate ascent on the dual, slowly and surely, by bisection for each domain in turn."""
    mass = t @ p
    share = weights / weights.sum()
    target = share * (mass / share).min()
    s = np.zeros(p.shape[1])
    for _ in range(4000):
        was = s.copy()
        for d in range(len(s)):
            rest = 1 - p @ s + p[:, d] * s[d]
            slope = lambda x: source_mixing.RIDGE * mass[d] * x + target[d] - (t * p[:, d] * np.maximum(0, rest - p[:, d] * x)).sum()  # noqa: B023, E731
            lo, hi = -1e6, 1e6
            for _ in range(90):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if slope(mid) < 0 else (lo, mid)
            s[d] = (lo + hi) / 2
        if np.abs(s - was).max() < 1e-10:
            break
    return (t * np.maximum(0, 1 - p @ s)) @ p, target


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.2, "b": 0.4, "c": 0.4}, {"a": 0.98, "b": 0.01, "c": 0.01}])
def test_rates_equal_a_reference_fit(spark, weights):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([2.0, 0.4, 0.2], 300)
    p = 0.9 * p + 0.1 * np.array([0.6, 0.3, 0.1])  # no document is free of any domain: small shares can't be reached
    t = rng.integers(0, 500, 300)
    members = spark.createDataFrame([(int(n), [float(x) for x in row]) for n, row in zip(t, p, strict=True)], "n_tokens long, posterior array<double>")
    steps, fitted, wanted = source_mixing.fit_rates(members, ["a", "b", "c"], weights)
    best, target = reference_fit(p, t.astype(float), np.array([weights[k] for k in "abc"]))
    assert np.allclose(wanted, target) and np.abs(fitted - best).max() <= 1e-3 * best.max(), (fitted, best, target)
    rates = np.array([r[0] for r in members.select(source_mixing._rate(steps)).collect()])
    assert (rates >= 0).all() and np.allclose((t * rates) @ p, fitted)
    if weights["b"] == 0.3:
        assert np.abs(fitted - wanted).max() <= 2e-3 * wanted.max()  # these can be reached


# ---- SentencePiece


def test_normalizer_aligns_as_the_library_does():
    for rule in ("nfkc", "nmt_nfkc", "nmt_nfkc_cf", "identity"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        spec = sentencepiece_codec.proto_fields(sentencepiece_codec.proto_fields(library.serialized_model_proto())[3][0])
        n = sentencepiece_codec.Normalizer(sentencepiece_codec.CharacterMap(spec.get(2, [b""])[0]), dummy_prefix=False, squeeze=False, escape=False)
        assert bool(n.char_map.units) == (rule != "identity")
        for text in ["Ｈｅｌｌｏ ﬁne ①②", "½ Å é", "カ゛ｶﾞ", "plain", "", "x㍍y", "Ⅷ ﷺ"]:
            out, origin = n.run(text)
            # The library marks spaces, puts one before the text, and gives the place of each character in characters of the source.
            want, offsets = library.Normalize(text, with_offsets=True)
            data = text.encode()
            starts = [k for k, b in enumerate(out) if b & 0xC0 != 0x80]
            mine = ["▁" + out.decode().replace(" ", "▁")] if out else [""]
            assert mine == [want], (rule, text)
            assert [len(data[: origin[k]].decode()) for k in starts] == list(offsets)[1 : 1 + len(starts)], (rule, text)


def test_spans_of_every_document_are_those_of_each_piece(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, "", " ", "two words", "  a  b ", "é日本 😀 x", "▁x y▁", "line\n\nend ", "word " * 3000, "x" * 4000, "\x00\x01  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sums = {r.doc_id: r.spans_crc32 for r in sentencepiece_codec.round_trip(docs, path).collect()}
    for r in sentencepiece_codec.encode(docs, path).collect():
        spans = list(zip(r.span_starts, r.span_ends, strict=True))[:-1]
        assert sums[r.doc_id] == sentencepiece_codec.spans_checksum(spans), texts[r.doc_id]
    assert sentencepiece_codec.round_trip(docs.limit(0), path).count() == 0


# ---- secrets


def der_key(size=9):
    n = lambda body, tag=2: bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")) + body
    return n(b"".join([n(b"\0"), *(n(bytes([k + 1] * size)) for k in range(8))]), 0x30)


def test_nested_headers_are_no_tokens():
    deep = base64.urlsafe_b64encode(b'{"alg":"x","a":' + b"[" * 200_000).decode().rstrip("=")
    assert secret_scan.find(f"{deep}.e30.sig") == []


@pytest.mark.parametrize("tail", ["", "a", "abcde", "word", "Hello", "ab"])
def test_keys_before_a_line_of_one_word(tail):
    for size in (9, 10, 11, 60):
        raw = base64.b64encode(der_key(size)).decode().rstrip("=")
        body = "\n".join(raw[k : k + 64] for k in range(0, len(raw), 64))
        assert secret_scan.say(secret_scan.find(body + "\n" + tail)).split(",")[0] == f"der_key:0:{len(body)}", (tail, size)


def test_an_ssh_key_ends_where_its_lengths_say():
    string = lambda b: len(b).to_bytes(4, "big") + b
    data = secret_scan.SSH_MAGIC + string(b"none") * 2 + string(b"") + (1).to_bytes(4, "big") + string(b"p" * 51) + string(b"k" * 300)
    for more in (b"", b"k", b"kk"):
        raw = base64.b64encode(data[:-304] + string(b"k" * 300 + more)).decode().rstrip("=")
        body = "\n".join(raw[k : k + 70] for k in range(0, len(raw), 70))
        for tail in ("", "abcd", "word\nabcd\nabcd\nabcd\nabcd\nabcd"):
            assert secret_scan.say(secret_scan.find(body + "\n" + tail)) == f"ssh_key:0:{len(body)}"


def test_long_runs_of_base64_are_quick():
    rng = random.Random(3)
    line = lambda first: first + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef0123456789+/", k=60))
    for first in ("QUJD", "MIIE", "MAAA", "b3BlbnNzaC1rZXktdjEA"):
        began = time.perf_counter()
        secret_scan.find("\n".join(line(first) for _ in range(20_000)))
        assert time.perf_counter() - began < 5, first


# ---- MinHash


def shared_passage(seed, n):
    """Texts that share a long passage, 0.5 to 0.65 alike, and pairs of near copies among them."""
    rng = np.random.default_rng(seed)
    passage, texts = " ".join(f"p{k}" for k in range(60)), []
    for i in range(n):
        own = [f"u{i}x{k}" for k in range(20)]
        texts.append(passage + " " + " ".join(own))
        if i % 10 == 0:
            own[rng.integers(2, 18)] = "edited"
            texts.append(passage + " " + " ".join(own))
    return texts


@pytest.mark.parametrize("deep", [8000, 40])
def test_links_among_documents_that_share_a_passage(spark, monkeypatch, deep):
    monkeypatch.setattr(minhash_dedup, "DEEP", deep)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 100)
    texts = shared_passage(9, 600)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    links = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(links) == 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.dedup(docs).collect()}
    found = sum(got[i] == got[j] for i, j in links)
    assert found >= 0.99 * len(links) and sum(got[d] != d for d in got) == found


@pytest.mark.parametrize("deep", [8000, 40])
def test_links_just_above_the_threshold_amid_documents_just_below(spark, monkeypatch, deep):
    """All documents are 0.70 alike, and 60 pairs 0.765: with regions cut at 40 members nearly all must still be found."""
    monkeypatch.setattr(minhash_dedup, "DEEP", deep)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 200)
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    common, texts = word(284), []
    for k in range(400):
        if k % 2 == 0 or k >= 120:  # below that, two by two
            own = word(18)
        texts.append(" ".join(common + own + word(42)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert len(links) == 60
    got = {r.doc_id: r.component_id for r in minhash_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[i] == got[j] for i, j in links) >= 59


# ---- language


def test_parsing_counts_longest_matches():
    rng = random.Random(5)
    han = [chr(0x4E00 + k) for k in range(600)]
    references = {"zh": "".join(rng.choices(han[:500], k=3000)), "ja": "".join(rng.choices(han[100:], k=3000)), "xx": "abc abd abe " * 40}
    p = language_id.CrossParser(references)
    texts = ["".join(rng.choices(han, k=200)) for _ in range(20)] + ["abc ab zzz abd", "q", "abc", references["zh"][500:900]]
    counts, sizes = p.phrases(texts)
    for text, row in zip(texts, counts, strict=True):
        for k, name in enumerate(p.languages):
            whole, at, phrases = language_id._letters(references[name]), 0, 0
            letters = language_id._letters(text)
            while at < len(letters):
                n = 0
                while at + n < len(letters) and letters[at : at + n + 1] in whole:
                    n += 1
                phrases += 1
                at += max(n, 1)
                if n and at < len(letters) and letters[at] not in whole:
                    at += 1  # a letter that no text holds ends the match before it
            assert row[k] == phrases, (text, name)
    assert p.predict([references["zh"][500:900], references["ja"][500:900]])[0] == ["zh", "ja"]


def test_what_is_learnt_is_spread_over_long_texts(spark):
    docs = spark.createDataFrame([(i, "aaaa " * 20_000 + "bbbb " * 20_000, "xx") for i in range(5)], "doc_id long, text string, lang string")
    ((name, text),) = language_id.references(docs)
    assert name == "xx" and len(text) <= language_id.REFERENCE_CHARS + 5 and 0.4 < text.count("b") / text.count("a") < 2.5


# ---- URLs


def test_lists_may_be_tables_and_false_hits_are_removed(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_ENTRY", 1)  # nearly every try passes the filter
    listed = spark.createDataFrame([(f"h{k}.org/p{k % 7}/",) for k in range(3000)] + [(None,), ("h1.org/p1/",)], "entry string")
    pages = spark.createDataFrame([(k, f"http://www.h{k}.org/p{k % 5}/x") for k in range(4000)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, (), listed).collect()}
    assert got == {k: "block" if k < 3000 and k % 7 == k % 5 else "allow" for k in range(4000)}


# ---- record files


def test_ids_equal_the_unaltered_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, ours = Tokenizer.from_file(path), record_files.Encoder(path)
    assert ours.joins
    rng = random.Random(2)
    parts = ["the", "Éléa", "straße", "don't", "x's", "12ab", "...", ".\n", "\n", "\n\n", "\t", " ", "  ", "日本", "😀", "a,b", "end.", "Q:", "#tag", "×", "\u0085", "\x1c", "ﬁ", "O'Neil", "it'll", "word", "ünïcode", "<|endoftext|>", "%$", "a\nb", "a.\nb,\nc"]
    texts = ["", " ", "a", *("".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(3000)), "lorem ipsum " * 5000]
    for _ in range(2):  # the second time from what was kept
        got = ours.encode(texts)
        want = library.encode_batch(texts, add_special_tokens=False)
        for t, x, y in zip(texts, got, want, strict=True):
            assert x.tolist() == y.ids, repr(t)


def test_records_without_an_id_fill_several_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.range(400).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).union(spark.createDataFrame([(None, None), (3, "again"), (3, "again")], "doc_id long, text string"))
    got = sorted(tuple(r) for r in record_files.export(docs, path).select("start", "n_tokens", "doc_id", "ids_crc32").collect())
    assert len(got) == docs.count() and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(got)) and got[0][0] == 0
    ids = [r[2] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    e = record_files.Encoder(path)
    want = sorted(zlib.crc32(np.array([*e.library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in docs.collect())
    assert sorted(r[3] for r in got) == want
