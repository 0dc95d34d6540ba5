"""Document operators against brute force, the libraries themselves, and the edges of their input."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factweave.llm import _shared, html_text, language_id, minhash_dedup, quality_rules, record_files, secret_scan, sentencepiece_codec, source_mixing, url_filter
from factweave.llm._components import components
from factweave.llm._ngrams import Words

EDGES = [None, "", " ", "\n", "a", "word " * 40, "a  b   c ", "é ü\tß\n\nx", "日本語 漢字 😀", "▁x y▁", "it's  we'll", "x" * 5000, "<|endoftext|> x", "token = \"abcdefgh1\"", "same text here now please", "same text here now please"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int, kept boolean"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or ""), 7, False) for i, t in enumerate(texts)], SCHEMA)


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_quality_counts(spark):
    texts = [*EDGES, "a b c d e f g h " * 4, "one\none\n\n one\none", "# * $ % & | < >"]
    model = quality_rules.TextClassifier.fit([], [])
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows: dict = {}
        for k in range(len(w) - 7):
            windows.setdefault(tuple(w[k : k + 8]), []).append(k)
        repeat = len({j for v in windows.values() if len(v) > 1 for k in v for j in range(k, k + 8)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat), t
        assert r.base_failed == (len(w) < 20 or 100 * repeat > 30 * len(w)) and (not r.base_failed or not r.kept)
    assert quality_rules.judge(frame(spark, []), model).count() == 0


def test_quality_learns(spark):
    good = [" ".join(f"plain{k % 7} text{j} here" for j in range(12)) for k in range(60)]
    bad = [" ".join(f"CLICK$$ buy{j}## now" for j in range(12)) for k in range(60)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (0, None, None), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality_rules.train(spark, docs, labels)
    out = {r.doc_id: r.kept for r in quality_rules.judge(docs, model).collect()}
    assert all(out[i] == (i < 60) for i in range(120))


def test_word_hashes_are_of_the_words_alone():
    a, b = Words(["x foo y", ""]), Words(["foo"])
    assert a.hashes[1] == b.hashes[0] and a.n_words.tolist() == [3, 0]


def test_sentencepiece_equals_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    c = sentencepiece_codec.Codec(path)
    got = {r.doc_id: r for r in sentencepiece_codec.round_trip(frame(spark, EDGES), path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(EDGES):
        ids = c.library.encode(t or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256, got[i].span_bytes) == (len(ids), sha(" ".join(map(str, ids))), sha(c.library.decode(ids)), len((t or "").encode()))
    enc = sentencepiece_codec.encode(frame(spark, EDGES), path)
    for r in enc.collect():
        data = (EDGES[r.doc_id] or "").encode()
        assert b"".join(data[a:b] for a, b in zip(r.span_starts, r.span_ends, strict=True)) == data
    assert rows(sentencepiece_codec.decode(enc, path), "text") == sorted(((t or ""),) for t in [c.library.decode(c.library.encode(t or "")) for t in EDGES])


def test_character_map_takes_the_longest_prefix():
    # A double array for "a" -> "x" and "ab" -> "yz": unit = offset << 10 | leaf flag 0x100 | label.
    units = [0] * 512
    units[0] = 1 << 10  # root: children at 1 ^ label
    a = 1 ^ ord("a")
    units[a] = ord("a") | 0x100 | ((a ^ 200) << 10)  # its value at 200, its children at 200 ^ label
    units[200] = 0x80000000 | 0
    ab = 200 ^ ord("b")
    units[ab] = ord("b") | 0x100 | ((ab ^ 300) << 10)
    units[300] = 0x80000000 | 2
    import struct

    cm = sentencepiece_codec.CharacterMap(struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + b"x\0yz\0")
    assert cm.longest(b"ab", 0) == (2, b"yz") and cm.longest(b"ac", 0) == (1, b"x") and cm.longest(b"c", 0) is None
    out, origin = sentencepiece_codec.Normalizer(cm, dummy_prefix=False, squeeze=True).run(" abc  a ")
    assert out.decode() == "yzc▁x" and origin == [1, 1, 3, 4, 4, 4, 6, 7]


def test_record_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = record_files.Encoder(path)
    docs = frame(spark, EDGES).union(spark.createDataFrame([(None, "no id", None, None, None, None, None)], SCHEMA))
    got = {r.doc_id: r for r in record_files.export(docs, path).collect()}
    at = len(e.library.encode("no id", add_special_tokens=False).ids) + 1
    assert got[None].start == 0
    for i, t in enumerate(EDGES):
        ids = [*e.library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert record_files.export(frame(spark, []), path).count() == 0
    record_files.write(docs, path, f"{tmp_path}/f")
    index = record_files.build_index(spark, f"{tmp_path}/f").where("doc_id = 5").first()
    (file,) = [f for f in (tmp_path / "f").iterdir() if f.name.startswith(f"part-{index.file:05d}")]
    assert record_files.read_at(file.read_bytes(), index.offset, index.length)[1].tolist() == [*e.library.encode(EDGES[5], add_special_tokens=False).ids, 0]
    broken = bytearray(file.read_bytes())
    broken[index.offset + 20] ^= 1
    with pytest.raises(ValueError):
        list(record_files.unframe(bytes(broken)))


def test_secrets(spark):
    import base64
    import json

    b64 = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    token = f"{b64(json.dumps({'alg': 'HS256'}).encode())}.{b64(b'{}xx')}.{b64(b'sig')}"
    n = lambda body, tag=2: bytes([tag, len(body)]) + body
    key = b"".join([n(b"\0"), *(n(bytes([k + 1] * 9)) for k in range(8))])
    der = b"\x30" + bytes([len(key)]) + key
    texts = [*EDGES, f"see {token} .", f"k {base64.b64encode(der).decode()} end", f"h {der.hex()} end", f"bad {base64.b64encode(der[:-1] + b'xx' * 9).decode()}", "PASSWORD: 'hunter2hunter2' AKIA" + "A1" * 8 + " " + "0f" * 20, "password = short"]
    for t in texts:
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.A) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        assert [x for x in secret_scan.find(t) if x[1] < 3] == sorted(want)
    kinds = lambda t: [secret_scan.KINDS[k] for _, k, _ in secret_scan.find(t)]
    assert kinds(texts[len(EDGES)]) == ["signed_token"] and kinds(texts[len(EDGES) + 1]) == ["der_key"]
    assert kinds(texts[len(EDGES) + 2]) == ["hex", "der_key"] and kinds(texts[len(EDGES) + 3]) == []
    assert secret_scan.scan(frame(spark, texts)).count() == len(texts)
    out = {r.doc_id: r for r in secret_scan.redact(frame(spark, texts)).collect()}
    assert out[0].text is None and out[len(EDGES)].text == "see [SECRET] ." and out[len(EDGES)].n_chars == 14 and out[3].extra == 7


def test_minhash_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 400, 80)] for _ in range(25)]
    texts = []
    for words in base:
        for edits in (0, 0, 1, 2, 3, 6):
            w = list(words)
            for k in rng.integers(0, 80, edits):
                w[k] = "changed"
            texts.append(" ".join(w))
    texts += [None, "", "  ", "one two", "ONE two", "one two three", "A b c d e f"]
    got = {r.doc_id: r for r in minhash_dedup.dedup(frame(spark, texts)).collect()}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for _ in range(6):
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert [got[i].component_id for i in range(len(texts))] == label
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (label[i] == i) for i in range(len(texts)))
    assert minhash_dedup.dedup(frame(spark, [])).count() == 0


def edited_copies(seed, n, original):
    """Texts of which all but `original` are copies of it at 0.79; the copies are at 0.62 among themselves."""
    rng = np.random.default_rng(seed)
    words = [f"w{x}" for x in range(300)]
    texts = []
    for i in range(n):
        w = list(words)
        if i != original:
            for k in 10 + 40 * np.arange(7) + rng.integers(0, 30, 7):
                w[k] = f"edit{i}x{k}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(296)} for t in texts]
    near = [len(sets[original] & s) / len(sets[original] | s) for s in sets]
    assert min(near) >= 0.75 and all(len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.75 for i in range(n - 1) if original not in (i, i + 1))
    return texts


def test_minhash_compares_all_of_a_crowded_region(spark):
    got = minhash_dedup.dedup(frame(spark, edited_copies(2, 1001, 500))).collect()
    assert {r.component_id for r in got} == {0}


def test_minhash_all_members_of_a_group_meet_others(spark):
    got = minhash_dedup.dedup(frame(spark, edited_copies(3, 1001, 0))).collect()
    assert {r.component_id for r in got} == {0}


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(100, 101)], "a long, b long").repartition(7)
    assert {r.component for r in components(chain).collect()} == {10, 100}


def test_language(spark):
    words = {"xx": "lorem ipsum dolor sit amet".split(), "yy": "zażółć gęślą jaźń pchnąć w tę".split()}
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(rng.choice(words[lang], 30)), lang) for i, lang in enumerate(["xx", "yy"] * 30)]
    docs = spark.createDataFrame([*texts, (None, "x", "xx"), (90, None, "xx"), (91, "123 !", None)], "doc_id long, text string, lang string")
    learnt = language_id.references(docs.where("doc_id < 40"))
    got = {r.doc_id: r for r in language_id.identify(docs, learnt).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in texts)
    assert got[90].lang_pred == got[91].lang_pred == "und"
    assert {r.lang_pred for r in language_id.identify(docs, ()).collect()} == {"und"}
    # The number of phrases against a direct search for longest matches.
    p = language_id.CrossParser({"a": "abcabcabd"})
    assert p.phrases(["abcabd", "xyz", "dab"])[0].ravel().tolist() == [1, 3, 2]


def test_mixing(spark):
    docs = frame(spark, ["good words in a row " * 5] * 40 + ["bad bad idiot stuff " * 5] * 40 + [None, ""])
    labels = spark.createDataFrame([(i, 1, int(i >= 40)) for i in range(80)], "doc_id long, quality int, toxic int")
    out = source_mixing.mix(docs, source_mixing.domains_of(labels), {"clean": 0.8, "toxic": 0.2})
    got = out.select("domain", "n_tokens", "rate", "posterior").collect()
    totals = np.sum([np.array(r.posterior) * r.n_tokens * r.rate for r in got], axis=0)
    assert all(r.rate >= 0 for r in got) and abs(totals[0] / totals.sum() - 0.8) < 1e-3
    none = source_mixing.mix(docs, source_mixing.domains_of(labels).limit(0), {"clean": 1.0}).collect()
    assert {(r.rate, r.copies, r.domain) for r in none} == {(1.0, 1, None)}


def test_urls(spark):
    import duckdb

    urls = [None, "", "x", "http://", "HTTP://Ex.ORG", "http://a.example.org/es/x", "https://EXAMPLE.org/en/148?q#f", "http://example.org/en/2", "http://a.b.com/fr/1", "http://com/de/", "http://notcom.net/x", "https://www.cheap-pills.example.net/a", "http://h.org?x=http://y.com/de/", "http://h.org/a", "http://h.org/a"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = rows(url_filter.judge(pages), "page_id", "host", "path", "rule", "verdict", "listed")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(i, u) for i, u in enumerate(urls)])
    cursor = con.execute(url_filter.oracle())
    order = [[c[0] for c in cursor.description].index(n) for n in ("page_id", "host", "path", "rule", "verdict", "listed")]
    assert got == sorted(tuple(r[k] for k in order) for r in cursor.fetchall())
    assert url_filter.judge(pages, (), ()).where("verdict <> 'allow'").count() == 0


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a>Home</a></ul></nav><div class="cookie-notice">Agree</div>
      <article><h1>Head &amp; more</h1><p>One <b>two<br>three</b>\n four&nbsp;five<p>Next<div class="ad">Buy</div><aside>Side</aside><section id="comments"><p>Reply</p></section></article><form>Mail</form><footer>&copy; x"""
    got = html_text.extract(spark.createDataFrame([(1, "http://a/b", page, 3), (2, None, None, 4), (3, "x", "plain &lt; text", 5)], "page_id long, url string, html string, text int")).collect()
    assert {r.page_id: r.text for r in got} == {1: "Head & more\n\nOne two three four five\n\nNext", 2: "", 3: "plain < text"}
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.common_lines(list("abcbdab"), list("bdcaba")) and len(html_text.common_lines(list("abcbdab"), list("bdcaba"))) == 4
    own = [("Menu", False), ("My own line", False), ("Foot", False)]
    assert html_text.difference(own, [("Menu", False), ("Other", False), ("More", False), ("Even more", False), ("Foot", False)]) == ("My own line", 2)
    assert html_text.difference(own, list(own))[0] == "Menu\n\nMy own line\n\nFoot"  # copies delete nothing


def test_html_keeps_unshared_lines_outside_the_main_text():
    own = [("Menu", False), ("Own lead", False), ("Teaser", True), ("Foot", False)]
    other = [("Menu", False), ("Their lead", False), ("Teaser", True), ("Foot", False)]
    assert html_text.difference(own, other) == ("Own lead\n\nTeaser", 2)


def test_record_files_take_added_tokens_as_the_library_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> there", "plain words here", "x<|endoftext|>", *(t or "" for t in EDGES)]
    got = [x.tolist() for x in record_files.Encoder(path).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in got[0]


def test_secrets_between_lines_of_words():
    import base64

    n = lambda body, tag=2: bytes([tag, len(body)]) + body
    key = n(b"".join([n(b"\0"), *(n(bytes([k + 1] * 9)) for k in range(8))]), 0x30)
    string = lambda b: len(b).to_bytes(4, "big") + b
    ssh = secret_scan.SSH_MAGIC + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + b"\7" * 40
    for kind, data in (("der_key", key), ("ssh_key", ssh)):
        raw = base64.b64encode(data).decode().rstrip("=")
        for end in ("\n", "\r\n"):
            body = end.join(raw[k : k + 64] for k in range(0, len(raw), 64))
            after = "Hello" if len(raw) % 4 == 0 else "Hi" if len(raw) % 4 == 3 else "abc"
            for text in (body + end + after, "x" * 30 + end + body, "x" * 30 + end + body + end + after):
                a = text.index(raw[:20])
                assert secret_scan.say(secret_scan.find(text)) == f"{kind}:{a}:{a + len(body)}", (kind, text)


def test_samples_take_one_row_of_an_id_that_many_share(spark):
    labels = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(40)] + [(0, "b"), (0, "a")], "doc_id long, domain string")
    texts = [(k, f"{'red apple tree' if k % 2 == 0 else 'steel bolt press'} {k} " * 5) for k in range(40)]
    many = spark.createDataFrame(texts + [(0, f"red apple tree number {k}") for k in range(3000)], "doc_id long, text string")
    models = [quality_rules.fit_on_labels(many.repartition(n), labels.repartition(n), "domain", 15) for n in (1, 7)]
    assert models[0].classes == ["a", "b"] and (models[0].weights == models[1].weights).all()
    spoken = many.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy"))
    one, other = (language_id.references(spoken.repartition(n), 15) for n in (1, 7))
    assert one == other and [k for k, _ in one] == ["xx", "yy"]
    sampled = _shared.sample_per_stratum(spoken, "doc_id", "lang", 15).select("doc_id", "lang").distinct().groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in sampled} == {"xx": 20, "yy": 20}


def test_ids_of_other_whole_types(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (None, None), (2, "one two three four five six")], "doc_id int, text string")
    assert [r.doc_id for r in quality_rules.judge(docs, quality_rules.TextClassifier.fit([], [])).orderBy("doc_id").collect()] == [None, 1, 2]
    assert secret_scan.scan(docs).count() == 3
