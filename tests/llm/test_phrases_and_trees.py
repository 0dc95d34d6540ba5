"""Phrase mining, Merkle fingerprints and fill-in-middle against brute force; keys in the shapes they take in files."""

import base64
import collections
import hashlib
import json
import random
import re

import pytest

from factweave.llm import fill_middle, merkle, phrase_mining, secret_scan

ODD = [None, "", " ", "\n\n", "one", "A. b", "x" * 5000, "no end " * 3000, "Ünï cödé 日本語 😀 the end.", "a<P>b", "<<S", "tail <", "same text here.\nIt has lines.\n\nAnd sections.", "same text here.\nIt has lines.\n\nAnd sections."]
COLUMNS = "doc_id long, text string, lang string, n long, phrase string, mark long, wanted int, units int, form int, key_id int, edited int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "p", 2, 3, 4, 5, 6, 7) for i, t, g in rows], COLUMNS)


def brute_phrases(rows, least, percent, top):
    counts, words = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for m in (1, 2, 3):
                for k in range(len(w) - m + 1):
                    counts[lang, tuple(w[k : k + m])] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if any(g == lang and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q))) and 100 * b >= percent * a for (g, q), b in found.items()):
            continue
        cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, score, a, " ".join(p), counts[lang, p[:k]], counts[lang, p[k:]]))
    out.sort(key=lambda x: (x[0], -x[1], -x[2], x[3].encode()))
    ranked, seen = [], collections.Counter()
    for lang, score, a, p, left, right in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p, a, left, right, words[lang], score))
    return ranked


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "of", "new", "york", "city", "san", "é", "日本", "x-1", " y", "#"])
    return [(i, "".join(word() + rng.choice([" "] * 9 + ["\t ", ". ", "\n", ", ", "\x0b"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for i in range(n)]


@pytest.mark.parametrize("block", [1 << 22, 300])
def test_phrases_equal_brute_force(spark, block):
    rows = texts(5, 160) + [(None, t, None) for t in ODD] + [(7, "New York city. " * 12, "fr")] * 2
    for least, top in ((3, 2000), (5, 7)):
        got = phrase_mining.mine(frame(spark, rows), least=least, top=top, block_bytes=block).collect()
        assert sorted(tuple(r) for r in got) == sorted(brute_phrases(rows, least, 50, top))


def test_phrases_with_a_full_filter_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "FILTER_WORDS", 1)  # lets nearly all pass
    rows = texts(6, 120)
    assert sorted(tuple(r) for r in phrase_mining.mine(frame(spark, rows), least=4).collect()) == sorted(brute_phrases(rows, 4, 50, 2000))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_print(text):
    sections, entry = [], ""
    leaves = collections.Counter()
    for p in re.findall(merkle.PARAGRAPH, text):
        pieces = re.findall(merkle.PIECES, p)
        assert "".join(pieces) == p
        codes = [hashlib.md5(x.encode()).hexdigest()[:8] + f"{len(x):02x}" for x in pieces]
        leaves.update(codes)
        entry += f";{sha(p)}:{''.join(codes)}"
        if p == "\n" or sha(p)[0] in "01":
            sections.append(entry)
            entry = ""
    sections += [entry] if entry else []
    tree = "".join(f"/{sha(s)[:16]}" + re.sub(r";([0-9a-f]{16})[0-9a-f]*:", r";\1:", s) for s in sections)
    return sha("".join(map(sha, sections))) + tree, leaves


def brute_near(a, b):
    (pa, la), (pb, lb) = brute_print(a), brute_print(b)
    weight = lambda c: sum(n * int(x[8:], 16) for x, n in c.items())
    return 1.0 if pa == pb else 2.0 * weight(la & lb) / max(1, weight(la) + weight(lb))


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(2)
    lines = [" ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(rng.randint(1, 14))) + rng.choice([".", "", "!"]) for _ in range(40)]
    rows = [(10 + i, t, None) for i, t in enumerate(ODD)] + [(100 + i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 60))), None) for i in range(40)]
    ring = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in merkle.digests(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, t, _) in enumerate(ring):
        t, follows = t or "", ring[(k + 1) % len(ring)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + follows[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(edited), brute_print(t)[0], brute_print(edited)[0])
        assert r.near_edited == brute_near(t, edited) and r.near_next == brute_near(t, follows)
    assert got[22].fingerprint == got[23].fingerprint and got[23].near_next == 1.0


def test_fingerprints_with_repeated_and_missing_ids(spark):
    rows = [(None, "null id.", None), (None, None, None), (1, "one text", None), (1, "one text", None), (1, "another text", None), (2, "", None)]
    got = merkle.digests(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "2", "None", "None"]
    same = [tuple(r) for r in got if r.doc_id == 1 and r.n_chars == 8]
    assert len(same) == 2 and same[0] == same[1]
    alone = merkle.digests(frame(spark, [(5, "abcdef", None)])).collect()[0]
    assert alone.edited_sha256 == sha("abcdab") and alone.near_next == 1.0
    for make in (merkle.digests, fill_middle.digests, phrase_mining.mine):
        assert make(frame(spark, [])).count() == 0


def test_differing_branches_locate_edits(spark):
    lines = [f"Paragraph {k} says something of its own.\n" for k in range(200)]
    other = lines.copy()
    other[57] = "This one is new.\n"
    del other[120]
    rows = frame(spark, [(1, "".join(lines), None), (2, "".join(other), None)])
    prints = {r.doc_id: r.fingerprint for r in merkle.fingerprints(rows).collect()}
    pairs = spark.createDataFrame([(1, prints[1], prints[2]), (2, prints[2], prints[1]), (3, prints[1], prints[1])], "doc_id long, fingerprint string, other string")
    got = {(r.doc_id, r.start, r.n_chars) for r in merkle.edits(pairs).collect()}
    at = lambda ls, k: sum(map(len, ls[:k]))
    assert got == {(1, at(lines, 57), len(lines[57])), (1, at(lines, 120), len(lines[120])), (2, at(other, 57), len(other[57]))}


def test_fill_middle_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i if i else None, t, None) for i, t in enumerate(ODD)] + [(50 + i, "".join(rng.choice(["word ", "<", "P", ">", "S>", "<M", "é", "\n", "😀"]) for _ in range(rng.randint(0, 40))), None) for i in range(150)]
    got = collections.defaultdict(list)
    for r in fill_middle.digests(frame(spark, rows)).collect():
        got[r.doc_id].append(tuple(r))
    forms = collections.Counter()
    for i, t, _ in rows:
        t = t or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        digest, n = sha("1:" + ("" if i is None else str(i))), len(units)
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b, c = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        forms[form] += 1
        out = {"plain": t, "psm": f"<P>{a}<S>{c}<M>{b}", "spm": f"<S>{c}<P>{a}<M>{b}"}[form]
        assert (i, n, form, None if form == "plain" else len(a), None if form == "plain" else len(b), sha(out), sha(t)) in got[i]
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 10


def test_new_queries_keep_to_functions_where_asked(spark, tmp_path):
    docs = frame(spark, [(1, "a b. c", "en")])
    for made in (merkle.digests(docs), fill_middle.digests(docs)):
        assert "Python" not in made._jdf.queryExecution().toString() and "Arrow" not in made._jdf.queryExecution().toString()


# ---- keys as they stand in files


def element(tag, value):
    n = len(value)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + value


def rsa_key(seed):
    rng = random.Random(seed)
    number = lambda n: element(2, b"\x01" + rng.randbytes(n - 1))
    return element(0x30, element(2, b"\0") + number(128) + element(2, b"\1\0\1") + number(128) + b"".join(number(64) for _ in range(5)))


def lined(key, size, end):
    text = base64.b64encode(key).decode()
    return end.join(text[k : k + size] for k in range(0, len(text), size))


@pytest.mark.parametrize("shape", ["json", "escaped returns", "indented", "short lines", "behind other characters", "plain"])
def test_keys_in_all_shapes(shape):
    key = rsa_key(shape)
    body = {"json": lined(key, 64, "\\n"), "escaped returns": lined(key, 64, "\\r\\n"), "indented": lined(key, 64, "\n      "), "short lines": lined(key, 16, "\n"), "behind other characters": "data:a/" + lined(key, 10_000, ""), "plain": lined(key, 64, "\n")}[shape]
    text = f"before {body} after"
    begin, end = text.index("MII"), text.index(" after")
    assert (begin, 3, end) in secret_scan.find(text)
    assert not any(k == 3 for _, k, _ in secret_scan.find(text[: begin + 40] + "A" + text[begin + 40 :]))


def test_tokens_with_headers_over_lines():
    part = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    token = f"{part(json.dumps({'alg': 'HS256'}, indent=1))}.{part('{}' * 4)}.c2ln"
    assert token.startswith("ew") and (4, 5, 4 + len(token)) in secret_scan.find(f"see {token} there")
    assert not any(k == 5 for _, k, _ in secret_scan.find("a new12345678.word.here and ewoKICJub25lIjogMX0.abcd.x"))
