"""Frequent phrases and how strongly their words hang together, from vertical positional inverted lists.

The index is cut into blocks of whole documents of one language. A block's row holds, for each of its words, the sorted
list of the positions where it stands; positions run on within a piece of text and skip one between pieces, so that
phrases cross none. A phrase of m words has a list of its own: the positions of a phrase of m - 1 words, merge-joined with
those positions of such phrases that follow by one, and with the postings of the word at its end. No phrase crosses
documents, so each block is joined by itself, and the length of a phrase's lists, added up over the blocks, is its exact
frequency.

Only phrases whose parts are frequent are extended. Which ones may be comes from exact sums over 64-bit hashes of the
phrases of each length, kept as a blocked Bloom filter of FILTER_WORDS words of 64 bits (8 MB, whatever the input): it lets
all frequent phrases pass, and others seldom; what it lets pass in vain is counted and dropped, so it never changes a
result. Phrases themselves are counted as strings.

A candidate's score is the least over its cuts of floor(1000000 a² / (l r)), in whole numbers of up to 38 digits.

Defined results: a null text counts as empty and a null language as `und`; rows are counted whatever their doc_id, equal ones
too; only A-Z become lower case; a language without a candidate has no row; an empty table gives an empty result. A text
that is longer than a block has a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._ngrams import mix
from ._shared import materialize

#: Words of a candidate at most, its least frequency, the percentage at which a longer one drops it, and results of a language.
MOST_WORDS, LEAST, PERCENT, TOP = 3, 10, 50, 2000
#: UTF-8 bytes of the texts of a block.
BLOCK_BYTES = 1 << 22
#: 64-bit words of a filter of frequent phrases, each with FILTER_BITS of the bits of a phrase.
FILTER_WORDS, FILTER_BITS = 1 << 20, 4
#: The last stage ranks a language from this many parts of it, of which each gives its first ones.
PARTS = 16
_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)
#: What a byte of UTF-8 text is: part of a word, a blank between words, or an end of a piece. A-Z stand as a-z.
_PIECE_END = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8)) | _PIECE_END
_LOWER = np.arange(256, dtype=np.uint8) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint8)
INDEX = "lang string, words array<string>, counts binary, positions binary"


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits as they are kept in a row: their number, then themselves, compressed."""
    raw = numbers.astype(np.int32).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd"), np.int32)


def _block(lang: str, texts: list[bytes]) -> pa.RecordBatch | None:
    """The inverted lists of some texts."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1)))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return None
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[~blank])).dictionary_encode()
    # Between two words of a piece one step, between others two.
    piece = np.concatenate(([0], np.cumsum(_PIECE_END[data], dtype=np.int32)))[begin]
    place = np.arange(len(begin)) + np.unique(piece, return_inverse=True)[1]
    number = words.indices.to_numpy()
    order = np.argsort(number, kind="stable")
    packed = (_packed(np.bincount(number)), _packed(np.diff(place[order], prepend=0)))
    columns = pa.array([lang]), pa.array([words.dictionary.to_pylist()], pa.list_(pa.string())), *(pa.array([x]) for x in packed)
    return pa.RecordBatch.from_arrays(list(columns), names=["lang", "words", "counts", "positions"])


def inverted_lists(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, words, counts, positions): a row for each block; `counts` are the lengths of the words' lists in `positions`,
    which are kept as steps from one to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if lang in held and sizes[lang] + len(text) > block_bytes:
                    block = _block(lang, held.pop(lang))
                    if block:
                        yield block
                    sizes[lang] = 0
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sum(sizes.values()) > 2 * block_bytes:  # many languages
                    most = max(sizes, key=sizes.get)
                    block = _block(most, held.pop(most))
                    if block:
                        yield block
                    del sizes[most]
        for lang, texts in held.items():
            block = _block(lang, texts)
            if block:
                yield block

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, INDEX)


class Lists:
    """The lists of a block, sorted by position, and those of the phrases made from them."""

    def __init__(self, row: dict):
        self.lang, self.words = row["lang"], row["words"]
        counts, places = _unpacked(row["counts"]), np.cumsum(_unpacked(row["positions"]))
        order = np.argsort(places, kind="stable")  # merges the words' lists, which are sorted
        self.posts, self.post_word = places[order], np.repeat(np.arange(len(counts)), counts)[order]
        hashes = pd.util.hash_array(np.array([*self.words, self.lang], object), categorize=False)
        self.word_hash = mix(hashes[:-1] * _STEP + hashes[-1])
        # Of the phrases of `size` words so far: their positions, the number of the phrase at each, and the phrases' hashes.
        self.size, self.at, self.phrase, self.hashes = 1, self.posts, self.post_word, self.word_hash

    def extend(self) -> None:
        """Phrases of one word more, both of whose parts are among those so far."""
        follow = np.searchsorted(self.at, self.at + 1)
        good = np.flatnonzero(self.at[np.minimum(follow, len(self.at) - 1)] == self.at + 1) if len(self.at) else follow
        at, head = self.at[good], self.phrase[good]
        last = self.post_word[np.searchsorted(self.posts, at + self.size)]
        pair, phrase = np.unique(head * np.int64(len(self.words)) + last, return_inverse=True)
        head, last = pair // len(self.words), pair % len(self.words)
        self.hashes = mix(self.hashes[head] * _STEP + self.word_hash[last])
        self.size, self.at, self.phrase = self.size + 1, at, phrase

    def lengths(self) -> np.ndarray:
        return np.bincount(self.phrase, minlength=len(self.hashes))

    def keep(self, bits: np.ndarray) -> None:
        """Drop the lists of phrases that a filter doesn't hold."""
        word, mask = filter_places(self.hashes, len(bits))
        stay = bits[word] & mask == mask
        self.hashes, number = self.hashes[stay], np.cumsum(stay) - 1
        own = stay[self.phrase]
        self.at, self.phrase = self.at[own], number[self.phrase[own]]

    def texts(self) -> pa.Array:
        """The phrases, their words joined by a space."""
        first = np.zeros(len(self.hashes), np.int64)
        first[self.phrase] = np.arange(len(self.phrase))
        spot = np.searchsorted(self.posts, self.at[first]) if len(first) else first
        words = pa.array(self.words, pa.string())
        parts = [words.take(pa.array(self.post_word[spot + k])) for k in range(self.size)]
        return pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]


def filter_places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a filter of so many words, and the bits in it, of each hash."""
    mask = np.zeros(len(hashes), _U)
    for k in range(FILTER_BITS):
        mask |= _U(1) << (hashes >> _U(6 * k) & _U(63))
    return (hashes >> _U(24)) % _U(words), mask


def _filter(index: DataFrame, filters: list, least: int):
    """The filter of the phrases of one word more than those of the last filter that stand `least` times, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _rows(batches):
            for bits in filters:
                lists.extend()
                lists.keep(bits.value)
            lists.extend()
            n = lists.lengths()
            for k in range(0, len(n), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(lists.hashes[k : k + (1 << 17)].view(np.int64)), pa.array(n[k : k + (1 << 17)])], names=["hash", "n"])

    sums = index.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    mask = F.lit(0).cast("long")
    for k in range(FILTER_BITS):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {6 * k}) & 63 as int))"))
    words = sums.groupBy((F.shiftrightunsigned("hash", 24) % FILTER_WORDS).alias("word")).agg(F.bit_or(mask).alias("bits")).toArrow()
    bits = np.zeros(FILTER_WORDS, _U)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy().view(_U)
    return index.sparkSession.sparkContext.broadcast(bits)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Lists]:
    for b in batches:
        for k in range(b.num_rows):
            yield Lists({name: b.column(name)[k].as_py() for name in ("lang", "words", "counts", "positions")})


def frequencies(index: DataFrame, most_words: int, least: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of 2 to `most_words` words that stand `least` times or more in a language."""
    filters: list = []
    for _ in range(2, most_words):
        filters.append(_filter(index, filters, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _rows(batches):
            for size in range(2, most_words + 1):
                lists.extend()
                if size < most_words:
                    lists.keep(filters[size - 2].value)
                texts, n = lists.texts(), lists.lengths()
                for k in range(0, len(n), 1 << 16):
                    own = texts.slice(k, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array([lists.lang] * len(own), pa.string()), own, pa.array(n[k : k + (1 << 16)])], names=["lang", "phrase", "n"])

    return index.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def word_counts(index: DataFrame) -> DataFrame:
    """(lang, phrase, n) of all words, from the lengths of their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, words, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words, n = words.values, _unpacked(counts).astype(np.int64)
                for k in range(0, len(n), 1 << 16):
                    own = words.slice(k, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), own, pa.array(n[k : k + (1 << 16)])], names=["lang", "phrase", "n"])

    return index.select("lang", "words", "counts").mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _words(phrase: str) -> Column:
    return F.split(phrase, " ")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each candidate (lang, phrase, a) by its lowest-scoring cut."""
    words = _words("phrase")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(words) - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ").alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    exact = "(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    best = F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "a").agg(best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def contained(candidates: DataFrame, most_words: int, percent: int) -> DataFrame:
    """(lang, phrase) of the candidates that a longer one drops."""
    words = _words("phrase")
    sizes = candidates.select("lang", F.col("a").alias("longer"), words.alias("w"), F.explode(F.sequence(F.lit(2), F.lit(most_words))).alias("size")).where(F.size("w") > F.col("size"))
    run = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda b: F.array_join(F.slice("w", b, F.col("size")), " "))
    most = sizes.select("lang", F.explode(run).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return candidates.join(most, ["lang", "phrase"]).where(100 * F.col("longer") >= percent * F.col("a")).select("lang", "phrase")


def mine(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, percent: int = PERCENT, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language of the rows (lang, text)."""
    # Rows are large and compressed already; Parquet's own codec would hold whole pages of them outside the heap.
    index = materialize(inverted_lists(docs, block_bytes), "lists", compression="none")
    words = materialize(word_counts(index), "words")
    candidates = materialize(frequencies(index, most_words, least).withColumnRenamed("n", "a"), "phrases")
    counts = words.where(F.col("n") >= least).unionAll(candidates)
    found = scored(candidates, counts).join(contained(candidates, most_words, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    # A language's first ones are among the first ones of its parts, so that none is sorted in one task.
    few = found.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words.groupBy("lang").agg(F.sum("n").alias("total")), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def oracle() -> str:
    """The same for DuckDB."""
    ends = "' || '.,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || '"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{ends}]')) AS piece FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^ ' || chr(9) || ']+') AS w FROM pieces),
words AS (SELECT lang, x AS phrase, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM cut) GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM words GROUP BY ALL),
runs AS (
  SELECT lang, unnest(list_transform(range(1, len(w)::BIGINT), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM cut
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)::BIGINT - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM cut),
candidates AS (SELECT lang, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= {LEAST}),
counts AS (SELECT lang, phrase, n FROM words UNION ALL SELECT lang, phrase, a FROM candidates),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM candidates),
cuts AS (
  SELECT lang, phrase, a, w, 1 AS k, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM split
  UNION ALL SELECT lang, phrase, a, w, 2, w[1] || ' ' || w[2], w[3] FROM split WHERE len(w) = 3),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.n AS l, y.n AS r, (1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n))::BIGINT AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n), k) AS place
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM split WHERE len(w) = 3) GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
  WHERE place = 1 AND (g.a IS NULL OR 100 * g.a < {PERCENT} * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= {TOP}"""
