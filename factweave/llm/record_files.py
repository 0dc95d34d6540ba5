"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record is framed as

    length of the payload, 8 bytes | masked checksum of those 8 bytes, 4 | payload | masked checksum of the payload, 4 | line end, 1

with little-endian numbers. A masked checksum is the CRC-32 turned right by 15 bits plus 0xA282EAD8, so that data which
holds checksums does not check itself. The payload is doc_id (8 bytes, signed), the width of an id (1 byte: 2 or 4) and
the ids. Spark's own writer and committer make the files: a task that is lost or runs twice leaves one copy, on any
file system that Spark knows. Each record ends with a line end because that writer puts one there; readers go by the
lengths alone.

Files are dealt by ranges of doc_id and each is ascending, so that the files in order of their numbers are one
ascending sequence. The index (file, ordinal, doc_id, offset, length, n_tokens, ids_crc32, checks) is a Parquet table
of its own.

Defined results: null texts count as empty and give the end id alone; rows with a null doc_id come first, as doc_id
null; equal doc_ids keep all their rows, side by side; texts are encoded whole; an empty table gives no files and an
empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import WordIndex, chunks, fresh_path, laid_out

END_ID = 0
#: Bytes of text that go to a file; the ids take about as much room as the text, or half of it.
FILE_BYTES = 24 << 20
#: Most words that a Python worker keeps; beyond, it goes on with those of the texts at hand.
KEPT_WORDS = 400_000
#: Code points that are encoded together, and words that the library's model gets at once.
TOGETHER, JOINED = 4 << 20, 4000
#: Rows that Spark hands to a Python worker at once.
ROWS_AT_ONCE = 1000
#: Files whose sizes are summed up together.
FILES_TOGETHER = 1024
NO_DOC = -(1 << 63)  # stands for a null doc_id in a payload
#: The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for characters from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - _PRINTED))}
INDEX = "file int, ordinal long, doc_id long, offset long, length long, n_tokens long, ids_crc32 long"
#: Letters of the Latin blocks, which are letters in all versions of the character tables, and marks behind words.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ".,!?;:)|#$%&*"
#: Words, marks and single line ends, which the pattern cuts apart wherever they meet.
_SIMPLE = rf"^[{_LETTERS}]+[{_MARKS}]*(?:\n[{_LETTERS}]+[{_MARKS}]*)*$"
#: A space between characters that surely aren't white space, where the byte-level pattern always cuts.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record of a file; raises where a checksum or a length doesn't hold."""
    at = 0
    while at < len(data):
        head = data[at : at + 8]
        if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
            raise ValueError(f"damaged length at byte {at}")
        size = struct.unpack("<Q", head)[0]
        payload = data[at + 12 : at + 12 + size]
        if len(payload) < size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        yield at, payload
        at += size + 17


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<qB", NO_DOC if doc_id is None else doc_id, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = struct.unpack_from("<qB", payload)
    return None if doc_id == NO_DOC else doc_id, np.frombuffer(payload, f"<u{width}", offset=9)


def _kind(byte: int) -> str | None:
    """What a byte of a simple piece is: letter, mark, line end or space."""
    c = chr(byte)
    if (c.isascii() and c.isalpha()) or 0x80 <= byte <= 0xBF or 0xC3 <= byte <= 0xC9:
        return "letter"
    return "mark" if c in _MARKS else {"\n": "end", " ": "space"}.get(c)


def crosses(piece: bytes) -> bool:
    """Whether a piece of the vocabulary holds two neighbours that the pattern would cut apart in joined simple words."""
    kinds = [_kind(x) for x in piece]
    return None not in kinds and any(x != y and x != "space" or y == "space" for x, y in zip(kinds, kinds[1:], strict=False))


class Kept:
    """Words with their ids, as columns: where each one's ids begin, how many there are, and all ids."""

    def __init__(self, kind: str):
        self.index, self.begin, self.sizes, self.ids = WordIndex(KEPT_WORDS), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def places(self, words: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The place of each of the distinct words; those that aren't kept are encoded first."""
        places, fresh, stay = self.index.find(words)
        if stay is not None:
            self.ids, self.sizes = laid_out(self.ids, self.begin[stay], self.sizes[stay]), self.sizes[stay]
        if len(fresh):
            sizes, ids = encode(fresh)
            self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))
        self.begin = np.cumsum(self.sizes) - self.sizes
        return places


class Encoder:
    """The library's byte-level BPE. Its pattern cuts at every single space between two other characters, and merges
    never cross a cut; so each such piece is encoded once and kept.

    A merge makes a piece of the vocabulary. Where no piece crosses a cut between simple words, many of them joined by
    spaces get from the library's model the ids that each gets alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Tokens that the library takes out of a text before its pattern cuts it.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = Tokenizer.from_file(path).model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words are kept here
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.spaced, self.bare = Kept(self.kind), Kept(self.kind)
        byte_of = {c: b for b, c in BYTE_CHARS.items()}
        vocabulary = [(w, i) for w, i in self.library.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in w)]
        self.joins = not any(crosses(bytes(byte_of[c] for c in w)) for w, _ in vocabulary)
        self.begins = np.zeros(self.library.get_vocab_size(), bool)
        self.begins[[i for w, i in vocabulary if w[0] == BYTE_CHARS[32]]] = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; those that hold an added token go to the library whole."""
        whole = [k for k, t in enumerate(texts) if any(x in t for x in self.added)]
        if whole:
            apart = set(whole)
            rest = iter(self._by_words([t for k, t in enumerate(texts) if k not in apart]))
            alone = iter(self.library.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False))
            return [np.array(next(alone).ids, self.kind) if k in apart else next(rest) for k in range(len(texts))]
        return self._by_words(texts)

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        pieces, offsets = split.values.dictionary_encode(), split.offsets.to_numpy()
        words = pieces.dictionary
        # A piece that is empty or has white space at an end may not be cut off so simply.
        odd = pc.or_(pc.equal(pc.utf8_length(words), 0), pc.not_equal(pc.utf8_trim_whitespace(words), words)).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._joined(pieces.indices.to_numpy(), words, offsets)
        where = np.maximum.reduceat(odd[pieces.indices.to_numpy()], offsets[:-1])
        careful = [_CUT.split(texts[k]) for k in np.flatnonzero(where)]
        flat = pa.array([w for p in careful for w in p], pa.large_string()).dictionary_encode()
        apart = iter(self._joined(flat.indices.to_numpy(), flat.dictionary, np.cumsum([0, *map(len, careful)])))
        plain = iter(self._by_words([texts[k] for k in np.flatnonzero(~where)]))
        return [next(apart) if w else next(plain) for w in where]

    def _joined(self, index: np.ndarray, words: pa.Array, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of texts whose pieces are words[index], each text from its offset to the next one."""
        first = offsets[:-1]
        inside = np.ones(len(index), bool)
        inside[first] = False
        seen = np.zeros(len(words), bool)
        seen[index[inside]] = True
        used = np.flatnonzero(seen)
        heads, head = np.unique(index[first], return_inverse=True)
        place = np.zeros(len(words), np.int64)
        place[used] = self.spaced.places(words.take(pa.array(used)), lambda w: self._fresh(w, " "))
        spot = place[index]
        spot[first] = len(self.spaced.sizes) + self.bare.places(words.take(pa.array(heads)), lambda w: self._fresh(w, ""))[head]
        begin = np.concatenate((self.spaced.begin, self.bare.begin + len(self.spaced.ids)))
        sizes = np.concatenate((self.spaced.sizes, self.bare.sizes))[spot]
        ids = laid_out(np.concatenate((self.spaced.ids, self.bare.ids)), begin[spot], sizes)
        return np.split(ids, np.cumsum(sizes)[offsets[1:-1] - 1])

    def _fresh(self, words: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has with `before` in front of it, and the ids of all."""
        simple = pc.match_substring_regex(words, _SIMPLE) if self.joins and before else pa.array(np.zeros(len(words), bool))
        flags = simple.to_numpy(zero_copy_only=False)
        easy, hard = np.flatnonzero(flags), np.flatnonzero(~flags)
        cuts = np.append(np.arange(0, len(easy), JOINED), len(easy))
        sizes, parts = [np.zeros(0, np.int64)], [np.zeros(0, self.kind)]
        for joined in pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.filter(simple).cast(pa.string())), " ").to_pylist():
            said = (" " + joined).encode().decode("latin-1").translate(BYTE_CHARS)
            parts.append(np.array([t.id for t in self.model.tokenize(said)], self.kind))
            sizes.append(np.diff(np.append(np.flatnonzero(self.begins[parts[-1]]), len(parts[-1]))))
        found = [e.ids for e in self.library.encode_batch_fast([before + w for w in words.take(pa.array(hard)).to_pylist()], add_special_tokens=False)]
        parts += [np.array(x, self.kind) for x in found]
        sizes = np.concatenate([*sizes, np.fromiter(map(len, found), np.int64, len(found))])
        order = np.argsort(np.concatenate((easy, hard)), kind="stable")
        return sizes[order], laid_out(np.concatenate(parts), (np.cumsum(sizes) - sizes)[order], sizes[order])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
    return Encoder(path)


def write(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = END_ID) -> None:
    """Encode each row of (doc_id, text) and write its record; ascending over the files."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    # Rows that share a doc_id, or have none, are dealt to as many files as they fill.
    order = ["doc_id", F.xxhash64("text"), "row"]
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer_path)
        closing = np.array([end_id], f"<u{tool.width}")
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in chunks(texts, TOGETHER):
                frames = [frame(pack(d, np.concatenate((x, closing)), tool.width)) for d, x in zip(ids[i:j], tool.encode(texts[i:j]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    at_once = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark, before = docs.sparkSession, docs.sparkSession.conf.get(at_once)
    spark.conf.set(at_once, str(ROWS_AT_ONCE))
    # A string of Spark holds bytes as they are, and the text writer puts them out as they are.
    try:
        dealt.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.text(out)
    finally:
        spark.conf.set(at_once, before)


def read_files(spark: SparkSession, where: str) -> DataFrame:
    """One row a file: its number and its bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(where).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")


def build_index(spark: SparkSession, where: str) -> DataFrame:
    """The offset index of the files, each record checked on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                n, data, rows = b.column(0)[k].as_py(), b.column(1)[k].as_py(), []
                for ordinal, (at, payload) in enumerate(unframe(data)):
                    doc_id, ids = unpack(payload)
                    rows.append((n, ordinal, doc_id, at, len(payload) + 17, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.int64()] * 6], strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    return read_files(spark, where).mapInArrow(run, INDEX)


def read_records(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, ids) of all records, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = [unpack(p) for _, p in unframe(b.column(1)[k].as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([x.astype(np.int64) for _, x in rows], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return read_files(spark, where).mapInArrow(run, "doc_id long, ids array<long>")


def read_at(data: bytes, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """One record out of a file's bytes data[offset : offset + length], as the index gives them."""
    ((_, payload),) = unframe(data[offset : offset + length])
    return unpack(payload)


def positions(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: where each document's ids begin in the one ascending sequence.

    Sums of files, then of FILES_TOGETHER files each: only the latter meet in one task, one row for about 25 GB of text."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = index.groupBy("file").agg(F.sum("n_tokens").alias("tokens")).withColumn("part", F.floor(F.col("file") / FILES_TOGETHER))
    parts = sums.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", F.coalesce(F.sum("tokens").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    in_part = F.coalesce(F.sum("tokens").over(before(Window.partitionBy("part").orderBy("file"))), F.lit(0))
    files = sums.withColumn("in_part", in_part).join(parts, "part").select("file", (F.col("base") + F.col("in_part")).alias("base"))
    local = index.withColumn("local", F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("file").orderBy("ordinal"))), F.lit(0)))
    return local.join(files, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def export(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the files and their index to the shared folder, read them back, and say where each document is."""
    spark = docs.sparkSession
    where = fresh_path(spark, "records")
    write(docs, tokenizer_path, f"{where}/data")
    build_index(spark, f"{where}/data").write.parquet(f"{where}/index")
    return positions(spark.read.schema(INDEX).parquet(f"{where}/index"))
