"""SentencePiece encoding and decoding with byte offsets.

The text is normalised by the longest prefixes that the model's compiled character map holds; each byte of the result
remembers the bytes of the source that it came from, so that every piece can be projected onto a span of the original
text. Pieces and ids are the library's own. Where no piece of a model has a space mark behind another character, merges
never cross into a run of marks; then each word is encoded and aligned once, and kept with the source bytes that each of
its pieces spans. A text's spans are those of its words, one word behind the other.

Defined results: null texts count as empty, which encodes to the end id alone; texts are encoded whole; equal texts
get equal results; lone surrogates cannot occur in Spark strings; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WordIndex, laid_out, map_texts

MARK = "▁"
#: Most words that a Python worker keeps; beyond, it goes on with those of the texts at hand.
KEPT_WORDS = 500_000
#: Words that the library gets as one text, and code points that are encoded together.
JOINED, TOGETHER = 4000, 4 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long, spans_crc32 long"


def proto_fields(data: bytes) -> dict[int, list]:
    """Fields of one protocol buffer message, by number; values are ints or bytes."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value, at = data[at : at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


class CharacterMap:
    """The compiled map: a double array (Aoe 1989) of source prefixes, and the zero-ended strings that replace them."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] in the map, and what replaces it."""
        if not self.units:
            return None
        node, best = 0, None
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100 and node < len(self.units):
                value = self.units[node] & 0x7FFFFFFF
                best = (k + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return best


@dataclass
class Normalizer:
    """What the model's settings do to a text, with alignment."""

    char_map: CharacterMap
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def plain(self) -> bool:
        return not self.char_map.units and self.dummy_prefix and not self.squeeze and self.escape

    def run(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised UTF-8, and for each of its bytes, and its end, where in the source it begins."""
        data, at = text.encode("utf-8", "surrogatepass"), 0
        out, origin = bytearray(), []
        space = MARK.encode() if self.escape else b" "

        def put(what: bytes, where: int) -> None:
            out.extend(what)
            origin.extend([where] * len(what))

        pieces = []
        while at < len(data):
            hit = self.char_map.longest(data, at)
            if hit:
                pieces.append((at, hit[1]))
                at += hit[0]
            else:
                first = data[at]
                n = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                pieces.append((at, data[at : at + n]))
                at += n
        if self.squeeze:
            lead = 0
            while lead < len(pieces) and not pieces[lead][1].strip(b" "):
                lead += 1
            pieces = pieces[lead:]
        if pieces and self.dummy_prefix:
            put(space, pieces[0][0])
        was_space = self.squeeze
        for where, what in pieces:
            if self.squeeze and was_space:
                what = what.lstrip(b" ")
            for b in (bytes([x]) for x in what):
                if b == b" ":
                    if not (self.squeeze and was_space):
                        put(space, where)
                    was_space = True
                else:
                    put(b, where)
                    was_space = False
        end = len(data)
        if self.squeeze:
            while out.endswith(space) and out:
                del out[-len(space) :]
                end = origin[-len(space)]
                del origin[-len(space) :]
        return bytes(out), [*origin, end]


class Kept:
    """Words and what is kept of each: its ids in decimal, each with a space behind it, its bytes once decoded, and the
    number of source bytes that each piece spans, the mark before the word not counted."""

    def __init__(self) -> None:
        self.index, self.said, self.raw = WordIndex(KEPT_WORDS), np.zeros(0, object), np.zeros(0, object)
        self.pieces, self.begin, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def places(self, words: pa.Array, tell: Callable[[list[str]], tuple[np.ndarray, ...]]) -> np.ndarray:
        """The place of each of the distinct words; those that aren't kept are told first."""
        places, fresh, stay = self.index.find(words)
        if stay is not None:
            self.sizes = laid_out(self.sizes, self.begin[stay], self.pieces[stay])
            self.said, self.raw, self.pieces = self.said[stay], self.raw[stay], self.pieces[stay]
        if len(fresh):
            new = tell(fresh.to_pylist())
            self.said, self.raw, self.pieces, self.sizes = (np.concatenate(x) for x in zip((self.said, self.raw, self.pieces, self.sizes), new, strict=True))
        self.begin = np.cumsum(self.pieces) - self.pieces
        return places


def objects(items: list) -> np.ndarray:
    out = np.empty(len(items), object)
    out[:] = items
    return out


@dataclass
class Codec:
    path: str
    kept: Kept = field(default_factory=Kept)

    def __post_init__(self) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=self.path)
        with open(self.path, "rb") as f:
            model = proto_fields(f.read())
        spec = proto_fields(model.get(3, [b""])[0])
        flag = lambda n: bool(spec.get(n, [1])[0])
        self.normalizer = Normalizer(CharacterMap(spec.get(2, [b""])[0]), flag(3), flag(4), flag(5))
        #: A merge of BPE makes a piece of the model, so none crosses from a character into a space mark.
        kind = proto_fields(model.get(2, [b""])[0]).get(3, [1])[0]
        self.by_word = kind == 2 and self.normalizer.plain and not any(re.search(f"[^{MARK}]{MARK}", self.library.id_to_piece(i)) for i in range(self.library.get_piece_size()))
        self.byte = {i: int(self.library.id_to_piece(i)[3:5], 16) for i in range(self.library.get_piece_size()) if self.library.is_byte(i)}
        #: What each piece stands for in the source.
        self.piece = [bytes([self.byte[i]]) if i in self.byte else self.library.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.library.get_piece_size())]
        self.size = [len(x) for x in self.piece]
        self.said = [str(i) for i in range(self.library.get_piece_size())]
        self.said_bytes = [f"{i} ".encode() for i in range(self.library.get_piece_size())]
        self.begins = np.array([self.library.id_to_piece(i).startswith(MARK) for i in range(self.library.get_piece_size())])
        self.end, self.unknown, self.mark = self.library.eos_id(), self.library.unk_id(), self.library.piece_to_id(MARK)

    def spans(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids (without the end id) and the span of source bytes of each piece.

        Pieces are laid along the normalised text in order, and its alignment takes each to the source. The mark put
        before the text spans no bytes; bytes of one character that fell apart each span their own byte."""
        ids = self.library.encode(text)
        if self.normalizer.plain and MARK not in text and self.unknown not in ids:
            ends = self._plain_ends(ids)
            return ids, list(zip([0, *ends], ends, strict=False)) if ends else []
        normal, origin = self.normalizer.run(text)
        out, at = [], 0
        unknown = self.unknown
        for n, i in enumerate(ids):
            if i == unknown:
                # An unknown piece covers all up to where the next known piece is found.
                nxt = next((self._bytes(j) for j in ids[n + 1 :] if j != unknown), None)
                end = len(normal) if nxt is None else normal.find(nxt, at + 1)
                end = len(normal) if end < 0 else end
            else:
                end = at + len(self._bytes(i))
            out.append((origin[at], origin[min(end, len(normal))]))
            at = end
        return ids, self._split_bytes(ids, out)

    def _bytes(self, i: int) -> bytes:
        return bytes([self.byte[i]]) if i in self.byte else self.library.id_to_piece(i).encode()

    def _split_bytes(self, ids: list[int], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Byte pieces of one character begin at the same place; they take its bytes one by one."""
        out, k = list(spans), 0
        for same, group in groupby(range(len(ids)), key=lambda j: ids[j] in self.byte):
            members = list(group)
            if not same:
                continue
            while k < len(members):
                run = [j for j in members[k:] if spans[j][0] == spans[members[k]][0]]
                first, last = spans[run[0]][0], spans[run[-1]][1]
                for n, j in enumerate(run):
                    out[j] = (min(first + n, last), min(first + n + 1, last) if n + 1 < len(run) else last)
                k += len(run)
            k = 0
        return out

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word with a mark before it. Many words at once where each one's first piece is the one with the mark."""
        out: list[list[int] | None] = [None] * len(words)
        simple = [k for k, w in enumerate(words) if w and " " not in w]
        for lo in range(0, len(simple), JOINED):
            some = simple[lo : lo + JOINED]
            ids = self.library.encode(" ".join([words[k] for k in some]))
            cuts = np.flatnonzero(self.begins[ids]).tolist()
            if len(cuts) == len(some):
                for k, a, b in zip(some, cuts, [*cuts[1:], len(ids)], strict=True):
                    out[k] = ids[a:b]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self.library.encode([words[k] for k in rest], num_threads=1), strict=True):
            out[k] = ids or [self.mark]  # the mark that ends a text
        return out

    def _tell(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """What is kept of each word, in columns."""
        piece, said, size, unknown = self.piece, self.said_bytes, self.size, self.unknown
        found, sizes = self._encode_words(words), []
        for word, ids in zip(words, found, strict=True):
            if unknown in ids:
                sizes += [b - a for a, b in self.spans(word)[1]]
            else:
                sizes += [size[i] for i in ids]
                sizes[-len(ids)] -= 1  # the mark put before the word stands for no byte of it
        return objects([b"".join([said[i] for i in ids]) for ids in found]), objects([b"".join([piece[i] for i in ids]) for ids in found]), np.fromiter(map(len, found), np.int64, len(found)), np.array(sizes, np.int32)

    def _plain_ends(self, ids: list[int]) -> list[int]:
        """Where the pieces end in the source when nothing but the space marks was changed: a mark stands for one byte,
        the first one, put before the text, for none."""
        return list(accumulate([len(self.piece[i]) for i in ids], initial=-1))[1:]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, int, int]]:
        """For each text, of its ids with the end id: how many, their hash, the hash of the decoded text, the source bytes
        that pieces span, and a checksum of all spans."""
        whole = [not (self.by_word and t and MARK not in t) for t in texts]
        rest = iter(self._by_words([t for t, w in zip(texts, whole, strict=True) if not w]))
        return [self._whole(t) if w else next(rest) for t, w in zip(texts, whole, strict=True)]

    def _by_words(self, texts: list[str]) -> list[tuple[int, str, str, int, int]]:
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words, offsets = split.values, split.offsets.to_numpy()
        if pc.any(pc.equal(pc.binary_length(words), 0)).as_py():
            # Each space before a word is the mark that encoding the word alone puts before it. Runs of spaces go with
            # the word behind them: of n spaces, n - 1 are text of that word.
            lists = [self._words(t) for t in texts]
            words, offsets = pa.array([w for x in lists for w in x], pa.large_string()), np.cumsum([0, *map(len, lists)])
        coded, k = words.dictionary_encode(), self.kept
        spot = k.places(coded.dictionary, self._tell)[coded.indices.to_numpy()]
        return [self._join(spot[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def _whole(self, text: str) -> tuple[int, str, str, int, int]:
        ids, spans = self.spans(text)
        ids = [*ids, self.end]
        return len(ids), _sha(" ".join([self.said[i] for i in ids]).encode()), _sha(self.library.decode(ids).encode()), sum(b - a for a, b in spans), spans_checksum(spans)

    def _join(self, spot: np.ndarray) -> tuple[int, str, str, int, int]:
        """What the library does to the whole text: ids one after the other; decoded, without the space put before the text.

        Spans too stand one after the other; each word but the first has the space before it in its first piece."""
        k = self.kept
        said, decoded = b"".join(k.said[spot].tolist()), b"".join(k.raw[spot].tolist())[1:]
        pieces = k.pieces[spot]
        sizes = laid_out(k.sizes, k.begin[spot], pieces).astype(np.int64)
        sizes[np.cumsum(pieces)[:-1]] += 1
        ends = np.cumsum(sizes)
        spans = np.stack((ends - sizes, ends), axis=1)
        return len(sizes) + 1, _sha(said + self.said[self.end].encode()), _sha(decoded), int(ends[-1]), spans_checksum(spans)

    def _words(self, text: str) -> list[str]:
        pieces = text.split(" ")
        return [x[1:] for x in re.findall(" +[^ ]*", " " + text)] if "" in pieces else pieces


def spans_checksum(spans: list[tuple[int, int]] | np.ndarray) -> int:
    """CRC-32 of the first and last offset of each piece, as 64-bit integers."""
    return zlib.crc32(np.asarray(spans, "<i8").tobytes())


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Digests of ids and decoded text of each row of (doc_id, text). The model is on every machine at `model_path`."""

    def work(texts: list[str | None]) -> dict:
        c = codec(model_path)
        rows = c.digests([t or "" for t in texts])
        return {"n_tokens": pa.array([r[0] for r in rows], pa.int64()), "ids_sha256": pa.array([r[1] for r in rows], pa.string()), "decoded_sha256": pa.array([r[2] for r in rows], pa.string()), "span_bytes": pa.array([r[3] for r in rows], pa.int64()), "spans_crc32": pa.array([r[4] for r in rows], pa.int64())}

    return map_texts(docs, "doc_id", "text", work, SCHEMA, TOGETHER)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, span_starts, span_ends) with the end id, whose span is empty at the text's end."""

    def work(texts: list[str | None]) -> dict:
        c = codec(model_path)
        rows = [c.spans(t or "") for t in texts]
        ends = [len((t or "").encode()) for t in texts]
        return {
            "ids": pa.array([[*i, c.end] for i, _ in rows], pa.list_(pa.int32())),
            "span_starts": pa.array([[*(a for a, _ in s), e] for (_, s), e in zip(rows, ends, strict=True)], pa.list_(pa.int64())),
            "span_ends": pa.array([[*(b for _, b in s), e] for (_, s), e in zip(rows, ends, strict=True)], pa.list_(pa.int64())),
        }

    return map_texts(docs, "doc_id", "text", work, "doc_id long, ids array<int>, span_starts array<long>, span_ends array<long>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows with `ids`; null ids give a null text."""

    def run(batches):
        for b in batches:
            c = codec(model_path)
            out = [None if i is None else c.library.decode([x for x in i if x is not None]) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id"), F.col("ids")).mapInArrow(run, "doc_id long, text string")
