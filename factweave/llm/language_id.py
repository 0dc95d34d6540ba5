"""Language identification by cross-parsing entropy.

For each language the transitions of a suffix automaton of labelled text are packed into one array: each state has its
row moved to where its letters find free places. A text is parsed from left to right into the longest matches that the
language's reference text holds; the language that needs the fewest phrases a character wins. All letters that the
references hold are told apart, however many. Texts are parsed in blocks of BLOCK letters, side by side, so that a very
long text costs no more a character than a short one.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the first language by name;
without any labelled text every result is `und` with score 0; rows with equal texts get equal results; a null doc_id
is held in, and its text is never learnt from.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import least_hashes, map_texts, sample_per_stratum

#: Bounds of what is learnt, for each language: documents, characters of reference text, and code points of one document,
#: taken from WINDOWS places spread over the whole text.
TRAIN_ROWS, REFERENCE_CHARS, DOCUMENT_CHARS, WINDOWS = 60, 24_000, 8_000, 8
#: Letters that are parsed in a row.
BLOCK = 4096
LETTER = re.compile(r"[^\W\d_]")
SCHEMA = "doc_id long, lang_pred string, score double"


def _letters(text: str) -> str:
    return " ".join(LETTER_RUNS.findall(text.lower()))


LETTER_RUNS = re.compile(r"[^\W\d_]+")


def suffix_automaton(classes: list[int]) -> tuple[list[dict[int, int]], int]:
    """Transitions of the minimal automaton of all substrings (Blumer et al. 1985)."""
    moves, link, longest, last = [{}], [-1], [0], 0
    for c in classes:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                twin = len(moves)
                moves.append(dict(moves[to]))
                longest.append(longest[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return moves, len(moves)


def packed(moves: list[dict[int, int]], n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of transitions in one array by displacement (Tarjan and Yao 1979): where each state's row begins, and for each
    place the state it belongs to (-1 for none) and the next state."""
    size = n_codes + max(64, 5 * sum(map(len, moves)) // 2)
    base, owner, to = np.zeros(len(moves), np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
    free, rng, room = bytearray(b"\1") * size, random.Random(7), size - n_codes
    for s in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
        at = 0
        while any(not free[at + c] for c in moves[s]):
            at = rng.randrange(room)
        base[s] = at
        for c, nxt in moves[s].items():
            free[at + c], owner[at + c], to[at + c] = 0, s, nxt
    return base, owner, to


class CrossParser:
    """Codes of letters: 0 anything that no reference holds, 1 a run of non-letters, then the letters of the references."""

    def __init__(self, references: dict[str, str]):
        self.languages = sorted(references)
        prepared = [_letters(references[x]) for x in self.languages]
        known = sorted(set().union(*prepared) - {" "})
        self._codes = np.zeros(0x110000, np.int32)
        self._codes[ord(" ")] = 1
        for k, c in enumerate(known):
            self._codes[ord(c)] = k + 2
        n, states, places = len(known) + 2, 0, 0
        self._roots, self._fresh = np.zeros(len(prepared), np.int32), np.zeros((len(prepared), n), np.int32)
        parts: list[tuple[np.ndarray, ...]] = []
        for k, text in enumerate(prepared):
            moves, _ = suffix_automaton(self._encode(text).tolist())
            base, owner, to = packed(moves, n)
            self._roots[k] = states
            self._fresh[k] = states
            for c, nxt in moves[0].items():
                self._fresh[k, c] = states + nxt
            parts.append((base + places, np.where(owner < 0, -1, owner + states), to + states))
            states, places = states + len(moves), places + len(owner)
        self._base, self._owner, self._to = (np.concatenate(x).astype(np.int32) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 3

    def _encode(self, text: str) -> np.ndarray:
        return self._codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text for each language, and the characters parsed of each text."""
        coded = [self._encode(_letters(t)) for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        blocks = [(i, b) for i, c in enumerate(coded) for b in range(0, len(c), BLOCK)]
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        lengths = np.array([min(BLOCK, sizes[i] - b) for i, b in blocks], np.int64)
        order = np.argsort(-lengths, kind="stable")
        for lo in range(0, len(order), 512):
            own = order[lo : lo + 512]
            width = int(lengths[own[0]])
            lanes = np.zeros((width, len(own)), np.int32)
            for k, o in enumerate(own):
                i, b = blocks[o]
                lanes[: lengths[o], k] = coded[i][b : b + BLOCK]
            alive = np.searchsorted(-lengths[own], -np.arange(width), side="left")
            state = np.repeat(self._roots[:, None], len(own), axis=1)
            ended = np.zeros(state.shape, np.int32)
            for t in range(width):
                n = alive[t]
                now, code = state[:, :n], lanes[t, :n]
                place = self._base[now] + code
                goes = self._owner[place] == now
                ended[:, :n] += ~goes
                state[:, :n] = np.where(goes, self._to[place], self._fresh[:, code])
            ended += state != self._roots[:, None]  # the last phrase of each block
            np.add.at(out, np.array([blocks[o][0] for o in own]), ended.T)
        return out, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        live = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if live and self.languages:
            counts, sizes = self.phrases([texts[i] for i in live])
            rate = counts / np.maximum(sizes, 1)[:, None]
            least = np.sort(rate, axis=1)
            score = 1 - least[:, 0] / (least[:, 0] + least[:, 1]) if rate.shape[1] > 1 else np.ones(len(live))
            for i, k, s in zip(live, rate.argmin(axis=1), score, strict=True):
                names[i], scores[i] = self.languages[k], float(s)
        return names, scores


@lru_cache(maxsize=2)
def _parser(references: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(dict(references))


def _spread(text: str, limit: int) -> str:
    """The text if it is that short, else windows of it from evenly spread places."""
    if len(text) <= limit:
        return text
    size = limit // WINDOWS - 1  # and a space
    last = len(text) - size
    return " ".join(text[last * k // (WINDOWS - 1) :][:size] for k in range(WINDOWS))


def references(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[tuple[str, str], ...]:
    """Reference text of each language, from at most `rows` of its documents (doc_id, text, lang); of several texts of one
    doc_id the least counts, by what is kept of it."""
    usable = labelled.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    size = DOCUMENT_CHARS // WINDOWS
    last = F.length("text") - size
    windows = [F.substr("text", (last * k / (WINDOWS - 1)).cast("int") + 1, F.lit(size)) for k in range(WINDOWS)]
    cut = F.when(F.length("text") <= DOCUMENT_CHARS, F.col("text")).otherwise(F.concat_ws(" ", *windows))
    sampled = sample_per_stratum(usable, "doc_id", "lang", rows).groupBy("doc_id", "lang", "sample_hash").agg(F.min(cut).alias("text"))
    got = least_hashes(sampled.collect(), lambda r: r["lang"], lambda r: (r["sample_hash"], r["doc_id"], r["text"]), rows)
    texts: dict[str, list[str]] = {}
    for r in got:
        texts.setdefault(r["lang"], []).append(_letters(r["text"]))
    # Equal shares of each document, so that one long text is not all that a language knows.
    return tuple((k, " ".join(_spread(t, REFERENCE_CHARS // len(v) - 1) for t in v)) for k, v in sorted(texts.items()))


def identify(docs: DataFrame, learnt: tuple[tuple[str, str], ...]) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of (doc_id, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(learnt)

    def work(texts: list[str | None]) -> dict:
        names, scores = _parser(shipped.value).predict(texts)
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return map_texts(docs, "doc_id", "text", work, SCHEMA)


def held_out() -> F.Column:
    """Whether crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
