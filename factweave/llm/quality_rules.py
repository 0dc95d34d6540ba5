"""Quality rules: exact counts for each text, and a calibrated n-gram classifier trained on labelled quality rows.

Defined results: a null text counts as empty; an empty text has zero counts and fails the base rules; texts of any
length are handled whole; equal rows get equal results; an empty table gives an empty result; without labels of both
kinds only the base rules decide; extra columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._classifier import TextClassifier, sparse_features
from ._ngrams import Words
from ._shared import chunks, least_hashes, map_texts, sample_per_stratum

#: Bound of the training sample: labelled rows of each class.
TRAIN_ROWS = 800
#: Fixed thresholds.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, MIN_PROBABILITY = 20, 30, 8, 0.5
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def text_features(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, value): the hashed features of each whole text, bounded by the tables' size."""

    def work(texts: list[str | None]) -> dict:
        rows = sparse_features([t or "" for t in texts])
        return {"index": pa.array([i for i, _ in rows], pa.list_(pa.int32())), "value": pa.array([v for _, v in rows], pa.list_(pa.float32()))}

    kind = df.schema[key].dataType.simpleString()
    return map_texts(df, key, text, work, f"`{key}` {kind}, index array<int>, value array<float>")


def fit_on_labels(docs: DataFrame, labelled: DataFrame, label: str, rows: int, with_priors: bool = False) -> TextClassifier:
    """Train on at most `rows` documents of each class. `labelled` holds doc_id and the class in column `label`.

    Of several labels or texts of one doc_id the least counts, so that one row for each sampled doc_id comes to the driver.
    `with_priors` weighs classes by their labelled rows; else they count alike."""
    priors = {r[0]: r[1] for r in labelled.where(F.col(label).isNotNull()).groupBy(label).count().collect()} if with_priors else None
    chosen = sample_per_stratum(labelled.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label)), "doc_id", label, rows)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    got = text_features(texts, "doc_id", "text").toArrow().combine_chunks()
    index, value = (got.column(c).combine_chunks() for c in ("index", "value"))
    flat = [x.values.to_numpy() for x in (index, value)]
    begin = index.offsets.to_numpy()
    features = {d: tuple(x[begin[i] : begin[i + 1]] for x in flat) for i, d in enumerate(got.column("doc_id").to_pylist())}
    kept = [r for r in least_hashes(chosen.collect(), lambda r: r[label], lambda r: (r["sample_hash"], r["doc_id"]), rows) if r["doc_id"] in features]
    kept.sort(key=lambda r: (r["sample_hash"], r["doc_id"]))
    return TextClassifier.fit([features[r["doc_id"]] for r in kept], [r[label] for r in kept], priors=priors)


def _repeats(owner: np.ndarray, hashes: np.ndarray, words_before: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Words in windows that occur twice or more in their text, by text."""
    counts = np.zeros(len(words_before) - 1, np.int64)
    if len(hashes):
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        same = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        cover = np.zeros(words_before[-1] + 1, np.int32)
        hit = starts[order[twice]]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + size, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
        counts = covered[words_before[1:]] - covered[words_before[:-1]]
    return counts


def measure(texts: list[str], words: Words) -> dict[str, np.ndarray]:
    """The exact counts of the base rules."""
    n, cp = len(texts), words.cp
    before = np.concatenate((words.first, words.last[-1:])) if n else np.zeros(1, np.int64)
    sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.concatenate((words.starts, words.ends[-1:]))])
    word_chars = np.concatenate(([0], np.cumsum(words.word_end - words.word_start)))
    # Lines end at every \n; the one added behind each text closes its last line.
    ends = np.flatnonzero(cp == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    holds = np.searchsorted(words.word_start, ends) > np.searchsorted(words.word_start, starts)
    starts, ends = starts[holds], ends[holds]
    owner, hashes = np.searchsorted(words.ends, starts, side="right"), words.span_hash(starts, ends)
    order = np.lexsort((hashes, owner))
    again = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    window_hashes, window_owner = words.windows(WINDOW)
    all_owner = np.repeat(np.arange(n), words.n_words)
    first_words = np.flatnonzero(all_owner[: len(all_owner) - WINDOW + 1] == all_owner[WINDOW - 1 :]) if len(all_owner) >= WINDOW else np.zeros(0, np.int64)
    return {
        "n_words": words.n_words.astype(np.int64),
        "word_chars": word_chars[before[1:]] - word_chars[before[:-1]],
        "n_symbols": sums(np.isin(cp, [ord(c) for c in SYMBOLS])).astype(np.int64),
        "n_dup_lines": np.bincount(owner[order][1:][again], minlength=n).astype(np.int64),
        "n_repeat_words": _repeats(window_owner, window_hashes, before, first_words, WINDOW).astype(np.int64),
    }


def judge(docs: DataFrame, model: TextClassifier) -> DataFrame:
    """Counts, base verdict, calibrated probability of good quality, and `kept`, for each row of (doc_id, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> dict:
        model, whole = shipped.value, [t or "" for t in texts]
        words = Words(whole)
        out = measure(whole, words)
        n, repeat = out["n_words"], out["n_repeat_words"]
        failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
        p = model.posteriors(words)[:, model.classes.index(1)] if len(model.classes) > 1 else np.ones(len(n))
        return out | {"base_failed": failed, "probability": p, "kept": ~failed & (p >= MIN_PROBABILITY)}

    return map_texts(docs, "doc_id", "text", work, SCHEMA)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> TextClassifier:
    return fit_on_labels(docs, labels.where(F.col("quality").isin(0, 1)), "quality", rows)
