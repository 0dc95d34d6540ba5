"""Hashed word and character n-gram logistic regression: trained on a bounded sample, scored in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ._ngrams import Words, char_ngrams

#: n-gram families: name and length. Each has a table of its own with 2**BITS weights for each class.
FAMILIES = (("word", 1), ("word", 2), ("char", 4))
BITS = 15
#: An n-gram's value is its count over the square root of the family's count in the text: the sum over many n-grams that
#: say nothing stays of one size, and a few that say much are not lost in a long text.


def _hashed(words: Words, kind: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    h, owner = words.windows(size) if kind == "word" else char_ngrams(words, size)
    if kind == "word":
        at = (h >> np.uint64(64 - BITS)).astype(np.int64)
        if size == 2 and len(words.hashes) > 1:  # a word that follows itself is one n-gram, whatever the word
            again = words.hashes[1:] == words.hashes[:-1]
            at[again[np.repeat(np.arange(len(words.n_words)), words.n_words)[:-1] == np.repeat(np.arange(len(words.n_words)), words.n_words)[1:]]] = 0
        return at, owner
    return (h >> np.uint32(32 - BITS)).astype(np.int64), owner


def sparse_features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the indices and the values of its features: the counts of its n-grams, scaled by family."""
    words, n = Words(texts), len(texts)
    index, value, owner = [], [], []
    for f, (kind, size) in enumerate(FAMILIES):
        h, own = _hashed(words, kind, size)
        total = np.bincount(own, minlength=n)
        keys, counts = np.unique(own << BITS | h, return_counts=True)
        index.append((keys & ((1 << BITS) - 1)) + (f << BITS))
        owner.append(keys >> BITS)
        value.append(counts / np.sqrt(total[keys >> BITS]))
    index, value, owner = map(np.concatenate, (index, value, owner))
    return [(index[owner == i].astype(np.int32), value[owner == i].astype(np.float32)) for i in range(n)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class TextClassifier:
    """weights: (families * 2**BITS, classes); temperature and prior calibrate the posteriors."""

    classes: list
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    @classmethod
    def fit(cls, features: list[tuple[np.ndarray, np.ndarray]], labels: list, *, rounds: int = 60, rate: float = 0.2, decay: float = 3e-4, priors: dict | None = None) -> TextClassifier:
        """Balanced cross-entropy by Adam over four fifths of the rows; the rest calibrates the temperature.

        With `priors`, rows of each class among all that were labelled, the posteriors are brought back from balance.
        With one class the posterior is 1; without rows there are no classes and the caller decides."""
        classes = sorted(set(labels), key=str)
        k, dim = len(classes), len(FAMILIES) << BITS
        model = cls(classes, np.zeros((dim, k), np.float32), np.zeros(k))
        if k < 2:
            return model
        y = np.array([classes.index(v) for v in labels])
        held = np.arange(len(y)) % 5 == 4
        if min(np.bincount(y[~held], minlength=k)) == 0 or not held.any():
            held[:] = False
        sizes = np.array([len(i) for i, _ in features])
        index = np.concatenate([i for i, _ in features])
        value = np.concatenate([v for _, v in features])
        row = np.repeat(np.arange(len(y)), sizes)
        use = ~held[row]
        uses, rows, values = index[use], row[use], value[use].astype(np.float64)
        active = np.unique(uses)
        spot = np.searchsorted(active, uses)
        w, b = np.zeros((len(active), k)), np.zeros(k)
        weight = 1.0 / np.maximum(np.bincount(y[~held], minlength=k), 1)[y] * ~held / k
        target = np.eye(k)[y]
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k)]
        for t in range(1, rounds + 1):
            z = np.stack([np.bincount(rows, values * w[spot, c], len(y)) for c in range(k)], 1) + b
            err = (softmax(z) - target) * weight[:, None]
            grad = np.stack([np.bincount(spot, values * err[rows, c], len(active)) for c in range(k)], 1) + decay * w
            for p, g, m, v in ((w, grad, moments[0], moments[1]), (b, err.sum(0), moments[2], moments[3])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        model.weights[active] = w
        model.bias = b
        if held.any():
            z = np.stack([np.bincount(row, value * model.weights[index, c], len(y)) for c in range(k)], 1) + b
            z, t = z[held], y[held]
            loss = lambda s: -np.log(softmax(z / s)[np.arange(len(t)), t] + 1e-12).mean()
            model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        if priors:
            model.bias = model.bias + model.temperature * np.log([priors[c] / sum(priors.values()) * k for c in classes])
        return model

    def posteriors(self, words: Words) -> np.ndarray:
        """Calibrated posteriors of each text, one column for each class."""
        n, k = len(words.n_words), len(self.classes)
        if k < 2:
            return np.ones((n, k))
        z = np.tile(self.bias, (n, 1))
        for f, (kind, size) in enumerate(FAMILIES):
            h, own = _hashed(words, kind, size)
            total = np.maximum(np.bincount(own, minlength=n), 1)
            for c in range(k):
                z[:, c] += np.bincount(own, self.weights[(f << BITS) : (f + 1) << BITS, c][h], n) / np.sqrt(total)
        return softmax(z / self.temperature)
