"""Mixing sources to target weights by soft membership.

A classifier trained on a labelled table gives each document posteriors p over the domains. Rates r >= 0, one for each
document, are fitted so that the expected tokens of each domain, sum of r * tokens * p, come to its target: least squares

    1/2 sum over domains of error^2 / mass  +  RIDGE/2 sum over documents of tokens * (r - 1)^2

where an error is measured by what the domain holds, and the second term, small, takes of all rates that do so those
nearest to 1. The fit is by projected gradients, r <- max(0, r - p . step), in the metric where a document weighs its
tokens; so all iterates are r = max(0, 1 - p . s) with one sum of steps s for the whole corpus, and documents keep no
state. The gradient and the curvature along p of the documents that the projection leaves above 0 are sums over all
documents, a few numbers for each pair of domains: each pass is one scan with a map-side sum, and a lost executor costs
nothing but its tasks. Steps are scaled by that curvature and halved until the objective of the dual falls, so that
about ten passes do what plain gradient steps don't in hundreds.

The fit ends when its gap is closed: when a whole step would move no domain's tokens by more than TOLERANCE of its mass.
It fails loudly if that takes over PASSES passes. Targets that no rates reach get the nearest ones by the objective; the
result names what each domain was to have and has, and a warning says so.

A rate of 1.3 means one copy and, by a hash of doc_id, a second one for 30 % of such documents.

Defined results: null and empty texts have no tokens and do not count in the fit; without labels every rate is 1 and
the domain null; domains without labelled rows, mass or weight are left out and the other weights scaled up; equal
texts get equal rates; an empty table gives an empty result; of rows that share a labelled doc_id one text is learnt.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._classifier import TextClassifier
from ._ngrams import Words
from ._shared import map_texts, materialize
from .quality_rules import fit_on_labels

#: Bound of the training sample: labelled rows of each domain.
TRAIN_ROWS = 800
#: Shares of the tokens that each domain is to have.
WEIGHTS = {"clean": 0.93, "junk": 0.05, "toxic": 0.02}
#: The share of a domain's mass at which the gap counts as closed, the most passes, and the weight of rates near 1.
TOLERANCE, PASSES, RIDGE = 1e-7, 200, 1e-4
#: A domain that misses its target by more than this share is warned of.
MISSED = 0.01
SEED = 11


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled rows: toxic, else by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())


def posteriors(docs: DataFrame, model: TextClassifier) -> DataFrame:
    """(doc_id, n_tokens, posterior) of each row of (doc_id, text); tokens are words."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> dict:
        words = Words([t or "" for t in texts])
        p = shipped.value.posteriors(words)
        return {"n_tokens": words.n_words.astype(np.int64), "posterior": pa.array(list(p), pa.list_(pa.float64()))}

    return map_texts(docs, "doc_id", "text", work, "doc_id long, n_tokens long, posterior array<double>")


def _rate(steps: np.ndarray | None) -> Column:
    """The rate after the sum of all steps, from the posteriors alone."""
    if steps is None:
        return F.lit(1.0)
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col("posterior")[d] * F.lit(float(x)) for d, x in enumerate(steps)), F.lit(0.0)))


def _sums(members: DataFrame, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Over all documents: each domain's tokens, the curvature of those above 0, and the weighted squares of the rates."""
    k, t = len(steps), F.col("n_tokens")
    p = [F.col("posterior")[d] for d in range(k)]
    above = F.when(F.col("r") > 0, t).otherwise(0)
    rated = members.select("n_tokens", "posterior", _rate(steps).alias("r"))
    row = rated.agg(
        *(F.sum(F.col("r") * t * p[d]) for d in range(k)),
        *(F.sum(above * p[d] * p[e]) for d in range(k) for e in range(d, k)),
        F.sum(t * F.col("r") * F.col("r")),
    ).first()
    row = [float(x or 0.0) for x in row]
    curvature = np.zeros((k, k))
    curvature[np.triu_indices(k)] = row[k:-1]
    return np.array(row[:k]), np.maximum(curvature, curvature.T), row[-1]


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float], total: float | None = None) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """The sum of steps that gives the rates, and each domain's tokens: fitted and wanted.

    `total` is the wanted number of tokens; by default the most for which no domain has to be repeated on the whole."""
    k = len(domains)
    steps = np.zeros(k)
    mass, curvature, squares = _sums(members, steps)
    wanted = np.array([weights.get(d, 0.0) for d in domains])
    live = (mass > 0) & (wanted > 0)
    if not live.any():
        return None, mass, mass
    share = np.where(live, wanted, 0) / wanted[live].sum()
    target = share * (total if total is not None else (mass[live] / share[live]).min())
    scale = np.maximum(mass, 1.0)
    now = mass
    objective = lambda s, sq: RIDGE / 2 * (scale * s * s).sum() + sq / 2 + target @ s
    for _ in range(PASSES):
        gradient = RIDGE * scale * steps + target - now
        step = np.linalg.solve(curvature + RIDGE * np.diag(scale), -gradient)
        moved = curvature @ step
        if np.all(np.abs(moved) <= TOLERANCE * scale) and np.all(np.abs(gradient) <= 10 * TOLERANCE * scale):
            return steps, now, target
        here, size = objective(steps, squares), 1.0
        while True:
            tried = steps + size * step
            now, curvature, squares = _sums(members, tried)
            if objective(tried, squares) <= here + 1e-4 * size * (gradient @ step) + 1e-12 * abs(here) or size < 1e-6:
                break
            size /= 2
        steps = tried
    raise RuntimeError(f"rates did not settle in {PASSES} passes; {dict(zip(domains, (target - now).tolist(), strict=True))} tokens are missing")


def copies_of(rate: Column) -> Column:
    """Whole copies, and one more with the probability of the rest, by a hash of doc_id."""
    chance = F.xxhash64(F.col("doc_id"), F.lit(SEED)).cast("double") / 2.0**64 + 0.5
    return F.floor(rate + F.least(chance, F.lit(1.0 - 1e-12))).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """(doc_id, domain, n_tokens, posterior, rate, wanted, fitted, copies) of each row of (doc_id, text).

    `labelled` holds doc_id and domain; `domain` of the result is the likeliest one, `wanted` and `fitted` are its tokens."""
    model = fit_on_labels(docs, labelled, "domain", TRAIN_ROWS, with_priors=True)
    members = materialize(posteriors(docs, model), "posteriors")
    steps, fitted, wanted = fit_rates(members, model.classes, weights, total) if model.classes else (None, np.zeros(0), np.zeros(0))
    for name, has, want in zip(model.classes, fitted, wanted, strict=True):
        if abs(has - want) > MISSED * max(want, 1.0):
            logging.getLogger(__name__).warning("no rates give %s its %.0f expected tokens; it has %.0f", name, want, has)
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    of = lambda values, kind: F.when(best > 0, F.try_element_at(F.array(*(F.lit(x) for x in values)).cast(f"array<{kind}>"), best))
    out = members.select("doc_id", of(model.classes, "string").alias("domain"), "n_tokens", "posterior", _rate(steps).alias("rate"), of(wanted.tolist(), "double").alias("wanted"), of(fitted.tolist(), "double").alias("fitted"))
    return out.withColumn("copies", copies_of(F.col("rate")))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return mix(read("documents"), domains_of(read("labels")), WEIGHTS)
