"""Requests to a language model, a mock model in columns, and what its answers become."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import patterns as P
from factweave.functions.columns import coord_id, float_text, parse_unit, parse_value, short_hash

from .scans import unsent


def requests(chunks: DataFrame, max_tier: int = 3) -> DataFrame:
    """(doc_id, req_id, chunk_id, content, prompt, tier) of chunks that need a model; the tier is told by length anew."""
    need = chunks.where((F.col("tier") >= 3) & (F.col("tier") <= max_tier) & (F.col("chunk_type") != "JSON"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_seq"))
    before, after = P.CLAIM_PROMPT.split("{content}")
    return need.select("doc_id", F.format_string("llm_%06d", n).alias("req_id"), "chunk_id", "content", F.concat(F.lit(before), "content", F.lit(after)).alias("prompt"), F.when(F.length("content") < 500, 3).otherwise(4).alias("tier"))


def mock_answers(content: Column) -> Column:
    """Array of (subject, predicate, object, confidence) that the mock model finds, sentence by sentence."""
    sentences = F.split(content, r"(?U)(?<=[.!?])\s+(?=[A-Z])")

    def of(s: Column) -> Column:
        low = F.lower(s)
        metric = F.when(F.lit(False), "")
        for name, pattern in P.METRICS.items():
            metric = metric.when(low.rlike(pattern), name)
        money = F.regexp_extract(s, r"(?Ui)\$[\d.,]+\s*(?:million|billion|M|B)?", 0)
        growth = F.regexp_extract(s, r"(?Ui)(\d+(?:\.\d+)?)\s*%\s*(?:increase|growth|grew)", 1)
        row = lambda a, b, c, d: F.struct(a.alias("subject"), F.lit(b).alias("predicate"), c.alias("object"), F.lit(d).alias("confidence"))
        both = F.array(F.when(money != "", row(metric, "has_value", money, 0.85)), F.when(growth != "", row(F.concat(metric, F.lit("_growth")), "percentage", F.concat(growth, F.lit("%")), 0.8)))
        return F.when(metric.isNotNull(), F.filter(both, lambda x: x.isNotNull())).otherwise(F.slice(both, 1, 0))

    return F.flatten(F.transform(sentences, of))


def mock_claims(requests_: DataFrame) -> DataFrame:
    """(doc_id, req_id, chunk_id, pos, subject, predicate, object, confidence)"""
    return requests_.select("doc_id", "req_id", "chunk_id", F.posexplode(mock_answers(F.col("content"))).alias("pos", "a")).select("doc_id", "req_id", "chunk_id", "pos", "a.*")


def claim_values(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, label, value_label, known_id): each claim's label, its object, and the first node that has that label."""
    said = claims.select("doc_id", F.concat("subject", F.lit(": "), "object").alias("label"), F.col("object").alias("value_label"))
    known = nodes.groupBy("doc_id", F.col("label").alias("value_label")).agg(F.min_by("node_id", "node_seq").alias("known_id"))
    return said.join(unsent(known), ["doc_id", "value_label"], "left").select("doc_id", "label", "value_label", "known_id")


CLAIM, VALUE = (8, 1, 1), (7, 1, 1)
_NODE = ("doc_id", "node_id", "major", "type", "subtype", "instance", "label", "prov_id", "value_kind", "value_str", "value_num", "unit", "content_hash", "chunk_id", "node_seq")


def emit_claims(claims: DataFrame, nodes: DataFrame, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, provenance) that a model's claims add to a program's nodes.

    Each claim is a node "subject: object" with its own provenance and a HAS_VALUE edge to the node of its object: the
    first one with that label, else a new one that claims of the document share. Claims that are equal to a node become
    that node, but keep their edges. The request stands for the chunk. `used` holds (doc_id, major, type, subtype, top),
    the instances given out before; by default the highest of the nodes. An empty object has no value and no edge."""
    names = ["doc_id", "major", "type", "subtype"]
    used = nodes.groupBy(*names).agg(F.max("instance").alias("top")) if used is None else used
    top = lambda coord: used.where((F.col("major") == coord[0]) & (F.col("type") == coord[1]) & (F.col("subtype") == coord[2])).select("doc_id", "top")
    number = lambda: F.row_number().over(Window.partitionBy("doc_id").orderBy("req_id", "pos"))
    said = claims.select("doc_id", "req_id", "pos", F.concat(F.coalesce("subject", F.lit("claim")), F.lit(": "), F.coalesce("object", F.lit(""))).alias("label"), F.coalesce("object", F.lit("")).alias("object"), F.coalesce("confidence", F.lit(0.7)).alias("confidence"))
    said = said.withColumn("k", number()).join(unsent(top(CLAIM)), "doc_id", "left").withColumn("n", F.col("k") + F.coalesce("top", F.lit(0))).drop("top")
    said = said.withColumn("prov_id", F.format_string("prov_llm_%s_%d", "req_id", "pos")).withColumn("content_hash", short_hash(F.concat("label", F.lit("|None|None"))))
    said = said.withColumn("first", F.min("k").over(Window.partitionBy("doc_id", "content_hash"))).withColumn("first_n", F.min("n").over(Window.partitionBy("doc_id", "content_hash")))
    same = nodes.groupBy("doc_id", "content_hash").agg(F.min_by("node_id", "node_seq").alias("same_id"))
    said = said.join(unsent(same), ["doc_id", "content_hash"], "left").withColumn("claim_id", F.coalesce("same_id", coord_id(*(F.lit(x) for x in CLAIM), F.col("first_n"))))
    known = nodes.groupBy("doc_id", F.col("label").alias("object")).agg(F.min_by("node_id", "node_seq").alias("known_id"))
    said = said.join(unsent(known), ["doc_id", "object"], "left")
    fresh = said.where("known_id is null and object <> ''").groupBy("doc_id", "object").agg(F.min(F.struct("k", "req_id", "pos", "prov_id")).alias("by")).select("doc_id", "object", "by.*")
    fresh = fresh.withColumn("n", number()).join(unsent(top(VALUE)), "doc_id", "left").withColumn("instance", (F.col("n") + F.coalesce("top", F.lit(0))).cast("int"))
    fresh = fresh.withColumn("node_id", coord_id(*(F.lit(x) for x in VALUE), F.col("instance")))
    joined = said.join(unsent(fresh.select("doc_id", "object", F.col("node_id").alias("fresh_id"))), ["doc_id", "object"], "left").withColumn("object_id", F.coalesce("known_id", "fresh_id"))
    edges = joined.where("object_id is not null and object_id <> claim_id").select("doc_id", F.col("claim_id").alias("subject_id"), F.lit("HAS_VALUE").alias("predicate"), "object_id", "prov_id", F.lit(1.0).alias("confidence"))
    last = nodes.groupBy("doc_id").agg(F.max("node_seq").alias("last"))
    coord = lambda c: [F.lit(x).alias(n) for x, n in zip(c, ("major", "type", "subtype"), strict=True)]
    place = lambda step: (F.coalesce("last", F.lit(0)) + 2 * F.col("k") + step).cast("long").alias("node_seq")
    none = lambda kind: F.lit(None).cast(kind)
    new_claims = said.where("same_id is null and k = first").join(unsent(last), "doc_id", "left").select(
        "doc_id", F.col("claim_id").alias("node_id"), *coord(CLAIM), F.col("n").cast("int").alias("instance"), "label", "prov_id", F.lit("null").alias("value_kind"), none("string").alias("value_str"), none("double").alias("value_num"), none("string").alias("unit"), "content_hash", F.col("req_id").alias("chunk_id"), place(0)
    )
    value, unit = parse_value(F.col("object")), parse_unit(F.col("object"))
    valued = fresh.withColumn("value_num", value).withColumn("unit", unit).withColumn("value_str", float_text(F.col("value_num"))).join(unsent(last), "doc_id", "left")
    key = F.concat_ws("|", "object", F.coalesce("value_str", F.lit("None")), F.coalesce("unit", F.lit("None")))
    new_values = valued.select(
        "doc_id", "node_id", *coord(VALUE), "instance", F.col("object").alias("label"), "prov_id", F.when(F.col("value_num").isNull(), "null").otherwise("float").alias("value_kind"), "value_str", "value_num", "unit", short_hash(key).alias("content_hash"), F.col("req_id").alias("chunk_id"), place(1)
    )
    prov = said.select("doc_id", "prov_id", F.col("req_id").alias("chunk_id"), F.lit("tier3:llm").alias("extractor"), F.lit(3).alias("tier"), "confidence")
    return new_claims.select(*_NODE).unionByName(new_values.select(*_NODE)), edges, prov


def parse_response(text: str) -> list[dict]:
    """The JSON list or object inside an answer, without fences; empty where there is none."""
    body = text.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0]
    for a, b in (("[", "]"), ("{", "}")):
        lo, hi = body.find(a), body.rfind(b)
        if 0 <= lo < hi:
            try:
                got = json.loads(body[lo : hi + 1])
            except ValueError:
                continue
            return got if isinstance(got, list) else [got]
    return []


def valid(items: list) -> bool:
    return isinstance(items, list) and all(isinstance(x, dict) and "subject" in x for x in items)


def sure(value) -> float:
    """A confidence as a model gives it; 0.7 where it gives none or no number."""
    try:
        return 0.7 if value is None or isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return 0.7


def with_retries(call: Callable[[str], list], prompt: str, tries: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[list, int, str]:
    """(answers, attempts, error). Invalid answers are asked for again at once, exceptions after base * 2 ** n seconds."""
    error = ""
    for n in range(tries):
        try:
            got = call(prompt)
            if valid(got):
                return got, n + 1, ""
            error = "invalid response"
        except Exception as e:  # any failure of a model's back-end counts as one try
            error = str(e)
            if n + 1 < tries:
                sleep(base * 2**n)
    return [], tries, error


def execute(requests_: DataFrame, call: Callable[[str], list], tries: int = 3) -> DataFrame:
    """Answers of a plugged-in model, asked from the executors in Arrow batches."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, req_id, chunk_id, prompt in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for pos, x in enumerate(with_retries(call, prompt, tries)[0]):
                    rows.append((doc_id, req_id, chunk_id, pos, str(x["subject"]), str(x.get("predicate", "")), str(x.get("object", "")), sure(x.get("confidence"))))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64())
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "req_id", "chunk_id", "pos", "subject", "predicate", "object", "confidence"])

    return requests_.select(F.col("doc_id").cast("long"), "req_id", "chunk_id", "prompt").mapInArrow(run, "doc_id long, req_id string, chunk_id string, pos int, subject string, predicate string, object string, confidence double")
