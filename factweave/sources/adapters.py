"""Sources with a schema of their own to entities: XBRL, iCalendar, RSS and Atom, and flattened JSON.

XML with names unknown beforehand and JSON in the order of its keys are read in Arrow batches; calendars are plain
column functions. Each gives (doc_id, pos, label, major, type, subtype, value_kind, value_str, value_num, unit, metadata).
"""

from __future__ import annotations

import json
import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.columns import coord_id, strip
from factweave.functions.patterns import XBRL_COORDS
from factweave.operators import scans

SCHEMA = "doc_id long, pos int, label string, major int, type int, subtype int, value_kind string, value_str string, value_num double, unit string, metadata map<string,string>"
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(kind: str):
    """Make a function from (doc_id, text) to entities the adapter of a source type."""

    def add(f: Callable[[DataFrame], DataFrame]):
        ADAPTERS[kind] = f
        return f

    return add


def _batched(docs: DataFrame, parse: Callable[[str], list[tuple]]) -> DataFrame:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.map_(pa.string(), pa.string()))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, k, *e) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, e in enumerate(parse(t or ""))]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    # A file of documents that compresses well would be one task, so they are dealt out; batches bound what a task holds.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scans.dealt(texts, "doc_id", n=scans.least(texts)).mapInArrow(run, SCHEMA)


def _value(v) -> tuple[str, str | None, float | None]:
    """Kind, text as Python writes it, and number of a value."""
    if v is None:
        return "null", None, None
    kind = {bool: "bool", int: "int", float: "float"}.get(type(v), "str")
    try:
        number = float(v)
    except (ValueError, OverflowError):
        number = None
    return kind, str(v), number


def _root(text: str):
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return None


def xbrl_facts(text: str) -> list[tuple]:
    root, out = _root(text), []
    for e in root.iter() if root is not None else ():
        reference, concept = e.get("contextRef"), e.tag.split("}")[-1]
        if reference is None or concept.lower() in ("context", "unit", "schemaref") or e.text is None:
            continue
        try:
            value = float(e.text.replace(",", ""))
        except ValueError:
            value = e.text
        coord = XBRL_COORDS.get(re.sub("[_-]", "", concept.lower()), (7, 99, 1))
        unit = "USD" if "usd" in (e.get("unitRef") or "").lower() else None
        out.append((re.sub("([a-z])([A-Z])", r"\1 \2", concept), *coord, *_value(value), unit, [("xbrl_concept", concept), ("context_ref", reference)]))
    return out


_ATOM = "{http://www.w3.org/2005/Atom}"


def feed_items(text: str) -> list[tuple]:
    root, out = _root(text), []
    if root is None:
        return out
    pairs = lambda d: [(k, v) for k, v in d.items() if v is not None]
    for item in root.iter("item"):
        if title := item.findtext("title"):
            description = item.find("description")
            about = (description.text or "")[:300] if description is not None else ""
            text_of = lambda tag, item=item: None if item.find(tag) is None else item.find(tag).text
            out.append((title, 1, 10, 1, "null", None, None, None, pairs({"link": text_of("link"), "pubDate": text_of("pubDate"), "description": about})))
    for entry in root.iter(_ATOM + "entry"):
        title, link, updated = (entry.find(_ATOM + t) for t in ("title", "link", "updated"))
        if title is not None and title.text:
            out.append((title.text, 1, 10, 1, "null", None, None, None, pairs({"link": None if link is None else link.get("href"), "updated": None if updated is None else updated.text})))
    return out


#: Parts of a key that decide its category, the first match first.
KEY_WORDS = (((7, 1), ("amount", "price", "cost", "revenue", "total")), ((6, 1), ("date", "time", "created", "updated")), ((1, 1), ("name", "company", "org")), ((5, 1), ("location", "address", "city", "country")))


def json_leaves(text: str, most: int = 20) -> list[tuple]:
    """Scalars of objects, depth first in the order of their keys; the first `most` items of lists."""
    try:
        data = json.loads(text)
    except (ValueError, RecursionError):  # not JSON, or nested deeper than the reader goes: no leaves
        return []
    out: list[tuple] = []
    stack = [("", "", data, False)]  # path, key, value, whether it is an object's
    while stack:
        path, key, value, named = stack.pop()
        if isinstance(value, dict):
            stack += [(f"{path}.{k}" if path else k, k, v, True) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(f"{path}[{i}]", key, v, False) for i, v in reversed(list(enumerate(value[:most])))]
        elif named and value is not None and not (isinstance(value, float) and math.isnan(value)):
            coord = next((c for c, words in KEY_WORDS if any(w in key.lower() for w in words)), (3, 1))
            out.append((path, *coord, 1, *_value(value), None, []))
    return out


@register("XBRL")
def xbrl(docs: DataFrame) -> DataFrame:
    return _batched(docs, xbrl_facts)


@register("RSS")
def feeds(docs: DataFrame) -> DataFrame:
    return _batched(docs, feed_items)


def json_flatten(docs: DataFrame) -> DataFrame:
    return _batched(docs, json_leaves)


@register("ICAL")
def calendar(docs: DataFrame) -> DataFrame:
    """Events with a summary; a repeated key's last value counts, folded lines stay apart."""
    lines = F.transform(F.split("text", "\n"), strip)
    last = lambda ls, key: F.get(F.reverse(F.transform(F.filter(ls, lambda x: F.split_part(F.split_part(x, F.lit(":"), F.lit(1)), F.lit(";"), F.lit(1)) == key), lambda x: F.regexp_extract(x, r"(?s)^[^:]*:(.*)\z", 1))), F.lit(0))
    events = F.split(F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")), "\nBEGIN:VEVENT\n")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.slice(events, 2, F.greatest(F.size(events) - 1, F.lit(0)))).alias("pos", "event")).withColumn("event", F.concat("event", F.lit("\n")))
    body = F.filter(F.split(F.split_part("event", F.lit("\nEND:VEVENT\n"), F.lit(1)), "\n"), lambda x: x.contains(":"))
    ended = each.where(F.contains("event", F.lit("\nEND:VEVENT\n"))).withColumn("l", body)
    got = ended.select("doc_id", "pos", *(last(F.col("l"), k).alias(k) for k in ("SUMMARY", "DTSTART", "DTEND", "LOCATION", "DESCRIPTION"))).where("SUMMARY <> ''")
    meta = F.create_map(F.lit("dtstart"), F.col("DTSTART"), F.lit("dtend"), F.col("DTEND"), F.lit("location"), F.col("LOCATION"), F.lit("description"), F.substring(F.coalesce("DESCRIPTION", F.lit("")), 1, 200))
    null = lambda t: F.lit(None).cast(t)
    return got.select(
        "doc_id", "pos", F.col("SUMMARY").alias("label"), F.lit(6).alias("major"), F.lit(1).alias("type"), F.lit(1).alias("subtype"), F.lit("null").alias("value_kind"), null("string").alias("value_str"), null("double").alias("value_num"), null("string").alias("unit"), meta.alias("metadata"),
    )


def to_nodes(entities: DataFrame) -> DataFrame:
    """Entities with coordinates, numbered by document in their order; equal ones (label, value, unit) once, the first.
    `pos` is the entity's place in its document."""
    order = Window.partitionBy("doc_id", "major", "type", "subtype").orderBy("pos")
    numbered = entities.withColumn("instance", F.row_number().over(order)).withColumn("key", F.concat_ws("|", "label", F.coalesce("value_str", F.lit("None")), F.coalesce("unit", F.lit("None"))))
    first = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("pos"))
    return numbered.withColumn("r", first).where("r = 1").select("doc_id", "pos", coord_id(F.col("major"), F.col("type"), F.col("subtype"), F.col("instance")).alias("node_id"), "label", "value_kind", "value_str", "value_num", "unit", "metadata")
