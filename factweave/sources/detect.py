"""What a source is, and which way it goes; ordered rules on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions import patterns as P
from factweave.functions.columns import strip


def _xml_kind(c: Column) -> Column:
    head = F.lower(F.substring(c, 1, 2000))
    return F.when(head.contains("xbrl") | head.contains("us-gaap"), "XBRL").when(head.contains("fhir"), "FHIR").otherwise("XML")


def _json_kind(c: Column) -> Column:
    keys = F.json_object_keys(c)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    fhir = F.coalesce(F.get_json_object(c, "$.resourceType").isin("Bundle", "Patient", "Observation", "Condition"), F.lit(False))
    return F.when(has("@context") | has("@type"), "SCHEMA_ORG").when(has("openapi") | has("swagger"), "OPENAPI").when(fhir, "FHIR").otherwise("JSON")


def detect(content: Column) -> Column:
    """Source type of a text."""
    c = strip(content)
    head = F.substring(c, 1, 1)
    start = F.substring(c, 1, 500)
    return (
        F.when(head == "<", _xml_kind(c)).when(head.isin("{", "["), _json_kind(c)).when(start.contains("BEGIN:VCALENDAR"), "ICAL").when(start.contains("<rss") | start.contains("<feed"), "RSS")
        .when(start.rlike(r"(?Umd)^#{1,6}\s"), "MARKDOWN").otherwise("TEXT")
    )


def detect_file(path: Column, content: Column) -> Column:
    """Source type by extension; XML and JSON are refined by content, unknown extensions detected by it."""
    table = F.create_map(*(F.lit(x) for kv in P.EXTENSIONS.items() for x in kv))
    kind = F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1)))
    return F.when(kind == "XML", _xml_kind(strip(content))).when(kind == "JSON", _json_kind(strip(content))).otherwise(F.coalesce(kind, detect(content)))


def json_has_schema(content: Column) -> Column:
    """Explicit markers, or at least two items of which the first five are objects with the same keys."""
    keys = F.json_object_keys(content)
    marked = F.arrays_overlap(keys, F.array(*(F.lit(k) for k in ("@context", "openapi", "swagger"))))
    items = F.from_json(F.get_json_object(content, "$.items"), "array<string>")
    names = F.transform(F.slice(items, 1, 5), lambda i: F.sort_array(F.json_object_keys(i)))
    alike = (F.size(items) >= 2) & (F.size(names[0]) > 0) & F.forall(names, lambda k: F.coalesce(k == names[0], F.lit(False)))
    return F.coalesce(marked, F.lit(False)) | F.coalesce(alike, F.lit(False))


def route(kind: Column, content: Column) -> Column:
    """ADAPTER for what has a schema, COMPILER for the rest."""
    schema = ((kind == "JSON") & json_has_schema(content)) | ((kind == "XML") & (_xml_kind(strip(content)) != "XML"))
    return F.when(kind.isin(*P.ADAPTER_TYPES) | schema, "ADAPTER").otherwise("COMPILER")


def source_info(content: Column) -> list[Column]:
    """Address, hash and size of a text that came as a string."""
    return [F.concat(F.lit("string://"), F.substring(F.md5(content), 1, 8)).alias("uri"), F.sha2(content, 256).alias("hash_sha256"), F.octet_length(content).cast("long").alias("size_bytes")]
