"""The queries over the test tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import emission, extraction, lexing
from factweave.operators.scans import slices

from . import text_oracles as T
from .views import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def chunks_of(spark: SparkSession, sf_dir: str, source: str = "rendered_docs") -> DataFrame:
    return lexing.lex(view(spark, sf_dir, source))


# ---- lexing

@query("lex_kind", T.over("rendered_docs", "texts AS (SELECT 'd' || doc_id AS id, text FROM rendered_docs UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL SELECT 'e' || event_id, props FROM events)", select="SELECT id, CASE WHEN substr(text, 1, 1) IN ('{', '[') THEN 'JSON' WHEN substr(text, 1, 1) = '<' AND contains(lower(text), 'xbrl') THEN 'XBRL' WHEN substr(text, 1, 1) = '<' THEN 'XML' ELSE 'TEXT' END AS kind FROM texts"))
def _(spark, d):
    docs = view(spark, d, "rendered_docs").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    pages = spark.table("pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    events = spark.table("events").select(F.concat(F.lit("e"), "event_id").alias("id"), F.col("props").alias("text"))
    return docs.union(pages).union(events).select("id", lexing.lex_kind(F.col("text")).alias("kind"))


_CHUNK = "SELECT doc_id, chunk_seq::INT AS chunk_seq, chunk_id, chunk_type, tier::INT AS tier, words::INT AS words, section, content_hash FROM o_chunks"


@query("lex_chunks", T.over("rendered_docs", select="SELECT doc_id, chunk_id, content, first_start::INT AS start, (first_start + length(content))::INT AS \"end\" FROM o_chunks"))
def _(spark, d):
    return chunks_of(spark, d).select("doc_id", "chunk_id", "content", "start", "end")


@query("classify_chunks", T.over("rendered_docs", select=_CHUNK))
def _(spark, d):
    return chunks_of(spark, d).select("doc_id", "chunk_seq", "chunk_id", "chunk_type", "tier", "words", "section", "content_hash")


@query("lex_chunks_segmented", ORACLE_SQL["lex_chunks"])
def _(spark, d):
    return lexing.lex(view(spark, d, "rendered_docs"), segment=4).select("doc_id", "chunk_id", "content", "start", "end")


@query("section_carry_segmented", T.over("rendered_docs", select="SELECT doc_id, chunk_id, section FROM o_chunks"))
def _(spark, d):
    return lexing.lex(view(spark, d, "rendered_docs"), segment=4).select("doc_id", "chunk_id", "section")


@query("chunk_hash", T.over("documents", select="SELECT doc_id, chunk_id, content_hash, words::INT AS words FROM o_chunks"))
def _(spark, d):
    return chunks_of(spark, d, "documents").select("doc_id", "chunk_id", "content_hash", "words")


@query("section_headers", T.over("rendered_docs", select="SELECT doc_id, chunk_id, content FROM o_chunks WHERE section = lower(content)"))
def _(spark, d):
    return chunks_of(spark, d).where(lexing.is_section(F.col("content"))).select("doc_id", "chunk_id", "content")


@query("section_carry", T.over("rendered_docs", select="SELECT section, count(*) AS chunks FROM o_chunks GROUP BY section"))
def _(spark, d):
    return chunks_of(spark, d).groupBy("section").agg(F.count(F.lit(1)).alias("chunks"))


@query("lexer_summary", T.over("rendered_docs", select="SELECT t::INT AS tier, count(tier) AS chunks, (SELECT round(count(*) FILTER (tier <= 1) / count(*) FILTER (tier >= 3), 6) FROM o_chunks) AS efficiency FROM range(5) r(t) LEFT JOIN o_chunks ON tier = t GROUP BY t"))
def _(spark, d):
    return lexing.lexer_summary(chunks_of(spark, d))


# ---- extraction

_COLUMNS = "doc_id, chunk_id, pos::INT AS pos, entity_type, label, value_kind, value_str, value_num, unit"
for _name, _make, _on_patterns, _prose in (
    ("money", extraction.money, True, False), ("percent", extraction.percents, True, False), ("dates", extraction.dates, True, False), ("kv", extraction.key_values, True, False), ("list", extraction.list_items, True, False),
    ("orgs", extraction.organisations, False, True), ("people", extraction.people, False, True), ("locations", extraction.locations, False, True), ("durations", extraction.durations, False, True), ("ratios", extraction.ratios, False, True),
    ("sentiment", extraction.sentiment, False, False),
):
    for _source in ("rendered_docs", "documents") if _name in ("percent", "orgs", "locations") else ("rendered_docs",):
        def _one(spark, d, make=_make, on=_on_patterns, prose=_prose, source=_source):
            return extraction.one_extractor(chunks_of(spark, d, source), make, on, prose).select("doc_id", "chunk_id", "pos", "entity_type", "label", "value_kind", "value_str", "value_num", "unit")

        if _source == "documents":  # compared by what survives RE2's narrower letters
            query(f"extract_{_name}_documents", f"WITH plain AS (SELECT doc_id, {T.PLAIN.format('text')} AS text FROM documents), {T.chunks('plain')} SELECT doc_id, count(*) AS n FROM ({T.EXTRACTORS[_name]}) GROUP BY doc_id")(lambda s, d, f=_one: f(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
        else:
            query(f"extract_{_name}", T.over(_source, select=f"SELECT {_COLUMNS} FROM ({T.EXTRACTORS[_name]})"))(_one)


def _claim_rows(spark, d, source):
    return extraction.one_extractor(chunks_of(spark, d, source), extraction.claims, False).select("doc_id", "chunk_id", "label", "value_num")


query("claim_types", T.over("rendered_docs", select=f"SELECT doc_id, chunk_id, label, value_num FROM ({T.EXTRACTORS['claims']})"))(lambda s, d: _claim_rows(s, d, "rendered_docs"))
query("claim_types_documents", f"WITH plain AS (SELECT doc_id, {T.PLAIN.format('text')} AS text FROM documents), {T.chunks('plain')} SELECT doc_id, chunk_id, label, value_num FROM ({T.EXTRACTORS['claims']})")(lambda s, d: _claim_rows(s, d, "documents"))


# ---- emission

def nodes_of(spark, d, source="rendered_docs"):
    return emission.nodes(extraction.extract(chunks_of(spark, d, source)))


_PROGRAM = (T.extractions(), T.nodes())


@query("assign_coords", T.over("rendered_docs", *_PROGRAM, select="SELECT doc_id, chunk_id, ext_seq, entity_type, label, major, type, subtype, instance::INT AS instance FROM o_coord"))
def _(spark, d):
    return emission.assign_coords(extraction.extract(chunks_of(spark, d))).select("doc_id", "chunk_id", "ext_seq", "entity_type", "label", "major", "type", "subtype", "instance")


@query("assign_coords_segmented", ORACLE_SQL["assign_coords"])
def _(spark, d):
    docs = view(spark, d, "rendered_docs")
    n = slices(docs)
    found = extraction.extract(lexing.lex(docs, segment=4, n=n), segment=4, n=n)
    return emission.assign_coords(found, segment=4, n=n).select("doc_id", "chunk_id", "ext_seq", "entity_type", "label", "major", "type", "subtype", "instance")


@query("dedup_nodes", T.over("rendered_docs", *_PROGRAM, select="SELECT doc_id, node_id, label, prov_id, value_str, value_num, unit, content_hash, node_seq FROM o_nodes"))
def _(spark, d):
    return nodes_of(spark, d).select("doc_id", "node_id", "label", "prov_id", "value_str", "value_num", "unit", "content_hash", "node_seq")


@query("provenance", T.over("rendered_docs", select="SELECT doc_id, 'prov_' || chunk_id AS prov_id, chunk_id, 'tier' || tier || ':' || chunk_type AS extractor, tier::INT AS tier FROM o_chunks"))
def _(spark, d):
    return emission.provenance(chunks_of(spark, d)).select("doc_id", "prov_id", "chunk_id", "extractor", "tier")


@query("chunk_index", T.over("rendered_docs", *_PROGRAM, select="SELECT doc_id, chunk_id, string_agg(node_id, ',' ORDER BY node_seq) AS node_ids, count(*) AS n_nodes FROM o_nodes GROUP BY doc_id, chunk_id"))
def _(spark, d):
    return emission.chunk_index(nodes_of(spark, d))


@query("find_by_label", T.over("rendered_docs", *_PROGRAM, select="SELECT doc_id, label, arg_min(node_id, node_seq) AS node_id FROM o_nodes GROUP BY doc_id, label"))
def _(spark, d):
    return emission.find_by_label(nodes_of(spark, d))


@query("query_quantity_gt", T.over("rendered_docs", *_PROGRAM, select="SELECT doc_id, node_id, label, value_num, unit FROM o_nodes WHERE major = 7 AND value_num > 1000000"))
def flagship(spark, d):
    """Documents to chunks to extractions to coordinates to nodes, then a filter on quantities."""
    large = emission.nodes(extraction.extract(chunks_of(spark, d), majors=(7,)))
    return large.where("major = 7 and value_num > 1000000").select("doc_id", "node_id", "label", "value_num", "unit")
