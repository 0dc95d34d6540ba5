"""Queries over the graph of facts, versions, merging, sources and retrieval, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import patterns as P
from factweave.functions.columns import coord_parts, coord_valid, parse_unit, parse_value, spaced_label
from factweave.operators import claims, derivation, emission, extraction, graph, lexing, retrieval, space, versions
from factweave.operators.scans import unsent
from factweave.sources import adapters, detect, table_functions

from . import text_oracles as T
from .catalog import _PROGRAM, chunks_of, nodes_of, query
from .program import Program, compile_documents, compile_universal
from .views import ctes, view


def kb(select: str, *extra: str, views: tuple = ("kb_nodes", "kb_prov", "kb_edges")) -> str:
    return f"WITH RECURSIVE {', '.join([ctes(*views), *extra])} {select}"


def tables(spark, d):
    view(spark, d, "kb_nodes")
    return spark.table("kb_nodes"), spark.table("kb_prov"), spark.table("kb_edges")


_COLS = ["doc_id", "node_id", "label", "value_num", "unit"]
_SEL = "SELECT doc_id, node_id, label, value_num, unit FROM kb_nodes"
_N = ("kb_nodes",)
_ID = "01-01-01-0003"


def filtered(name: str, where: str, f) -> None:
    query(name, kb(f"{_SEL} {where}", views=_N))(lambda s, d: f(tables(s, d)[0]).select(*_COLS))


filtered("node_get", f"WHERE node_id = '{_ID}'", lambda n: space.get(n, _ID))
filtered("node_scan", "", lambda n: n)
filtered("query_major", "WHERE major = 5", lambda n: space.where(n, major=5))
filtered("query_type", "WHERE major = 1 AND type = 1 AND subtype = 2", lambda n: space.where(n, major=1, type_=1, subtype=2))
filtered("query_label", "WHERE contains(lower(label), 'customer#00000001')", lambda n: space.where(n, label_contains="Customer#00000001"))
filtered("query_range", "WHERE major = 7 AND value_num > 50000 AND value_num < 60000", lambda n: space.where(n, major=7, value_gt=50000.0, value_lt=60000.0))
filtered("by_prefix", "WHERE starts_with(node_id, '07-01-01-00')", lambda n: space.by_prefix(n, "07-01-01-00"))
filtered("query_limit", "WHERE major = 1 ORDER BY doc_id, seq LIMIT 20", lambda n: space.limit(space.where(n, major=1), 20))


@query("query_first", kb("SELECT doc_id, arg_min(node_id, seq) AS node_id, arg_min(label, seq) AS label FROM kb_nodes WHERE major = 7 GROUP BY doc_id", views=_N))
def _(s, d):
    return space.first(space.where(tables(s, d)[0], major=7))


@query("edges_out", kb(f"SELECT doc_id, predicate, object_id, confidence FROM kb_edges WHERE subject_id = '{_ID}'"))
def _(s, d):
    return space.outgoing(tables(s, d)[2], _ID).select("doc_id", "predicate", "object_id", "confidence")


@query("edges_in", kb(f"SELECT doc_id, subject_id, predicate, confidence FROM kb_edges WHERE object_id = '{_ID}'"))
def _(s, d):
    return space.incoming(tables(s, d)[2], _ID).select("doc_id", "subject_id", "predicate", "confidence")


@query("fork_best", kb("SELECT doc_id, major AS fork_id, arg_max(node_id, (value_num, -seq)) AS node_id, max(value_num) AS confidence FROM kb_nodes WHERE major = 7 GROUP BY doc_id, major", views=_N))
def _(s, d):
    n = tables(s, d)[0].where("major = 7")
    options = F.transform(F.array_sort(F.collect_list(F.struct("seq", "node_id", F.col("value_num").alias("confidence")))), lambda x: F.struct(x["node_id"].alias("node_id"), x["confidence"].alias("confidence")))
    return space.fork_best(n.groupBy("doc_id", F.col("major").alias("fork_id")).agg(options.alias("options")))


@query("base_confidence", kb("SELECT n.doc_id, node_id, coalesce(confidence, 1.0) AS confidence FROM kb_nodes n LEFT JOIN kb_prov p ON n.doc_id = p.doc_id AND n.prov_id = p.prov_id"))
def _(s, d):
    n, p, _e = tables(s, d)
    return space.base_confidence(n, p).select("doc_id", "node_id", "confidence")


@query("count_by_major", kb("SELECT doc_id, major, count(*) AS n FROM kb_nodes GROUP BY doc_id, major", views=_N))
def _(s, d):
    return space.count_by_major(tables(s, d)[0])


@query("sum_values", kb("SELECT doc_id, coalesce(sum(cast(round(value_num * 100) AS BIGINT)) FILTER (major = 1 AND type = 1), 0) / 100.0::DOUBLE AS total FROM kb_nodes GROUP BY doc_id", views=_N))
def _(s, d):
    return space.sum_values(tables(s, d)[0], major=1, type_=1)


@query("distinct_labels", kb("SELECT DISTINCT doc_id, label FROM kb_nodes WHERE major = 5", views=_N))
def _(s, d):
    return space.distinct_labels(tables(s, d)[0], 5)


@query("avg_confidence", kb("SELECT n.doc_id, round(coalesce(avg(confidence), 0.0), 6) AS avg_confidence FROM kb_nodes n LEFT JOIN kb_prov p ON n.doc_id = p.doc_id AND n.prov_id = p.prov_id GROUP BY n.doc_id"))
def _(s, d):
    n, p, _e = tables(s, d)
    return space.avg_confidence(n, p)


_MAJORS = ", ".join(f"({k}, '{v}')" for k, v in P.MAJORS.items())


@query("stats_major", kb("SELECT m.major::INT AS major, name, count(n.major) AS n, round(100 * count(n.major) / (SELECT greatest(count(*), 1) FROM kb_nodes), 6) AS pct FROM m LEFT JOIN kb_nodes n ON n.major = m.major GROUP BY m.major, name", f"m(major, name) AS (VALUES {_MAJORS})", views=_N))
def _(s, d):
    return space.stats_major(tables(s, d)[0])


@query("stats_quantity", kb("SELECT doc_id, count(*) AS n, min(value_num) AS least, max(value_num) AS most, sum(value_num::DECIMAL(18, 2))::DOUBLE AS total FROM kb_nodes WHERE major = 7 AND value_num IS NOT NULL GROUP BY doc_id", views=_N))
def _(s, d):
    return space.stats_quantity(tables(s, d)[0])


@query("kb_stats", kb("SELECT n.doc_id, count(*) AS nodes, count(value_num) AS valued, count(DISTINCT major) AS categories, (SELECT count(*) FROM kb_edges e WHERE e.doc_id = n.doc_id) AS relations FROM kb_nodes n GROUP BY n.doc_id"))
def _(s, d):
    n, _p, e = tables(s, d)
    return space.kb_stats(n, e)


@query("tier_stats", kb("SELECT tier, count(*) AS n FROM kb_prov GROUP BY tier"))
def _(s, d):
    return emission.tier_stats(tables(s, d)[1])


@query("manifest_counts", kb("SELECT 'nodes' AS name, count(*) AS n FROM kb_nodes UNION ALL SELECT 'provenance', count(*) FROM kb_prov UNION ALL SELECT 'relations', count(*) FROM kb_edges"))
def _(s, d):
    return Program(*tables(s, d)).manifest()


_SUMS = ", ".join(f"cast(sum(('0x' || substr(h, {1 + 15 * k}, 15))::BIGINT::HUGEINT) AS VARCHAR)" for k in range(4))


@query("manifest_hash", kb(
    "SELECT doc_id, substr(sha256(string_agg(range || ' ' || digest, chr(10) ORDER BY range || ' ' || digest)), 1, 16) AS hash FROM digests GROUP BY doc_id",
    "lines AS (SELECT doc_id, 'n|' || node_id || '|' || label AS line FROM kb_nodes UNION ALL SELECT doc_id, 'r|' || subject_id || '|' || predicate || '|' || object_id FROM kb_edges)",
    "hashed AS (SELECT doc_id, array_to_string(string_split(line, '-')[1:2], '-') AS range, sha256(line) AS h FROM lines)",
    f"digests AS (SELECT doc_id, range, sha256(concat_ws(' ', {_SUMS})) AS digest FROM hashed GROUP BY doc_id, range)",
))
def _(s, d):
    n, p, e = tables(s, d)
    return Program(n.withColumn("content_hash", F.col("label")), p, e).content_hash()


@query("merge_provenance", kb("SELECT doc_id, prov_id || '_p0' AS prov_id, tier, confidence FROM kb_prov UNION ALL SELECT doc_id, prov_id || '_p1', tier, confidence FROM kb_prov WHERE tier > 0"))
def _(s, d):
    n, p, _e = tables(s, d)
    return versions.merge_provenance([(n, p), (n, p.where("tier > 0"))]).select("doc_id", "prov_id", "tier", "confidence")


_GONE = "NOT EXISTS (SELECT 1 FROM kb_prov p WHERE p.doc_id = x.doc_id AND p.prov_id = x.prov_id)"


@query("integrity_violations", kb(f"SELECT doc_id, 'node provenance' AS what, node_id AS id FROM kb_nodes x WHERE {_GONE} UNION ALL SELECT doc_id, 'relation provenance', prov_id FROM kb_edges x WHERE {_GONE}"))
def _(s, d):
    return emission.integrity_violations(*tables(s, d))


@query("coord_parse", kb("SELECT doc_id, node_id, major, type, subtype, instance, major BETWEEN 1 AND 8 AND type BETWEEN 0 AND 99 AND subtype BETWEEN 0 AND 99 AND instance BETWEEN 0 AND 9999 AS valid FROM kb_nodes", views=_N))
def _(s, d):
    parts = tables(s, d)[0].select("doc_id", "node_id", *coord_parts(F.col("node_id")))
    return parts.withColumn("valid", coord_valid(*(F.col(c) for c in ("major", "type", "subtype", "instance"))))


# ---- graph

_OUT = "SELECT doc_id, subject_id AS src, object_id AS dst, '0 ' || predicate || ' ' || object_id AS rank, predicate FROM kb_edges"
_IN = "SELECT doc_id, object_id AS src, subject_id AS dst, '1 ' || subject_id || ' ' || predicate AS rank, predicate FROM kb_edges"
_WALKS = (  # name, ways, depth, starts, predicate
    ("out", _OUT, 3, "major = 8", None),
    ("in", _IN, 3, "major = 5 AND type = 3", None),
    ("both", f"{_OUT} UNION ALL {_IN}", 3, "major = 8", None),
    ("predicate", _OUT, 3, "major IN (1, 5)", "LOCATED_IN"),
)
for _direction, _ways, _depth, _from, _only in _WALKS:
    @query(
        f"traverse_{_direction}",
        kb(
            "SELECT doc_id, start, spot AS node_id, depth, array_to_string(nodes, '>') AS path FROM first WHERE spot <> start AND EXISTS (SELECT 1 FROM kb_nodes n WHERE n.doc_id = first.doc_id AND n.node_id = spot)",
            f"ways AS (SELECT doc_id, src, dst, min(rank) AS rank FROM ({_ways}){'' if _only is None else f' WHERE predicate = {T.q(_only)}'} GROUP BY doc_id, src, dst)",
            f"walk(doc_id, start, spot, depth, ranks, nodes) AS (SELECT doc_id, node_id, node_id, 0, []::VARCHAR[], [node_id] FROM kb_nodes WHERE {_from} UNION ALL SELECT w.doc_id, start, dst, depth + 1, list_append(ranks, rank), list_append(nodes, dst) FROM walk w JOIN ways ON w.doc_id = ways.doc_id AND spot = src WHERE depth < {_depth})",
            "first AS (SELECT doc_id, start, spot, min(depth)::INT AS depth, arg_min(nodes, (depth, ranks)) AS nodes FROM walk GROUP BY doc_id, start, spot)",
        ),
    )
    def _(s, d, direction=_direction, starts=_from, depth=_depth, only=_only):
        n, _p, e = tables(s, d)
        return graph.traverse(n, e, n.where(starts).select("doc_id", F.col("node_id").alias("start")), only, depth, "out" if only else direction)


_REGION = "05-03-01-0001"


@query(
    "shortest_path",
    kb(
        "SELECT p.doc_id, p.node_id AS a, b, d.depth AS length, concat_ws('>', p.node_id, n1.dst, n2.dst, n3.dst, n4.dst) AS path FROM kb_nodes p JOIN dist d ON d.doc_id = p.doc_id AND d.spot = p.node_id"
        " LEFT JOIN nxt n1 ON n1.doc_id = p.doc_id AND n1.src = p.node_id LEFT JOIN nxt n2 ON n2.doc_id = p.doc_id AND n2.src = n1.dst LEFT JOIN nxt n3 ON n3.doc_id = p.doc_id AND n3.src = n2.dst LEFT JOIN nxt n4 ON n4.doc_id = p.doc_id AND n4.src = n3.dst WHERE p.major = 8",
        f"ways AS (SELECT doc_id, src, dst, min(rank) AS rank FROM ({_OUT} UNION ALL {_IN}) GROUP BY doc_id, src, dst)",
        f"walk(doc_id, b, spot, depth) AS (SELECT DISTINCT doc_id, '{_REGION}', '{_REGION}', 0 FROM kb_nodes UNION SELECT w.doc_id, b, src, depth + 1 FROM walk w JOIN ways ON w.doc_id = ways.doc_id AND spot = dst WHERE depth < 4)",
        "dist AS (SELECT doc_id, b, spot, min(depth)::INT AS depth FROM walk GROUP BY doc_id, b, spot)",
        "nxt AS (SELECT w.doc_id, w.src, arg_min(w.dst, w.rank) AS dst FROM ways w JOIN dist x ON x.doc_id = w.doc_id AND x.spot = w.src JOIN dist y ON y.doc_id = w.doc_id AND y.spot = w.dst WHERE y.depth = x.depth - 1 GROUP BY w.doc_id, w.src)",
    ),
)
def _(s, d):
    n, _p, e = tables(s, d)
    pairs = n.where("major = 8").select("doc_id", F.col("node_id").alias("a"), F.lit(_REGION).alias("b"))
    return graph.shortest_path(e, pairs, 4)


@query("neighbors", kb("SELECT n.doc_id, p.node_id AS point, n.node_id, round(sqrt(1.0 * (n.major - p.major) * (n.major - p.major) + 0.5 * (n.type - p.type) * (n.type - p.type) + 0.3 * (n.subtype - p.subtype) * (n.subtype - p.subtype) + 0.1 * (n.instance - p.instance) * (n.instance - p.instance)), 9) AS distance FROM kb_nodes n JOIN kb_nodes p ON n.doc_id = p.doc_id AND p.node_id = '05-04-01-0001' WHERE distance <= 3.0", views=_N))
def _(s, d):
    n = tables(s, d)[0]
    return graph.neighbours(n, space.get(n, "05-04-01-0001"), 3.0)


@query("neighbors_ranked", kb("SELECT doc_id, point, row_number() OVER (PARTITION BY doc_id, point ORDER BY distance, seq) AS rank, node_id, distance FROM (SELECT n.doc_id, n.seq, p.node_id AS point, n.node_id, round(sqrt(1.0 * (n.major - p.major) * (n.major - p.major) + 0.5 * (n.type - p.type) * (n.type - p.type) + 0.3 * (n.subtype - p.subtype) * (n.subtype - p.subtype) + 0.1 * (n.instance - p.instance) * (n.instance - p.instance)), 9) AS distance FROM kb_nodes n JOIN kb_nodes p ON n.doc_id = p.doc_id AND p.major = 5 WHERE distance <= 1.5)", views=_N))
def _(s, d):
    n = tables(s, d)[0]
    return graph.ranked_neighbours(n, n.where("major = 5"), 1.5, "seq")


_SPREAD = (
    "base AS (SELECT n.doc_id, node_id, coalesce(confidence, 1.0) AS c FROM kb_nodes n LEFT JOIN kb_prov p ON n.doc_id = p.doc_id AND n.prov_id = p.prov_id)",
    "up AS (SELECT doc_id, subject_id, object_id, confidence AS own FROM kb_edges WHERE predicate IN ('DERIVED_FROM', 'SUPPORTS', 'SAME_AS'))",
    "walk(doc_id, spot, c, depth) AS (SELECT doc_id, node_id, c, 0 FROM base UNION ALL SELECT w.doc_id, object_id, least(c, own), depth + 1 FROM walk w JOIN up ON w.doc_id = up.doc_id AND spot = subject_id WHERE depth < 6)",
)


@query(
    "confidence",
    kb(
        "SELECT doc_id, spot AS node_id, max(c) AS confidence FROM (SELECT doc_id, node_id AS spot, c FROM base UNION ALL SELECT doc_id, spot, c FROM walk) GROUP BY doc_id, spot",
        *_SPREAD,
    ),
)
def _(s, d):
    return graph.confidence(*tables(s, d))


# ---- derivations

_OPERANDS = "SELECT o_orderkey % 25 AS doc_id, o_orderkey AS key, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS pos, l_quantity AS value, (50 + l_partkey % 50) / 100.0e0 AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
_FOLDS = {
    "ADD": "list_sum(v)", "SUBTRACT": "v[1] - coalesce(list_sum(v[2:]), 0)", "MULTIPLY": "list_reduce(v, lambda a, x: a * x)", "DIVIDE": "list_reduce(v, lambda a, x: a / x)",
    "AVERAGE": "list_sum(v) / len(v)", "RATIO": "list_sum(v) / len(v)", "TEMPORAL_ALIGN": "v[1]",
}
for _op, _fold in _FOLDS.items():
    @query(f"derive_{_op.lower()}", f"WITH x AS ({_OPERANDS}), l AS (SELECT doc_id, key, list(value ORDER BY pos) AS v, min(confidence) AS c FROM x GROUP BY doc_id, key) SELECT doc_id, key, {_fold if _op == 'MULTIPLY' else f'round({_fold}, 6)'}::DOUBLE AS value, least(c, {P.OPERATOR_WEIGHTS[_op]}::DOUBLE) AS confidence FROM l")
    def _(s, d, op=_op):
        view(s, d, "rendered_docs")
        return derivation.derive(s.sql(_OPERANDS), op)


@query(
    "derive_by_label",
    kb(
        "SELECT x.doc_id, 0 AS key, round(x.value_num - y.value_num, 6) AS value, least(cx.c, cy.c, 0.95::DOUBLE) AS confidence, x.node_id || ',' || y.node_id AS operands FROM x JOIN y ON x.doc_id = y.doc_id JOIN conf cx ON cx.doc_id = x.doc_id AND cx.spot = x.node_id JOIN conf cy ON cy.doc_id = y.doc_id AND cy.spot = y.node_id",
        *_SPREAD,
        "conf AS (SELECT doc_id, spot, max(c) AS c FROM (SELECT doc_id, node_id AS spot, c FROM base UNION ALL SELECT doc_id, spot, c FROM walk) GROUP BY doc_id, spot)",
        "x AS (SELECT doc_id, node_id, value_num FROM kb_nodes WHERE node_id = '01-01-01-0001')",
        "y AS (SELECT doc_id, arg_min(node_id, seq) AS node_id, arg_min(value_num, seq) AS value_num FROM kb_nodes WHERE contains(lower(label), 'order total') GROUP BY doc_id)",
    ),
)
def _(s, d):
    n, p, e = tables(s, d)
    # Instances are numbered from 1, so that a space has 01-01-01-0001 if it has that kind; no number has to be made for it.
    kind = (F.col("major") == 1) & (F.col("type") == 1) & (F.col("subtype") == 1)
    both = n.groupBy("doc_id").agg(F.max(kind.cast("int")).alias("x"), F.max((F.col("major") == 7).cast("int")).alias("y")).where("x = 1 and y = 1")
    refs = both.select("doc_id", F.lit(0).alias("key"), F.posexplode(F.array(F.lit("01-01-01-0001"), F.lit("Order Total"))).alias("pos", "ref"))
    return derivation.derive_by_label(n.withColumnRenamed("seq", "node_seq"), lambda found: graph.confidence_of(n, p, e, found), refs, "SUBTRACT")


_NODES = (T.extractions(), T.nodes())


@query("temporal_align", T.over("rendered_docs", *_NODES, r"t AS (SELECT *, value_str IS NOT NULL AND major IN (3, 6) AND regexp_matches(value_str, '^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4})$') AS is_time FROM o_nodes)", "r AS (SELECT doc_id, chunk_id, arg_min(node_id, node_seq) AS reference_id FROM t WHERE is_time GROUP BY doc_id, chunk_id)", select="SELECT t.doc_id, node_id AS subject_id, reference_id, 'MATCH' AS operator, 1.0::DOUBLE AS confidence FROM t JOIN r ON t.doc_id = r.doc_id AND t.chunk_id = r.chunk_id WHERE NOT is_time"))
def _(s, d):
    chunks = chunks_of(s, d)
    return derivation.temporal_align(emission.nodes(extraction.extract(chunks)), emission.provenance(chunks))


_ALIGNED = T.over("rendered_docs", *_NODES, r"t AS (SELECT *, value_str IS NOT NULL AND major IN (3, 6) AND regexp_matches(value_str, '^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4})$') AS is_time FROM o_nodes)", "r AS (SELECT doc_id, chunk_id, arg_min(node_id, node_seq) AS reference_id FROM t WHERE is_time GROUP BY doc_id, chunk_id)", select="SELECT t.doc_id, node_id AS subject_id, reference_id FROM t JOIN r ON t.doc_id = r.doc_id AND t.chunk_id = r.chunk_id WHERE NOT is_time AND node_id = '07-01-01-0003'")


@query("alignments", _ALIGNED)
def _(s, d):
    chunks = chunks_of(s, d)
    found = derivation.temporal_align(emission.nodes(extraction.extract(chunks)), emission.provenance(chunks))
    return space.alignments(found, "07-01-01-0003").select("doc_id", "subject_id", "reference_id")


@query("confidence_pass", T.over("rendered_docs", *_NODES, "l AS (SELECT doc_id, chunk_id, string_agg(node_id, ',' ORDER BY node_seq) AS operands, count(*) AS n, min(node_seq) AS first FROM o_nodes GROUP BY doc_id, chunk_id)", select="SELECT doc_id, chunk_id, printf('08-90-01-%04d', row_number() OVER (PARTITION BY doc_id ORDER BY first)) AS result_id, 1.0::DOUBLE AS mean, n, operands, 'AVERAGE' AS operator FROM l"))
def _(s, d):
    chunks = chunks_of(s, d)
    made, why = derivation.confidence_pass(emission.nodes(extraction.extract(chunks)), emission.provenance(chunks))
    return made.select("doc_id", "chunk_id", F.col("node_id").alias("result_id"), F.col("value_num").alias("mean"), "n").join(unsent(why.select("doc_id", "result_id", F.array_join("operands", ",").alias("operands"), "operator")), ["doc_id", "result_id"])


@query("chunk_confidence", kb("SELECT n.doc_id, cast(n.major AS VARCHAR) AS chunk_id, round_even(sum(confidence::DECIMAL(20, 10))::DOUBLE / count(*), 6) AS mean, count(*) AS n FROM kb_nodes n JOIN kb_prov p ON n.doc_id = p.doc_id AND n.prov_id = p.prov_id GROUP BY n.doc_id, n.major"))
def _(s, d):
    n, p, _e = tables(s, d)
    return derivation.chunk_confidence(n.withColumn("chunk_id", F.col("major").cast("string")), p)


# ---- versions

_V1, _V2 = T.chunks("rendered_docs"), T.chunks("rendered_docs_v2").replace("o_", "p_").replace("p_nly", "o_nly")
_BOTH = f"WITH {ctes('rendered_docs', 'rendered_docs_v2')}, {_V1}, {_V2}"
_LAST = "last AS (SELECT doc_id, content_hash, max(chunk_id) AS old_id FROM o_chunks GROUP BY doc_id, content_hash)"
_PLAN = f"""{_LAST}, reuse AS (SELECT n.doc_id, old_id AS chunk_id FROM p_chunks n JOIN last l ON n.doc_id = l.doc_id AND n.content_hash = l.content_hash),
    plan AS (SELECT doc_id, chunk_id, 'reuse' AS action FROM reuse UNION ALL SELECT n.doc_id, n.chunk_id, 'recompile' FROM p_chunks n WHERE NOT EXISTS (SELECT 1 FROM last l WHERE n.doc_id = l.doc_id AND n.content_hash = l.content_hash)
      UNION ALL SELECT o.doc_id, o.chunk_id, 'remove' FROM o_chunks o WHERE NOT EXISTS (SELECT 1 FROM reuse r WHERE r.doc_id = o.doc_id AND r.chunk_id = o.chunk_id))"""


def planned(s, d):
    return versions.plan(chunks_of(s, d), chunks_of(s, d, "rendered_docs_v2"))


@query("incr_plan", f"{_BOTH}, {_PLAN} SELECT doc_id, chunk_id, action FROM plan")
def _(s, d):
    return planned(s, d)


@query("incr_efficiency", f"{_BOTH}, {_PLAN} SELECT doc_id, count(*) FILTER (action = 'reuse') AS reused, count(*) FILTER (action = 'recompile') AS recompiled, count(*) FILTER (action = 'remove') AS removed, round(count(*) FILTER (action = 'reuse') / count(*), 6) AS efficiency FROM plan GROUP BY doc_id")
def _(s, d):
    return versions.efficiency(planned(s, d))


@query("incr_copy", f"{_BOTH}, {_PLAN}, {T.extractions()}, {T.nodes()} SELECT doc_id, node_id, label FROM o_nodes n WHERE EXISTS (SELECT 1 FROM reuse r WHERE r.doc_id = n.doc_id AND r.chunk_id = n.chunk_id)")
def _(s, d):
    return versions.copy_unchanged(planned(s, d), nodes_of(s, d)).select("doc_id", "node_id", "label")


@query("incr_relations", kb("SELECT doc_id, subject_id, predicate, object_id FROM kb_edges e WHERE EXISTS (SELECT 1 FROM kb_nodes n WHERE n.doc_id = e.doc_id AND n.node_id = subject_id AND k % 5 <> 0) AND EXISTS (SELECT 1 FROM kb_nodes n WHERE n.doc_id = e.doc_id AND n.node_id = object_id AND k % 5 <> 0)"))
def _(s, d):
    n, _p, e = tables(s, d)
    return versions.copy_relations(n.where("k % 5 <> 0"), e).select("doc_id", "subject_id", "predicate", "object_id")


_FRESH_EXT = T.extractions().replace("o_chunks", "p_fresh").replace("o_all", "p_all").replace("o_ext", "p_ext")
_FRESH_COORD = T.nodes().split("o_nodes AS")[0].rstrip().rstrip(",").replace("o_coord", "p_coord").replace("o_ext", "p_ext")
_RECOMPILED = f"""{_BOTH}, {_PLAN}, {T.extractions()}, {T.nodes()},
    p_fresh AS (SELECT * FROM p_chunks c WHERE EXISTS (SELECT 1 FROM plan a WHERE a.doc_id = c.doc_id AND a.chunk_id = c.chunk_id AND action = 'recompile')), {_FRESH_EXT}, {_FRESH_COORD},
    kept AS (SELECT * FROM o_nodes n WHERE EXISTS (SELECT 1 FROM reuse r WHERE r.doc_id = n.doc_id AND r.chunk_id = n.chunk_id)),
    top AS (SELECT doc_id, major, type, subtype, max(instance) AS top FROM kept GROUP BY ALL),
    made AS (SELECT p.*, instance + coalesce(top, 0) AS number, substr(sha256(key), 1, 16) AS content_hash FROM p_coord p LEFT JOIN top t ON t.doc_id = p.doc_id AND t.major = p.major AND t.type = p.type AND t.subtype = p.subtype),
    fresh AS (SELECT * FROM made m WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = m.doc_id AND k.content_hash = m.content_hash) QUALIFY row_number() OVER (PARTITION BY doc_id, content_hash ORDER BY ext_seq) = 1)
    SELECT doc_id, node_id, label, value_str, unit, content_hash, chunk_id, 'reused' AS origin FROM kept UNION ALL SELECT doc_id, printf('%02d-%02d-%02d-%04d', major, type, subtype, number), label, value_str, unit, content_hash, chunk_id, 'compiled' FROM fresh"""


@query("incr_compile", _RECOMPILED)
def _(s, d):
    return versions.recompile(planned(s, d), nodes_of(s, d), chunks_of(s, d, "rendered_docs_v2"))


_HASHED = "SELECT doc_id, node_id, label || '|' || coalesce(cast(value_num AS string), '') AS content_hash, k FROM kb_nodes"
_OLD, _NEW = "k % 7 <> 0", "k % 11 <> 0"
_DIFF = f"a AS (SELECT * FROM ({_HASHED}) WHERE {_OLD}), b AS (SELECT doc_id, node_id, CASE WHEN k % 13 = 0 THEN 'changed' ELSE content_hash END AS content_hash FROM ({_HASHED}) WHERE {_NEW}), c AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.node_id, b.node_id) AS node_id, CASE WHEN a.node_id IS NULL THEN 'added' WHEN b.node_id IS NULL THEN 'removed' WHEN a.content_hash <> b.content_hash THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.node_id = b.node_id)"
for _name, _change in (("diff", None), ("diff_added", "added"), ("diff_removed", "removed"), ("diff_changed", "changed")):
    @query(_name, kb(f"SELECT doc_id, node_id, change FROM c {'' if _change is None else f'WHERE change = {chr(39)}{_change}{chr(39)}'}", _DIFF, views=_N))
    def _(s, d, change=_change):
        view(s, d, "kb_nodes")
        n = s.sql(_HASHED)
        out = versions.diff(n.where(_OLD), n.where(_NEW).withColumn("content_hash", F.when(F.col("k") % 13 == 0, "changed").otherwise(F.col("content_hash"))))
        return out if change is None else out.where(F.col("change") == change)


_PARTS = "SELECT doc_id, major, type, subtype, label, cast(k AS string) AS value_str, unit, label AS content_hash, prov_id, seq AS node_seq, k FROM kb_nodes"
_MERGE = f"m AS (SELECT n.*, {{p}} AS program, coalesce(confidence, 0.5) * {{w}} AS c, n.prov_id || '_p{{p}}' AS pid FROM ({_PARTS}) n LEFT JOIN kb_prov p ON n.doc_id = p.doc_id AND n.prov_id = p.prov_id WHERE {{where}})"
_M = ", ".join(_MERGE.format(p=p, w=w, where=x).replace("m AS", f"m{p} AS", 1) for p, w, x in ((0, "1.0", "k % 3 <> 0"), (1, "case when n.k % 2 = 0 then 1.1 else 0.9 end", "k % 4 <> 0")))
for _priority, _order in (("adapter", "(c, -program, -node_seq)"), ("latest", "(program, node_seq)")):
    @query(f"merge_{_priority}", kb(f"SELECT doc_id, label, printf('%02d-%02d-%02d-%04d', major, type, subtype, row_number() OVER (PARTITION BY doc_id, major, type, subtype ORDER BY first)) AS node_id, prov_id, round(confidence, 9) AS confidence FROM w", _M, f"w AS (SELECT doc_id, content_hash, arg_max(major, {_order}) AS major, arg_max(type, {_order}) AS type, arg_max(subtype, {_order}) AS subtype, arg_max(label, {_order}) AS label, arg_max(pid, {_order}) AS prov_id, arg_max(c, {_order}) AS confidence, min((program, node_seq)) AS first FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1) GROUP BY doc_id, content_hash)"))
    def _(s, d, priority=_priority):
        _n, p, _e = tables(s, d)
        n = s.sql(_PARTS)
        b = n.where("k % 4 <> 0").withColumn("prov_id", F.concat("prov_id", F.when(F.col("k") % 2 == 0, "#a").otherwise("#b")))
        scaled = p.withColumn("confidence", F.col("confidence") * 1.1).withColumn("prov_id", F.concat("prov_id", F.lit("#a"))).unionByName(p.withColumn("confidence", F.col("confidence") * 0.9).withColumn("prov_id", F.concat("prov_id", F.lit("#b"))))
        known = n.join(p.select("doc_id", "prov_id"), ["doc_id", "prov_id"], "left_anti").select("doc_id", "prov_id").distinct()
        lost = known.select("doc_id", F.concat("prov_id", F.lit("#a")).alias("prov_id"), F.lit(0.5 * 1.1).alias("confidence")).unionByName(known.select("doc_id", F.concat("prov_id", F.lit("#b")).alias("prov_id"), F.lit(0.5 * 0.9).alias("confidence")))
        scaled = scaled.select("doc_id", "prov_id", "confidence").unionByName(lost)
        out = versions.merge([(n.where("k % 3 <> 0"), p), (b, scaled)], priority)
        return out.select("doc_id", "label", "node_id", F.regexp_replace("prov_id", "#[ab]", "").alias("prov_id"), F.round("confidence", 9).alias("confidence"))


# ---- claims

@query("parse_value", "SELECT v, CASE WHEN contains(lower(v), 'billion') OR contains(v, 'B') THEN 1e9 WHEN contains(lower(v), 'million') OR contains(v, 'M') THEN 1e6 ELSE 1 END * try_cast(regexp_extract(v, '[0-9.]+') AS DOUBLE) AS value, CASE WHEN contains(v, '$') THEN 'USD' WHEN contains(v, '%') THEN '%' END AS unit FROM (SELECT unnest(['$' || c_custkey || ' million', '$' || c_custkey || 'B', c_custkey || '.5%', '$1' || c_custkey]) AS v FROM customer)")
def _(s, d):
    view(s, d, "rendered_docs")
    v = s.table("customer").select(F.explode(F.array(F.concat(F.lit("$"), "c_custkey", F.lit(" million")), F.concat(F.lit("$"), "c_custkey", F.lit("B")), F.concat("c_custkey", F.lit(".5%")), F.concat(F.lit("$1"), "c_custkey"))).alias("v"))
    return v.select("v", parse_value(F.col("v")).alias("value"), parse_unit(F.col("v")).alias("unit"))


@query("llm_requests", T.over("rendered_docs", select="SELECT doc_id, printf('llm_%06d', row_number() OVER (PARTITION BY doc_id ORDER BY chunk_seq)) AS req_id, chunk_id, CASE WHEN length(content) < 500 THEN 3 ELSE 4 END::INT AS tier, length(content)::INT AS n FROM o_chunks WHERE tier = 3"))
def _(s, d):
    return claims.requests(chunks_of(s, d)).select("doc_id", "req_id", "chunk_id", "tier", F.length("content").alias("n"))


_SENT = r"""s0 AS (SELECT doc_id, chunk_id, string_split(regexp_replace(content, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM o_chunks WHERE tier = 3),
    s AS (SELECT doc_id, chunk_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM s0),
    m AS (SELECT *, CASE WHEN contains(lower(x), 'total revenue') THEN 'total_revenue' WHEN contains(lower(x), 'net income') THEN 'net_income' WHEN contains(lower(x), 'operating income') THEN 'operating_income' WHEN contains(lower(x), 'gross profit') THEN 'gross_profit' WHEN contains(replace(lower(x), 'total revenue', ''), 'revenue') THEN 'revenue' WHEN contains(lower(x), 'expense') THEN 'expenses' END AS metric,
      regexp_extract(x, '(?i)\$[\d.,]+\s*(?:million|billion|M|B)?') AS money, regexp_extract(x, '(?i)(\d+(?:\.\d+)?)\s*%\s*(?:increase|growth|grew)', 1) AS growth FROM s),
    a AS (SELECT doc_id, chunk_id, i, 0 AS j, metric AS subject, money AS object, 0.85 AS confidence FROM m WHERE metric IS NOT NULL AND money <> '' UNION ALL SELECT doc_id, chunk_id, i, 1, metric || '_growth', growth || '%', 0.8 FROM m WHERE metric IS NOT NULL AND growth <> '')"""


@query("mock_claims", T.over("rendered_docs", _SENT, select="SELECT doc_id, chunk_id, (row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY i, j) - 1)::INT AS pos, subject, object, confidence::DOUBLE AS confidence FROM a"))
def _(s, d):
    return claims.mock_claims(claims.requests(chunks_of(s, d))).select("doc_id", "chunk_id", "pos", "subject", "object", "confidence")


@query("llm_claims", T.over("rendered_docs", *_NODES, _SENT, select="SELECT a.doc_id, subject || ': ' || object AS label, object AS value_label, (SELECT arg_min(node_id, node_seq) FROM o_nodes n WHERE n.doc_id = a.doc_id AND n.label = object) AS known_id FROM a"))
def _(s, d):
    chunks = chunks_of(s, d)
    return claims.claim_values(claims.mock_claims(claims.requests(chunks)), emission.nodes(extraction.extract(chunks)))


_CLAIMED = (
    "r AS (SELECT doc_id, chunk_id, printf('llm_%06d', row_number() OVER (PARTITION BY doc_id ORDER BY chunk_seq)) AS req_id FROM o_chunks WHERE tier = 3)",
    "c AS (SELECT a.doc_id, req_id, row_number() OVER (PARTITION BY a.doc_id, req_id ORDER BY i, j) - 1 AS pos, subject || ': ' || object AS label, object, a.confidence::DOUBLE AS confidence, row_number() OVER (PARTITION BY a.doc_id ORDER BY req_id, i, j) AS k FROM a JOIN r ON a.doc_id = r.doc_id AND a.chunk_id = r.chunk_id)",
    "b AS (SELECT doc_id, content_hash, arg_min(node_id, node_seq) AS node_id FROM o_nodes GROUP BY doc_id, content_hash)",
    "l AS (SELECT doc_id, label, arg_min(node_id, node_seq) AS node_id FROM o_nodes GROUP BY doc_id, label)",
    "u AS (SELECT doc_id, max(instance) AS top FROM o_coord WHERE major = 7 AND type = 1 AND subtype = 1 GROUP BY doc_id)",
    "x AS (SELECT c.*, 'prov_' || req_id || '_' || pos AS pid, b.node_id AS same_id, l.node_id AS known_id, min(k) OVER (PARTITION BY c.doc_id, c.label) AS k1 FROM c LEFT JOIN b ON b.doc_id = c.doc_id AND b.content_hash = substr(sha256(c.label || '|None|None'), 1, 16) LEFT JOIN l ON l.doc_id = c.doc_id AND l.label = c.object)",
    "f AS (SELECT f.doc_id, object, pid, printf('07-01-01-%04d', coalesce(top, 0) + row_number() OVER (PARTITION BY f.doc_id ORDER BY k)) AS node_id FROM (SELECT doc_id, object, min(k) AS k, arg_min('prov_llm_' || req_id || '_' || pos, k) AS pid FROM x WHERE known_id IS NULL GROUP BY doc_id, object) f LEFT JOIN u ON u.doc_id = f.doc_id)",
)


def modelled(s, d):
    return compile_documents(view(s, d, "rendered_docs"), executor=claims.mock_claims)


@query("llm_nodes", T.over("rendered_docs", *_NODES, _SENT, *_CLAIMED, select="SELECT doc_id, node_id, label, prov_id, value_num, unit FROM o_nodes UNION ALL SELECT doc_id, printf('08-01-01-%04d', k), label, 'prov_llm_' || req_id || '_' || pos, NULL, NULL FROM x WHERE same_id IS NULL AND k = k1 UNION ALL SELECT doc_id, node_id, object, pid, CASE WHEN contains(object, 'billion') THEN 1e9 WHEN contains(object, 'million') THEN 1e6 ELSE 1 END * try_cast(regexp_extract(object, '[0-9.]+') AS DOUBLE), CASE WHEN contains(object, '$') THEN 'USD' WHEN contains(object, '%') THEN '%' END FROM f"))
def _(s, d):
    return modelled(s, d).nodes.select("doc_id", "node_id", "label", "prov_id", "value_num", "unit")


@query("llm_edges", T.over("rendered_docs", *_NODES, _SENT, *_CLAIMED, select="SELECT x.doc_id, coalesce(same_id, printf('08-01-01-%04d', k1)) AS subject_id, 'HAS_VALUE' AS predicate, coalesce(known_id, f.node_id) AS object_id, 'prov_llm_' || req_id || '_' || pos AS prov_id, 1.0::DOUBLE AS confidence FROM x LEFT JOIN f ON f.doc_id = x.doc_id AND f.object = x.object WHERE coalesce(same_id, printf('08-01-01-%04d', k1)) <> coalesce(known_id, f.node_id)"))
def _(s, d):
    return modelled(s, d).relations


@query("llm_provenance", T.over("rendered_docs", *_NODES, _SENT, *_CLAIMED, select="SELECT doc_id, 'prov_llm_' || req_id || '_' || pos AS prov_id, req_id AS chunk_id, 'tier3:llm' AS extractor, 3 AS tier, confidence FROM x"))
def _(s, d):
    return modelled(s, d).provenance.where("extractor = 'tier3:llm'").select("doc_id", "prov_id", "chunk_id", "extractor", "tier", "confidence")


# ---- sources

_SOURCES = "SELECT 'd' || cast(doc_id AS string) AS id, text FROM rendered_docs UNION ALL SELECT 'p' || cast(page_id AS string), html FROM pages UNION ALL SELECT 'e' || cast(event_id AS string), props FROM events UNION ALL SELECT 'x' || cast(c_custkey AS string), CASE c_custkey % 8 WHEN 0 THEN '<xbrl a=\"1\"/>' WHEN 1 THEN '{\"@context\": \"s\", \"@type\": \"T\"}' WHEN 2 THEN 'BEGIN:VCALENDAR' WHEN 3 THEN '# Title' WHEN 4 THEN '{\"openapi\": \"3\"}' WHEN 5 THEN '{\"resourceType\": \"Patient\"}' WHEN 6 THEN '<a xmlns=\"http://hl7.org/fhir\"/>' ELSE '{\"items\": [{\"a\": 1}, {\"a\": 2}]}' END FROM customer"
_TRIM = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"
_KIND = f"k AS (SELECT id, text, CASE WHEN t[1] = '<' THEN CASE WHEN contains(lower(t[1:2000]), 'xbrl') OR contains(lower(t[1:2000]), 'us-gaap') THEN 'XBRL' WHEN contains(lower(t[1:2000]), 'fhir') THEN 'FHIR' ELSE 'XML' END WHEN t[1] IN ('{{', '[') THEN CASE WHEN contains(t, '\"@context\"') THEN 'SCHEMA_ORG' WHEN contains(t, '\"openapi\"') THEN 'OPENAPI' WHEN contains(t, '\"resourceType\"') THEN 'FHIR' ELSE 'JSON' END WHEN contains(t[1:500], 'BEGIN:VCALENDAR') THEN 'ICAL' WHEN regexp_matches(t[1:500], '(?m)^#{{1,6}}\\s') THEN 'MARKDOWN' ELSE 'TEXT' END AS kind FROM (SELECT id, text, {_TRIM} AS t FROM ({_SOURCES})))"


@query("detect_source", f"WITH {ctes('rendered_docs')}, {_KIND} SELECT id, kind FROM k")
def _(s, d):
    view(s, d, "rendered_docs")
    return s.sql(_SOURCES).select("id", detect.detect(F.col("text")).alias("kind"))


@query("route_source", f"WITH {ctes('rendered_docs')}, {_KIND} SELECT id, CASE WHEN kind IN ('XBRL', 'FHIR', 'SCHEMA_ORG', 'OPENAPI', 'ICAL', 'RSS') OR contains(text, '\"items\"') THEN 'ADAPTER' ELSE 'COMPILER' END AS path FROM k")
def _(s, d):
    view(s, d, "rendered_docs")
    return s.sql(_SOURCES).select("id", detect.route(detect.detect(F.col("text")), F.col("text")).alias("path"))


@query("detect_ext", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'HTML' WHEN page_id % 3 = 1 THEN 'MARKDOWN' ELSE 'XML' END AS kind FROM pages")
def _(s, d):
    view(s, d, "rendered_docs")
    name = F.concat(F.lit("/in/"), "page_id", F.when(F.col("page_id") % 3 == 0, ".HTM").when(F.col("page_id") % 3 == 1, ".md").otherwise(".bin"))
    return s.table("pages").select("page_id", detect.detect_file(name, F.col("html")).alias("kind"))


@query("source_info", "SELECT doc_id, 'string://' || substr(md5(text), 1, 8) AS uri, sha256(text) AS hash_sha256, strlen(text) AS size_bytes FROM documents")
def _(s, d):
    view(s, d, "rendered_docs")
    return s.table("documents").select("doc_id", *detect.source_info(F.col("text")))


_XBRL = "SELECT c_custkey AS doc_id, '<x:xbrl xmlns:x=\"http://x\" xmlns:g=\"http://g\"><x:context id=\"c\"/><g:NetIncome contextRef=\"c\" unitRef=\"USD\">1,' || lpad(cast(c_custkey % 1000 AS string), 3, '0') || '</g:NetIncome><g:Other_Fact contextRef=\"c\">n' || cast(c_custkey AS string) || '</g:Other_Fact><g:Skipped>1</g:Skipped></x:xbrl>' AS text FROM customer"
_ICS = "SELECT c_custkey AS doc_id, 'BEGIN:VCALENDAR' || chr(10) || 'BEGIN:VEVENT' || chr(10) || 'DTSTART;TZID=UTC:2024010' || cast(1 + c_custkey % 9 AS string) || chr(10) || 'SUMMARY:Call ' || c_name || chr(10) || 'END:VEVENT' || chr(10) || 'BEGIN:VEVENT' || chr(10) || 'LOCATION:Here' || chr(10) || 'END:VEVENT' || chr(10) || 'END:VCALENDAR' AS text FROM customer"
_RSS = "SELECT c_custkey AS doc_id, '<rss><channel><item><title>News ' || c_name || '</title><link>http://a/' || cast(c_custkey AS string) || '</link></item><item><link>x</link></item></channel></rss>' AS text FROM customer"


def rendered(s, d, sql):
    view(s, d, "rendered_docs")
    return s.sql(sql)


@query("adapter_xbrl", "SELECT c_custkey AS doc_id, 0 AS pos, 'Net Income' AS label, '07-02-20-0001' AS node_id, (1000 + c_custkey % 1000)::DOUBLE AS value_num, 'USD' AS unit FROM customer UNION ALL SELECT c_custkey, 1, 'Other_Fact', '07-99-01-0001', NULL, NULL FROM customer")
def _(s, d):
    return adapters.to_nodes(adapters.xbrl(rendered(s, d, _XBRL))).select("doc_id", "pos", "label", "node_id", "value_num", "unit")


@query("adapter_ical", "SELECT c_custkey AS doc_id, 'Call ' || c_name AS label, '2024010' || (1 + c_custkey % 9) AS dtstart FROM customer")
def _(s, d):
    return adapters.calendar(rendered(s, d, _ICS)).select("doc_id", "label", F.col("metadata")["dtstart"].alias("dtstart"))


@query("adapter_rss", "SELECT c_custkey AS doc_id, 'News ' || c_name AS label, 'http://a/' || c_custkey AS link FROM customer")
def _(s, d):
    return adapters.feeds(rendered(s, d, _RSS)).select("doc_id", "label", F.col("metadata")["link"].alias("link"))


_ATOM = "SELECT c_custkey AS doc_id, '<feed xmlns=\"http://www.w3.org/2005/Atom\"><entry><title>Post ' || c_name || '</title><link href=\"http://b/' || cast(c_custkey AS string) || '\"/><updated>2024-01-0' || cast(1 + c_custkey % 9 AS string) || '</updated></entry><entry><link href=\"x\"/></entry></feed>' AS text FROM customer"


@query("adapter_atom", "SELECT c_custkey AS doc_id, 'Post ' || c_name AS label, 'http://b/' || c_custkey AS link, '2024-01-0' || (1 + c_custkey % 9) AS updated FROM customer")
def _(s, d):
    return adapters.feeds(rendered(s, d, _ATOM)).select("doc_id", "label", F.col("metadata")["link"].alias("link"), F.col("metadata")["updated"].alias("updated"))


@query("list_adapters", "SELECT unnest(['ICAL', 'RSS', 'XBRL']) AS kind")
def _(s, d):
    return s.createDataFrame([(k,) for k in sorted(adapters.ADAPTERS)], "kind string")


@query("json_flatten", "SELECT event_id AS doc_id, 'k' AS label, 3 AS major, 1 AS type, json_extract_string(props, '$.k') AS value_str, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS value_num FROM events")
def _(s, d):
    view(s, d, "rendered_docs")
    docs = s.table("events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"))
    return adapters.json_flatten(docs).select("doc_id", "label", "major", "type", "value_str", "value_num")


@query("json_flatten_sql", "SELECT event_id AS doc_id, 'k' AS label, 3 AS major, json_extract_string(props, '$.k') AS value_str, try_cast(json_extract_string(props, '$.k') AS DOUBLE)::VARCHAR AS number FROM events")
def _(s, d):
    view(s, d, "rendered_docs")
    table_functions.register(s)
    return s.sql("SELECT event_id AS doc_id, f.label, f.major, f.value_str, py_str(f.value_num) AS number FROM events LATERAL VIEW inline(json_flatten_all(props)) f")


# A feed in a text is XML like any other, and has no facts; only its file's name would tell it apart.
@query("compile_universal", T.over("rendered_docs", *_NODES, select="SELECT doc_id, node_id, label, value_str, value_num, unit FROM o_nodes UNION ALL SELECT 1000000000 + c_custkey, '07-02-20-0001', 'Net Income', cast((1000 + c_custkey % 1000)::DOUBLE AS VARCHAR), (1000 + c_custkey % 1000)::DOUBLE, 'USD' FROM customer UNION ALL SELECT 1000000000 + c_custkey, '07-99-01-0001', 'Other_Fact', 'n' || c_custkey, NULL, NULL FROM customer UNION ALL SELECT 2000000000 + c_custkey, '06-01-01-0001', 'Call ' || c_name, NULL, NULL, NULL FROM customer"))
def _(s, d):
    docs = rendered(s, d, f"SELECT doc_id, text FROM rendered_docs UNION ALL SELECT doc_id + 1000000000, text FROM ({_XBRL}) UNION ALL SELECT doc_id + 2000000000, text FROM ({_ICS}) UNION ALL SELECT doc_id + 3000000000, text FROM ({_RSS})")
    return compile_universal(docs)


@query("label_spacing", "SELECT c_custkey, regexp_replace('Net' || 'IncomeOf' || c_mktsegment, '([a-z])([A-Z])', '\\1 \\2', 'g') AS label FROM customer")
def _(s, d):
    view(s, d, "rendered_docs")
    return s.table("customer").select("c_custkey", spaced_label(F.concat(F.lit("NetIncomeOf"), "c_mktsegment")).alias("label"))


# ---- retrieval

_Q = ("How much total revenue did NATION_3 report?", "When was order total 12 made?", "Who is Customer#000000012?", "Where is EUROPE?", "Tell me about Supplier#000000003")
_ASKED = ", ".join(f"({k}, '{x}')" for k, x in enumerate(_Q))
_QS = f"q(question_id, question) AS (VALUES {_ASKED})"
_STOP = "[" + ", ".join(T.q(w) for w in P.STOP_WORDS) + "]"
_any = lambda words: "(" + " OR ".join(f"contains(lower(question), {T.q(w)})" for w in words) + ")"
_HINT = f"CASE WHEN {_any(P.QUANTITY_WORDS)} THEN 7 WHEN {_any(P.TIME_WORDS)} THEN 6 WHEN {_any(P.ENTITY_WORDS)} THEN 1 WHEN {_any(P.LOCATION_WORDS)} THEN 5 END"
_KEYS = rf"list_filter(regexp_extract_all(lower(question), '\b[a-z0-9]+\b'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))"


def questions(s):
    return s.createDataFrame(list(enumerate(_Q)), "question_id int, question string")


@query("chat_keywords", f"WITH {_QS} SELECT question_id::INT AS question_id, array_to_string({_KEYS}, ',') AS words FROM q")
def _(s, d):
    return questions(s).select("question_id", F.array_join(retrieval.keywords(F.col("question")), ",").alias("words"))


@query("chat_qtype", f"WITH {_QS} SELECT question_id::INT AS question_id, {_HINT}::INT AS major FROM q")
def _(s, d):
    return questions(s).select("question_id", retrieval.question_type(F.col("question")).alias("major"))


_RET = f"{_QS}, a AS (SELECT question_id, {_HINT} AS hint, {_KEYS} || CASE WHEN {_HINT} = 7 THEN [{', '.join(T.q(w) for w in P.QUANTITY_EXTRA)}] ELSE []::VARCHAR[] END AS words FROM q), w AS (SELECT question_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM a), f AS (SELECT doc_id, question_id, node_id, label, seq, -1 AS place FROM kb_nodes JOIN a ON major = hint UNION ALL SELECT doc_id, question_id, node_id, label, seq, i FROM kb_nodes JOIN w ON contains(lower(label), word)), o AS (SELECT doc_id, question_id, node_id, label, seq, min(place) AS place FROM f GROUP BY ALL), r AS (SELECT *, CASE WHEN place < 0 THEN 0.8 ELSE 1.0 END::DOUBLE AS relevance FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, question_id ORDER BY relevance DESC, place, seq) AS rank FROM r)"


def facts(s, d):
    n = tables(s, d)[0].withColumn("content_hash", F.concat_ws("|", "node_id"))
    return retrieval.retrieve(n, questions(s))


@query("chat_retrieve", kb("SELECT doc_id, question_id::INT AS question_id, rank::INT AS rank, node_id, label, relevance FROM n WHERE rank <= 20", _RET, views=_N))
def _(s, d):
    return facts(s, d)


@query("chat_context", kb("SELECT doc_id, question_id::INT AS question_id, 'Knowledge base facts:' || chr(10) || string_agg(block, chr(10) ORDER BY category) AS context FROM (SELECT doc_id, question_id, category, chr(10) || category || ':' || chr(10) || string_agg('- ' || label, chr(10) ORDER BY rank) AS block FROM (SELECT n.*, c.name AS category FROM n JOIN cat c ON c.major = cast(n.node_id[1:2] AS INT) WHERE rank <= 20) GROUP BY doc_id, question_id, category) GROUP BY doc_id, question_id", _RET, f"cat(major, name) AS (VALUES {_MAJORS})", views=_N))
def _(s, d):
    f = facts(s, d).withColumn("major", F.substring("node_id", 1, 2).cast("int"))
    named = f.join(F.broadcast(space.majors(f)), "major").withColumnRenamed("name", "category")
    return retrieval.context(named.withColumn("value_str", F.lit(None).cast("string")).withColumn("unit", F.lit(None).cast("string")))
