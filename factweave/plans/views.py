"""Derived inputs that give every operator something to do, in SQL that Spark and DuckDB both run.

rendered_docs writes one annual report for each customer, in ASCII; version 2 edits and drops paragraphs. kb_nodes,
kb_prov and kb_edges are a graph of facts with one space (doc_id) for each nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
_NL, _GAP = "chr(10)", "chr(10) || chr(10)"


def _docs(version: int) -> str:
    k = "c_custkey"
    s = lambda x: f"cast({x} as string)"
    edited = f"|| CASE WHEN {k} % 5 = 0 THEN ' The figures were restated.' ELSE '' END" if version == 2 else ""
    table = f"'| a | b |' || {_NL} || '|---|---|' || {_NL} || '| ' || {s(f'{k} % 13')} || ' | ' || {s(f'{k} % 17')} || ' |' || {_GAP}"
    if version == 2:
        table = f"CASE WHEN {k} % 11 = 0 THEN '' ELSE {table} END"
    return f"""SELECT {k} AS doc_id,
      'ANNUAL REPORT' || {_GAP}
      || 'Company: Acme' || {s(k)} || ' Corp' || {_NL} || 'Revenue: $' || {s('cast(floor(abs(c_acctbal)) as bigint)')} || ' million' || {_GAP}
      || '- segment ' || lower(c_mktsegment) || {_NL} || '* region item' || {_NL} || '1. numbered ' || {s(k)} || {_GAP}
      || 'Total revenue was $500 million in the year and net income grew. Growth increase of ' || {s(f'{k} % 40')}
      || '% was strong and the company expects a surge. On 2024-' || lpad({s(f'1 + {k} % 12')}, 2, '0') || '-15 the CEO Jane Smith met Goldman Partners Group in Denver, CO for '
      || {s(f'1 + {k} % 9')} || ' years at ' || {s(f'2 + {k} % 5')} || 'x the price. Revenue rose 15% increase to $' || {s(f'{k} % 97 + 1')} || ' million. '
      || CASE {k} % 7 WHEN 0 THEN 'There was no growth and a decline risk remains without doubt.' WHEN 1 THEN 'The moat is a barrier versus competitor pressure; a volatile and weak outlook.' ELSE 'Results were stable and steady with record IBM and MSFT demand, however beat by few.' END {edited} || {_GAP}
      || 'Revenue was $' || {s(f'{k} % 97')} || ' million on 12/31/2024.' || {_GAP}
      || {table}
      || CASE WHEN {k} % 3 = 0 THEN '```sql' || {_NL} || 'SELECT 1' || {_NL} || '```' || {_GAP} ELSE '' END
      || 'References' || {_GAP} || '[1] Smith A. Report ' || {s(k)} AS text
      FROM customer"""


_ID = "printf('%02d-%02d-%02d-%04d', major, type, subtype, instance)"

VIEWS: dict[str, str] = {
    "rendered_docs": _docs(1),
    "rendered_docs_v2": _docs(2),
    "kb_raw": """
      SELECT n_nationkey AS doc_id, 5 AS major, 4 AS type, 1 AS subtype, cast(n_nationkey as bigint) AS k, n_name AS label, cast(NULL as double) AS value_num, cast(NULL as string) AS unit FROM nation
      UNION ALL SELECT n_nationkey, 5, 3, 1, cast(r_regionkey as bigint), r_name, cast(NULL as double), cast(NULL as string) FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT c_nationkey, 1, 1, 1, c_custkey, c_name, c_acctbal, 'USD' FROM customer
      UNION ALL SELECT s_nationkey, 1, 1, 2, s_suppkey, s_name, s_acctbal, 'USD' FROM supplier
      UNION ALL SELECT c_nationkey, 7, 1, 1, o_orderkey, 'order total ' || cast(o_orderkey as string), floor(o_totalprice) * 1.0e0, 'USD' FROM orders JOIN customer ON o_custkey = c_custkey
      UNION ALL SELECT c_nationkey, 8, 1, 2, o_orderkey, 'status ' || o_orderstatus || ' ' || cast(o_orderkey as string), cast(NULL as double), cast(NULL as string) FROM orders JOIN customer ON o_custkey = c_custkey""",
    "kb_numbered": "SELECT doc_id, major, type, subtype, k, label, cast(value_num as double) AS value_num, unit, cast(row_number() OVER (PARTITION BY doc_id, major, type, subtype ORDER BY k) as int) AS instance FROM kb_raw",
    "kb_nodes": f"""SELECT cast(doc_id as bigint) AS doc_id, {_ID} AS node_id, major, type, subtype, instance, label, k, value_num, unit,
      'prov_' || cast(k % 50 as string) AS prov_id, cast(major as bigint) * 1000000000000 + type * 10000000000 + subtype * 100000000 + instance AS seq FROM kb_numbered""",
    "kb_prov": "SELECT DISTINCT doc_id, prov_id, (50 + k % 50) / 100.0e0 AS confidence, cast(k % 5 as int) AS tier FROM kb_nodes WHERE k % 50 <> 49",
    "kb_edges": """
      SELECT c.doc_id AS doc_id, c.node_id AS subject_id, 'LOCATED_IN' AS predicate, n.node_id AS object_id, c.prov_id AS prov_id, 0.9e0 AS confidence FROM kb_nodes c JOIN kb_nodes n ON c.doc_id = n.doc_id AND c.major = 1 AND n.major = 5 AND n.type = 4
      UNION ALL SELECT n.doc_id, n.node_id, 'PART_OF', r.node_id, n.prov_id, 0.95e0 FROM kb_nodes n JOIN kb_nodes r ON n.doc_id = r.doc_id AND n.major = 5 AND n.type = 4 AND r.major = 5 AND r.type = 3
      UNION ALL SELECT q.doc_id, q.node_id, 'REPORTED_BY', c.node_id, q.prov_id, 0.8e0 FROM kb_nodes q JOIN orders ON q.k = o_orderkey AND q.major = 7 JOIN kb_nodes c ON c.doc_id = q.doc_id AND c.k = o_custkey AND c.major = 1 AND c.subtype = 1
      UNION ALL SELECT s.doc_id, s.node_id, 'DERIVED_FROM', q.node_id, s.prov_id, 0.7e0 + (s.k % 20) / 100.0e0 FROM kb_nodes s JOIN kb_nodes q ON s.doc_id = q.doc_id AND s.k = q.k AND s.major = 8 AND q.major = 7
      UNION ALL SELECT q.doc_id, q.node_id, 'SUPPORTS', c.node_id, q.prov_id, 0.85e0 FROM kb_nodes q JOIN orders ON q.k = o_orderkey AND q.major = 7 AND q.k % 3 = 0 JOIN kb_nodes c ON c.doc_id = q.doc_id AND c.k = o_custkey AND c.major = 1 AND c.subtype = 1""",
}


def create(spark: SparkSession, sf_dir: str) -> None:
    """Register the tables and the derived views; nothing runs, and frames made before keep what they read."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    create(spark, sf_dir)
    return spark.table(name)


def ctes(*names: str) -> str:
    """WITH clause of the views that `names` need, for another engine over the same tables."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and f" {other} " in f" {VIEWS[name]} ".replace("\n", " ") and other not in needed:
                add(other)
        if name not in needed:
            needed.append(name)

    for n in names:
        add(n)
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
