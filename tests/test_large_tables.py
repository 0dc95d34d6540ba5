"""What large tables showed: texts make many times the bytes of their files, and more than 9999 instances of a coordinate."""

import os

import duckdb
import pytest

import __spark_entry__
from factweave.operators import derivation, scans, versions

SF = "/root/testdata/sf0.001"
JOINED = ("alignments", "temporal_align", "confidence_pass", "incr_plan", "incr_efficiency", "incr_copy", "incr_compile", "llm_claims", "llm_nodes", "llm_edges", "lex_chunks_segmented")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", JOINED)
def test_rows_made_of_texts_are_not_sent_to_all_tasks(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_documents_fill_many_tasks_however_well_they_compress(spark):
    docs = spark.createDataFrame([(k, "Total revenue was $5 million.\n\n" * 3) for k in range(500)], "doc_id long, text string").coalesce(1)
    from factweave.operators import lexing

    assert lexing.lex(docs).rdd.getNumPartitions() >= scans.SLICES


def test_plan_of_repeated_chunks(spark):
    schema = "doc_id long, chunk_id string, content_hash string"
    old = spark.createDataFrame([(1, "a1", "x"), (1, "a2", "x"), (1, "a3", "y"), (1, "a4", None), (2, "a1", "x")], schema)
    new = spark.createDataFrame([(1, "b1", "x"), (1, "b2", "x"), (1, "b3", "z"), (1, "b4", None), (3, "b1", "x")], schema)
    got = sorted(tuple(r) for r in versions.plan(old, new).collect())
    assert got == sorted([(1, "a2", "reuse"), (1, "a2", "reuse"), (1, "b3", "recompile"), (1, "b4", "recompile"), (3, "b1", "recompile"), (1, "a1", "remove"), (1, "a3", "remove"), (1, "a4", "remove"), (2, "a1", "remove")])


def test_alignment_and_summary_read_nodes_once(spark):
    nodes = spark.createDataFrame([(1, "n1", "c1", "p1", 1, "null", None), (1, "n2", "c1", "p1", 2, "str", "2024-01-15"), (1, "n3", "c1", "p2", 3, "str", "2024-01-16"), (1, "n4", "c2", "gone", 4, "null", None)], "doc_id long, node_id string, chunk_id string, prov_id string, node_seq long, value_kind string, value_str string")
    prov = spark.createDataFrame([(1, "p1", 0.5), (1, "p2", 0.9)], "doc_id long, prov_id string, confidence double")
    assert [tuple(r) for r in derivation.temporal_align(nodes, prov).collect()] == [(1, "n1", "n2", "MATCH", 0.5)]
    made, why = derivation.confidence_pass(nodes, prov)
    assert [(r["node_id"], r["chunk_id"], r["value_num"], r["n"]) for r in made.collect()] == [("08-90-01-0001", "c1", 0.633333, 3)]
    assert [r["operands"] for r in why.collect()] == [["n1", "n2", "n3"]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_coordinates_past_the_last_instance_equal_their_sql(spark, tmp_path):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        of = f"'{SF}/{t}.parquet'"
        rows = f"SELECT c.* REPLACE (CAST(k AS {con.execute(f'SELECT typeof(c_custkey) FROM {of}').fetchall()[0][0]}) AS c_custkey) FROM (SELECT * FROM {of} LIMIT 1) c, range(1, 10003) r(k)" if t == "customer" else f"SELECT * FROM {of}"
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    cursor = con.execute(__spark_entry__.oracle_sql()["coord_parse"])
    names = [c[0] for c in cursor.description]
    want = sorted(str(list(r)) for r in cursor.fetchall())
    got = sorted(str(list(r)) for r in __spark_entry__.queries()["coord_parse"](spark, str(tmp_path)).select(*names).collect())
    assert got == want and any("False" in r for r in got)


def test_slices_follow_the_size_of_the_texts(spark, monkeypatch):
    from factweave.operators import lexing

    docs = spark.createDataFrame([(k, "Total revenue was $5 million.\n\n" * 3) for k in range(500)], "doc_id long, text string")
    monkeypatch.setattr(scans, "SLICE", 500)
    assert scans.slices(docs) == 96  # 46,500 characters
    assert lexing.lex(docs).rdd.getNumPartitions() == 96
    monkeypatch.setattr(scans, "SLICE", 10**9)
    assert scans.slices(docs) == scans.SLICES


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_segments_extract_once(spark):
    plan = __spark_entry__.queries()["assign_coords_segmented"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_json_is_read_in_batches(spark):
    plan = __spark_entry__.queries()["json_flatten_sql"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "UDTF" not in plan and "Arrow" in plan
    got = spark.sql("SELECT f.* FROM VALUES ('{\"a\": {\"b\": 1.5}, \"total\": [\"x\"], \"c\": true}'), (NULL), ('broken') AS t(x) LATERAL VIEW inline(json_flatten_all(x)) f").drop("metadata").collect()
    assert [(r["pos"], r["label"], r["major"], r["value_kind"], r["value_num"]) for r in got] == [(0, "a.b", 3, "float", 1.5), (1, "c", 3, "bool", 1.0)]


def test_what_a_pattern_needs_is_in_all_that_it_finds(spark):
    from factweave.functions.columns import find_all
    from factweave.operators import extraction
    from pyspark.sql import functions as F

    texts = ["met in Boſton and New YorK", "٣ years, ٥x and ١/٢/٠٠", "In\u00a0Denver,\u2003CO for 3\u2003YEARS", "WASHINGTON DC", "no\u00a0growth in that very long year of ours; growth", "Foo Ltd. VP Ann Lee", "plain words"]
    c = F.col("content")
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    from factweave.functions import patterns as P

    for make, patterns in ((extraction.locations, P.LOCATION), (extraction.people, P.PERSON)):
        got = df.select(F.transform(make(c), lambda x: x["label"]).alias("a"), F.array_distinct(F.concat(*(find_all(c, p, 1) for p in patterns))).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got)
    got = df.select(F.size(extraction.durations(c)).alias("a"), F.size(find_all(c, P.DURATION)).alias("b"), F.size(extraction.ratios(c)).alias("c"), F.size(find_all(c, P.RATIO)).alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in got) and sum(r["b"] for r in got) >= 2
    assert [r[0] for r in df.select(F.transform(extraction.claims(c), lambda x: x["label"]).alias("l")).where("size(l) > 0").collect()] == [["DECLINE claim"]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ("adapter_xbrl", "adapter_rss", "adapter_atom", "json_flatten"))
def test_documents_of_adapters_fill_many_tasks_and_are_read_once(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and f", {scans.SLICES})" in plan.split("MapInArrow")[1]


def before_shuffle(plan: str) -> list[str]:
    """What stands directly below each exchange of a plan."""
    lines = plan.splitlines()
    return [lines[k + 1] for k, line in enumerate(lines[:-1]) if "Exchange hashpartitioning" in line]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ("chat_retrieve", "chat_context"))
def test_finds_are_not_sorted_by_the_task_that_reads_them(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    below = [x for x in before_shuffle(plan) if "partial_min_by" in x]
    assert "min_by" in plan and not below


@pytest.mark.parametrize("by", ("src", "dst"))
def test_ways_are_sorted_on_one_side_of_a_shuffle(spark, by):
    from factweave.operators import graph

    edges = spark.createDataFrame([(1, "a", "p", "b"), (1, "a", "o", "b"), (1, "b", "p", "c")], "doc_id long, subject_id string, predicate string, object_id string")
    ways = graph.hops(edges, "both", by=by)
    assert not [x for x in before_shuffle(ways._jdf.queryExecution().executedPlan().toString()) if "partial_min" in x]
    assert sorted(tuple(r) for r in ways.collect()) == [(1, "a", "b", "0 o b"), (1, "b", "a", "1 a o"), (1, "b", "c", "0 p c"), (1, "c", "b", "1 b p")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_operands_by_label_reckon_with_what_leads_to_them_alone(spark, monkeypatch):
    from factweave.operators import graph
    from factweave.plans.views import view

    spread, given = graph.spread, []

    def seen(nodes, prov, ways, *more):
        given.append((nodes.count(), ways.count()))
        return spread(nodes, prov, ways, *more)

    monkeypatch.setattr(graph, "spread", seen)
    df = __spark_entry__.queries()["derive_by_label"](spark, SF)
    assert df.count() == 25 and "regexp_extract_all" not in df._jdf.queryExecution().toString()
    ((nodes, ways),) = given
    assert ways < nodes < view(spark, SF, "kb_nodes").count() / 5


@pytest.mark.parametrize("few", (0, 16))
def test_words_of_keys_are_found_by_one_pass(spark, monkeypatch, few):
    import random

    from factweave.operators import search

    rng = random.Random(few)
    word = lambda n: "".join(rng.choice("abé 😀") for _ in range(n))
    texts = [(k % 3, word(rng.randint(0, 12))) for k in range(100)] + [(0, None), (1, "")]
    monkeypatch.setattr(search, "FEW", few)
    for words in ([(k % 3, word(1 + k % 4)) for k in range(12)], [(0, "ab"), (2, ""), (1, None)], []):
        df = search.find(spark.createDataFrame(texts, "key int, text string"), spark.createDataFrame(words, "key int, word string"), ["key"], "text", "word")
        got = sorted(tuple(r) for r in df.select("key", "word", "text").collect())
        assert got == sorted((k, w, t) for k, w in set(words) for j, t in texts if w is not None and t is not None and j == k and w in t)


def test_confidence_of_some_nodes_equals_that_of_all(spark):
    import random

    from factweave.operators import graph

    rng = random.Random(3)
    names = [f"n{k:02d}" for k in range(30)]
    edges = [(u, p, v, rng.choice((0.5, 0.7, 0.9))) for u, v, p in ((rng.choice(names), rng.choice(names), rng.choice(("SUPPORTS", "DERIVED_FROM", "PART_OF"))) for _ in range(40))]
    edges += [(f"c{k}", "SUPPORTS", f"c{k + 1}", 0.95) for k in range(9)]  # longer than is searched back
    n = spark.createDataFrame([(d, x, f"p{(k + d) % 7}") for d in (1, 2) for k, x in enumerate(names + [f"c{k}" for k in range(10)])], "doc_id long, node_id string, prov_id string")
    prov = spark.createDataFrame([(d, f"p{k}", k / 10) for d in (1, 2) for k in range(6)], "doc_id long, prov_id string, confidence double")
    e = spark.createDataFrame([(d, *x) for d in (1, 2) for x in edges], "doc_id long, subject_id string, predicate string, object_id string, confidence double")
    made = spark.createDataFrame([(1, "n03", ["n04", "n05"], "ADD", 1.0), (1, "n06", ["n03", "gone"], "ADD", 1.0), (2, "c0", ["n01"], "ADD", 1.0)], "doc_id long, result_id string, operands array<string>, operator string, confidence double")
    every = {d is not None: {(r.doc_id, r.node_id): r.confidence for r in graph.confidence(n, prov, e, d).collect()} for d in (None, made)}
    for of, d in (([(1, "n03"), (2, "n07"), (1, "n06"), (1, "n06"), (1, "nobody"), (2, "c2")], made), ([(2, "c9"), (1, "n00")], None), ([(1, "c2"), (2, "c2")], None)):
        asked = spark.createDataFrame(of, "doc_id long, node_id string")
        if d is None:
            assert (graph.upstream(graph.supporting(e), asked) is None) == ((2, "c9") in of)
        got = [tuple(r) for r in graph.confidence_of(n, prov, e, asked, d).select("doc_id", "node_id", "confidence").collect()]
        assert sorted(got) == sorted((*k, every[d is not None][k]) for k in set(of) if k in every[d is not None])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_walks_both_ways_go_as_deep_as_the_others(spark):
    from collections import defaultdict, deque

    from factweave.plans.views import view

    got = {(r.doc_id, r.start, r.node_id): (r.depth, r.path) for r in __spark_entry__.queries()["traverse_both"](spark, SF).collect()}
    view(spark, SF, "kb_nodes")
    ways, nodes, want = defaultdict(list), {(r.doc_id, r.node_id): r.major for r in spark.table("kb_nodes").collect()}, {}
    for e in spark.table("kb_edges").collect():
        ways[e.doc_id, e.subject_id].append((0, e.predicate, e.object_id, e.object_id))
        ways[e.doc_id, e.object_id].append((1, e.subject_id, e.predicate, e.subject_id))
    for doc, start in (k for k, major in nodes.items() if major == 8):
        seen, queue = set(), deque([(start, [start])])
        while queue:
            at, path = queue.popleft()
            if at in seen:
                continue
            seen.add(at)
            if at != start and (doc, at) in nodes:
                want[doc, start, at] = (len(path) - 1, ">".join(path))
            if len(path) <= 3:
                queue.extend((dst, [*path, dst]) for *_, dst in sorted(ways[doc, at]))
    assert got == want
    # The third depth leads back from a customer to its other totals: most of what is reached, and none of it by ways out alone.
    assert sum(depth == 3 and node.startswith("07") for (_, _, node), (depth, _) in want.items()) > len(want) / 2


def test_walks_return_each_node_once_and_ends_without_a_node_never(spark):
    from factweave.operators import graph

    edges = [("a", "P", "b"), ("a", "Q", "b"), ("b", "P", "gone"), ("gone", "P", "c"), ("b", "P", "d"), ("d", "P", "last"), ("x", "P", "d")]
    e = spark.createDataFrame([(1, s, p, o) for s, p, o in edges], "doc_id long, subject_id string, predicate string, object_id string")
    n = spark.createDataFrame([(1, k) for k in "abbcdx"] + [(2, "last"), (1, None)], "doc_id long, node_id string")
    start = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, start string")
    walk = lambda *a: sorted((r.node_id, r.depth, r.path) for r in graph.traverse(n, e, start, None, *a).collect())
    out = [("b", 1, "a>b"), ("c", 3, "a>b>gone>c"), ("d", 2, "a>b>d")]
    assert walk(3, "out") == out and walk(9, "out") == out
    assert walk(3, "both") == [*out, ("x", 3, "a>b>d>x")]
    assert walk(1, "both") == out[:1] and walk(0, "both") == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_what_walks_reach_is_not_joined_with_the_nodes(spark):
    plan = __spark_entry__.queries()["traverse_both"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan and "Scan parquet" not in plan
