"""What lets one large document or key fill many tasks, against the plain forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import derivation, emission, extraction, graph, lexing, retrieval, search, versions
from factweave.operators.scans import scan
from factweave.plans.program import Program, compile_documents
from factweave.sources import adapters, table_functions
from factweave.streaming import compile_stream

LONG = "\n\n".join(f"# Part {k}\n\nIt cost ${k} million.\n\n \n\nThen 5% and ${k} million." if k % 3 else f"Words of part {k} that go on." for k in range(60))


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_scans_of_one_key_with_all_rows(spark, size):
    rng = random.Random(size)
    values = [(1, k, rng.choice([None, 1, 2, 5]), rng.choice([None, None, "a", "b"])) for k in range(300)] + [(2, 5, 3, None), (None, 1, 1, "x")]
    df = spark.createDataFrame(values, "key long, place long, n int, head string")
    got = scan(df.repartition(5), ["key"], "place", size, {"before": F.col("n")}, {"last": F.col("head")}).where("key = 1").orderBy("place").collect()
    total, last = 0, None
    assert len(got) == 300
    for r in got:
        last = r.head or last
        assert (r.before, r["last"]) == (total, last)
        total += r.n or 0


def test_segments_give_the_same_chunks_and_coordinates(spark):
    d = docs(spark, LONG, "", "{\"a\": 1}", "One. \n\n Two $3 million.", None)
    plain, cut = lexing.lex(d), lexing.lex(d, segment=3)
    assert rows(cut.select(*plain.columns)) == rows(plain)
    ext = extraction.extract(plain)
    assert rows(extraction.extract(cut, segment=2).select(*ext.columns)) == rows(ext)
    numbered = emission.assign_coords(ext)
    assert rows(emission.assign_coords(ext, segment=2).select(*numbered.columns)) == rows(numbered)
    assert numbered.count() > 60


def test_words_are_found_in_texts_like_by_looking_at_all(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcé 😀") for _ in range(n))
    texts = [(k % 3, word(rng.randint(0, 12))) for k in range(200)] + [(0, None)]
    words = [(k % 3, word(rng.randint(0, 4))) for k in range(40)]
    df = search.holding(search.index(spark.createDataFrame(texts, "key int, text string"), ["key"], "text"), spark.createDataFrame(words, "key int, word string"), ["key"], "text", "word")
    assert {tuple(r) for r in df.collect()} == {(k, w, t) for k, w in words for j, t in texts if w and t is not None and j == k and w in t}
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()


def test_retrieval_and_operands_need_no_nested_loop(spark):
    n = spark.createDataFrame([(1, "07-01-01-0001", 7, "Revenue", 5.0, "h1", 0), (1, "01-01-01-0001", 1, "Acme revenue", None, "h2", 1), (1, "07-01-01-0002", 7, "Cost", 2.0, "h3", 2)], "doc_id long, node_id string, major int, label string, value_num double, content_hash string, seq long")
    asked = spark.createDataFrame([(1, "How much revenue?"), (2, "nothing fits"), (3, "")], "question_id int, question string")
    found = retrieval.retrieve(n, asked)
    again = retrieval.retrieve(n, asked, postings=retrieval.label_postings(n))
    assert rows(found) == rows(again) and [(r.node_id, r.relevance) for r in found.where("question_id = 1").orderBy("rank").collect()] == [("01-01-01-0001", 1.0), ("07-01-01-0001", 0.8), ("07-01-01-0002", 0.8)]
    assert found.where("question_id > 1").count() == 0
    refs = spark.createDataFrame([(1, 0, 0, "REVENUE"), (1, 0, 1, "st"), (1, 1, 0, "")], "doc_id long, key int, pos int, ref string")
    resolved = derivation.resolve(n.withColumnRenamed("seq", "node_seq"), refs)
    assert sorted((r.key, r.pos, r.node_id) for r in resolved.collect()) == [(0, 0, "07-01-01-0001"), (0, 1, "07-01-01-0002"), (1, 0, "07-01-01-0001")]
    for df in (found, resolved):
        assert "NestedLoop" not in df._jdf.queryExecution().toString()


def test_hashes_do_not_hang_on_partitions(spark):
    p = compile_documents(docs(spark, LONG, "It cost $5 million."))
    nodes = p.nodes.persist()
    one, many = (Program(nodes.repartition(n), p.provenance) for n in (1, 64))
    assert rows(one.content_hash()) == rows(many.content_hash()) and one.root_hash().first() == many.root_hash().first()
    changed = Program(nodes.where("node_id <> '07-01-01-0001' or doc_id = 1"), p.provenance)
    differ = set(rows(changed.range_digests())) ^ set(rows(one.range_digests()))
    assert len(differ) == 2 and all("07-01" in r for r in differ)
    assert changed.root_hash().first().root != one.root_hash().first().root


def test_exports_in_parts(spark, tmp_path):
    p = compile_documents(docs(spark, *[LONG] * 3))
    nodes = p.nodes.persist()
    Program(nodes, p.provenance).write(f"{tmp_path}/p")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        Program(nodes, p.provenance).export(f"{tmp_path}/x")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = sorted((tmp_path / "x" / "nodes.jsonl").glob("part-*"))
    lines = [json.loads(x) for f in parts for x in f.read_text().splitlines()]
    assert len(parts) > 1 and [(x["doc_id"], x["node_id"]) for x in lines] == sorted((r.doc_id, r.node_id) for r in nodes.collect())
    said = json.loads(next((tmp_path / "x" / "manifest.json").glob("part-*")).read_text())
    assert said["counts"]["nodes"] == len(lines) == sum(said["parts"]["nodes"]) and said["root"] == Program(nodes, p.provenance).root_hash().first().root
    read = lambda: Program.read_export(spark, f"{tmp_path}/x", nodes.schema, p.provenance.schema)
    assert rows(read().nodes.select(*nodes.columns)) == rows(nodes)
    last = parts[-1]
    (last.parent / f".{last.name}.crc").unlink()
    whole = last.read_text()
    last.write_text(whole + "not json\n")
    with pytest.raises(ValueError, match=f"nodes at line {len(lines) + 1}"):
        read()
    last.write_text("\n".join(whole.splitlines()[1:]) + "\n")
    with pytest.raises(ValueError, match="the manifest counts"):
        read()


def test_streams_keep_versions(spark, tmp_path):
    one, two, four, five, six = (f"It cost ${k} million." for k in (1, 2, 4, 5, 6))
    versions_ = ["\n\n".join(x) for x in ((one, two), (two, four, five), (six, two, one))]
    labels = lambda text: {r.label for r in compile_documents(docs(spark, text)).nodes.collect()}
    kept = None
    for k, text in enumerate(versions_):
        for _ in range(2):  # a batch that runs again replaces its own output
            compile_stream.compile_batch(docs(spark, text, *(["It was $9 million."] if k == 0 else [])), k, f"{tmp_path}/s")
        now = compile_stream.current_nodes(spark, f"{tmp_path}/s").where("doc_id = 0").collect()
        assert {r.label for r in now} == labels(text) and len({r.node_id for r in now}) == len(now) == len(text.split("\n\n"))
        ids = {r.label: r.node_id for r in now}
        assert kept is None or ids["$2 million"] == kept["$2 million"]
        kept = ids
        assert {r.value_num for r in now} >= {2e6}
    assert compile_stream.current_nodes(spark, f"{tmp_path}/s").where("doc_id = 1").count() == 1
    compile_stream.compile_batch(docs(spark, ""), 3, f"{tmp_path}/s")
    assert compile_stream.current_nodes(spark, f"{tmp_path}/s").where("doc_id = 0").count() == 0


def test_merged_nodes_find_their_provenance(spark):
    programs = [(p.nodes, p.provenance) for p in (compile_documents(docs(spark, t)) for t in ("It cost $1 million.\n\nIt fell 5%.", "It cost $1 million.\n\nIt cost $3 million."))]
    merged, prov = versions.merge(programs), versions.merge_provenance(programs)
    assert merged.join(prov, ["doc_id", "prov_id"], "left_anti").count() == 0 and prov.count() == 4
    with pytest.raises(ValueError):
        versions.merge_provenance([])


def test_neighbours_come_in_order(spark):
    n = spark.createDataFrame([(1, f"05-01-01-{k:04d}", 5, 1, 1, k, 10 - k) for k in range(1, 6)], "doc_id long, node_id string, major int, type int, subtype int, instance int, node_seq long")
    got = graph.ranked_neighbours(n, n.where("instance = 3"), 0.5).orderBy("rank").collect()
    assert [r.node_id[-1] for r in got] == ["3", "4", "2"] and [r["rank"] for r in got] == [1, 2, 3]


def test_derivations_by_name(spark):
    p = compile_documents(docs(spark, "It cost $1 million on 2024-01-02."))
    assert derivation.run("temporal", p.nodes, p.provenance).count() >= 0
    summaries, made = derivation.run("confidence", p.nodes, p.provenance)
    assert summaries.count() == made.count() == 1
    with pytest.raises(ValueError, match="known: confidence, temporal"):
        derivation.run("other", p.nodes, p.provenance)


def brute_confidence(base, edges, derivations):
    """The least fixed point, round by round."""
    c = dict(base)
    while True:
        new = dict(c)
        for u, v, own in edges:
            if u in c and v in c:
                new[v] = max(new[v], min(c[u], own))
        for v, operands, own in derivations:
            if v in c:
                new[v] = max(new[v], min([c.get(o, 0.0) for o in operands] + [own]))
        if new == c:
            return c
        c = new


@pytest.mark.parametrize("seed", [1])
def test_confidence_on_chains_rings_and_forks(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k:03d}" for k in range(160)]
    base = {n: rng.choice([0.05, 0.1, 0.2]) for n in names} | {"n000": 0.9, "n100": 0.8}
    edges = [(names[k], names[k + 1], 0.99 - k / 1000) for k in range(59)]  # a chain
    edges += [(names[100 + k], names[100 + (k + 1) % 20], 0.7 + k / 100) for k in range(20)]  # a ring
    edges += [(names[60 + k], names[61 + k], 0.9) for k in range(30)] + [(names[50], names[60], 0.93), (names[105], names[75], 0.85), ("gone", names[60], 1.0), (names[3], "lost", 1.0), (names[5], names[5], 1.0)]
    edges += [(rng.choice(names), rng.choice(names[120:]), rng.random()) for _ in range(30)] + [(names[0], names[1], 0.3)]
    made = [(names[130], [names[59], names[90]], 0.95), (names[40], [names[39]], 0.95), (names[131], [names[2], "gone"], 0.95)]
    n = spark.createDataFrame([(1, x, x) for x in names], "doc_id long, node_id string, prov_id string")
    prov = spark.createDataFrame([(1, x, c) for x, c in base.items()], "doc_id long, prov_id string, confidence double")
    e = spark.createDataFrame([(1, u, "SUPPORTS", v, c) for u, v, c in edges], "doc_id long, subject_id string, predicate string, object_id string, confidence double")
    d = spark.createDataFrame([(1, v, o, "SUBTRACT", 1.0) for v, o, _ in made], "doc_id long, result_id string, operands array<string>, operator string, confidence double")
    for derivations in (None, d):
        got = {r.node_id: r.confidence for r in graph.confidence(n, prov, e, derivations, max_rounds=40).collect()}
        assert got == pytest.approx(brute_confidence(base, edges, made if derivations is not None else []))


def test_a_chain_takes_as_many_rounds_as_its_length_has_bits(spark):
    size = 2000
    n = spark.range(size).select(F.lit(1).cast("long").alias("doc_id"), F.format_string("%05d", "id").alias("node_id"), F.when(F.col("id") == 0, "p").otherwise("q").alias("prov_id"))
    prov = spark.createDataFrame([(1, "p", 0.9), (1, "q", 0.1)], "doc_id long, prov_id string, confidence double")
    e = spark.range(size - 1).select(F.lit(1).cast("long").alias("doc_id"), F.format_string("%05d", "id").alias("subject_id"), F.lit("SUPPORTS").alias("predicate"), F.format_string("%05d", F.col("id") + 1).alias("object_id"), F.lit(0.95).alias("confidence"))
    got = graph.confidence(n, prov, e, max_rounds=graph.SHALLOW + 13)
    assert [tuple(r) for r in got.groupBy("confidence").count().collect()] == [(0.9, size)]


@pytest.mark.parametrize("radius,weights", [(1.5, (1.0, 0.5, 0.3, 0.1)), (0.0, (1.0, 0.5, 0.3, 0.1)), (2.0, (1.0, 0.0, 0.3, 0.1)), (-1.0, (1.0, 0.5, 0.3, 0.1))])
def test_neighbours_of_all_points(spark, radius, weights):
    rng = random.Random(3)
    points = sorted({(rng.randint(1, 8), rng.randint(0, 4), rng.randint(0, 3), rng.randint(1, 30)) for _ in range(250)})
    n = spark.createDataFrame([(1, "-".join(map(str, p)), *p) for p in points], "doc_id long, node_id string, major int, type int, subtype int, instance int")
    found = graph.neighbours(n, n, radius, weights)
    near = lambda a, b: sum(w * (x - y) ** 2 for w, x, y in zip(weights, a, b, strict=True)) ** 0.5 <= radius
    want = sorted(("-".join(map(str, p)), "-".join(map(str, q))) for p in points for q in points if near(p, q))
    assert sorted((r.point, r.node_id) for r in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_stored_programs_are_joined_as_they_lie(spark, tmp_path):
    nodes = compile_documents(docs(spark, *[LONG] * 3)).nodes.persist()
    edges = nodes.select("doc_id", F.col("node_id").alias("subject_id"), F.lit("P").alias("predicate"), F.lit("07-01-01-0001").alias("object_id"), "prov_id", F.lit(1.0).alias("confidence"))
    p = Program(nodes, compile_documents(docs(spark, LONG)).provenance, edges)
    p.store(f"{tmp_path}/a", "stored_a", 3)
    p.store(f"{tmp_path}/b", "stored_b", 3)
    for name in ("nodes", "provenance", "relations"):  # as in a session that never saw them; the files stay
        spark.sql(f"DROP TABLE stored_b_{name}")
    a, b = Program.stored(spark, f"{tmp_path}/a", "stored_a", 3), Program.stored(spark, f"{tmp_path}/b", "stored_b", 3)
    assert rows(b.nodes.select(*nodes.columns)) == rows(nodes)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = a.nodes.select("doc_id", "node_id").join(b.nodes.select("doc_id", "node_id", "label"), ["doc_id", "node_id"])
        ends = a.nodes.join(a.relations.withColumnRenamed("subject_id", "node_id").select("doc_id", "node_id", "predicate"), ["doc_id", "node_id"])
        for df in (both, ends):
            assert df.count() == nodes.count() and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = a.nodes.where("node_id = '07-01-01-0003'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(node_id,07-01-01-0003)" in plan
    with pytest.raises(FileNotFoundError):
        Program.stored(spark, f"{tmp_path}/none", "stored_none", 3)


def test_readers_as_table_functions(spark):
    table_functions.register(spark)
    xbrl = "<xbrl><Revenues contextRef='c' unitRef='usd'>1,250</Revenues><Note contextRef='c'>x</Note></xbrl>"
    d = docs(spark, '{"a": {"price": 3}, "b": [1, {"name": "x"}]}', "", "[1", None, xbrl)
    d.createOrReplaceTempView("table_function_docs")
    for name, plain in (("json_flatten", adapters.json_flatten(d)), ("xbrl_facts", adapters.xbrl(d)), ("feed_items", adapters.feeds(d))):
        got = spark.sql(f"SELECT doc_id, f.* FROM table_function_docs, LATERAL {name}(text) f").select(*plain.columns)
        assert rows(got) == rows(plain)
    assert spark.sql("SELECT count(*) FROM table_function_docs, LATERAL json_flatten(text) f").first()[0] == 2
    numbers = [5e6, 0.25, 2.87e9, 1e15, 1e16, 1.5e-7, 1e-4, 3.0, float("inf"), float("-inf"), float("nan"), None, 1e100, -2.5e20]
    got = spark.createDataFrame([(v,) for v in numbers], "v double").selectExpr("py_str(v)").collect()
    assert [r[0] for r in got] == [None if v is None else str(v) for v in numbers]
