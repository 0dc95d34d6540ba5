"""Goldens of the text operators, by hand."""

import pytest
from pyspark.sql import functions as F

from factweave.functions.columns import coord_valid, distance, float_text, money_value, to_number
from factweave.operators import claims, derivation, extraction, graph, lexing, retrieval, space, versions
from factweave.plans.program import Program, compile_documents, compile_universal
from factweave.sources import adapters, detect


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def nodes(spark, text):
    rows = compile_documents(docs(spark, text)).nodes.orderBy("node_seq").collect()
    return [(r.node_id, r.label, r.value_num if r.value_kind != "str" else r.value_str, r.unit) for r in rows]


def test_money(spark):
    assert nodes(spark, "Revenue was $5 million in 2025.") == [("07-01-01-0001", "$5 million", 5e6, "USD")]


def test_money_percent_claim(spark):
    assert nodes(spark, "Total revenue was $500 million. Growth was 25%.") == [("07-01-01-0001", "$500 million", 5e8, "USD"), ("07-02-01-0001", "25%", 25.0, "%"), ("08-01-02-0001", "GROWTH claim", 0.25, None)]


def test_negation(spark):
    assert nodes(spark, "The company showed no growth this quarter.") == []
    assert nodes(spark, "The company showed strong growth this quarter.") == [("08-01-02-0001", "GROWTH claim", 0.25, None), ("08-02-01-0001", "POSITIVE sentiment", 1.0, None)]


def test_key_values(spark):
    assert nodes(spark, "Name: John\nAge: 30") == [("03-01-01-0001", "Name: John", "John", None), ("03-01-01-0002", "Age: 30", "30", None)]


def test_numbers_have_gaps_where_duplicates_were(spark):
    got = nodes(spark, "It cost $5 million.\n\nIt cost $5 million again.\n\nThen $7 million.")
    assert [n for n, *_ in got] == ["07-01-01-0001", "07-01-01-0003"]


def test_odd_money(spark):
    values = spark.createDataFrame([("$3",), ("$5 b",), ("$1,000.50",), ("$2K",), ("$2B",), ("$,",)], "m string").select("m", money_value(F.col("m")).alias("v")).collect()
    assert [r.v for r in values] == [3.0, None, 1000.5, 2000.0, 2e9, None]


def test_numbers_as_text(spark):
    got = spark.createDataFrame([(5e6,), (0.25,), (2.87e9,), (1e15,)], "v double").select(float_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == ["5000000.0", "0.25", "2870000000.0", "1000000000000000.0"]
    got = spark.createDataFrame([("1.0d",), ("1_000",), (" 7 ",), ("nan",), ("x",), (None,)], "t string").select(to_number(F.col("t")).alias("v")).collect()
    assert [None if r.v is None else str(r.v) for r in got] == [None, "1000.0", "7.0", "nan", None, None]


def test_locations_in_order(spark):
    rows = extraction.one_extractor(lexing.lex(docs(spark, "However, it rose; Denver, Colorado; Austin, TX")), extraction.locations, False).orderBy("pos").collect()
    assert [r.label for r in rows] == ["However, it", "Austin, TX", "Denver", "Austin"]


def test_chunk_types(spark):
    text = "| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx = 1\n```\n\nReferences\n\n[1] Smith A."
    got = [(r.chunk_type, r.tier, r.section) for r in lexing.lex(docs(spark, text)).orderBy("chunk_seq").collect()]
    assert got == [("TABLE", 0, None), ("CODE", 0, None), ("PROSE", 3, "references"), ("CITATION", 1, "references")]
    assert [r.chunk_type for r in lexing.lex(docs(spark, '{"a": 1}', "<xbrl/>", "<a/>", "", None)).orderBy("doc_id").collect()] == ["JSON", "XBRL", "XML"]


def test_offsets(spark):
    text = "  One two.\n \n Three\nfour. \n\n\nFive."
    for r in lexing.lex(docs(spark, text)).collect():
        assert text[r.start : r.end] == r.content


def test_detection_and_routes(spark):
    texts = ['{"@context": "x"}', '{"items": [{"a": 1}, {"a": 2}]}', '{"items": [{"a": 1}, {"b": 2}]}', "[1", "<a us-gaap='1'/>", "BEGIN:VCALENDAR", "## T", "plain", '{"resourceType": "Bundle"}']
    d = docs(spark, *texts).withColumn("kind", detect.detect(F.col("text")))
    got = [(r.kind, r.path) for r in d.withColumn("path", detect.route(F.col("kind"), F.col("text"))).orderBy("doc_id").collect()]
    assert got == [("SCHEMA_ORG", "ADAPTER"), ("JSON", "ADAPTER"), ("JSON", "COMPILER"), ("JSON", "COMPILER"), ("XBRL", "ADAPTER"), ("ICAL", "ADAPTER"), ("MARKDOWN", "COMPILER"), ("TEXT", "COMPILER"), ("FHIR", "ADAPTER")]


def test_adapters(spark):
    xbrl = "<r xmlns:g='g'><g:EarningsPerShare contextRef='c' unitRef='USDps'>8.25</g:EarningsPerShare></r>"
    ics = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:A\nEND:VEVENT\nBEGIN:VEVENT\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY;X=1:B:c\nEND:VEVENT\nEND:VCALENDAR"
    got = [(r.label, r.node_id, r.value_num) for r in compile_universal(docs(spark, xbrl.replace("<r", "<xbrl").replace("</r", "</xbrl"), ics)).orderBy("doc_id", "node_id").collect()]
    assert got == [("Earnings Per Share", "07-02-21-0001", 8.25), ("A", "06-01-01-0001", None), ("B:c", "06-01-01-0002", None)]
    leaves = adapters.json_leaves('{"b": {"price": 3}, "a": [{"city": "X"}, 5], "n": null, "t": true}')
    assert [(x[0], x[1], x[2], x[4], x[5]) for x in leaves] == [("b.price", 7, 1, "int", "3"), ("a[0].city", 5, 1, "str", "X"), ("t", 3, 1, "bool", "True")]
    feed = "<rss><item><title>T</title><description/></item></rss>"
    assert [r.label for r in adapters.feeds(docs(spark, feed, "not xml")).collect()] == ["T"]


def test_confidence_and_derivation(spark):
    n = spark.createDataFrame([(1, "profit", "p"), (1, "revenue", "p"), (1, "expense", "q")], "doc_id long, node_id string, prov_id string")
    prov = spark.createDataFrame([(1, "p", 0.9), (1, "q", 0.7)], "doc_id long, prov_id string, confidence double")
    e = spark.createDataFrame([(1, "revenue", "SUPPORTS", "profit", 0.85)], "doc_id long, subject_id string, predicate string, object_id string, confidence double")
    d = spark.createDataFrame([(1, "profit", ["revenue", "expense"], "SUBTRACT", 1.0)], "doc_id long, result_id string, operands array<string>, operator string, confidence double")
    assert {r.node_id: r.confidence for r in graph.confidence(n, prov, e, d).collect()} == {"profit": 0.9, "revenue": 0.9, "expense": 0.7}
    ops = spark.createDataFrame([(1, 1, 0, 500.0, 0.9), (1, 1, 1, 350.0, 0.7)], "doc_id long, key long, pos int, value double, confidence double")
    assert [tuple(r) for r in derivation.derive(ops, "SUBTRACT").select("value", "confidence").collect()] == [(150.0, 0.7)]
    with pytest.raises(ValueError):
        derivation.derive(ops, "POWER")
    zero = ops.withColumn("value", F.col("value") * F.when(F.col("pos") == 1, 0.0).otherwise(1.0))
    with pytest.raises(Exception, match="division by zero"):
        derivation.derive(zero, "DIVIDE").collect()


def test_confidence_on_a_cycle_ends(spark):
    n = spark.createDataFrame([(1, "a", "p"), (1, "b", "q")], "doc_id long, node_id string, prov_id string")
    prov = spark.createDataFrame([(1, "p", 0.9), (1, "q", 0.2)], "doc_id long, prov_id string, confidence double")
    e = spark.createDataFrame([(1, "a", "SUPPORTS", "b", 0.8), (1, "b", "SUPPORTS", "a", 1.0)], "doc_id long, subject_id string, predicate string, object_id string, confidence double")
    assert {r.node_id: r.confidence for r in graph.confidence(n, prov, e).collect()} == {"a": 0.9, "b": 0.8}


def test_paths(spark):
    e = spark.createDataFrame([(1, "a", "X", "b", 1.0), (1, "c", "X", "b", 1.0), (1, "c", "X", "d", 1.0)], "doc_id long, subject_id string, predicate string, object_id string, confidence double")
    pairs = spark.createDataFrame([(1, "a", "d"), (1, "a", "a"), (1, "a", "z")], "doc_id long, a string, b string")
    assert {(r.a, r.b, r.length, r.path) for r in graph.shortest_path(e, pairs).collect()} == {("a", "d", 3, "a>b>c>d"), ("a", "a", 0, "a")}
    n = spark.createDataFrame([(1, x) for x in "abd"], "doc_id long, node_id string")
    got = graph.traverse(n, e, spark.createDataFrame([(1, "a")], "doc_id long, start string"), None, 3, "both").collect()
    assert {(r.node_id, r.depth) for r in got} == {("b", 1), ("d", 3)}  # c is walked through


def test_value_filters(spark):
    n = spark.createDataFrame([(1, "a", 1.0), (1, "b", float("nan")), (1, "c", None)], "doc_id long, label string, value_num double")
    assert {r.label for r in space.where(n, value_gt=5.0).collect()} == {"b"}
    assert {r.label for r in space.where(n, value_lt=5.0).collect()} == {"a", "b"}
    assert space.where(n).count() == 3


def test_incremental(spark):
    old = lexing.lex(docs(spark, "One is $1 million.\n\nTwo is $2 million.\n\nThree is $3 million."))
    new = lexing.lex(docs(spark, "One is $1 million.\n\nTwo is $9 million.\n\nThree is $3 million."))
    plan = versions.plan(old, new)
    assert sorted((r.chunk_id, r.action) for r in plan.collect()) == [("chunk_000001", "reuse"), ("chunk_000002", "recompile"), ("chunk_000002", "remove"), ("chunk_000003", "reuse")]
    assert versions.efficiency(plan).first().efficiency == 0.5
    from factweave.operators import emission

    got = versions.recompile(plan, emission.nodes(extraction.extract(old)), new).orderBy("node_id").collect()
    assert [(r.node_id, r.label, r.origin) for r in got] == [("07-01-01-0001", "$1 million", "reused"), ("07-01-01-0003", "$3 million", "reused"), ("07-01-01-0004", "$9 million", "compiled")]


def test_round_trip(spark, tmp_path):
    p = compile_documents(docs(spark, "Total revenue was $500 million. Growth was 25%.", "Name: John\nAge: 30"))
    p.write(f"{tmp_path}/p")
    back = Program.load(spark, f"{tmp_path}/p")
    assert sorted(map(str, back.nodes.select(*p.nodes.columns).collect())) == sorted(map(str, p.nodes.collect()))
    p.export(f"{tmp_path}/a")
    Program.read_export(spark, f"{tmp_path}/a", p.nodes.schema, p.provenance.schema).export(f"{tmp_path}/b")
    read = lambda x: spark.read.text(f"{tmp_path}/{x}/nodes.jsonl").collect()
    assert read("a") == read("b")
    with pytest.raises(FileNotFoundError):
        Program.load(spark, f"{tmp_path}/none")


def test_retries():
    asked, slept = [], []

    def flaky(prompt):
        asked.append(prompt)
        if len(asked) == 1:
            raise OSError("down")
        return [{"no": 1}] if len(asked) == 2 else [{"subject": "s"}]

    assert claims.with_retries(flaky, "p", sleep=slept.append) == ([{"subject": "s"}], 3, "")
    assert slept == [1.0]
    assert claims.parse_response('```json\n[{"subject": "a"}]\n```') == [{"subject": "a"}]
    assert claims.parse_response("none") == []


def test_mock_model(spark):
    r = claims.requests(lexing.lex(docs(spark, "Total revenue was $5 million. Net income saw 12% growth this time around here. Nothing else was said in this long text of words.")))
    assert [(x.subject, x.object) for x in claims.mock_claims(r).orderBy("pos").collect()] == [("total_revenue", "$5 million"), ("net_income_growth", "12%")]


def test_questions(spark):
    q = spark.createDataFrame([("How much revenue did ACME make?",), ("Tell me",)], "q string").select(retrieval.question_type(F.col("q")).alias("t"), retrieval.keywords(F.col("q")).alias("k")).collect()
    assert [(r.t, r.k) for r in q] == [(7, ["much", "revenue", "acme", "make"]), (None, [])]


def test_coordinates(spark):
    row = spark.range(1).select(coord_valid(F.lit(9), F.lit(1), F.lit(1), F.lit(1)).alias("a"), coord_valid(F.lit(1), F.lit(100), F.lit(1), F.lit(1)).alias("b"), distance([F.lit(1)] * 4, [F.lit(2), F.lit(1), F.lit(1), F.lit(1)]).alias("d")).first()
    assert (row.a, row.b, row.d) == (False, False, 1.0)


def test_stream(spark, tmp_path):
    from factweave.streaming.compile_stream import start

    docs(spark, "It cost $5 million.").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    start(stream, f"{tmp_path}/store", f"{tmp_path}/cp", once=True).awaitTermination()
    docs(spark, "It cost $5 million.\n\nThen $6 million.").write.mode("append").parquet(f"{tmp_path}/in")
    start(stream, f"{tmp_path}/store", f"{tmp_path}/cp", once=True).awaitTermination()
    assert sorted(r.label for r in spark.read.parquet(f"{tmp_path}/store/nodes").collect()) == ["$5 million", "$6 million"]


def test_doubles_as_python_writes_them(spark):
    values = [12345678.5, 1234567.25, 0.001, 0.0001, 0.00012, 0.00001, 1.5e-7, 1e16, 1.5e16, 9007199254740993.0, 123456789012345.6, 1e22, 1.7976931348623157e308, 5e-324, -12345678.5, 0.0, -0.0, float("nan"), float("inf"), 1e-4 + 1e-12]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", float_text(F.col("v")).alias("t")).collect()
    said = {r.k: r.t for r in got}
    assert [float(said[k]) for k, v in enumerate(values) if v == v] == [v for v in values if v == v]
    # Java writes the least subnormal with one digit more than Python does.
    assert [said[k] for k in range(len(values)) if values[k] != 5e-324] == [repr(v) for v in values if v != 5e-324]


def test_cents_above_ten_million(spark):
    assert nodes(spark, "It was $12,345,678.50 then.") == [("07-01-01-0001", "$12,345,678.50", 12345678.5, "USD")]
    assert compile_documents(docs(spark, "It was $12,345,678.50 then.")).nodes.first().value_str == "12345678.5"


def test_long_digits_and_deep_nesting_do_not_stop_a_compile(spark):
    long = "The lease runs " + "9" * 45 + " years and 007 days from now, as everybody in the room has heard it said by now."
    got = nodes(spark, long + " " + "word " * 20)
    assert ("9" * 45 + " years", float("9" * 45)) in [(x[1], x[2]) for x in got] and "7 days" in [x[1] for x in got]
    assert adapters.json_leaves("[" * 100_000) == [] and adapters.json_leaves('{"a":' * 50_000) == []


def test_quantities_need_their_own_extractors_alone(spark):
    text = "Revenue: $5 million\nMargin: 5%\n\n- $5 million\n\nTotal revenue was $5 million, 3.5x and 12% growth over 5 years with Jane Smith of Acme Holdings Corp in Denver, CO, as everybody in the large room had been told before. It rose 12% again."
    chunks = lexing.lex(docs(spark, text))
    from factweave.operators import emission

    columns = ["doc_id", "node_id", "label", "value_num", "unit", "prov_id"]
    whole = emission.nodes(extraction.extract(chunks))
    for majors in ((7,), (3, 8)):
        some = emission.nodes(extraction.extract(chunks, majors=majors))
        want, got = (sorted(map(tuple, x.where(F.col("major").isin(*majors)).select(*columns).collect()), key=str) for x in (whole, some))
        assert got == want and want
    assert len(extraction.needed((7,))) == 3


def test_operands_by_id_or_label(spark):
    n = spark.createDataFrame([(1, "a", "Total Revenue", 500.0, 1), (1, "b", "revenue of parts", 100.0, 2), (1, "c", "no number", None, 3)], "doc_id long, node_id string, label string, value_num double, node_seq long")
    conf = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.7), (1, "c", 1.0)], "doc_id long, node_id string, confidence double")
    refs = lambda *r: spark.createDataFrame([(1, 0, k, x) for k, x in enumerate(r)], "doc_id long, key int, pos int, ref string")
    assert [tuple(r) for r in derivation.derive_by_label(n, conf, refs("REVENUE", "b"), "SUBTRACT").select("value", "confidence", "operands").collect()] == [(400.0, 0.7, "a,b")]
    for bad, why in (("nothing", "not found"), ("no num", "not numeric")):
        with pytest.raises(Exception, match=why):
            derivation.derive_by_label(n, conf, refs("a", bad), "ADD").collect()


def test_paths_follow_the_ways_by_rank(spark):
    edges = [("a", "B", "x"), ("a", "A", "y"), ("x", "A", "z"), ("y", "A", "z"), ("w", "A", "a"), ("w", "A", "z")]
    e = spark.createDataFrame([(1, s, p, o, 1.0) for s, p, o in edges], "doc_id long, subject_id string, predicate string, object_id string, confidence double")
    got = graph.shortest_path(e, spark.createDataFrame([(1, "a", "z")], "doc_id long, a string, b string")).first()
    assert (got.length, got.path) == (2, "a>y>z")  # the edge with the lesser predicate comes first
    n = spark.createDataFrame([(1, x) for x in "axyzw"], "doc_id long, node_id string")
    start = spark.createDataFrame([(1, "a")], "doc_id long, start string")
    walk = lambda *a: {(r.node_id, r.depth, r.path) for r in graph.traverse(n, e, start, *a).collect()}
    assert walk(None, 3, "out") == {("x", 1, "a>x"), ("y", 1, "a>y"), ("z", 2, "a>y>z")}
    assert walk("A", 1, "in") == {("w", 1, "a>w")} and walk("B", 3, "out") == {("x", 1, "a>x")}


def test_confidence_spreads_along_a_long_chain(spark):
    n = spark.createDataFrame([(1, f"n{k:03d}", "p" if k == 0 else "q") for k in range(12)], "doc_id long, node_id string, prov_id string")
    prov = spark.createDataFrame([(1, "p", 0.9), (1, "q", 0.1)], "doc_id long, prov_id string, confidence double")
    e = spark.createDataFrame([(1, f"n{k:03d}", "SUPPORTS", f"n{k + 1:03d}", 0.95) for k in range(11)], "doc_id long, subject_id string, predicate string, object_id string, confidence double")
    assert {r.confidence for r in graph.confidence(n, prov, e).collect()} == {0.9}
    with pytest.raises(RuntimeError):
        graph.confidence(n, prov, e, max_rounds=5)


def test_claims_of_a_model_join_the_program(spark):
    text = "Total revenue was $5 million this year as the whole company had hoped. " * 2 + "Net income saw 12% growth in the same time for reasons that nobody knows. Expenses were $7 million."
    p = compile_documents(docs(spark, text), executor=claims.mock_claims)
    new = {(r.node_id, r.label, r.prov_id, r.chunk_id) for r in p.nodes.where("prov_id like 'prov_llm%'").collect()}
    # Twice the same claim is one node with two edges; values that the text holds are its nodes.
    assert new == {("08-01-01-0001", "total_revenue: $5 million", "prov_llm_llm_000001_0", "llm_000001"), ("08-01-01-0003", "net_income_growth: 12%", "prov_llm_llm_000001_2", "llm_000001"), ("08-01-01-0004", "expenses: $7 million", "prov_llm_llm_000001_3", "llm_000001")}
    edges = sorted((r.subject_id, r.predicate, r.object_id, r.prov_id) for r in p.relations.collect())
    assert [e[:3] for e in edges] == [("08-01-01-0001", "HAS_VALUE", "07-01-01-0001")] * 2 + [("08-01-01-0003", "HAS_VALUE", "07-02-01-0001"), ("08-01-01-0004", "HAS_VALUE", "07-01-01-0003")]
    from factweave.operators import emission

    assert emission.integrity_violations(p.nodes, p.provenance, p.relations).count() == 0
    assert p.provenance.where("tier = 3 and extractor = 'tier3:llm'").count() == 4


def test_a_plugged_in_model(spark):
    def call(prompt):
        return [{"subject": "s", "object": "$3 million", "confidence": "high"}, {"subject": "t"}]

    p = compile_documents(docs(spark, "word " * 40), executor=lambda r: claims.execute(r, call))
    assert {(r.node_id, r.label, r.value_num) for r in p.nodes.collect()} == {("08-01-01-0001", "s: $3 million", None), ("08-01-01-0002", "t: ", None), ("07-01-01-0001", "$3 million", 3e6)}
    assert [(r.subject_id, r.object_id) for r in p.relations.collect()] == [("08-01-01-0001", "07-01-01-0001")]
    assert {r.confidence for r in p.provenance.where("extractor = 'tier3:llm'").collect()} == {0.7}


def test_exports_are_checked(spark, tmp_path):
    text = "Total revenue was $5 million this year as the whole company had hoped and planned for since long ago, when nobody else did."
    p = compile_documents(docs(spark, text), executor=claims.mock_claims)
    p.export(f"{tmp_path}/a")
    back = Program.read_export(spark, f"{tmp_path}/a", p.nodes.schema, p.provenance.schema)
    assert back.relations.count() == 1 and sorted(map(str, back.nodes.collect())) == sorted(map(str, p.nodes.collect()))
    assert [r.hash for r in back.content_hash().collect()] == [r.hash for r in p.content_hash().collect()]
    assert p.stats().first().asDict() == {"doc_id": 0, "nodes": 2, "chunks": 2, "relations": 1, "tiers": {3: 2}}
    (part,) = (tmp_path / "a" / "nodes.jsonl").glob("part-*")
    lines = part.read_text().splitlines()
    part.write_text("\n".join([lines[0], "", lines[1].replace("$5 million", "again"), lines[1]]) + "\n")
    (tmp_path / "a" / "nodes.jsonl" / f".{part.name}.crc").unlink()
    assert "again" not in str(Program.read_export(spark, f"{tmp_path}/a", p.nodes.schema, p.provenance.schema).nodes.collect())
    part.write_text("\n".join([*lines, "not json"]) + "\n")
    with pytest.raises(ValueError, match="nodes at line 3"):
        Program.read_export(spark, f"{tmp_path}/a", p.nodes.schema, p.provenance.schema)
    with pytest.raises(FileNotFoundError):
        Program.read_export(spark, f"{tmp_path}/none", p.nodes.schema, p.provenance.schema)


def test_alignments_are_checked(spark):
    from factweave.operators import emission

    chunks = lexing.lex(docs(spark, "Date: 2024-01-15\nCost: $5 million"))
    n, prov = emission.nodes(extraction.extract(chunks)), emission.provenance(chunks)
    found = derivation.temporal_align(n, prov)
    assert space.alignments(found, "07-01-01-0001").count() == 1 and emission.integrity_violations(n, prov, spark.createDataFrame([], "doc_id long, subject_id string, object_id string, prov_id string"), None, found).count() == 0
    assert emission.integrity_violations(n.where("major <> 7"), prov, spark.createDataFrame([], "doc_id long, subject_id string, object_id string, prov_id string"), None, found).count() == 1
    with pytest.raises(ValueError):
        derivation.temporal_align(n, prov, "NEAR")


def test_command_line(spark, tmp_path):
    from factweave import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("Total revenue was $500 million. Growth was 25%.")
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "one.txt").write_text("Total revenue was $600 million. Growth was 25%.")
    assert cli.run(spark, ["compile", f"{tmp_path}/in", f"{tmp_path}/p"]) is None
    docs(spark, "Cost: $1 million").write.parquet(f"{tmp_path}/d.parquet")
    cli.run(spark, ["compile", f"{tmp_path}/d.parquet", f"{tmp_path}/q", "--mock-model"])
    assert [r.label for r in cli.run(spark, ["query", f"{tmp_path}/p", "--major", "7", "--gt", "100"]).collect()] == ["$500 million"]
    assert {r.name: r.n for r in cli.run(spark, ["info", f"{tmp_path}/p"]).collect()} == {"nodes": 3, "provenance": 1}
    assert cli.run(spark, ["stats", f"{tmp_path}/p"]).where("major = 7").first().n == 2
    assert "$500 million" in cli.run(spark, ["ask", f"{tmp_path}/p", "How", "much", "revenue?"]).first().context
    assert cli.run(spark, ["diff", f"{tmp_path}/p", f"{tmp_path}/q"]).count() > 0
    done = cli.run(spark, ["compile", f"{tmp_path}/new", f"{tmp_path}/p2", "--previous", f"{tmp_path}/p"])
    again = cli.run(spark, ["compile", f"{tmp_path}/new", f"{tmp_path}/p3", "--previous", f"{tmp_path}/p2"])
    assert done.count() == 2 - (cli.documents(spark, f"{tmp_path}/in").first().doc_id == cli.documents(spark, f"{tmp_path}/new").first().doc_id)
    assert [r.efficiency for r in again.collect()] == [1.0]
    labels = lambda p: sorted(r.label for r in cli.run(spark, ["query", f"{tmp_path}/{p}"]).collect())
    assert labels("p2") == labels("p3") and "$600 million" in labels("p3")
    assert {(r.name, r["rank"]) for r in cli.run(spark, ["inspect", f"{tmp_path}/p", "--samples", "1"]).collect()} == {(r.name, 1) for r in cli.run(spark, ["stats", f"{tmp_path}/p"]).where("n > 0").collect()}
    (summary,) = cli.run(spark, ["derive", f"{tmp_path}/p", "confidence", "--into", f"{tmp_path}/d"]).collect()
    assert (summary.node_id, summary.n) == ("08-90-01-0001", 3)
    assert {r.name: r.n for r in cli.run(spark, ["info", f"{tmp_path}/d"]).collect()} == {"nodes": 4, "provenance": 2, "derivations": 1}
    assert cli.run(spark, ["derive", f"{tmp_path}/p", "temporal"]).count() == 0
    cli.run(spark, ["export", f"{tmp_path}/p", f"{tmp_path}/x"])
    assert (tmp_path / "x" / "manifest.json").exists()


def test_files_and_strings_as_sources(spark, tmp_path):
    from factweave.sources import files

    (tmp_path / "a.txt").write_bytes("Café costs $5 million.".encode("latin-1"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.json").write_text('{"a": 1}')
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.kind) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("Café costs $5 million.", "TEXT"), "b.pdf": ("[PDF: b.pdf - no reader installed]", "PDF"), "c.json": ('{"a": 1}', "JSON")}
    with pytest.raises(ValueError, match="too large"):
        files.read_documents(spark, str(tmp_path), max_bytes=10)
    assert files.read_documents(spark, str(tmp_path), max_bytes=10, skip_large=True).count() == 2
    for bad in ("x" * 5000, "/a/../b"):
        with pytest.raises(ValueError):
            files.read_documents(spark, bad)
    one = files.load_source(spark, f"file://{tmp_path}/a.txt").first()
    assert (one.text, one.kind, one.size_bytes) == ("Café costs $5 million.", "TEXT", 22) and one.uri.endswith("/a.txt")
    text = files.load_source(spark, "Revenue was $5 million.\n").first()
    assert text.uri.startswith("string://") and text.kind == "TEXT" and text.size_bytes == 24
    assert files.load_source(spark, str(tmp_path / "a.txt"), "string").first().text == str(tmp_path / "a.txt")
    for bad in ((str(tmp_path), "file"), ("x", "url")):
        with pytest.raises(ValueError):
            files.load_source(spark, *bad)


def test_too_many_instances_are_an_error(spark):
    from factweave.operators import emission

    many = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("ext_seq"), F.lit("Money").alias("entity_type"), F.lit(7).alias("major"), F.lit(1).alias("type"), F.lit(1).alias("subtype"))
    assert emission.assign_coords(many.where("ext_seq < 9999")).agg(F.max("instance")).first()[0] == 9999
    with pytest.raises(Exception, match="more than 9999"):
        emission.assign_coords(many).collect()
