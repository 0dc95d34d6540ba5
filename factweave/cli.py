"""Command line: compile texts to a program, and ask programs.

    python -m factweave.cli compile INPUT PROGRAM     documents (Parquet with doc_id and text, or a folder of text files)
    python -m factweave.cli compile INPUT PROGRAM --previous OLD     chunks that OLD has are not compiled again
    python -m factweave.cli info|stats|inspect PROGRAM
    python -m factweave.cli derive PROGRAM temporal|confidence [--into NEW]
    python -m factweave.cli query PROGRAM [--major N] [--label TEXT] [--gt X] [--lt X] [--limit N]
    python -m factweave.cli diff OLD NEW
    python -m factweave.cli export PROGRAM FOLDER
    python -m factweave.cli ask PROGRAM QUESTION...   the facts that a model would be given
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.columns import coord_parts, float_text
from factweave.operators import claims, derivation, lexing, retrieval, space, versions
from factweave.plans.program import Program, compile_documents, recompile_documents
from factweave.sources.files import read_documents


def documents(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.parquet(where).select("doc_id", "text") if where.endswith(".parquet") else read_documents(spark, where).select("doc_id", "text")


def facts_for(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """Retrieved facts with their category and value, as context() takes them."""
    found = retrieval.retrieve(nodes.withColumn("seq", F.col("node_seq")), questions)
    known = nodes.select("doc_id", "node_id", "major", "value_str", "unit")
    return found.join(known, ["doc_id", "node_id"]).join(F.broadcast(space.majors(nodes)), "major").withColumnRenamed("name", "category")


def derive(program: Program, kind: str, into: str | None) -> DataFrame:
    """What a pass derives; with `into`, a copy of the program that holds it is written."""
    made = derivation.run(kind, program.nodes, program.provenance)
    if kind == "temporal":
        program.alignments, shown = made.withColumn("prov_id", F.lit(None).cast("string")), made
    else:
        shown, program.derivations = made
        added = shown.select(*shown.columns, *coord_parts(F.col("node_id")), F.lit("float").alias("value_kind"), float_text(F.col("value_num")).alias("value_str"))
        program.nodes = program.nodes.unionByName(added.drop("n"), allowMissingColumns=True)
        named = shown.select("doc_id", "prov_id").distinct().withColumn("extractor", F.lit("derived:confidence")).withColumn("confidence", F.lit(1.0))
        program.provenance = program.provenance.unionByName(named, allowMissingColumns=True)
    if into:
        program.write(into)
    return shown


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factweave")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compile")
    c.add_argument("input")
    c.add_argument("program")
    c.add_argument("--tier", type=int, default=2)
    c.add_argument("--mock-model", action="store_true")
    c.add_argument("--previous")
    i = sub.add_parser("inspect")
    i.add_argument("program")
    i.add_argument("--samples", type=int, default=3)
    v = sub.add_parser("derive")
    v.add_argument("program")
    v.add_argument("kind", choices=sorted(derivation.STRATEGIES))
    v.add_argument("--into")
    for name in ("info", "stats"):
        sub.add_parser(name).add_argument("program")
    q = sub.add_parser("query")
    q.add_argument("program")
    q.add_argument("--major", type=int)
    q.add_argument("--label")
    q.add_argument("--gt", type=float)
    q.add_argument("--lt", type=float)
    q.add_argument("--limit", type=int, default=20)
    d = sub.add_parser("diff")
    d.add_argument("old")
    d.add_argument("new")
    e = sub.add_parser("export")
    e.add_argument("program")
    e.add_argument("folder")
    a = sub.add_parser("ask")
    a.add_argument("program")
    a.add_argument("question", nargs="+")
    return p


def run(spark: SparkSession, argv: list[str]) -> DataFrame | None:
    """The rows that a command shows; None where it only writes."""
    o = parser().parse_args(argv)
    if o.command == "compile":
        docs = documents(spark, o.input)
        if o.previous:
            program, held, planned = recompile_documents(Program.load(spark, o.previous), spark.read.parquet(f"{o.previous}/chunks"), docs, uuid.uuid4().hex[:8], o.tier)
            done = versions.efficiency(planned)
        else:
            program, done = compile_documents(docs, o.tier, claims.mock_claims if o.mock_model else None), None
            held = lexing.lex(docs).select("doc_id", "chunk_id", "content_hash")
        program.write(o.program)
        held.write.mode("overwrite").parquet(f"{o.program}/chunks")
        return done
    if o.command == "diff":
        old, new = (Program.load(spark, x).nodes for x in (o.old, o.new))
        return versions.diff(old, new).where("change <> 'same'")
    program = Program.load(spark, o.program)
    if o.command == "info":
        return program.manifest()
    if o.command == "stats":
        return space.stats_major(program.nodes)
    if o.command == "inspect":
        return space.samples(program.nodes, o.samples)
    if o.command == "derive":
        return derive(program, o.kind, o.into)
    if o.command == "query":
        found = space.where(program.nodes, major=o.major, label_contains=o.label, value_gt=o.gt, value_lt=o.lt)
        return space.limit(found.withColumn("seq", F.col("node_seq")), o.limit).select("doc_id", "node_id", "label", "value_str", "unit")
    if o.command == "export":
        program.export(o.folder)
        return None
    questions = spark.createDataFrame([(0, " ".join(o.question))], "question_id int, question string")
    return retrieval.context(facts_for(program.nodes, questions))


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("factweave").getOrCreate()
    rows = run(spark, argv)
    if rows is not None:
        rows.show(100, truncate=False)


if __name__ == "__main__":
    main()
