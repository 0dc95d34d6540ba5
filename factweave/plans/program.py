"""A program: the tables that compiling gives, as lazy DataFrames, with their Parquet and JSON-lines forms."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions.columns import coord_parts
from factweave.operators import claims, emission, extraction, lexing, scans, versions
from factweave.operators.graph import ensure_checkpoints
from factweave.sources import adapters, detect

VERSION = "0.5"
SORTED_BY = {"nodes": ["doc_id", "node_id"], "provenance": ["doc_id", "prov_id"], "relations": ["doc_id", "subject_id", "predicate", "object_id"], "derivations": ["doc_id", "result_id"], "alignments": ["doc_id", "subject_id", "reference_id"], "forks": ["doc_id", "fork_id"]}


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@dataclass
class Program:
    nodes: DataFrame
    provenance: DataFrame
    relations: DataFrame | None = None
    derivations: DataFrame | None = None
    alignments: DataFrame | None = None
    forks: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in self.__dict__.items() if v is not None}

    def write(self, path: str) -> None:
        """Parquet, nodes in folders by category so that a filter on it skips the others."""
        for name, df in self.tables().items():
            writer = df.write.mode("overwrite")
            (writer.partitionBy("major") if name == "nodes" else writer).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Program:
        there = [n for n in SORTED_BY if _exists(spark, f"{path}/{n}")]
        for name in ("nodes", "provenance"):
            if name not in there:
                raise FileNotFoundError(f"no program at {path}: {name} are missing")
        return cls(**{n: spark.read.parquet(f"{path}/{n}") for n in there if n != "provenance"}, provenance=spark.read.parquet(f"{path}/provenance"))

    def store(self, path: str, prefix: str, buckets: int) -> None:
        """Tables `prefix`_nodes and so on at `path`, in buckets by the key that they are joined on and sorted by it, with
        Bloom filters of it: nodes and relations of a program, or nodes of two of them with as many buckets, are joined as they
        lie, and lookups of an id skip the row groups that don't hold it. Buckets should be as many as the tasks of a join."""
        for name, df in self.tables().items():
            key = SORTED_BY[name][:2]
            # A task has whole buckets, so that each is one file.
            writer = df.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key)
            writer.option(f"parquet.bloom.filter.enabled#{key[1]}", "true").option("path", f"{path}/{name}").saveAsTable(f"{prefix}_{name}")

    @classmethod
    def stored(cls, spark: SparkSession, path: str, prefix: str, buckets: int) -> Program:
        """What store() wrote; in a session that doesn't know the tables they are named again, with the same buckets."""
        for name in SORTED_BY:
            if not spark.catalog.tableExists(f"{prefix}_{name}") and _exists(spark, f"{path}/{name}"):
                key = ", ".join(SORTED_BY[name][:2])
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{name}").schema)
                spark.sql(f"CREATE TABLE {prefix}_{name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
        there = {n: spark.table(f"{prefix}_{n}") for n in SORTED_BY if spark.catalog.tableExists(f"{prefix}_{n}")}
        for name in ("nodes", "provenance"):
            if name not in there:
                raise FileNotFoundError(f"no program {prefix} at {path}: {name} are missing")
        return cls(**there)

    def export(self, path: str) -> None:
        """JSON lines in canonical order, and a manifest. A table is as many parts as its sort has partitions, in the order of
        their names; the manifest counts rows, says how many lines each part has, and holds the root hash."""
        spark, parts = self.nodes.sparkSession, {}
        for name, df in self.tables().items():
            names = sorted(df.columns)
            df.orderBy(*SORTED_BY[name]).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/{name}.jsonl")
            sizes = spark.read.text(f"{path}/{name}.jsonl").groupBy(F.col("_metadata.file_name").alias("part")).agg(F.count(F.lit(1)).alias("n"))
            parts[name] = [r["n"] for r in sizes.orderBy("part").collect()]  # one number a part
        said = {"version": VERSION, "counts": {name: sum(n) for name, n in parts.items()}, "parts": parts, "root": self.root_hash().first()["root"]}
        spark.createDataFrame([(json.dumps(said, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")

    @classmethod
    def read_export(cls, spark: SparkSession, path: str, node_schema, prov_schema) -> Program:
        """The reverse of export(), with all tables that are there; the last of equal node ids wins, as lines stand.

        Without a manifest it is an error, and so is a number of rows that it doesn't name, and a line that isn't an object of
        the schema: the error names the table and the line's number over all its parts. All parts are checked in parallel."""
        if not _exists(spark, f"{path}/manifest.json"):
            raise FileNotFoundError(f"no manifest.json at {path}")
        out, counts = {}, json.loads(spark.read.text(f"{path}/manifest.json").first()["value"])["counts"]
        for name in SORTED_BY:
            if not _exists(spark, f"{path}/{name}.jsonl"):
                if name in ("nodes", "provenance"):
                    raise FileNotFoundError(f"no {name}.jsonl at {path}")
                continue
            # Lines in the order of the parts' names; where a part is read in pieces, in the order of these.
            at = F.struct(F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("id"))
            lines = spark.read.text(f"{path}/{name}.jsonl").select(at.alias("line"), "value").where(F.trim("value") != "")
            schema = {"nodes": node_schema, "provenance": prov_schema}.get(name) or TABLES[name]
            parsed = lines.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
            keys = [k for k in SORTED_BY[name]]
            bad = F.col("row").isNull() | F.col(f"row.{keys[-1]}").isNull()
            first = parsed.where(bad).agg(F.min("line").alias("line")).first()["line"]
            if first is not None:
                number = lines.where(F.col("line") <= F.struct(F.lit(first["part"]).alias("part"), F.lit(first["begin"]).alias("begin"), F.lit(first["id"]).alias("id"))).count()
                raise ValueError(f"invalid row of {name} at line {number}")
            if name == "nodes":
                parsed = parsed.groupBy(*(F.col(f"row.{k}") for k in keys)).agg(F.max_by("row", "line").alias("row"))
            rows = parsed.count()
            if rows != counts.get(name, rows):
                raise ValueError(f"{rows} rows of {name}, but the manifest counts {counts[name]}")
            out[name] = parsed.select("row.*")
        return cls(**out)

    def manifest(self) -> DataFrame:
        parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in self.tables().items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def stats(self) -> DataFrame:
        """(doc_id, nodes, chunks, relations, tiers): what the manifest says of each document; tiers as tier to chunks."""
        n = self.nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"))
        by_tier = self.provenance.groupBy("doc_id", "tier").agg(F.count(F.lit(1)).alias("n"))
        p = by_tier.groupBy("doc_id").agg(F.sum("n").alias("chunks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "n")))).alias("tiers"))
        out = p.join(n, "doc_id", "full")
        edges = self.relations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("relations")) if self.relations is not None else None
        out = out.join(edges, "doc_id", "left") if edges is not None else out.withColumn("relations", F.lit(0))
        return out.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "chunks", "relations")), "tiers")

    def content_hash(self) -> DataFrame:
        """(doc_id, hash) of the nodes and relations of each document, whatever their order: see range_digests."""
        listed = F.array_sort(F.collect_list(F.concat_ws(" ", "range", "digest")))  # at most one a pair of category and type
        return self.range_digests().groupBy("doc_id").agg(F.substring(F.sha2(F.array_join(listed, "\n"), 256), 1, 16).alias("hash"))

    def range_digests(self) -> DataFrame:
        """(doc_id, range, n, digest): a digest of each range of a document, the rows whose (subject's) id begins alike.

        A row's hash is four numbers of 60 bits, and a range's digest the hash of their sums: sums are merged wherever rows
        are, so a document is never gathered, and a range that two versions share needs no look at its rows."""
        lines = self.nodes.select("doc_id", F.concat_ws("|", F.lit("n"), "node_id", "content_hash").alias("line"))
        if self.relations is not None:
            lines = lines.unionByName(self.relations.select("doc_id", F.concat_ws("|", F.lit("r"), "subject_id", "predicate", "object_id").alias("line")))
        hashed = lines.select("doc_id", F.substring_index("line", "-", 2).alias("range"), F.sha2("line", 256).alias("h"))
        part = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
        return hashed.groupBy("doc_id", "range").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(" ", *(part(k) for k in range(4))), 256).alias("digest"))

    def root_hash(self) -> DataFrame:
        """(documents, root): one row for the whole program, from the digests of its documents."""
        each = self.content_hash().select(F.sha2(F.concat_ws(" ", "doc_id", "hash"), 256).alias("h"))
        part = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
        return each.agg(F.count(F.lit(1)).alias("documents"), F.sha2(F.concat_ws(" ", *(part(k) for k in range(4))), 256).alias("root"))


#: The tables that compiling doesn't make, as they are read from an export.
TABLES = {
    "relations": "doc_id long, subject_id string, predicate string, object_id string, prov_id string, confidence double",
    "derivations": "doc_id long, result_id string, operands array<string>, operator string, prov_id string, confidence double",
    "alignments": "doc_id long, subject_id string, reference_id string, operator string, prov_id string, confidence double",
    "forks": "doc_id long, fork_id string, options array<struct<node_id: string, confidence: double>>, prov_id string",
}


def compile_documents(docs: DataFrame, max_tier: int = 2, executor: Callable[[DataFrame], DataFrame] | None = None, slices: int | None = None) -> Program:
    """Texts to facts; nothing runs before an action but a count of the documents, which tells the number of slices unless
    `slices` does, unless there is an executor.

    `executor` takes claims.requests() to the claims of a model, as claims.mock_claims does or a function around
    claims.execute; their nodes, edges and provenance join the program. What the model said is kept at once, so that it
    is asked once, and so are the chunks and coordinates that its claims are joined with."""
    chunks = lexing.lex(docs, n=slices)
    if executor is None:
        return Program(emission.nodes(extraction.extract(chunks, max_tier)), emission.provenance(chunks))
    ensure_checkpoints(docs)
    chunks = chunks.checkpoint()
    numbered = emission.assign_coords(extraction.extract(chunks, max_tier)).checkpoint()
    said = executor(claims.requests(chunks)).checkpoint()
    program = Program(emission.distinct_nodes(numbered), emission.provenance(chunks))
    used = numbered.groupBy("doc_id", "major", "type", "subtype").agg(F.max("instance").alias("top"))
    nodes, edges, prov = claims.emit_claims(said, program.nodes, used)
    return Program(program.nodes.unionByName(nodes, allowMissingColumns=True), program.provenance.unionByName(prov, allowMissingColumns=True), edges)


def recompile_documents(previous: Program, old_chunks: DataFrame, docs: DataFrame, generation: str, max_tier: int = 2) -> tuple[Program, DataFrame, DataFrame]:
    """The program of new versions of documents, where chunks whose hash the previous one has keep their nodes; its chunks
    (doc_id, chunk_id, content_hash) for the next time; and what was done with each chunk, as versions.plan says.

    Chunks compiled now are named by `generation`, which must not have been used before. Relations between kept nodes stay."""
    lexed = lexing.lex(docs).withColumn("chunk_id", F.concat("chunk_id", F.lit(f"@{generation}")))
    planned = versions.plan(old_chunks, lexed)
    nodes = versions.recompile(planned, previous.nodes, lexed, ("value_kind", "value_num"), max_tier).select("*", *coord_parts(F.col("node_id")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("origin"), "chunk_id", "node_id"))  # reused ones first
    nodes = nodes.withColumn("node_seq", place.cast("long")).withColumn("prov_id", F.concat(F.lit("prov_"), "chunk_id")).drop("origin")
    held = old_chunks.unionByName(lexed.select("doc_id", "chunk_id", "content_hash")).join(planned.where("action <> 'remove'").select("doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"], "left_semi")
    prov = previous.provenance.unionByName(emission.provenance(lexed), allowMissingColumns=True).join(held.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_semi")
    edges = versions.copy_relations(nodes, previous.relations) if previous.relations is not None else None
    return Program(nodes, prov, edges), held, planned


def compile_universal(docs: DataFrame, max_tier: int = 2) -> DataFrame:
    """Nodes of (doc_id, text) whatever their type: by adapter where the route and an adapter are there, by text else."""
    kinded = docs.withColumn("kind", detect.detect(F.col("text"))).withColumn("path", detect.route(F.col("kind"), F.col("text")))
    columns = ["doc_id", "node_id", "label", "value_str", "value_num", "unit"]
    ready = [k for k in adapters.ADAPTERS]
    n = scans.slices(docs)  # once for all, as each path's own documents would be searched to count them
    out = compile_documents(kinded.where((F.col("path") != "ADAPTER") | ~F.col("kind").isin(*ready)).select("doc_id", "text"), max_tier, slices=n).nodes.select(*columns)
    for kind in ready:
        out = out.unionByName(adapters.to_nodes(adapters.ADAPTERS[kind](kinded.where((F.col("path") == "ADAPTER") & (F.col("kind") == kind)))).select(*columns))
    return out
