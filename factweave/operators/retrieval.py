"""Keyword retrieval of facts for questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import patterns as P
from factweave.functions.columns import contains_any, find_all

from . import search


def keywords(question: Column) -> Column:
    """Words of three and more characters that aren't stop words, in order, with repeats."""
    words = find_all(F.lower(question), r"\b[a-z0-9]+\b")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*P.STOP_WORDS))


def question_type(question: Column) -> Column:
    """The category that a question asks for, or null."""
    low = F.lower(question)
    return F.when(contains_any(low, P.QUANTITY_WORDS), 7).when(contains_any(low, P.TIME_WORDS), 6).when(contains_any(low, P.ENTITY_WORDS), 1).when(contains_any(low, P.LOCATION_WORDS), 5)


def label_postings(nodes: DataFrame) -> DataFrame:
    """The index of the labels, without regard to case, that retrieve() looks keywords up in; it may be stored."""
    return search.index(nodes.select(F.lower("label").alias("low")), [], "low", search.RUN)


def retrieve(nodes: DataFrame, questions: DataFrame, most: int = 20, postings: DataFrame | None = None) -> DataFrame:
    """(doc_id, question_id, rank, node_id, label, relevance): nodes of the asked category at 0.8, then those whose label
    holds a keyword at 1.0 unless their content was there already; the most relevant first, earlier finds first.

    With stored `postings` keywords find labels in them, and these their nodes by an equi-join, so that few labels are
    looked at. Without, nodes are read once: each asks under its category and under the runs of its label, where keywords
    and asked categories wait."""
    asked = questions.select("question_id", question_type(F.col("question")).alias("hint"), keywords(F.col("question")).alias("own"))
    extra = F.when(F.col("hint") == 7, F.array(*(F.lit(w) for w in P.QUANTITY_EXTRA))).otherwise(F.array().cast("array<string>"))
    words = asked.select("question_id", F.posexplode(F.concat("own", extra)).alias("place", "word"))
    hints = asked.where("hint is not null").select("question_id", F.col("hint").alias("major"), F.lit(-1).alias("place"))
    columns = ["doc_id", "question_id", "node_id", "label", "content_hash", "seq", "place"]
    if postings is None:
        category = lambda c: F.concat(F.lit("category "), c.cast("string"))  # noqa: E731  (longer than a run)
        waiting = words.withColumn("gram", F.substring("word", 1, search.RUN)).unionByName(hints.withColumn("gram", category(F.col("major"))).drop("major"), allowMissingColumns=True)
        low = F.lower("label")
        asking = nodes.select("doc_id", "node_id", "label", "content_hash", "seq", F.explode(F.concat(F.coalesce(search.runs(low, search.RUN), F.array().cast("array<string>")), F.array(category(F.col("major"))))).alias("gram"))
        placed = asking.join(search.sent(waiting, waiting.count()), "gram").where(F.col("word").isNull() | F.contains(low, "word")).select(*columns)
    else:
        labels = search.holding(postings, words, [], "low", "word").join(words, "word").groupBy("question_id", "low").agg(F.min("place").alias("place"))
        by_word = nodes.withColumn("low", F.lower("label")).join(labels, "low").select(*columns)
        placed = by_word.unionByName(nodes.join(hints, "major").select(*columns))
    # Dealt out before they are grouped: groups are small, and the task that reads a space would sort all its finds in vain.
    dealt = placed.repartition("doc_id", "question_id", "content_hash")
    once = dealt.groupBy("doc_id", "question_id", "content_hash").agg(F.min_by(F.struct("node_id", "label", "place", "seq"), F.struct("place", "seq")).alias("n")).select("doc_id", "question_id", "n.*")
    scored = once.withColumn("relevance", F.when(F.col("place") < 0, 0.8).otherwise(1.0))
    order = Window.partitionBy("doc_id", "question_id").orderBy(F.desc("relevance"), "place", "seq")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("doc_id", "question_id", "rank", "node_id", "label", "relevance")


def context(facts: DataFrame) -> DataFrame:
    """(doc_id, question_id, context): facts (with category, value_str and unit) as lines below their category."""
    unit = F.when(F.coalesce("unit", F.lit("")) != "", F.concat(F.lit(" "), "unit")).otherwise("")
    line = F.concat(F.lit("- "), "label", F.when(F.col("value_str").isNotNull(), F.concat(F.lit(": "), "value_str", unit)).otherwise(""))
    per = facts.withColumn("line", line).groupBy("doc_id", "question_id", "category").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    block = F.concat(F.lit("\n"), "category", F.lit(":\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    both = per.groupBy("doc_id", "question_id").agg(F.array_sort(F.collect_list(F.struct("category", block.alias("b")))).alias("c"))
    return both.select("doc_id", "question_id", F.concat(F.lit("Knowledge base facts:\n"), F.array_join(F.transform("c", lambda x: x["b"]), "\n")).alias("context"))


NO_FACTS = "No relevant facts found in the knowledge base."
