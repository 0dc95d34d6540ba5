"""Which texts hold which words: an inverted index of runs of characters, with an exact test of what it finds.

A text is posted under each run of three characters in it, and under shorter ones for words that are shorter. A word is
looked up under the rarest of its own runs, so that the join moves as few postings as any of them gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a posting at most.
RUN = 3
#: Words up to which their table is sent to all tasks; for more, texts and words are shuffled by their runs.
SENT = 100_000
#: Different words up to which each text is tested for all of them, which takes less than cutting it into runs.
FEW = 16


def runs(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters of a text; none if it is shorter. Behind a character of two code units one more
    stands, which the exact test sorts out."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def index(texts: DataFrame, keys: list[str], text: str, shortest: int = 1) -> DataFrame:
    """(keys, gram, text) of the distinct texts within the keys: postings under runs of `shortest` to RUN characters."""
    distinct = texts.where(F.col(text).isNotNull()).select(*keys, text).distinct()
    return distinct.select(*keys, F.explode(F.concat(*(runs(F.col(text), k) for k in range(shortest, RUN + 1)))).alias("gram"), text)


def holding(postings: DataFrame, words: DataFrame, keys: list[str], text: str, word: str) -> DataFrame:
    """(keys, word, text) of the words and the texts that hold them. An empty word is in no run and finds nothing."""
    asked = words.where(F.length(word) > 0).select(*keys, word).distinct()
    whole = F.array(F.col(word))  # a word that is shorter than a run
    grams = asked.select(*keys, word, F.explode(F.when(F.length(word) < RUN, whole).otherwise(runs(F.col(word), RUN))).alias("gram"))
    counts = postings.join(grams.select(*keys, "gram").distinct(), [*keys, "gram"], "left_semi").groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(counts, [*keys, "gram"], "left").groupBy(*keys, word).agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return postings.join(rarest, [*keys, "gram"]).where(F.contains(text, word)).select(*keys, word, text)


def sent(words: DataFrame, count: int) -> DataFrame:
    """The words, marked to be sent to all tasks where they are that few."""
    return F.broadcast(words) if count <= SENT else words


def find(texts: DataFrame, words: DataFrame, keys: list[str], text: str, word: str) -> DataFrame:
    """The rows of `texts`, each with the rows of `words` whose word it holds, in one pass over texts that no index was made
    of: a word waits under its first run, a text asks under all of its own. Up to FEW different words are looked for as they
    are. An empty word is in any text."""
    asked = words.where(F.col(word).isNotNull()).withColumn("gram", F.substring(word, F.lit(1), F.least(F.length(word), F.lit(RUN))))
    n, shortest = asked.agg(F.count(F.lit(1)), F.least(F.min(F.length(word)), F.lit(RUN))).first()
    different = [r[word] for r in asked.select(word).distinct().limit(FEW + 1).collect()]
    if len(different) <= FEW:
        held = F.array_compact(F.array(*(F.when(F.contains(F.col(text), F.lit(w)), F.lit(w)) for w in different)).cast("array<string>"))
        return texts.where(F.lit(n > 0)).withColumn(word, F.explode(held)).join(sent(asked.drop("gram"), n), [*keys, word])
    own = F.concat(*(F.coalesce(runs(F.col(text), k), F.array().cast("array<string>")) for k in range(shortest, RUN + 1)))
    return texts.withColumn("gram", F.explode(own)).join(sent(asked, n), [*keys, "gram"]).where(F.contains(text, word)).drop("gram")
