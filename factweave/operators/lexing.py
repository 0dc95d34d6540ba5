"""Documents to chunks: paragraphs with patterns, section, type and tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import patterns as P
from factweave.functions.columns import contains_any, find_all, short_hash, stripped, word_count

from .scans import dealt, scan, slices, unsent

_BREAK = r"(?U)\n\s*\n"


def lex_kind(text: Column) -> Column:
    """JSON, XBRL or XML for whole-document chunks; TEXT for what is split into paragraphs."""
    head = F.substring(stripped(text), 1, 1)
    return F.when(head.isin("{", "["), "JSON").when((head == "<") & F.lower(text).contains("xbrl"), "XBRL").when(head == "<", "XML").otherwise("TEXT")


def is_section(c: Column) -> Column:
    closed = F.substring(c, -1, 1).isin(".", ",", ";", ":")
    return (F.length(c) <= 100) & ~closed & (c.rlike(P.SECTION_MARKDOWN) | c.rlike(P.SECTION_CAPS) | c.rlike(P.SECTION_NAMED))


def pattern_struct(c: Column, live: Column) -> Column:
    """Everything the patterns find in a paragraph; empty where `live` is false.

    A pattern is searched where the text has what each of its matches has."""
    none = F.array().cast("array<string>")
    all_ = lambda pattern, needs, group=0: F.when(live & needs, find_all(c, pattern, group)).otherwise(none)
    has = lambda pattern, needs=live: live & needs & c.rlike(pattern)
    tab = has(P.TABLE_TAB, c.contains("\t"))
    table = (has(P.TABLE_PIPE, c.contains("|")) | tab) & (has(P.TABLE_SEPARATOR) | tab)
    named, listed = c.contains(":"), contains_any(c, ("-", "*"))
    return F.struct(
        all_(P.MONEY, c.contains("$")).alias("money"),
        all_(P.PERCENT, c.contains("%")).alias("percent"),
        all_(P.DATE, c.rlike(P.DATE_DIGITS)).alias("dates"),
        F.arrays_zip(all_(P.KEY_VALUE, named, 1).alias("key"), all_(P.KEY_VALUE, named, 2).alias("value")).alias("key_value"),
        F.concat(all_(P.BULLET, listed, 1), all_(P.NUMBERED, c.contains("."), 1)).alias("list_items"),
        table.alias("has_table"),
        has(P.CODE_FENCE, c.contains("```")).alias("has_code"),
        has(P.CITATION).alias("has_citations"),
    )


def paragraphs(docs: DataFrame, segment: int | None = None, n: int | None = None) -> DataFrame:
    """(doc_id, kind, chunk_seq, content, start, end): non-empty paragraphs, or the whole document.

    With `segment` a document is dealt out in segments of so many paragraphs, instead of being one task's."""
    n = n or slices(docs)
    docs = docs if segment else dealt(docs, "doc_id", n=n)
    text = F.coalesce(F.col("text"), F.lit(""))
    kinded = docs.select("doc_id", text.alias("text"), lex_kind(text).alias("kind"))
    pieces = F.when(F.col("kind") == "TEXT", F.split("text", _BREAK)).otherwise(F.array(stripped(F.col("text"))))
    gaps = F.when(F.col("kind") == "TEXT", find_all(F.col("text"), _BREAK)).otherwise(F.array().cast("array<string>"))
    # Each paragraph with the gap behind it, so that no row carries the gaps of its whole document.
    zipped = kinded.select("doc_id", "kind", F.posexplode(F.arrays_zip(pieces.alias("raw"), gaps.alias("gap"))).alias("pos", "x"))
    each = zipped.select("doc_id", "kind", "pos", "x.raw", F.col("x.gap").alias("gap"))
    gap = F.coalesce(F.length("gap"), F.lit(0))
    lead = F.when(F.substring("raw", 1, 1).rlike(r"(?U)\s"), F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))).otherwise(0)
    if segment:
        kept = ((stripped(F.col("raw")) != "") | (F.col("kind") != "TEXT")).cast("int")
        rows = scan(each, ["doc_id"], "pos", segment, sums={"before": F.length("raw") + gap, "seen": kept}, n=n)
        start = (F.col("before") + F.when(F.col("kind") == "TEXT", lead).otherwise(0)).cast("int")
        rows = rows.select("doc_id", "kind", (F.col("seen") + 1).cast("int").alias("chunk_seq"), stripped(F.col("raw")).alias("content"), start.alias("start"))
        return rows.where((F.col("content") != "") | (F.col("kind") != "TEXT")).withColumn("end", (F.col("start") + F.length("content")).cast("int"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    before = F.coalesce(F.sum(F.length("raw") + gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.select("doc_id", "kind", "pos", stripped(F.col("raw")).alias("content"), (before + F.when(F.col("kind") == "TEXT", lead).otherwise(0)).alias("start"))
    full = placed.where((F.col("content") != "") | (F.col("kind") != "TEXT"))
    return full.select("doc_id", "kind", F.row_number().over(order).alias("chunk_seq"), "content", F.col("start").cast("int").alias("start"), (F.col("start") + F.length("content")).cast("int").alias("end"))


def lex(docs: DataFrame, segment: int | None = None, n: int | None = None) -> DataFrame:
    """Chunks of (doc_id, text), one row each; all windows share one exchange on doc_id, of whole documents.

    With `segment` the same for documents that are too long for a task: segments of so many paragraphs are lexed by
    themselves, and only what they hand on (length, number of paragraphs, last header) meets. `n` is the number of slices, by default told by the size of the texts (scans.slices)."""
    n_slices = n or slices(docs)
    p = paragraphs(docs, segment, n_slices).where(F.col("content") != "")
    live = F.col("kind") == "TEXT"
    c = F.col("content")
    order = Window.partitionBy("doc_id").orderBy("chunk_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Patterns are found below the window, which no optimizer folds into what stands above: so each is searched once,
    # however many tests and extractors name it.
    found = p.withColumn("patterns", pattern_struct(c, live)).withColumn("words", word_count(c)).withColumn("head", F.when(live & is_section(c), F.lower(c)))
    if segment:
        found = scan(found, ["doc_id"], "chunk_seq", segment, lasts={"section": F.col("head")}, n=n_slices)
    else:
        found = found.withColumn("section", F.last("head", ignorenulls=True).over(order))
    n = lambda name: F.size(f"patterns.{name}")
    cited = F.coalesce(F.col("section").contains("reference"), F.lit(False)) & (F.col("patterns.has_citations") | (n("list_items") > 0))
    short = (n("money") + n("percent") + n("dates") > 0) & (F.col("words") < 20)
    kinds = [
        (~live, F.col("kind"), 0),
        (cited, F.lit("CITATION"), 1),
        (F.col("patterns.has_table"), F.lit("TABLE"), 0),
        (F.col("patterns.has_code"), F.lit("CODE"), 0),
        ((n("key_value") * 10 > F.col("words")), F.lit("KEY_VALUE"), 1),
        ((n("list_items") * 5 > F.col("words")), F.lit("LIST"), 1),
        (short, F.lit("METADATA"), 1),
        (F.col("words") < 200, F.lit("PROSE"), 3),
    ]
    kind, tier = F.when(*kinds[0][:2]), F.when(kinds[0][0], kinds[0][2])
    for test, name, level in kinds[1:]:
        kind, tier = kind.when(test, name), tier.when(test, level)
    return unsent(found).select(
        "doc_id", "chunk_seq", F.format_string("chunk_%06d", "chunk_seq").alias("chunk_id"), kind.otherwise("PROSE").alias("chunk_type"), tier.otherwise(4).alias("tier"),
        "content", "start", "end", F.lit(1.0).alias("confidence"), "section", "words", short_hash(c).alias("content_hash"), "patterns",
    )


def lexer_summary(chunks: DataFrame) -> DataFrame:
    """Chunks by tier, all five tiers filled, with the share of cheap to dear ones."""
    spark = chunks.sparkSession
    tiers = spark.range(5).select(F.col("id").cast("int").alias("tier"))
    counted = tiers.join(chunks.groupBy("tier").agg(F.count(F.lit(1)).alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("chunks"))
    at = lambda *t: F.sum(F.when(F.col("tier").isin(*t), F.col("chunks")).otherwise(0))
    ratio = counted.agg(F.when(at(3, 4) > 0, at(0, 1) / at(3, 4)).otherwise(F.lit(float("inf"))).alias("efficiency"))
    return counted.join(F.broadcast(ratio)).select("tier", "chunks", F.round("efficiency", 6).alias("efficiency"))
