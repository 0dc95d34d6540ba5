"""Chunks to extractions. Every extractor is an array of structs; they are laid end to end in the fixed order that
numbers coordinates, so that one generator makes all rows of a chunk and none is scanned twice."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import patterns as P
from factweave.functions.columns import contains_any, find_all, float_text, money_number, money_text, strip, to_number

from .scans import scan, unsent

FIELDS = "struct<entity_type:string,label:string,major:int,type:int,subtype:int,value_kind:string,value_str:string,value_num:double,unit:string,extractor:string>"


def empty() -> Column:
    return F.array().cast(f"array<{FIELDS}>")


def _row(kind: str, label: Column, coord: tuple[int, int, int], extractor: str, value_kind: Column | str = "null", value_str: Column | None = None, value_num: Column | None = None, unit: Column | str | None = None) -> Column:
    lit = lambda x, t: (F.lit(x) if not isinstance(x, Column) else x).cast(t)
    return F.struct(
        F.lit(kind).alias("entity_type"), label.alias("label"), *(F.lit(c).alias(n) for c, n in zip(coord, ("major", "type", "subtype"), strict=True)),
        lit(value_kind, "string").alias("value_kind"), lit(value_str, "string").alias("value_str"), lit(value_num, "double").alias("value_num"), lit(unit, "string").alias("unit"), F.lit(extractor).alias("extractor"),
    )


def _number(kind: str, label: Column, coord: tuple, extractor: str, v: Column, unit) -> Column:
    return _row(kind, label, coord, extractor, F.when(v.isNull(), "null").otherwise("float"), float_text(v), v, unit)


def bound(found: Column, **values) -> Column:
    """What was found as structs of values that rows name more than once: each is worked out once."""
    return F.transform(found, lambda m: F.struct(*(f(m).alias(n) for n, f in values.items())))


def money(p: Column) -> Column:
    texts = bound(p["money"], m=lambda m: m, t=money_text)
    return F.transform(bound(texts, m=lambda x: x["m"], v=lambda x: money_number(x["t"])), lambda x: _number("Money", x["m"], (7, 1, 1), "tier1:money", x["v"], "USD"))


def percents(p: Column) -> Column:
    valued = bound(p["percent"], m=lambda m: m, v=lambda m: to_number(F.regexp_replace(m, "%", "")))
    return F.transform(F.filter(valued, lambda x: x["v"].isNotNull()), lambda x: _number("Percentage", x["m"], (7, 2, 1), "tier1:percent", x["v"], "%"))


def _text(kind: str, label: Column, coord: tuple, extractor: str, value: Column) -> Column:
    return _row(kind, label, coord, extractor, "str", value, to_number(value))


def dates(p: Column) -> Column:
    return F.transform(p["dates"], lambda m: _text("Date", m, (6, 1, 1), "tier1:date", m))


def key_values(p: Column) -> Column:
    pairs = bound(p["key_value"], k=lambda m: strip(m["key"]), v=lambda m: strip(m["value"]))
    return F.transform(pairs, lambda x: _text("KeyValue", F.concat(x["k"], F.lit(": "), x["v"]), (3, 1, 1), "tier1:kv", x["v"]))


def list_items(p: Column) -> Column:
    return F.transform(p["list_items"], lambda m: _row("ListItem", strip(m), (3, 2, 1), "tier1:list"))


def _where(needs: Column, found: Column) -> Column:
    """What a pattern finds, searched only where the text has what each of its matches has."""
    return F.when(needs, found).otherwise(F.array().cast("array<string>"))


def _named(c: Column, patterns: tuple, needs: tuple, kind: str, coord: tuple, extractor: str, most: int, least: int = 0) -> Column:
    found = F.array_distinct(F.concat(*(_where(n, find_all(c, p, 1)) for p, n in zip(patterns, needs, strict=True))))
    return F.transform(F.slice(F.filter(found, lambda m: F.length(m) > least), 1, most), lambda m: _row(kind, m, coord, extractor))


def organisations(c: Column) -> Column:
    return _named(c, P.ORGANISATION, (contains_any(c, P.ORGANISATION_NEEDS[0]), c.rlike(P.ORGANISATION_NEEDS[1])), "Organization", (1, 1, 1), "tier1:org", 10, 2)


def people(c: Column) -> Column:
    return _named(c, P.PERSON, (contains_any(c, P.PERSON_NEEDS),) * 2, "Person", (1, 2, 1), "tier1:person", 5)


def locations(c: Column) -> Column:
    # Beyond ASCII more letters are equal than small letters tell.
    city = (F.length(c) != F.octet_length(c)) | contains_any(F.lower(c), P.LOCATION_NEEDS[1])
    return _named(c, P.LOCATION, (c.rlike(P.LOCATION_NEEDS[0]), city), "Location", (5, 1, 1), "tier1:location", 5)


def durations(c: Column) -> Column:
    all_ = lambda group: _where(c.rlike(P.DURATION_NEEDS), find_all(c, P.DURATION, group))
    both = F.arrays_zip(all_(1).alias("n"), all_(2).alias("u"))
    whole = lambda n: F.regexp_replace(n, r"^0+(?=[0-9])", "")  # noqa: E731  of any length, so never a number of Spark
    parts = bound(both, n=lambda m: whole(m["n"]), u=lambda m: F.lower(m["u"]), v=lambda m: to_number(m["n"]))
    return F.transform(parts, lambda x: _number("Duration", F.concat(x["n"], F.lit(" "), x["u"]), (6, 2, 1), "tier1:duration", x["v"], x["u"]))


def ratios(c: Column) -> Column:
    return F.transform(bound(_where(c.rlike(P.RATIO_NEEDS), find_all(c, P.RATIO, 1)), v=to_number), lambda x: _number("Ratio", F.concat(float_text(x["v"]), F.lit("x")), (7, 2, 1), "tier1:ratio", x["v"], "x"))


def clear_hits(text: Column, word: str) -> Column:
    """How often the word stands in the text without a negation in the 20 characters before it.

    The word cuts the text into pieces; walking along them, the last 20 characters before a cut are its context."""
    cut = F.split(text, word.replace("-", r"\-"), -1)

    def step(seen: Column, piece: Column) -> Column:
        context = F.right(F.concat(seen["tail"], piece), F.lit(20))
        return F.struct(F.concat(context, F.lit(word)).alias("tail"), (seen["n"] + F.when(context.rlike(P.NEGATION), 0).otherwise(1)).alias("n"))

    return F.aggregate(F.slice(cut, 1, F.size(cut) - 1), F.struct(F.lit("").alias("tail"), F.lit(0).alias("n")), step)["n"]


def claims(c: Column) -> Column:
    """One row for each class with words that no negation precedes within 20 characters; GROWTH and DECLINE swap where
    the chunk has a negation anywhere.

    Without one, occurrences are counted by length; the walk along a word's places is left to chunks that have one. The
    chunk in small letters, whether it has a negation, and the hits are arrays of their own, so that each is worked out
    once however often a row names it."""
    swap = {"GROWTH": "DECLINE", "DECLINE": "GROWTH"}

    def hits(low: Column, negated: Column, words: list[str]) -> Column:
        plain = lambda w: ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int")
        return sum((F.when(~low.contains(w), 0).when(negated, clear_hits(low, w)).otherwise(plain(w)) for w in words), F.lit(0))

    def rows(low: Column, negated: Column) -> Column:
        counted = F.array(*(F.struct(F.when(negated, swap.get(name, name)).otherwise(name).alias("name"), hits(low, negated, words).alias("n")) for name, words in P.CLAIM_WORDS.items()))
        strength = lambda x: F.least(F.lit(1.0), x["n"] * 0.25)
        return F.transform(F.filter(counted, lambda x: x["n"] > 0), lambda x: _row("ClaimType", F.concat(x["name"], F.lit(" claim")), (8, 1, 2), "tier2:claim", "float", strength(x).cast("string"), strength(x)))

    seen = bound(bound(F.array(F.lower(c)), low=lambda x: x), low=lambda x: x["low"], negated=lambda x: x["low"].rlike(P.NEGATION_NEEDS) & x["low"].rlike(P.NEGATION))
    return F.flatten(F.transform(seen, lambda x: rows(x["low"], x["negated"])))


def sentiment(c: Column) -> Column:
    """The class with most of its words present; ties go to the earlier class."""
    scored = bound(F.array(F.lower(c)), **{name: lambda low, words=words: sum((low.contains(w).cast("int") for w in words), F.lit(0)) for name, words in P.SENTIMENT_WORDS.items()})

    def row(x: Column) -> Column:
        top = F.greatest(*(x[name] for name in P.SENTIMENT_WORDS))
        label = F.when(F.lit(False), "")
        for name in P.SENTIMENT_WORDS:
            label = label.when(x[name] == top, f"{name} sentiment")
        return _row("Sentiment", label, (8, 2, 1), "tier2:sentiment", "int", top.cast("string"), top)

    return F.transform(F.filter(scored, lambda x: F.greatest(*(x[name] for name in P.SENTIMENT_WORDS)) > 0), row)


#: Extractors in the order that numbers coordinates: what it reads, whether of prose alone, its tier, category, and whether its rows
#: have a unit.
EXTRACTORS = (
    (money, "patterns", False, 1, 7, True), (percents, "patterns", False, 1, 7, True), (dates, "patterns", False, 1, 6, False), (key_values, "patterns", False, 1, 3, False), (list_items, "patterns", False, 1, 3, False),
    (organisations, "content", True, 1, 1, False), (people, "content", True, 1, 1, False), (locations, "content", True, 1, 5, False), (durations, "content", True, 1, 6, True), (ratios, "content", True, 1, 7, True),
    (claims, "content", False, 2, 8, False), (sentiment, "content", False, 2, 8, False),
)


def needed(majors: tuple[int, ...] | None) -> list[tuple]:
    """The extractors that nodes of these categories hang on.

    Numbers are given within a category, and nodes are equal only if their units are: rows with a unit never meet rows
    without one, and units of different categories differ. So categories whose rows all have units, as quantities, need
    their own extractors alone; any other needs all those without units besides."""
    if majors is None:
        return list(EXTRACTORS)
    own = [e for e in EXTRACTORS if e[4] in majors]
    bare = any(not e[5] for e in own)
    return [e for e in EXTRACTORS if e in own or (bare and not e[5])]


def extract(chunks: DataFrame, max_tier: int = 2, majors: tuple[int, ...] | None = None, segment: int | None = None, n: int | None = None) -> DataFrame:
    """Extractions of all chunks but JSON ones, numbered by document in order of chunk, extractor and place.

    With `majors` only what nodes of these categories hang on; the others that come along may lack rows, and ext_seq
    has other numbers in the same order. With `segment` a document's chunks are numbered in segments of so many,
    and what is found is kept in `n` slices on the executors' disks, until the session or its cache is cleared."""
    parts = []
    for make, source, prose_only, tier, _, _ in needed(majors):
        if tier <= max_tier:
            found = make(F.col(source)).cast(f"array<{FIELDS}>")
            parts.append(F.when(F.col("chunk_type") == "PROSE", found).otherwise(empty()) if prose_only else found)
    found = chunks.where(F.col("chunk_type") != "JSON").select("doc_id", "chunk_id", "chunk_seq", (F.concat(*parts) if parts else empty()).alias("found"))
    if segment:
        # Each extraction is made once and kept on the executors' disks: two scans read it twice each.
        found = (found.repartition(n, "doc_id", "chunk_seq") if n else found).persist(StorageLevel.DISK_ONLY)
        counted = scan(found.select("doc_id", "chunk_seq", F.size("found").alias("n")), ["doc_id"], "chunk_seq", segment, sums={"ahead": F.col("n")}, n=n)
        numbered = found.join(unsent(counted.drop("n")), ["doc_id", "chunk_seq"])
    else:
        # A chunk's first number is told before its rows are made, so that no row is sorted for it.
        before = Window.partitionBy("doc_id").orderBy("chunk_seq").rowsBetween(Window.unboundedPreceding, -1)
        numbered = found.withColumn("ahead", F.coalesce(F.sum(F.size("found").cast("long")).over(before), F.lit(0).cast("long")))
    rows = numbered.select("doc_id", "chunk_id", "chunk_seq", "ahead", F.posexplode("found").alias("pos", "e"))
    return rows.select("doc_id", "chunk_id", "chunk_seq", (F.col("ahead") + F.col("pos") + 1).cast("long").alias("ext_seq"), "e.*")


def one_extractor(chunks: DataFrame, make, on_patterns: bool, prose_only: bool = False) -> DataFrame:
    """Rows of one extractor alone, with their place in the chunk."""
    source = chunks.where(F.col("chunk_type") == "PROSE") if prose_only else chunks.where(F.col("chunk_type") != "JSON")
    return source.select("doc_id", "chunk_id", F.posexplode(make(F.col("patterns" if on_patterns else "content"))).alias("pos", "e")).select("doc_id", "chunk_id", "pos", "e.*")
