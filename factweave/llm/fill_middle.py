"""Fill-in-middle transformation, in DataFrame functions alone.

A text is an array of units (runs of letters, and every other code point by itself). Two cuts, taken from a hash of the
document's id, part it into prefix, middle and suffix, and slices of the array are joined behind their sentinels in the
order of the form: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` is the text as it
is. `restore` finds the sentinels and puts the text together again. A text that holds a sentinel stays plain, and no
sentinel can arise where a part meets another, as each begins with `<` and holds no other `<`.

Every row is worked out by itself: no shuffle, no Python.

Defined results: a null text counts as empty and is plain; a null doc_id counts as no digits after `1:`; equal rows give
equal rows; a text is never cut short; further columns of the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Of a hundred documents those that stay plain, and of a hundred others those whose suffix stands first.
PLAIN, SUFFIX_FIRST = 10, 20


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) of each row of (doc_id, text); the parts are null where plain."""
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    cut = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"), digest.alias("digest"))
    cut = cut.withColumn("n", F.size("units").cast("long"))
    one, two = (_draw(F.col("digest"), k) % (F.col("n") + 1) for k in (1, 2))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("text").contains(mark)
    form = F.when((F.col("n") == 0) | marked | (_draw(F.col("digest"), 3) % 100 >= 100 - plain), "plain")
    form = form.when(_draw(F.col("digest"), 4) % 100 < suffix_first, "spm").otherwise("psm")
    cut = cut.select("doc_id", "text", "units", "n", form.alias("form"), F.least(one, two).cast("int").alias("lo"), F.greatest(one, two).cast("int").alias("hi"))

    def part(begin: Column, size: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", begin + 1, size), ""))

    lo, hi = F.col("lo"), F.col("hi")
    parts = cut.select("doc_id", "text", "n", "form", part(F.lit(0), lo).alias("prefix"), part(lo, hi - lo).alias("middle"), part(hi, F.col("n").cast("int") - hi).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""

    def between(mark: str, until: str | None) -> Column:
        begin = F.instr(output, mark) + len(mark)
        return F.substring(output, begin, (F.instr(output, until) - begin) if until else F.length(output))

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each row of (doc_id, text)."""
    made = transform(docs).withColumn("restored", restore(F.col("output"), F.col("form")))
    long = lambda c: F.length(c).cast("long")
    return made.select("doc_id", "n", "form", long("prefix").alias("prefix_chars"), long("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def oracle() -> str:
    """The same for DuckDB, with the text itself where the restored one is due."""
    draw = lambda k: f"('0x' || substr(digest, {8 * k - 7}, 8))::BIGINT"
    marked = " OR ".join(f"contains(body, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    part = lambda b, e: f"array_to_string(units[{b} + 1 : {e}], '')"
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
drawn AS (
  SELECT *, len(units)::BIGINT AS n, {draw(1)} % (len(units) + 1) AS one, {draw(2)} % (len(units) + 1) AS two FROM cut),
formed AS (
  SELECT *, least(one, two) AS lo, greatest(one, two) AS hi,
         CASE WHEN n = 0 OR {marked} OR {draw(3)} % 100 >= {100 - PLAIN} THEN 'plain'
              WHEN {draw(4)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, n, body, form, {part("0", "lo")} AS prefix, {part("lo", "hi")} AS middle, {part("hi", "n")} AS suffix FROM formed)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts"""
