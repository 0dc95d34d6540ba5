"""Fingerprints of documents: a Merkle tree over pieces, paragraphs and sections, in DataFrame functions alone.

Paragraphs are lines. A section ends after an empty line or after a paragraph whose hash begins with 0 or 1, so that an
edit moves no other section's ends. Below a paragraph stand its pieces, which end after `.`, `!` and `?` or after
PIECE code points. A paragraph's node is the hash of its text, a section's that of the nodes and pieces of its
paragraphs, the root that of the section nodes. So equal roots mean equal texts, and where roots differ one looks only
into sections whose nodes differ, and there only into paragraphs whose nodes differ (`edits`).

The fingerprint is the tree as text: the root; for each section a `/` and its node; for each of its paragraphs `;`, its
node, `:` and its pieces, each 8 digits of its hash and two of its length. The likeness of two fingerprints is the share
of code points in pieces that both have, a piece that occurs again counting again.

Each document also meets the next one in descending order of ids. The order is found on keys alone, slice by slice, with
one row a slice to join the slices. Texts are shuffled once, by key; a document's first code points and its fingerprint
then go to the one before it.

Defined results: a null text counts as empty; its root is the hash of nothing, and it has no section; two empty texts have
likeness 1; rows with one doc_id are ordered by a hash of their text, and equal rows are one document in that order and
get equal results; a null doc_id comes last; the only document's next one is itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

PARAGRAPH = "[^\\n]+\\n?|\\n"
PIECE = 32
PIECES = f"[^.!?\\n]{{1,{PIECE}}}[.!?\\n]{{0,8}}|[.!?\\n]{{1,8}}"
#: Digits of nodes within a fingerprint, of a piece's hash, and of a piece in all.
NODE, HASH, LEAF = 16, 8, 10


def _pieces(paragraph: Column) -> Column:
    leaf = lambda x: F.concat(F.substring(F.md5(x), 1, HASH), F.lpad(F.lower(F.hex(F.length(x))), LEAF - HASH, "0"))
    return F.array_join(F.transform(F.regexp_extract_all(paragraph, F.lit(PIECES), F.lit(0)), leaf), "")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a column `name`, the fingerprint of the column `text`, which has no nulls."""
    paragraphs = F.transform(F.regexp_extract_all(F.col(text), F.lit(PARAGRAPH), F.lit(0)), lambda p: F.struct(F.sha2(p, 256).alias("node"), p.alias("text")))
    last = lambda p: (p["text"] == "\n") | (p["node"] < "2")
    entries = F.transform(paragraphs, lambda p: F.concat(F.lit(";"), p["node"], F.lit(":"), _pieces(p["text"]), F.when(last(p), "/").otherwise("")))
    sections = F.filter(F.split(F.array_join(entries, ""), "/"), lambda s: s != "")
    nodes = df.withColumn("tree sections", F.transform(sections, lambda s: F.struct(F.sha2(s, 256).alias("node"), s.alias("below"))))
    root = F.sha2(F.array_join(F.transform("tree sections", lambda s: s["node"]), ""), 256)
    branch = lambda s: F.concat(F.lit("/"), F.substring(s["node"], 1, NODE), F.regexp_replace(s["below"], f";([0-9a-f]{{{NODE}}})[0-9a-f]*:", ";$1:"))
    return nodes.withColumn(name, F.concat(root, F.array_join(F.transform("tree sections", branch), ""))).drop("tree sections")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each row of (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
    return with_fingerprint(rows, "text", "fingerprint").select("doc_id", "n_chars", "fingerprint")


def _root(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 64)


def _leaf_list(tree: Column) -> Column:
    """The pieces of a fingerprint, or of a branch of it, in order."""
    return F.regexp_extract_all(F.array_join(F.regexp_extract_all(tree, F.lit(":([0-9a-f]*)"), F.lit(1)), ""), F.lit(f".{{{LEAF}}}"), F.lit(0))


def leaves(fingerprint: Column) -> Column:
    """The pieces of a fingerprint, equal ones numbered, so that sets of them count as multisets."""
    # Equal pieces stand side by side after the sort; each run of them is one match.
    runs = F.regexp_extract_all(F.array_join(F.sort_array(_leaf_list(fingerprint)), ","), F.lit(f"([0-9a-f]{{{LEAF}}})(?:,\\1)*"), F.lit(0))
    numbered = lambda run: F.transform(F.sequence(F.lit(1), ((F.length(run) + 1) / (LEAF + 1)).cast("int")), lambda k: F.concat(F.substring(run, 1, LEAF), k.cast("string")))
    return F.flatten(F.transform(runs, numbered))


def _weight(pieces: Column) -> Column:
    size = lambda x: F.conv(F.substring(x, HASH + 1, LEAF - HASH), 16, 10).cast("long")
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda total, x: total + size(x))


def with_likeness(df: DataFrame, one: str, others: dict[str, str]) -> DataFrame:
    """df with the likeness of the fingerprint `one` to each of the fingerprints `others`, under their new names."""
    out = df.withColumn("own leaves", leaves(F.col(one))).withColumn("own weight", _weight(F.col("own leaves")))
    for other, name in others.items():
        out = out.withColumn("other leaves", leaves(F.col(other)))
        both = _weight(F.array_intersect("own leaves", "other leaves"))
        share = 2.0 * both / (F.col("own weight") + _weight(F.col("other leaves")))
        out = out.withColumn(name, F.when(_root(F.col(one)) == _root(F.col(other)), 1.0).when(F.size("own leaves") + F.size("other leaves") > 0, share).otherwise(0.0)).drop("other leaves")
    return out.drop("own leaves", "own weight")


def edits(pairs: DataFrame) -> DataFrame:
    """(doc_id, section, paragraph, start, n_chars) of the paragraphs of `fingerprint` whose nodes are in no section of `other`
    that differs: where they stand, from 0, and where they begin and how long they are in code points.

    Equal roots give no row; sections that both have are only counted over."""
    rows = pairs.where(_root(F.col("fingerprint")) != _root(F.col("other"))).select(F.monotonically_increasing_id().alias("pair"), "doc_id", F.split("fingerprint", "/").alias("own"), F.split("other", "/").alias("there"))
    rows = materialize(rows, "differing")
    node = f";([0-9a-f]{{{NODE}}}):"
    known = rows.select("pair", F.explode(F.array_except("there", "own")).alias("below")).select("pair", F.explode(F.regexp_extract_all("below", F.lit(node), F.lit(1))).alias("node")).distinct()
    marked = F.transform(F.slice("own", 2, 1 << 30), lambda s: F.struct(s.alias("below"), _weight(_leaf_list(s)).alias("size"), (~F.array_contains("there", s)).alias("changed")))
    before = lambda *keys: F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sections = rows.select("pair", "doc_id", F.posexplode(marked).alias("place", "s")).select("pair", "doc_id", "place", "s.*").withColumn("start", before("pair"))
    changed = sections.where("changed").select("pair", "doc_id", F.col("place").alias("section"), "start", F.posexplode(F.slice(F.split("below", ";"), 2, 1 << 30)).alias("place", "entry"))
    parts = changed.withColumn("size", _weight(_leaf_list(F.col("entry")))).withColumn("start", F.col("start") + before("pair", "section"))
    found = parts.withColumn("node", F.substring("entry", 1, NODE)).join(known, ["pair", "node"], "left_anti")
    return found.select("doc_id", F.col("section").cast("long"), F.col("place").cast("long").alias("paragraph"), "start", F.col("size").alias("n_chars"))


def next_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, next_id, next_mark, wanted) of each distinct key of (doc_id, mark, n_chars): the key that follows it in
    descending order, after the last the first, and how many code points of that text it asks for.

    Keys alone are sorted, slice by slice; one row a slice says where the next one begins."""
    order = [F.desc_nulls_last("doc_id"), F.desc("mark")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.groupBy("doc_id", "mark").agg(F.max("n_chars").alias("n_chars"))
    # Written once, as the slices must stay as they are.
    slices = materialize(keys.repartitionByRange(parts, *order).withColumn("slice", F.spark_partition_id()), "keys")
    key = F.struct(F.col("doc_id").alias("next_id"), F.col("mark").alias("next_mark"))
    firsts = slices.groupBy("slice").agg(F.max(key).alias("first"))  # nulls are the least, as in the order
    ends = firsts.withColumn("after", F.coalesce(F.lead("first").over(Window.orderBy("slice")), F.max("first").over(Window.partitionBy())))
    follows = F.lead(key).over(Window.partitionBy("slice").orderBy(*order))
    rows = slices.withColumn("follows", follows).join(ends.select("slice", "after"), "slice").withColumn("follows", F.coalesce("follows", "after"))
    return rows.select("doc_id", "mark", "follows.*", F.expr("n_chars div 3").alias("wanted"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of each row of (doc_id, text): the
    text whose last third is replaced by the beginning of the next document's, and how near both are."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"), F.length(text).cast("long").alias("n_chars"))
    follows = materialize(next_keys(rows), "follows")
    # Keys without nulls, so that both joins find the texts dealt alike and Spark shuffles them once.
    key = lambda i, m: [F.coalesce(F.col(i).cast("long"), F.lit(0).cast("long")).alias("key_id"), F.col(i).isNull().alias("key_null"), F.col(m).alias("key_mark")]
    keys = ["key_id", "key_null", "key_mark"]
    keyed = rows.select(*key("doc_id", "mark"), "text")  # the same columns for both
    asked = follows.select(*key("next_id", "next_mark"), F.struct(*key("doc_id", "mark")).alias("to"), "wanted")
    met = keyed.join(asked.hint("shuffle_hash"), keys).select("to.*", F.expr("substring(text, 1, cast(wanted as int))").alias("head"), "text")
    # Of equal rows one answers. Summed up by the keys of the join, so that answers are shuffled once as well.
    answers = with_fingerprint(met, "text", "next_fingerprint").groupBy(*keys).agg(F.first(F.struct("head", "next_fingerprint")).alias("answer")).select(*keys, "answer.*")
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), head)")
    own = keyed.join(answers, keys).withColumn("n_chars", F.length("text").cast("long"))
    both = own.select(F.when(~F.col("key_null"), F.col("key_id")).alias("doc_id"), "n_chars", "text", edited.alias("edited"), "next_fingerprint")
    both = with_fingerprint(with_fingerprint(both, "text", "fingerprint"), "edited", "edited_fingerprint")
    near = with_likeness(both, "fingerprint", {"edited_fingerprint": "near_edited", "next_fingerprint": "near_next"})
    return near.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of (doc_id, text)."""
    found = compare_with_next(docs)
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def oracle() -> str:
    """The same for DuckDB."""
    line = lambda pattern: pattern.replace("\\n", "' || chr(10) || '")
    leaf = f"substr(md5(x), 1, {HASH}) || printf('%0{LEAF - HASH}x', length(x))"
    pieces = f"array_to_string(list_transform(regexp_extract_all(p, '{line(PIECES)}'), lambda x: {leaf}), '')"
    entry = f"';' || sha256(p) || ':' || {pieces} || CASE WHEN p = chr(10) OR sha256(p) < '2' THEN '/' ELSE '' END"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
ring AS (
  SELECT *, coalesce(lead(doc_id) OVER w, max(doc_id) OVER ()) AS next_id,
         coalesce(lead(body) OVER w, first_value(body) OVER (ORDER BY doc_id DESC)) AS next_body
  FROM base WINDOW w AS (ORDER BY doc_id DESC)),
edited AS (
  SELECT doc_id, n_chars, next_id, body, substr(body, 1, n_chars - n_chars // 3) || substr(next_body, 1, n_chars // 3) AS changed FROM ring),
texts AS (SELECT doc_id, 1 AS kind, body FROM edited UNION ALL SELECT doc_id, 2, changed FROM edited),
cut AS (
  SELECT doc_id, kind, list_filter(string_split(array_to_string(list_transform(regexp_extract_all(body, '{line(PARAGRAPH)}'),
         lambda p: {entry}), ''), '/'), lambda s: s <> '') AS sections FROM texts),
printed AS (
  SELECT doc_id, kind, sha256(array_to_string(list_transform(sections, lambda s: sha256(s)), '')) AS root,
         array_to_string(list_transform(sections, lambda s: '/' || substr(sha256(s), 1, {NODE}) || regexp_replace(s, ';([0-9a-f]{{{NODE}}})[0-9a-f]*:', ';\\1:', 'g')), '') AS tree,
         regexp_extract_all(array_to_string(regexp_extract_all(array_to_string(sections, ''), ':([0-9a-f]*)', 1), ''), '.{{{LEAF}}}') AS leaves FROM cut),
counted AS (
  SELECT doc_id, kind, leaf, count(*) AS n, ('0x' || substr(leaf, {HASH + 1}))::BIGINT AS size
  FROM (SELECT doc_id, kind, unnest(leaves) AS leaf FROM printed) GROUP BY ALL),
weights AS (SELECT doc_id, kind, sum(n * size) AS weight FROM counted GROUP BY ALL),
met AS (
  SELECT doc_id, 'near_edited' AS what, doc_id AS other, 2 AS kind FROM edited
  UNION ALL SELECT doc_id, 'near_next', next_id, 1 FROM edited),
shared AS (
  SELECT m.doc_id, m.what, sum(least(a.n, b.n) * a.size) AS both_have
  FROM met m JOIN counted a ON a.doc_id = m.doc_id AND a.kind = 1
  JOIN counted b ON b.doc_id = m.other AND b.kind = m.kind AND b.leaf = a.leaf GROUP BY ALL),
near AS (
  SELECT m.doc_id, m.what,
         CASE WHEN p.root = q.root THEN 1.0 WHEN p.tree = '' AND q.tree = '' THEN 0.0
              ELSE (2.0 * coalesce(s.both_have, 0)::DOUBLE) / (coalesce(a.weight, 0) + coalesce(b.weight, 0))::DOUBLE END AS share
  FROM met m JOIN printed p ON p.doc_id = m.doc_id AND p.kind = 1 JOIN printed q ON q.doc_id = m.other AND q.kind = m.kind
  LEFT JOIN weights a ON a.doc_id = m.doc_id AND a.kind = 1 LEFT JOIN weights b ON b.doc_id = m.other AND b.kind = m.kind
  LEFT JOIN shared s ON s.doc_id = m.doc_id AND s.what = m.what)
SELECT e.doc_id, e.n_chars, sha256(e.changed) AS edited_sha256, p.root || p.tree AS fingerprint, q.root || q.tree AS edited_fingerprint,
       x.share::DOUBLE AS near_edited, y.share::DOUBLE AS near_next
FROM edited e JOIN printed p ON p.doc_id = e.doc_id AND p.kind = 1 JOIN printed q ON q.doc_id = e.doc_id AND q.kind = 2
JOIN near x ON x.doc_id = e.doc_id AND x.what = 'near_edited' JOIN near y ON y.doc_id = e.doc_id AND y.what = 'near_next'"""
