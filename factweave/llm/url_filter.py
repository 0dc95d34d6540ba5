"""URL filters by listed canonical URLs, in DataFrame functions alone.

Each entry of the rules or of the block list is a host and a path prefix; it fits its host, all subdomains, and each
path that starts with its own. A URL's possible entries are its host's suffixes, each with its path cut to the lengths
that paths of the list have. A blocked Bloom filter of the listed keys (four words of 64 bits a block, two bits in each
word) drops those that surely aren't listed, before anything of them is shuffled; an exact hash join on host and path
removes its false positives. The longest entry wins, ties go to the greater string; rules come before the block list.

The filter is always broadcast: it has BITS_PER_ENTRY bits for each entry and at most MOST_BLOCKS blocks, beyond which
more false positives reach the exact join. Lists up to BROADCAST_ENTRIES are broadcast for that join after they were
counted; longer ones are joined by shuffle. The list is a tuple of entries or a table with a column `entry`.

Defined results: a null url, or one without `://`, has an empty host and path and no rule; equal rows are all kept; an
empty list lets everything pass; other columns of the pages aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most entries that are broadcast: below 20 MB with their keys.
BROADCAST_ENTRIES = 100_000
#: Bits of the filter for each entry, and most blocks of 256 bits: about 50 MB.
BITS_PER_ENTRY, MOST_BLOCKS = 16, 1 << 19
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The list that stands for a production block list: sites that sell or track, under each of the test domains.
BLOCKED_SITES = tuple(f"{name}.example.{top}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def entries(spark: SparkSession, rules: tuple, blocked: tuple | DataFrame) -> DataFrame:
    """(entry, entry_host, entry_path, verdict, rank): rank 1 for rules, 0 for the block list; each entry once."""
    kind = "entry string, verdict string, rank int"
    listed = spark.createDataFrame([(e, v, 1) for v, e in rules], kind)
    if isinstance(blocked, DataFrame):
        listed = listed.union(blocked.where("entry is not null").select("entry", F.lit("block"), F.lit(0)).distinct())
    else:
        listed = listed.union(spark.createDataFrame([(e, "block", 0) for e in blocked], kind))
    cut = F.locate("/", "entry")
    host = F.when(cut > 0, F.substr("entry", F.lit(1), cut - F.lit(1))).otherwise(F.col("entry"))
    path = F.when(cut > 0, F.substr("entry", cut)).otherwise(F.lit(""))
    return listed.select("entry", F.translate(host, _UPPER, _LOWER).alias("entry_host"), path.alias("entry_path"), "verdict", "rank")


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks))


def _mask(host: Column, path: Column, word: int) -> Column:
    h = F.xxhash64(path, host, F.lit(word))
    one = F.lit(1).cast("long")
    bit = lambda n: F.call_function("shiftleft", one, F.shiftrightunsigned(h, n).bitwiseAND(63).cast("int"))
    return bit(0).bitwiseOR(bit(17))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """One row for each block that isn't empty: block, and its words w0 to w3."""
    host, path = F.col("entry_host"), F.col("entry_path")
    return listed.groupBy(_block(_key(host, path), blocks).alias("block")).agg(*(F.bit_or(_mask(host, path, w)).alias(f"w{w}") for w in range(4)))


def judge(pages: DataFrame, rules: tuple = RULES, blocked: tuple | DataFrame = BLOCKED_SITES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of each row of (page_id, url)."""
    spark = pages.sparkSession
    listed = entries(spark, rules, blocked)
    size = F.length("entry_path")
    # How many entries there are, and the lengths of their paths: at most as many as a path has characters.
    facts = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(size).alias("lengths")).first()
    small = F.broadcast if facts["n"] <= BROADCAST_ENTRIES else (lambda df: df)
    blocks = min(max(1, -(-facts["n"] * BITS_PER_ENTRY // 256)), MOST_BLOCKS)
    lengths = F.array(*(F.lit(n) for n in sorted(facts["lengths"]))).cast("array<int>")
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = split.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    # The verdict hangs on host and path alone: equal rows need no name of their own.
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(lengths, lambda n: n <= F.length("path"))
    tries = split.where(F.col("host") != "").withColumn("entry_host", F.explode(suffixes)).withColumn("n", F.explode(cuts))
    tries = tries.select("host", "path", "entry_host", F.substr("path", F.lit(1), F.col("n")).alias("entry_path"))
    tries = tries.withColumn("block", _block(_key(F.col("entry_host"), F.col("entry_path")), blocks))
    words = [F.col(f"w{w}").bitwiseAND(m) == m for w in range(4) for m in [_mask(F.col("entry_host"), F.col("entry_path"), w)]]
    possible = tries.join(F.broadcast(bloom(listed, blocks)), "block").where(words[0] & words[1] & words[2] & words[3]).select("host", "path", "entry_host", "entry_path").distinct()
    hits = possible.join(small(listed), ["entry_host", "entry_path"])
    order = F.struct("rank", F.length("entry"), "entry")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("entry", "verdict", "rank"), order).alias("best"), F.max(F.col("rank") == 0).alias("listed"))
    found = best.select("host", "path", F.when(F.col("best.rank") == 1, F.col("best.entry")).alias("rule"), F.col("best.verdict").alias("found"), "listed")
    return split.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("found", F.lit("allow")).alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))


def oracle(rules: tuple = RULES, blocked: tuple = BLOCKED_SITES) -> str:
    """The same in DuckDB, by comparing each URL with each entry."""
    values = ", ".join(f"('{e}', '{e.partition('/')[0]}', '{'/' + e.partition('/')[2]}', '{v}', {r})" for e, v, r in [(e, v, 1) for v, e in rules] + [(e, "block", 0) for e in blocked])
    return f"""
    WITH entries(entry, h, p, v, rank) AS (VALUES {values}),
    rest AS (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    pairs AS (SELECT DISTINCT host, path FROM split),
    best AS (SELECT host, path, arg_max(entry, (rank, length(entry), entry)) AS entry, arg_max(v, (rank, length(entry), entry)) AS v, max(rank) AS rank, bool_or(rank = 0) AS listed
             FROM pairs JOIN entries ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
    SELECT page_id, split.host AS host, split.path AS path, CASE WHEN rank = 1 THEN entry END AS rule, coalesce(v, 'allow') AS verdict, coalesce(listed, false) AS listed
    FROM split LEFT JOIN best ON split.host = best.host AND split.path = best.path"""
