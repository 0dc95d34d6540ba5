"""Plumbing shared by the corpus operators: tables, shared storage, Arrow batches, bounded samples."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points handled at once inside a Python worker; a single longer text is handled alone.
CHUNK_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        root = root.rsplit("/", 1)[0] if root else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'factweave-shared')}"
    return root.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/factweave/{tag}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit
        return


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: no lost executor makes Spark compute it again."""
    path = fresh_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(texts: Iterable[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most `limit` code points together, or one longer text."""
    texts, begin, total = list(texts), 0, 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > limit:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def laid_out(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches flat[begin : begin + size], one behind the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordIndex:
    """Places of words whose encoding is kept in columns beside it; at most `limit` words, beyond which it goes on with
    those at hand."""

    def __init__(self, limit: int):
        self.limit, self.words = limit, pa.array([], pa.large_string())

    def find(self, words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray | None]:
        """The place of each of the distinct words; those that are new, which stand at the end in their order; and, where
        others had to go, the former places of the words that stay."""
        found = pc.index_in(words, value_set=self.words)
        new = found.is_null().to_numpy(zero_copy_only=False)
        places, fresh, stay = found.fill_null(0).to_numpy().astype(np.int64), words.filter(pa.array(new)), None
        if len(fresh) and len(self.words) + len(fresh) > self.limit:
            stay = places[~new]
            places[~new] = np.arange(len(stay))
            self.words = self.words.take(pa.array(stay))
        places[new] = len(self.words) + np.arange(len(fresh))
        if len(fresh):
            self.words = pa.concat_arrays([self.words, fresh])
        return places, fresh, stay


def map_texts(df: DataFrame, key: str, text: str, work: Callable[[list[str | None]], dict], schema: str, limit: int = CHUNK_CHARS) -> DataFrame:
    """`work` gets a list of whole texts and returns columns of equal length; `key` is passed on first, in its own
    type, whatever `schema` calls it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0)
            for i, j in chunks([t or "" for t in texts], limit):
                out = work(texts[i:j])
                names = list(out)
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), *(x if isinstance(x, pa.Array) else pa.array(x) for x in out.values())], names=[key, *names])

    own = f"`{key}` {df.schema[key].dataType.simpleString()}, {schema.split(', ', 1)[1]}"
    return df.select(key, text).mapInArrow(run, own)


def sample_per_stratum(df: DataFrame, key: str, stratum: str, rows: int) -> DataFrame:
    """The rows of about 2 * `rows` keys of each stratum at most, by a hash of `key`; the caller keeps the `rows` least.

    The thresholds come from the number of keys, to about 2 %, whatever the order of the input; a key that many rows share
    counts once, so that it leaves room for the others."""
    counts = {r[0]: max(r[1], 1) for r in df.groupBy(stratum).agg(F.approx_count_distinct(key, 0.02)).collect() if r[0] is not None}
    if not counts:
        return df.limit(0).withColumn("sample_hash", F.lit(0).cast("long"))
    share = F.create_map(*(x for s, n in counts.items() for x in (F.lit(s), F.lit(min(1.0, 2.0 * rows / n)))))
    h = F.xxhash64(F.col(key), F.lit(97))
    return df.withColumn("sample_hash", h).where(F.col(stratum).isNotNull() & ((h.cast("double") / 2.0**64 + 0.5) <= F.element_at(share, F.col(stratum))))


def least_hashes(rows: list, stratum: Callable, hashed: Callable, limit: int) -> list:
    """Of collected rows, the `limit` with the least hashes in each stratum, in a fixed order."""
    by: dict = {}
    for r in rows:
        by.setdefault(stratum(r), []).append(r)
    return [r for s in sorted(by, key=str) for r in sorted(by[s], key=hashed)[:limit]]
