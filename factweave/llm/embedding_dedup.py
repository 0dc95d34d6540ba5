"""Embedding near-duplicates by lattice hashing.

Each table projects the unit vectors onto eight random orthonormal directions, scales them, and decodes the result to
the nearest point of the lattice E8. A vector stands in its own cell and probes the PROBES cells whose walls are
nearest; two vectors are candidates where one's own cell is a cell of the other. Cosine in double precision decides.

Equal vectors are one class with a weight. Cells are worked out once and kept with the class. Only cells and numbers of
classes are shuffled to find the cells in which a pair can meet: those with two members, one of them at home there.
Vectors follow to these alone. Members of a cell are compared as blocks of a matrix; a cell with over BLOCK
members is cut into blocks and each pair of blocks is a task of its own, so no task holds more than 2 * BLOCK vectors.
A pair that meets in several cells counts only in the first of them, which both vectors name; so cells give one
count for each member and a spanning forest of its links, never the pairs.

Defined results: null or zero vectors, and vectors with a null or non-finite component, have no links and are their own
component; vectors of another length than the most common one are compared among their own length; rows with one
vec_id are each a vector with links of its own, and lie in one component; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ._components import components, least_labels
from ._shared import materialize

MIN_COSINE = 0.95
#: With these a pair at the threshold is found with a probability of about 0.997, a closer one more often.
TABLES, PROBES, SPREAD, SEED = 8, 3, 0.7, 20
#: Members of a cell that are compared at once, and rows of the comparison at a time.
BLOCK, SLAB = 4096, 256
_U = np.uint64


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with an even sum of integers (Conway and Sloane 1982)."""
    r = np.rint(x)
    e = x - r
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    k = np.abs(e[odd]).argmax(axis=1)
    r[odd, k] += np.where(e[odd, k] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 moved by one half in each direction; the nearer of both points."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def neighbours_e8() -> np.ndarray:
    """The 240 shortest vectors of E8: each is the way to a neighbouring cell."""
    whole = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(v) % 2 == 0]
    return np.array(whole + [list(v) for v in half])


_AROUND = neighbours_e8()


def _frames(dim: int) -> np.ndarray:
    """(TABLES, 8, dim): random directions, orthonormal as far as the dimension allows."""
    out = []
    for t in range(TABLES):
        g = np.random.default_rng([SEED, t, dim]).normal(size=(dim, 8))
        out.append(np.linalg.qr(g)[0].T if dim >= 8 else (g / np.linalg.norm(g, axis=0)).T)
    return np.stack(out) * SPREAD * np.sqrt(dim)


def cells(unit: np.ndarray) -> np.ndarray:
    """(vectors, TABLES, 1 + PROBES) keys of cells, a vector's own first. Depends on each row alone, to the last bit."""
    out = np.zeros((len(unit), TABLES, 1 + PROBES), _U)
    powers = np.cumprod(np.full(8, 0x9E3779B97F4A7C15, _U), dtype=_U)
    for t, frame in enumerate(_frames(unit.shape[1])):
        y = np.stack([(unit * d).sum(axis=1) for d in frame], axis=1)
        point = nearest_e8(y)
        toward = np.stack([((y - point)[:, None, :] * _AROUND[lo : lo + 60]).sum(axis=2) for lo in range(0, 240, 60)], axis=1).reshape(len(y), 240)
        ways = np.argsort(-toward, axis=1, kind="stable")[:, :PROBES]
        places = np.concatenate((point[:, None, :], point[:, None, :] + _AROUND[ways]), axis=1)
        key = ((places * 2).astype(np.int64).astype(_U) * powers).sum(axis=2, dtype=_U)
        key ^= key >> _U(29)
        out[:, t, :] = key * _U(0xBF58476D1CE4E5B9) + _U(t)
    return out


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # A vector is first brought to a largest component of 1: squares of tiny or huge ones stay in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (class, id, weight, embedding) with their length and the keys of their cells."""
    for b in batches:
        sizes = pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for lo in range(0, len(rows), 1000):
                part = b.take(pa.array(rows[lo : lo + 1000]))
                keys = cells(_unit(_matrix(part.column(3)).astype(np.float64))).reshape(len(part), -1)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(part), size, np.int32)), listed], names=["class", "id", "weight", "embedding", "dim", "cells"])


def linked(unit: np.ndarray, own: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j within the cosine, one of each pair at home in the cell; with two blocks, one of each block. SLAB rows at a time."""
    single = unit.astype(np.float32)
    for lo in range(0, len(unit), SLAB):
        # Single precision leaves out what is far below the threshold; double precision decides.
        near = single[lo : lo + SLAB] @ single[lo:].T >= MIN_COSINE - 1e-4
        i, j = np.nonzero(near)
        i += lo
        j += lo
        ok = (i < j) & (own[i] | own[j])
        if side is not None:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        sure = np.concatenate([(unit[i[k : k + (1 << 16)]] * unit[j[k : k + (1 << 16)]]).sum(axis=1) >= MIN_COSINE for k in range(0, len(i), 1 << 16)] or [np.zeros(0, bool)])
        if sure.any():
            yield i[sure], j[sure]


def first_meeting(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first cell where each pair (i, j) meets: by table, then i's own cell before j's."""
    out, open_ = np.zeros(len(i), _U), np.ones(len(i), bool)
    for t in range(keys.shape[1]):
        a, b = keys[i, t], keys[j, t]
        for cell, met in ((a[:, 0], (b == a[:, :1]).any(axis=1)), (b[:, 0], (a == b[:, :1]).any(axis=1))):
            now = open_ & met
            out[now] = cell[now]
            open_ &= ~met
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group in; (class, id, links, least id linked in the group) out."""
    held: list[pa.RecordBatch] = []

    def groups(b: pa.RecordBatch) -> tuple[list[tuple[int, int]], pa.RecordBatch]:
        key = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2, 3)], axis=1)
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        return list(zip([0, *cut], [*cut, b.num_rows], strict=True)), b

    def work(b: pa.RecordBatch, spans: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], []]
        for lo, hi in spans:
            if hi - lo < 2:
                continue
            part = b.slice(lo, hi - lo)
            cell, one, two = (part.column(k)[0].as_py() for k in (1, 2, 3))
            own, side, number, ids, weights = (part.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 6, 7, 8))
            unit = _unit(_matrix(part.column(9)).astype(np.float64))
            keys = _matrix(part.column(10)).view(_U).reshape(len(unit), TABLES, 1 + PROBES)
            links, label = np.zeros(len(unit), np.int64), np.arange(len(unit))
            for i, j in linked(unit, own, side if one != two else None):
                # Each pair names its first cell from the lesser class on, the same wherever it is met.
                swap = number[i] > number[j]
                first = first_meeting(keys, np.where(swap, j, i), np.where(swap, i, j)).view(np.int64) == cell
                links += np.bincount(i[first], weights[j[first]], len(unit)).astype(np.int64) + np.bincount(j[first], weights[i[first]], len(unit)).astype(np.int64)
                nodes, least = least_labels(label[i], label[j])
                label[nodes] = least
                label = label[label]
            members = np.bincount(label, minlength=len(unit))[label] > 1
            if not members.any():
                continue
            lowest = np.full(len(unit), np.iinfo(np.int64).max)
            np.minimum.at(lowest, label, ids)
            for column, values in zip(columns, (number, ids, links, lowest[label]), strict=True):
                column.append(values[members])
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["class", "id", "links", "least"])

    for b in batches:
        joined = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()
        held = []
        if not joined:
            continue
        spans, whole = groups(joined[0])
        yield from work(whole, spans[:-1])
        held = [whole.slice(spans[-1][0])]
    if held and held[0].num_rows:
        yield from work(held[0], [(0, held[0].num_rows)])


def dedup(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    # Doubles stay doubles: as single numbers tiny ones would be zero and large ones infinite.
    kind = "float" if vectors.schema["embedding"].dataType.elementType == FloatType() else "double"
    sound = F.coalesce(F.size(e) > 0, F.lit(False)) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), e.cast(f"array<{kind}>")).alias("embedding"))
    # Rows without an id take part under a number of their own, which no other class has.
    alike = rows.where(F.col("embedding").isNotNull()).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
    numbered = alike.select(F.monotonically_increasing_id().alias("class"), F.coalesce("first", F.xxhash64("embedding")).alias("id"), "weight", "embedding")
    classes = materialize(numbered.mapInArrow(_locate, f"class long, id long, weight long, embedding array<{kind}>, dim int, cells array<long>"), "classes")
    stands = classes.select("dim", "class", F.posexplode("cells").alias("place", "cell")).select("dim", "cell", (F.col("place") % (1 + PROBES) == 0).alias("own"), "class")
    # Where two can meet, with the number of blocks of the cell.
    shared = stands.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("home")).where("home AND n > 1")
    shared = shared.select("dim", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    meeting = stands.join(shared, ["dim", "cell"]).withColumn("side", F.pmod(F.xxhash64("class", "cell"), "blocks").cast("int"))
    placed = meeting.join(classes.drop("dim"), "class").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = placed.select("dim", "cell", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "own", "side", "class", "id", "weight", "embedding", "cells")
    compared = materialize(grouped.repartition("dim", "cell", "one", "two").sortWithinPartitions("dim", "cell", "one", "two").mapInArrow(_compare, "class long, id long, links long, least long"), "links")
    found = components(compared.select(F.col("id").alias("a"), F.col("least").alias("b")))
    links = compared.groupBy("class").agg(F.sum("links").alias("links"))
    by_class = classes.select("class", "id", "weight", "embedding").join(links, "class", "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    by_class = materialize(by_class.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "by-class")
    out = rows.join(by_class, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
