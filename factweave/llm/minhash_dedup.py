"""MinHash near-duplicates by an LSH forest.

Each tree orders the documents by a sequence of MinHash values: the tree's own DEPTH values first, then further ones in an
order of its own. The orders are sorted over all partitions; documents that share their first DEPTH values in a tree are
a region, a run of that order, and within a region the neighbours with the longest common prefix stand side by side.

Documents with equal shingle sets are one class from the start. Round one confirms, for each class, the neighbours with
the longest common prefixes, those that meet in two trees or share LONG values: in a group of copies each has several,
so nearly all of a group hang together after it. Round two takes all regions in which different groups still meet, and
compares every member with every member of another group, by signature first; then the texts of those that have a
partner are brought to the region, and pairs are confirmed, the likeliest first, until no pair between different groups
is left. Only links that join groups leave a task, never the pairs. A region of over BLOCK members is compared block by
block.

Depth adapts to the region: one of over DEEP members is cut by further values into deeper regions, by SPLITS sets of
values, so that a pair is not lost because one value differs, and so again, as long as that halves the pairs to compare.
A region whose members are too alike for that stays whole and is compared block by block, by signature, pair by pair. A
pair that meets in cut regions alone is looked for in all of them. Signatures only leave out pairs that agree in less than ESTIMATE of their values, more than
four standard deviations below the threshold; every link rests on full sets.

With 24 trees of 4 values a pair at the threshold of 0.75 meets with a probability of 0.9999. Where all its regions are cut
once it still meets with one of 0.9997, by the same reckoning: 1 - (1 - p (1 - (1 - p)^6))^24 with p = 0.75^4.

Defined results: words are runs of characters other than space and tab to carriage return, in lower-case A-Z; fewer
than five words are one shingle; null and empty texts have no shingle and no link; a null doc_id has no link and is
kept; rows that share a doc_id share its component; texts are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, least_labels
from ._ngrams import Words, mix
from ._shared import chunks, map_texts, materialize

SHINGLE, PERCENT = 5, 75
TREES, DEPTH = 24, 4
HASHES = TREES * DEPTH
#: Values that order a region, one byte of each.
FURTHER = 8
#: Round one: neighbours of each class, and the common prefix that makes one without a second tree.
NEIGHBOURS, LONG = 3, 7
#: Members of a region, and words in their sets, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 1000, 1 << 19
#: Members from which a region is cut by further values, the sets of values, and how often at most.
DEEP, SPLITS, LEVELS = 8000, 6, 20
ESTIMATE = 0.55
#: Long texts of one batch that are hashed at once, in code points.
TOGETHER = 1 << 20
_U = np.uint64
_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_STEP = _U(0x9E3779B97F4A7C15)
#: The tree of a region is in the last bits of its key.
_TREE = _U(31)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, in order of the texts, and where each text's begin."""
    words = Words(texts, lower_ascii=True)
    hashes, owner = words.windows(SHINGLE)
    for size in range(1, SHINGLE):
        short = np.flatnonzero(words.n_words == size)
        if len(short):
            h, o = words.windows(size)
            own = np.isin(o, short)
            hashes, owner = np.concatenate((hashes, h[own] + _U(size))), np.concatenate((owner, o[own]))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, HASHES) of uint32; rows of texts without shingles are zero."""
    n = len(starts) - 1
    out = np.zeros((n, HASHES), np.uint32)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        at = starts[full]
        for m in range(HASHES):
            out[full, m] = np.minimum.reduceat((hashes ^ _SEEDS[m]) * (_SEEDS[HASHES + m] | _U(1)), at) >> _U(32)
    return out


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature): the set's size, two hashes of it as a whole, and its MinHash values."""

    def work(texts: list[str | None]) -> dict:
        hashes, starts = shingle_sets([t or "" for t in texts])
        sums = [np.diff(np.concatenate((np.zeros(1, _U), np.cumsum(h, dtype=_U)))[starts]) for h in (mix(hashes.copy()), mix(hashes * _U(0xD6E8FEB86659FD93)))]
        return {
            "n_shingles": np.diff(starts).astype(np.int64),
            "set_a": sums[0].view(np.int64),
            "set_b": sums[1].view(np.int64),
            "signature": pa.array([row.tobytes() for row in signatures(hashes, starts)], pa.binary()),
        }

    return map_texts(docs, "doc_id", "text", work, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def further_values(tree: int, level: int) -> np.ndarray:
    """Places of values other than the tree's own, in an order that hangs on the tree and the level."""
    rest = np.delete(np.arange(HASHES), np.arange(tree * DEPTH, tree * DEPTH + DEPTH))
    return np.random.default_rng([tree, level]).permutation(rest)


def forest(classes: DataFrame) -> DataFrame:
    """(key, further, id): the place of each class in the order of each tree. `key` stands for the first DEPTH values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                ids, sig = b.column(0).slice(lo, 2000), _values(b.column(1).slice(lo, 2000)).astype(_U)
                keys, rest = [], []
                for t in range(TREES):
                    key, low = np.full(len(sig), t + 1, _U), np.zeros(len(sig), _U)
                    for k in range(t * DEPTH, t * DEPTH + DEPTH):
                        key = mix(key * _STEP + sig[:, k])
                    for k in further_values(t, 0)[:FURTHER]:
                        low = low << _U(8) | sig[:, k] & _U(255)
                    keys.append(key & ~_TREE | _U(t))
                    rest.append(low)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c).view(np.int64)) for c in (keys, rest)), pa.concat_arrays([ids] * TREES)], names=["key", "further", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key long, further long, id long")


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes that are equal."""
    differ = a ^ b
    return np.sum([differ < _U(1) << _U(s) for s in range(0, 64, 8)], axis=0)


def neighbours(order: DataFrame) -> DataFrame:
    """(key, id, near, prefix) of the members of regions: `near` shares the longest prefix, of that many values.

    The rows are those of one sorted partition. Its first and last row are named even if alone, without a `near`: the
    rest of their region may be in the next partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        key, further, ids = np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
        left = np.zeros(0, np.int64)  # common prefix of each row that is held with the one before it
        before = np.zeros(0, np.int64)

        def out(right: np.ndarray, after: np.ndarray, edge: bool) -> Iterator[pa.RecordBatch]:
            """Of the rows held, with the prefixes they share with the next ones."""
            n = len(right)
            best = np.maximum(left[:n], right)
            near = np.where(left[:n] >= right, before[:n], after)
            take = best > 0
            if edge:
                take[-1] = True
            if not begun and n:
                take[0] = True
            if take.any():
                alone = best[take] == 0
                yield pa.RecordBatch.from_arrays([pa.array(key[:n][take]), pa.array(ids[:n][take]), pa.array(near[take], mask=alone), pa.array(best[take].astype(np.int32), mask=alone)], names=["key", "id", "near", "prefix"])

        for b in batches:
            if not b.num_rows:
                continue
            k, f, i = b.column(0).to_numpy(), b.column(1).to_numpy().view(_U), b.column(2).to_numpy()
            last = len(key)
            key, further, ids = np.concatenate((key, k)), np.concatenate((further, f)), np.concatenate((ids, i))
            shared = np.where(key[1:] == key[:-1], DEPTH + common_prefix(further[1:], further[:-1]), 0)
            new_left = np.concatenate(([0], shared))
            left = np.concatenate((left, new_left[last:]))
            before = np.concatenate((before, np.concatenate((ids[:1], ids[:-1]))[last:]))
            yield from out(shared, ids[1:], False)
            begun = begun or len(key) > 1
            key, further, ids, left, before = key[-1:], further[-1:], ids[-1:], left[-1:], before[-1:]
        if len(key):
            yield from out(np.zeros(1, np.int64), ids, True)

    return order.mapInArrow(run, "key long, id long, near long, prefix int")


def met(classes: DataFrame) -> DataFrame:
    """The regions of all trees, from their sorted orders."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(neighbours(forest(classes).repartitionByRange(parts, "key", "further", "id").sortWithinPartitions("key", "further", "id")), "regions")


def _by_tile(sorted_rows: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`work` gets all rows of a tile, the first column; the rows come sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            tile = b.column(0).to_numpy()
            edges = np.flatnonzero(tile[1:] != tile[:-1]) + 1
            if held and held[-1].column(0)[0].as_py() != tile[0]:
                yield from whole(held)
                held = []
            for lo, hi in zip([0, *edges[:-1]], edges, strict=False):
                yield from whole([*held, b.slice(lo, hi - lo)])
                held = []
            held.append(b.slice(edges[-1] if len(edges) else 0))
        if held:
            yield from whole(held)

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(parts[0] if len(parts) == 1 else pa.concat_batches(parts))

    return sorted_rows.mapInArrow(run, schema)


def sets_of(texts: list[str]) -> list[np.ndarray]:
    """The shingle set of each text, sorted."""
    sets: list[np.ndarray] = []
    for lo, hi in chunks(texts, TOGETHER):
        hashes, starts = shingle_sets(texts[lo:hi])
        sets += [hashes[x:y] for x, y in zip(starts[:-1], starts[1:], strict=True)]
    return sets


def similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the full sets of each pair (i, j) are similar enough."""
    sizes = np.array([len(x) for x in sets], np.int64)
    out = (sizes[i] > 0) & (sizes[j] > 0) & (100 * np.minimum(sizes[i], sizes[j]) >= PERCENT * np.maximum(sizes[i], sizes[j]))
    fits = np.flatnonzero(out)
    fits = fits[np.argsort(i[fits], kind="stable")]
    edges = [*np.flatnonzero(np.diff(i[fits], prepend=-1)).tolist(), len(fits)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        own = sets[i[fits[lo]]]
        for at in range(lo, hi, 500):
            some = fits[at : min(at + 500, hi)]
            there, n = np.concatenate([sets[k] for k in j[some]]), sizes[j[some]]
            spot = np.minimum(np.searchsorted(own, there), len(own) - 1)
            both = np.add.reduceat((own[spot] == there).astype(np.int64), np.cumsum(n) - n)
            out[some] = 100 * both >= PERCENT * (len(own) + n - both)
    return out


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs (tile, a, b) whose full shingle sets are similar enough.

    A tile's documents meet in one task, each once, however many pairs of the tile it is in."""
    members = pairs.select("tile", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    brought = members.join(texts, "doc_id").select("tile", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = brought.unionAll(pairs.select("tile", "a", "b", F.lit(None).cast("string").alias("text"))).repartition("tile").sortWithinPartitions("tile")

    def work(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = rows.column(1).to_numpy(), rows.column(2)
        is_text = b.is_null().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(is_text)
        ids, sets = a[at], sets_of(rows.column(3).take(pa.array(at)).to_pylist())
        spots: dict[int, list[int]] = {}
        for k, d in enumerate(ids.tolist()):
            spots.setdefault(d, []).append(k)
        pairs = zip(a[~is_text].tolist(), b.filter(pa.array(~is_text)).to_pylist(), strict=True)
        both = np.array([(k, m) for x, y in pairs for k in spots.get(x, ()) for m in spots.get(y, ())], np.int64).reshape(-1, 2)
        sure = both[similar(sets, both[:, 0], both[:, 1])]
        if len(sure):
            yield pa.RecordBatch.from_arrays([pa.array(ids[sure[:, k]]) for k in (0, 1)], names=["a", "b"])

    return _by_tile(rows, work, "a long, b long")


def first_pairs(regions: DataFrame) -> DataFrame:
    """(tile, a, b): each class with the neighbours that share the longest prefixes with it."""
    seen = regions.where("near is not null and near <> id").groupBy("id", "near").agg(F.max("prefix").alias("prefix"), F.count(F.lit(1)).alias("trees"))
    good = seen.where((F.col("trees") > 1) | (F.col("prefix") >= LONG))
    # At most two neighbours a tree, so each list is short.
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.col("trees") + F.col("prefix"), F.xxhash64("id", "near"), "near")), asc=False), 1, NEIGHBOURS)
    pairs = good.groupBy("id").agg(best.alias("best"), F.least("id", F.min("near")).alias("tile")).select("tile", "id", F.explode("best.near").alias("near"))
    return pairs.groupBy(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).agg(F.min("tile").alias("tile")).select("tile", "a", "b")


def deeper(members: DataFrame, units: DataFrame, level: int) -> DataFrame:
    """(parent, key, id, component): the members (key, id, component) of too large regions, each in SPLITS regions that share
    DEPTH values more."""
    rows = members.join(units.select("id", "signature"), "id").select("key", "id", "component", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, sig = b.column(0).to_numpy().view(_U), _values(b.column(3)).astype(_U)
            tree = (key & _TREE).astype(np.int64)
            for split in range(SPLITS):
                new = mix(key * _STEP + _U(split + 1))
                for t in np.unique(tree):
                    own = np.flatnonzero(tree == t)
                    for place in further_values(int(t), level * SPLITS + split + 1)[:DEPTH]:
                        new[own] = mix(new[own] * _STEP + sig[own, place])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array((new & ~_TREE | key & _TREE).view(np.int64)), b.column(1), b.column(2)], names=["parent", "key", "id", "component"])

    return rows.mapInArrow(run, "parent long, key long, id long, component long")


def open_regions(regions: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id, component) of the members of regions in which different groups meet, and (id, cut): bits of the trees whose
    region of a member was cut.

    A too large region is cut only where that halves the pairs to compare; else it stays whole and is compared block by
    block, which is never more than all its pairs. So no series of cuts makes more rows than a few times its members."""
    rows = materialize(regions.select("key", "id").join(units.select("id", "component"), "id").select("key", "id", "component"), "members")
    sizes = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    done, cuts = [], units.select("id", F.lit(0).alias("cut")).limit(0)
    for level in range(LEVELS + 1):
        counts = sizes(rows, "key")
        large = materialize(counts.where(F.col("n") > DEEP).select(F.col("key").alias("parent"), "n"), "large")
        if level == LEVELS or not large.limit(1).count():
            done.append(rows.join(counts.select("key"), "key"))
            break
        tried = materialize(deeper(rows.join(large.select(F.col("parent").alias("key")), "key"), units, level), "deeper")
        left = sizes(tried, "parent", "key").groupBy("parent").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        pays = materialize(large.join(left, "parent", "left").select("parent", (2 * F.coalesce("pairs", F.lit(0.0)) <= F.col("n") * F.col("n")).alias("pays")), "pays")
        whole = counts.join(pays.where("pays").select(F.col("parent").alias("key")), "key", "left_anti")
        done.append(rows.join(whole.select("key"), "key"))
        if level == 0:
            cuts = tried.join(pays.where("pays"), "parent").groupBy("id").agg(F.bit_or(F.expr("shiftleft(1, cast(parent & 31 as int))")).alias("cut"))
        rows = materialize(tried.join(pays.where("pays"), "parent").select("key", "id", "component"), "cut")
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out, cuts


def compared(ids: np.ndarray, roots: np.ndarray, sizes: np.ndarray, side: np.ndarray, cut: np.ndarray, sig: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of pairs between different groups, in two blocks between them, whose signatures agree enough, and in how
    many values they agree. A pair is this tree's if it is the first one that they share whose region is whole; pairs that
    share cut regions only are taken in each."""
    names, spot, counts = np.unique(roots, return_inverse=True, return_counts=True)
    home = spot == counts.argmax()  # these have no pair among themselves
    rest = np.flatnonzero(~home)
    crossing = len(np.unique(side)) > 1
    left, right, score = [rest[:0]], [rest[:0]], [np.zeros(0, np.uint8)]
    for lo in range(0, len(rest), 128):
        i = rest[lo : lo + 128]
        agree = np.zeros((len(i), len(ids)), np.uint8)
        for m in range(HASHES):
            agree += sig[i, m, None] == sig[None, :, m]
        ok = (agree >= ESTIMATE * HASHES) & (roots[i, None] != roots) & (home | (ids[i, None] < ids))
        ok &= 100 * np.minimum(sizes[i, None], sizes) >= PERCENT * np.maximum(sizes[i, None], sizes)
        if crossing:
            ok &= side[i, None] != side
        x, y = np.nonzero(ok)
        for k in range(0, len(x), 1 << 16):
            u, v = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            whole = (sig[i[u]] == sig[v]).reshape(-1, TREES, DEPTH).all(axis=2) & (cut[v, None] >> np.arange(TREES) & 1 == 0)
            first = ~whole.any(axis=1) | (whole.argmax(axis=1) == tree)
            left.append(i[u[first]])
            right.append(v[first])
            score.append(agree[u[first], v[first]])
    return np.concatenate(left), np.concatenate(right), np.concatenate(score)


def joining(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, score: np.ndarray) -> tuple[list[int], list[int]]:
    """Confirmed links (a, b) of the pairs (i, j) that join different groups, the pairs with the best scores first."""
    order = np.argsort(-score.astype(np.int64), kind="stable")
    i, j, group = i[order], j[order], np.unique(roots, return_inverse=True)[1]
    a, b = [], []
    while len(i):
        now, later = slice(0, max(200, len(i) // 8)), slice(max(200, len(i) // 8), None)
        sure = similar(sets, i[now], j[now])
        x, y = i[now][sure], j[now][sure]
        if len(x):
            a += ids[x].tolist()
            b += ids[y].tolist()
            nodes, least = least_labels(group[x], group[y])
            to = np.arange(group.max() + 1)
            to[nodes] = least
            group = to[group]
        i, j = i[later], j[later]
        apart = group[i] != group[j]
        i, j = i[apart], j[apart]
    # Of the links found together some join what others have joined.
    links = np.unique(np.array([a, b], np.int64).T.reshape(-1, 2), axis=0)
    return links[:, 0].tolist(), links[:, 1].tolist()


_TILE = "tile long, key long, mine int, id long, component long, n_shingles long, cut int, signature binary"


def second_links(members: DataFrame, cuts: DataFrame, units: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of different groups that meet in a region: links enough to join all groups that a link joins.

    The members of the largest group of a region have blocks of their own, which meet the other blocks only."""
    members = materialize(members.join(units.select("id", "n_shingles"), "id").join(cuts, "id", "left").withColumn("cut", F.coalesce("cut", F.lit(0))), "open")
    counts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("count"), F.sum("n_shingles").alias("size"))
    regions = counts.groupBy("key").agg(F.max_by(F.struct("component", "count", "size"), F.struct("count", "component")).alias("home"), F.sum("count").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    alone = (F.col("n") <= BLOCK) & (F.col("size") <= BLOCK_SHINGLES)
    others = F.when(alone, 1).otherwise(blocks(F.col("n") - F.col("home.count"), F.col("size") - F.col("home.size")))
    homes = F.when(alone, 0).otherwise(blocks(F.col("home.count"), F.col("home.size")))
    regions = regions.select("key", F.when(~alone, F.col("home.component")).alias("home"), others.alias("others"), homes.alias("homes"))
    at_home = F.coalesce(F.col("component") == F.col("home"), F.lit(False))
    mine = F.when(at_home, F.col("others") + F.pmod(F.xxhash64("id", "key"), F.col("homes"))).otherwise(F.pmod(F.xxhash64("id", "key"), F.col("others"))).cast("int")
    met = F.when(at_home, F.col("others")).otherwise(F.col("others") + F.col("homes"))
    cut = members.join(regions, "key").withColumn("mine", mine).withColumn("met", met).join(units.select("id", "signature"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("met") - 1)))
    one, two = F.least("mine", "other"), F.greatest("mine", "other")
    tile = F.when(F.col("others") + F.col("homes") == 1, F.col("key")).otherwise(F.xxhash64("key", one, two))
    names = [x.split()[0] for x in _TILE.split(", ")]
    dealt = cut.withColumn("tile", tile).select(*names).repartition("tile").sortWithinPartitions("tile", "key")

    def one_key(work: Callable) -> Callable:
        """Two tiles of different regions may have one name by chance."""

        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            key = rows.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = rows.slice(lo, hi - lo)
                columns = [part.column(k).to_numpy() for k in (3, 4, 5, 2, 6)]
                yield from work(part, *columns[:2], compared(*columns, _values(part.column(7)), int(key[lo].view(_U) & _TREE)))

        return each

    def near(part, ids, roots, pairs) -> Iterator[pa.RecordBatch]:
        take = np.unique(np.concatenate(pairs[:2]))
        if len(take):
            yield part.take(pa.array(take))

    def links(part, ids, roots, pairs) -> Iterator[pa.RecordBatch]:
        a, b = joining(ids, roots, sets_of(part.column(8).to_pylist()), *pairs)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    likely = materialize(_by_tile(dealt, one_key(near), _TILE), "likely")
    brought = likely.join(texts.withColumnRenamed("doc_id", "id"), "id").select(*names, "text").repartition("tile").sortWithinPartitions("tile", "key")
    return _by_tile(brought, one_key(links), "a long, b long")


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of (doc_id, text)."""
    signed = materialize(sign(docs), "signatures")
    whole = ["n_shingles", "set_a", "set_b"]
    linkable = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(linkable.groupBy(*whole).agg(F.min("doc_id").alias("id"), F.min_by("signature", "doc_id").alias("signature")), "classes")
    regions = met(classes)
    # Only documents of a region can have a link; their texts are brought together once.
    in_region = regions.join(regions.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi").select(F.col("id").alias("doc_id")).distinct()
    texts = materialize(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(materialize(in_region, "members"), "doc_id", "left_semi"), "texts")
    links = materialize(confirmed(materialize(first_pairs(regions), "pairs-1"), texts), "links-1")
    groups = components(links).toDF("id", "component")
    units = materialize(classes.join(groups, "id", "left").select("id", "signature", F.coalesce("component", "id").alias("component"), *whole), "units")
    links = links.unionAll(materialize(second_links(*open_regions(regions, units), units, texts), "links-2"))
    found = components(links).toDF("id", "component")
    by_set = materialize(units.drop("component", "signature").join(found, "id", "left").select(*whole, F.coalesce("component", "id").alias("component")), "by-set")
    out = signed.drop("signature").join(by_set, whole, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
