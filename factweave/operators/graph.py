"""Graph operators over edges (doc_id, subject_id, predicate, object_id, confidence): bounded traversal, shortest path,
nearest coordinates, and confidence that spreads along supporting edges. Loops run at the driver for a bounded number
of rounds; each round is a join on (doc_id, node), cut by a checkpoint in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.columns import distance
from factweave.functions.patterns import OPERATOR_WEIGHTS, SUPPORTING

from .search import sent


def ensure_checkpoints(df: DataFrame) -> None:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or "/tmp/factweave-checkpoints")


def hops(edges: DataFrame, direction: str = "out", predicate: str | None = None, by: str = "src") -> DataFrame:
    """(doc_id, src, dst, rank) to walk along, one of each (src, dst), the first by rank. They are dealt out by
    doc_id and `by` before they are grouped, as the groups are mostly single rows and sorting them on both sides of a shuffle is in vain.

    Ranks order the ways out of a node: outgoing edges first, and edges as programs keep them, by subject, predicate and
    object."""
    e = edges if predicate is None else edges.where(F.col("predicate") == predicate)
    out = e.select("doc_id", F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.concat(F.lit("0 "), "predicate", F.lit(" "), "object_id").alias("rank"))
    back = e.select("doc_id", F.col("object_id").alias("src"), F.col("subject_id").alias("dst"), F.concat(F.lit("1 "), "subject_id", F.lit(" "), "predicate").alias("rank"))
    ways = {"out": out, "in": back, "both": out.union(back)}[direction].repartition("doc_id", by)
    return ways.groupBy("doc_id", by, "dst" if by == "src" else "src").agg(F.min("rank").alias("rank")).select("doc_id", "src", "dst", "rank")


def traverse(nodes: DataFrame, edges: DataFrame, starts: DataFrame, predicate: str | None = None, max_depth: int = 3, direction: str = "out") -> DataFrame:
    """(doc_id, start, node_id, depth, path): nodes first reached at each depth from (doc_id, start); the start isn't one.

    The path is the one that a breadth-first walk takes which follows the ways out of each node by their rank. Ends
    without a node are walked through but not returned; ways know them, so that what is reached isn't joined with the nodes. The
    last depth, mostly the largest, is not kept: it is worked out as it is read."""
    ensure_checkpoints(edges)
    there = nodes.select("doc_id", F.col("node_id").alias("dst"), F.lit(True).alias("there")).distinct()
    ways = hops(edges, direction, predicate, by="dst").join(there, ["doc_id", "dst"], "left")
    rank = F.row_number().over(Window.partitionBy("doc_id", "src").orderBy("rank", "dst"))  # numbers are less to carry than ranks
    ways, keys = ways.select("doc_id", "src", "dst", rank.alias("rank"), F.col("there").isNotNull().alias("there")).checkpoint(), ["doc_id", "start", "at"]
    path = F.struct(F.array().cast("array<int>").alias("ranks"), F.lit(0).alias("rank"), F.lit("").alias("via"), F.lit(None).cast("string").alias("came"))
    levels = [starts.select("doc_id", "start", F.col("start").alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("there"), path.alias("path")).checkpoint()]
    for depth in range(1, max_depth + 1):
        # A row keeps the way to the node before it, and only what leaves that node is new in each row of a step.
        ranks, via = F.concat("path.ranks", F.array("path.rank")), F.coalesce(F.concat("path.via", "path.came", F.lit(">")), F.lit(""))
        frontier = levels[-1].select("doc_id", "start", "at", F.col("path.came").alias("last"), ranks.alias("ranks"), via.alias("via"))
        step = frontier.join(ways, (frontier["doc_id"] == ways["doc_id"]) & (F.col("at") == F.col("src"))).where("last IS NULL OR last <> dst")
        if depth == max_depth:
            step = step.where("there")
        step = step.select(frontier["doc_id"], "start", F.col("dst").alias("at"), F.lit(depth).alias("depth"), "there", F.struct("ranks", "rank", "via", F.col("src").alias("came")).alias("path"))
        before = levels[-2:] if direction == "both" else levels  # ways that lead back reach the last two depths alone
        met = reduce(DataFrame.unionByName, [x.withColumn("path", F.lit(None)) for x in before], step).repartition(*keys)
        # Sorted by a number first, as spaces and ids mostly begin alike.
        step = met.groupBy(F.xxhash64(*keys), *keys).agg(F.min("depth").alias("depth"), F.max("there").alias("there"), F.min("path").alias("path"))
        step = step.where(F.col("depth") == depth).select(*keys, "depth", "there", "path")
        levels.append(step if depth == max_depth else step.checkpoint())
        if depth < max_depth and levels[-1].isEmpty():
            break
    found = reduce(DataFrame.unionByName, levels).where("there")
    return found.select("doc_id", "start", F.col("at").alias("node_id"), "depth", F.concat("path.via", "path.came", F.lit(">"), "at").alias("path"))


def shortest_path(edges: DataFrame, pairs: DataFrame, max_depth: int = 5) -> DataFrame:
    """(doc_id, a, b, length, path) of each pair that an undirected walk of at most max_depth edges joins; of several as
    short, the one that a breadth-first walk from a meets first which follows the ways out of each node by their rank.

    The search runs from the distinct ends b, once for all pairs that share one: each node reached learns its next node
    toward b, the one by the least rank, so its path is told when it is reached. So the work follows the distinct ends."""
    ensure_checkpoints(edges)
    ways, keys = hops(edges, "both", by="dst").checkpoint(), ["doc_id", "b", "at"]
    levels = [pairs.select("doc_id", "b").distinct().select("doc_id", "b", F.col("b").alias("at"), F.lit(0).alias("length"), F.array("b").alias("path")).checkpoint()]
    for depth in range(1, max_depth + 1):
        front = levels[-1]
        step = front.join(ways, (front["doc_id"] == ways["doc_id"]) & (F.col("at") == F.col("dst")))
        step = step.select(front["doc_id"], "b", F.col("src").alias("at"), "path", "rank").repartition(*keys).groupBy(*keys).agg(F.min_by("path", "rank").alias("path"))
        before = reduce(DataFrame.unionByName, levels[-2:])  # ways lead back too, so earlier depths are not reached
        step = step.join(before.select(*keys), keys, "left_anti")
        levels.append(step.select(*keys, F.lit(depth).alias("length"), F.concat(F.array("at"), "path").alias("path")).checkpoint())
        if levels[-1].isEmpty():
            break
    reached = reduce(DataFrame.unionByName, levels)
    found = pairs.select("doc_id", "a", "b").join(reached.withColumnRenamed("at", "a"), ["doc_id", "a", "b"])
    return found.select("doc_id", "a", "b", "length", F.array_join("path", ">").alias("path"))


def neighbours(nodes: DataFrame, points: DataFrame, radius: float, weights: tuple = (1.0, 0.5, 0.3, 0.1)) -> DataFrame:
    """(doc_id, point, node_id, distance) within the radius of each point's coordinates, itself included; none for a
    negative radius.

    Nodes lie in the cells of a grid over all four parts, which are twice as wide in each as the radius reaches there, so
    a point asks in two cells a part at most and meets what is near it in every part: an equi-join on (doc_id, cells).
    A part without weight has one cell."""
    names = ("major", "type", "subtype", "instance")
    near = points.select("doc_id", F.col("node_id").alias("point"), *(F.col(n).alias(f"p_{n}") for n in names))
    far, cells = nodes, []
    for n, w in zip(names, weights, strict=True):
        if w <= 0 or radius < 0:
            continue
        reach = radius / w**0.5 + 1e-6
        cell = lambda c, side=max(2 * reach, 1.0): F.floor(c / F.lit(side))
        cells.append(f"cell_{n}")
        far = far.withColumn(cells[-1], cell(F.col(n)))
        near = near.withColumn(cells[-1], F.explode(F.sequence(cell(F.col(f"p_{n}") - reach), cell(F.col(f"p_{n}") + reach))))
    d = distance([F.col(n) for n in names], [F.col(f"p_{n}") for n in names], weights)
    return far.join(near, ["doc_id", *cells]).withColumn("distance", d).where(F.col("distance") <= radius).select("doc_id", "point", "node_id", F.round("distance", 9).alias("distance"))


def ranked_neighbours(nodes: DataFrame, points: DataFrame, radius: float, order: str = "node_seq", weights: tuple = (1.0, 0.5, 0.3, 0.1)) -> DataFrame:
    """(doc_id, point, rank, node_id, distance): the same from the nearest on, and in the order of the nodes where as near."""
    found = neighbours(nodes, points, radius, weights).join(nodes.select("doc_id", "node_id", F.col(order).alias("place")), ["doc_id", "node_id"])
    rank = F.row_number().over(Window.partitionBy("doc_id", "point").orderBy("distance", "place"))
    return found.select("doc_id", "point", rank.alias("rank"), "node_id", "distance")


def shortcuts(ways: DataFrame, now: DataFrame, held: DataFrame | None, most: int) -> tuple[DataFrame, int]:
    """(doc_id, node_id, from, own, confidence) of the nodes that a single edge of `ways` leads to, those of `held` left out:
    the nearest node upstream that isn't one of them, the least confidence on the way from it, and what the nodes between
    give without it. A ring of such nodes has no start, and each learns what the whole ring gives.

    Along one edge a node's confidence is max(own, min(edge, x)) of x upstream, and two such steps make a step of the same
    kind, so each round doubles the way that a row stands for: a chain of n nodes takes log2(n) rounds of n rows. The rounds
    are returned too; more than `most` are an error."""
    single = ways.groupBy("doc_id", "node_id").agg(F.count(F.lit(1)).alias("n"), F.first("from").alias("from"), F.first("own").alias("own")).where("n = 1").drop("n")
    if held is not None:
        single = single.join(held, ["doc_id", "node_id"], "left_anti")
    steps = single.join(now, ["doc_id", "node_id"]).select("doc_id", "node_id", "from", "own", "confidence").checkpoint()
    needed, k = steps.count().bit_length(), 0
    for k in range(1, needed + 1):
        if k > most:
            raise RuntimeError(f"ways are not drawn together after {most} rounds")
        up = steps.select("doc_id", F.col("node_id").alias("from"), F.col("from").alias("up"), F.col("own").alias("up_own"), F.col("confidence").alias("up_c"))
        joined = steps.join(up, ["doc_id", "from"], "left")
        gained = F.greatest("confidence", F.least("up_c", "own"))  # least and greatest skip nulls
        longer = joined.select("doc_id", "node_id", F.coalesce("up", "from").alias("from"), F.least("own", "up_own").alias("own"), F.when(F.col("up").isNull(), F.col("confidence")).otherwise(gained).alias("confidence"), F.col("up").isNotNull().alias("moved")).checkpoint()
        steps = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    return steps, k


#: Rounds of confidence() after which single ways are drawn together.
SHALLOW = 4


def confidence(nodes: DataFrame, prov: DataFrame, edges: DataFrame, derivations: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(doc_id, node_id, confidence): the least fixed point of

        max(base, derivations' min(operands' confidence, own * operator's weight), supporting edges' min(subject's, own))

    which recursion gives on graphs without cycles; on cycles it does not hang on the order of visits. A node without
    provenance starts at 1.0, an operand that isn't a node at 0.0. Values only rise and come from a finite set, so rounds
    end; going over max_rounds is an error.

    Edges and first values are kept once. A round keeps what rose in it alone, and only that speaks in the next one. Where
    values still rise after SHALLOW rounds, ways without a fork are drawn together (shortcuts), so that rounds follow the
    forks on a way and not its length."""
    ensure_checkpoints(nodes)
    return spread(nodes, prov, supporting(edges), derivations, max_rounds)


def supporting(edges: DataFrame) -> DataFrame:
    """(doc_id, from, node_id, own) of the edges that confidence spreads along."""
    along = edges.where(F.col("predicate").isin(*SUPPORTING) & (F.col("subject_id") != F.col("object_id")))
    return along.select("doc_id", F.col("subject_id").alias("from"), F.col("object_id").alias("node_id"), F.col("confidence").alias("own"))


def upstream(ways: DataFrame, of: DataFrame) -> DataFrame | None:
    """(doc_id, node_id) of the nodes `of` and of all that lead to them along `ways` (doc_id, from, node_id); None where that
    takes more than SHALLOW rounds, as each of them reads all ways."""
    key = ["doc_id", "node_id"]
    levels = [of.select(*key).distinct().checkpoint()]
    for _ in range(SHALLOW):
        before = reduce(DataFrame.unionByName, levels)
        step = ways.join(sent(levels[-1], levels[-1].count()), key, "left_semi").select("doc_id", F.col("from").alias("node_id")).distinct()
        levels.append(step.join(before, key, "left_anti").checkpoint())
        if levels[-1].isEmpty():
            return before
    return None


def confidence_of(nodes: DataFrame, prov: DataFrame, edges: DataFrame, of: DataFrame, derivations: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """The rows of confidence() of the nodes `of` (doc_id, node_id). What they get comes from the nodes upstream of them, so
    that rounds go over these alone, or over all nodes where these are not found in a few rounds."""
    ensure_checkpoints(nodes)
    key = ["doc_id", "node_id"]
    ways = supporting(edges).checkpoint()
    leading = ways.select("doc_id", "from", "node_id")
    if derivations is not None:
        leading = leading.unionByName(derivations.select("doc_id", F.explode("operands").alias("from"), F.col("result_id").alias("node_id")).checkpoint())
    needed = upstream(leading, of)
    if needed is not None:
        needed = sent(needed, needed.count())
        nodes, ways = nodes.join(needed, key, "left_semi"), ways.join(needed, key, "left_semi")
        if derivations is not None:
            derivations = derivations.join(needed.withColumnRenamed("node_id", "result_id"), ["doc_id", "result_id"], "left_semi")
    return spread(nodes, prov, ways, derivations, max_rounds).join(of.select(*key).distinct(), key, "left_semi")


def spread(nodes: DataFrame, prov: DataFrame, ways: DataFrame, derivations: DataFrame | None, max_rounds: int) -> DataFrame:
    """confidence() over `ways` (doc_id, from, node_id, own)."""
    from .space import base_confidence

    key = ["doc_id", "node_id"]
    base = base_confidence(nodes, prov).select(*key, F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    ways = ways.groupBy("doc_id", "from", "node_id").agg(F.max("own").alias("own")).checkpoint()
    weight = F.create_map(*(F.lit(x) for kv in OPERATOR_WEIGHTS.items() for x in kv))
    each = held = None
    if derivations is not None:
        numbered = derivations.select("doc_id", F.col("result_id").alias("node_id"), F.monotonically_increasing_id().alias("n"), (F.col("confidence") * weight[F.col("operator")]).alias("own"), "operands").checkpoint()
        each, held = numbered.select(*key, "n", "own", F.explode("operands").alias("from")), numbered.select(*key).distinct()
    now = base.checkpoint()
    risen, rose = None, now

    def known() -> DataFrame:
        if risen is None:
            return now
        return now.join(risen.groupBy(*key).agg(F.max("confidence").alias("higher")), key, "left").select(*key, F.coalesce("higher", "confidence").alias("confidence"))

    k, drawn = -1, 0
    while (k := k + 1) + drawn < max_rounds:
        if k == SHALLOW:
            now, risen = known().checkpoint(), None
            short, drawn = shortcuts(ways, now, held, max_rounds - k)
            ways = short.select("doc_id", "from", "node_id", "own").unionByName(ways.join(short, key, "left_anti").select("doc_id", "from", "node_id", "own")).checkpoint()
            now = now.join(short.select(*key, F.col("confidence").alias("higher")), key, "left").select(*key, F.coalesce("higher", "confidence").alias("confidence")).checkpoint()
            rose = now
        spoke = rose.select("doc_id", F.col("node_id").alias("from"), F.col("confidence").alias("c"))
        told = ways.join(spoke, ["doc_id", "from"]).groupBy(*key).agg(F.max(F.least("c", "own")).alias("told"))
        if each is not None:
            # A derivation is judged anew where an operand rose, by all its operands.
            touched = each.join(spoke, ["doc_id", "from"], "left_semi").select(*key, "n").distinct()
            have = known().select("doc_id", F.col("node_id").alias("from"), F.col("confidence").alias("c"))
            got = each.join(touched, [*key, "n"], "left_semi").join(have, ["doc_id", "from"], "left").groupBy(*key, "n").agg(F.least(F.min(F.coalesce("c", F.lit(0.0))), F.first("own")).alias("told"))
            told = told.unionByName(got.select(*key, "told")).groupBy(*key).agg(F.max("told").alias("told"))
        higher = told.join(known(), key).where("told > confidence").select(*key, F.col("told").alias("confidence")).checkpoint()
        if higher.isEmpty():
            return known()
        risen = higher if risen is None else risen.unionByName(higher)
        if k % SHALLOW == 0:  # else their union would grow with the rounds
            risen = risen.groupBy(*key).agg(F.max("confidence").alias("confidence")).checkpoint()
        rose = higher
    raise RuntimeError(f"confidence still rises after {max_rounds} rounds")
