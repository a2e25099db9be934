"""Hierarchies of unknown depth: ancestors, depth, path, roots and loops of every node.

Edges are contracted fragment by fragment. Every node follows its first parent up to a sampled head, so
that a fragment is a piece of a parent chain or tree; fragments are dealt to partitions. Each partition
solves its own edges and keeps, per node, the exits into other partitions. The entry points of those
exits form a smaller graph, which is solved the same way; its result and the partitions' own pieces give
the whole closure. A fragment that grew too large (a parent with millions of children, say) is split by
a hash of the child, which only turns the edges to that parent into exits. Where a graph is so dense
that the entries' graph is hardly smaller, the next fragments are larger, until the exits are few.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.operators.spread import partitions, spread_join
from termweave.session import cut, discard

#: Of so many nodes on a parent chain about one becomes the head of a fragment.
HEAD_EVERY = 16
#: Doublings of the chain steps; longer headless chains are simply cut.
JUMPS = 5
#: Nodes of a fragment, above which it is split.
FRAGMENT_NODES = 2048
#: A quotient graph of at most so many edges goes to all tasks, each of which solves a share of its nodes; the size is counted before.
BASE_EDGES = 20_000
#: Factor by which fragments grow after a graph that got smaller by less than a quarter.
GROWTH = 8

PAIRS = "src string, dst string, dist long"

Steps = dict[str, list[tuple[str, int]]]


def _reach(steps: Steps, starts: Iterator[str]) -> Iterator[pa.RecordBatch]:
    """Shortest distances of one or more steps from each start."""
    out: list[tuple[str, str, int]] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["src", "dst", "dist"])

    for start in starts:
        best: dict[str, int] = {}
        heap = [(dist, node) for node, dist in steps.get(start, ())]
        heapq.heapify(heap)
        while heap:
            dist, node = heapq.heappop(heap)
            if node in best:
                continue
            best[node] = dist
            for following, step in steps.get(node, ()):
                if following not in best:
                    heapq.heappush(heap, (dist + step, following))
        out.extend((start, node, dist) for node, dist in best.items())
        if len(out) > 50_000:
            yield flush()
    if out:
        yield flush()


def _reach_in_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The closure of this partition's edges."""
    steps: Steps = {}
    for batch in batches:
        for src, dst, dist in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            steps.setdefault(src, []).append((dst, dist))
    yield from _reach(steps, iter(list(steps)))


def _solved(edges: DataFrame) -> DataFrame:
    """The closure of at most BASE_EDGES edges: these are broadcast, and every task solves its own share of start nodes."""
    spark, steps = edges.sparkSession, {}
    for r in edges.collect():  # at most BASE_EDGES
        steps.setdefault(r["src"], []).append((r["dst"], r["dist"]))
    shared = spark.sparkContext.broadcast(steps)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _reach(shared.value, iter(batch.column(0).to_pylist()))

    return edges.select("src").distinct().repartition(partitions(edges), "src").mapInArrow(solve, PAIRS)


def _shortest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src", "dst").agg(F.min("dist").alias("dist"))


def _chain(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs src-dst over a node where ``left`` ends and ``right`` begins; any share of ``left`` may end in one node."""
    a = left.select("src", F.col("dst").alias("via"), F.col("dist").alias("dist_a"))
    b = right.select(F.col("src").alias("via"), "dst", F.col("dist").alias("dist_b"))
    return spread_join(a, b, ["via"]).select("src", "dst", (F.col("dist_a") + F.col("dist_b")).alias("dist"))


def _dealt(edges: DataFrame, level: int, growth: int, parts: int) -> DataFrame:
    """node, part: every node of ``edges`` with the partition of its fragment."""
    head = lambda node: F.pmod(F.xxhash64(node, F.lit(level)), F.lit(HEAD_EVERY * growth)) == 0
    nodes = edges.groupBy(F.col("src").alias("node")).agg(F.min(F.struct("dist", "dst"))["dst"].alias("up"))
    tops = edges.select(F.col("dst").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")
    own = cut(nodes.select("node", F.when(head(F.col("node")), F.col("node")).otherwise(F.col("up")).alias("up")).unionByName(tops.select("node", F.col("node").alias("up"))))
    # Heads and tops are their own: who has reached one stays out of the further steps.
    still = own.where(F.col("up") != F.col("node"))
    done, moving = [own.where(F.col("up") == F.col("node"))], still.where(~head(F.col("up")))
    done.append(still.where(head(F.col("up"))))
    ways = own
    for jump in range(JUMPS + growth.bit_length() - 1):
        further = ways.select(F.col("node").alias("up"), F.col("up").alias("further"))
        stepped = cut(spread_join(moving, further, ["up"]).select("node", F.col("further").alias("up"), (F.col("further") == F.col("up")).alias("is_top")))
        settled = F.col("is_top") | head(F.col("up"))
        done.append(stepped.where(settled).select("node", "up"))
        moving = stepped.where(~settled).select("node", "up")
        # what still moves has doubled its steps; what it may land on has either moved as far or is settled
        ways = moving
        for some in done:
            ways = ways.unionByName(some)
        if moving.isEmpty():
            break
    up = cut(ways)
    sizes = up.groupBy("up").agg(F.count("*").alias("size"))
    shares = F.ceil(F.col("size") / (FRAGMENT_NODES * growth))
    return spread_join(up, sizes, ["up"]).select("node", F.pmod(F.xxhash64("up", F.pmod(F.xxhash64("node"), shares)), F.lit(parts)).cast("int").alias("part"))


def closure(edges: DataFrame, level: int = 0, growth: int = 1, before: int | None = None) -> DataFrame:
    """All pairs src, dst with dst reached from src in one or more steps, with the least distance.

    edges: src, dst STRING and dist LONG (a plain edge has 1); repeated edges and loops are fine, rows
    with a null end are left out. A node on a loop is paired with itself. Empty input gives no rows.
    level, growth and before (the edges of the graph whose quotient this is) belong to the recursion.
    """
    edges = cut(_shortest(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", F.col("dist").cast("long"))))
    count = edges.count()
    if count == 0:
        return edges
    if level and count <= BASE_EDGES:
        return cut(_solved(edges))
    if before is not None and 4 * count > 3 * before:
        growth *= GROWTH
    parts = max(1, max(partitions(edges), count // 100_000) // growth)
    dealt = cut(_dealt(edges, level, growth, parts))
    placed = edges.join(dealt.select(F.col("node").alias("src"), F.col("part").alias("src_part")), "src")
    placed = cut(spread_join(placed, dealt.select(F.col("node").alias("dst"), F.col("part").alias("dst_part")), ["dst"], counted_on=edges))
    within = placed.where("src_part = dst_part").repartition(parts, "src_part").select("src", "dst", "dist")
    exits = placed.where("src_part <> dst_part").select("src", "dst", "dist")
    inner = cut(within.mapInArrow(_reach_in_partition, PAIRS))
    leaving = cut(_shortest(exits.unionByName(_chain(inner, exits))))
    entries = exits.select(F.col("dst").alias("src")).distinct()
    between = closure(leaving.join(entries, "src", "left_semi"), level + 1, growth, count)
    above = _shortest(inner.join(entries, "src", "left_semi").unionByName(between).unionByName(_chain(between, inner)))
    out = cut(_shortest(inner.unionByName(leaving).unionByName(_chain(leaving, above))))
    discard(edges, dealt, placed, inner, leaving, between)
    return out


def parent_edges(terms: DataFrame, node: Column, parents: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a table with a list of parents: parents of all rows of a node count, unknown ones don't.

    node and parents are expressions over ``terms`` that give a cleaned id (null rows are left out) and a
    cleaned array of ids; other columns of ``terms`` play no part.
    """
    rows = terms.select(node.alias("src"), parents.alias("parents")).where("src IS NOT NULL")
    nodes = rows.select(F.col("src").alias("node")).distinct()
    edges = cut(rows.select("src", F.explode("parents").alias("dst")).where("dst IS NOT NULL").distinct())
    known = spread_join(edges, nodes.select(F.col("node").alias("dst")), ["dst"], "left_semi")
    return nodes, known.select("src", "dst", F.lit(1).cast("long").alias("dist"))


def path_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, root): the edges of all paths to each root. A node's paths to a root are the ways along its rows of that root.

    This holds every path of a node with several parents, of which there may be exponentially many, in a row per
    edge and root; ``hierarchy`` writes out one of them. Edges that lead only to loops have no rows.
    """
    has_parent = edges.select(F.col("src").alias("node")).distinct()
    roots = cut(nodes.join(has_parent, "node", "left_anti").select(F.col("node").alias("root")))
    pairs = closure(edges)
    led = spread_join(pairs.select("src", F.col("dst").alias("root")), roots, ["root"], "left_semi")
    led = led.unionByName(roots.select(F.col("root").alias("src"), "root"))
    return spread_join(edges.select("src", "dst"), led.select(F.col("src").alias("dst"), "root"), ["dst"]).select("src", "dst", "root")


def hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per node: depth, path, roots, numbers of ancestors and descendants, on_loop.

    depth is the least number of steps to a root (a node without known parents), path the ids from the
    root down to the node along such steps, each time by the smallest parent id among those one step
    nearer a root. A node that only reaches loops has null depth and path and no roots. roots is sorted.
    """
    pairs = closure(edges)
    has_parent = edges.select(F.col("src").alias("node")).distinct()
    roots = cut(nodes.join(has_parent, "node", "left_anti"))
    to_root = spread_join(pairs, roots.select(F.col("node").alias("dst")), ["dst"], "left_semi").select("src", "dst", "dist")
    to_root = to_root.unionByName(roots.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("dist")))
    depths = cut(to_root.groupBy(F.col("src").alias("node")).agg(F.min("dist").alias("depth"), F.array_sort(F.collect_set("dst")).alias("roots")))
    below = edges.join(depths.select(F.col("node").alias("src"), F.col("depth").alias("below")), "src")
    near = spread_join(cut(below), depths.select(F.col("node").alias("dst"), F.col("depth").alias("over")), ["dst"])
    first = near.where("over = below - 1").groupBy("src").agg(F.min("dst").alias("dst")).withColumn("dist", F.lit(1).cast("long"))
    steps = closure(first).groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("dist", "dst")), asc=False).alias("up"))
    counts_up = pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_ancestors"), F.max(F.col("src") == F.col("dst")).alias("on_loop"))
    counts_down = pairs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_descendants"))
    joined = nodes.join(depths, "node", "left").join(steps, "node", "left").join(counts_up, "node", "left").join(counts_down, "node", "left")
    path = F.concat(F.coalesce(F.transform("up", lambda x: x["dst"]), F.array().cast("array<string>")), F.array("node"))
    return joined.select(
        "node",
        "depth",
        F.when(F.col("depth").isNotNull(), path).alias("path"),
        F.coalesce("roots", F.array().cast("array<string>")).alias("roots"),
        F.coalesce("n_ancestors", F.lit(0)).alias("n_ancestors"),
        F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"),
        F.coalesce("on_loop", F.lit(False)).alias("on_loop"),
    )
