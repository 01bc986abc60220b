"""Directed cycles: reduction of a graph to its core, and strongly connected components.

Nodes without a way in or out are peeled off, and chains of nodes with one way in
and one way out are contracted to single edges by pointer doubling, so a chain of
any length takes rounds by its logarithm.  What was contracted is remembered as
(node, start, end) of its chain and answered for when the ends are known.  Every
round's tables are written to the shared folder; only row counts are gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.session import staged

#: called after each round with its kind and the rows that are left
Trace = Callable[[str, int], None]


def _silent(kind: str, rows: int) -> None:
    pass


@dataclass
class Reduced:
    """A graph without chains and dead ends, and what was taken out of it."""

    edges: DataFrame
    rings: DataFrame  # (node, component): cycles nothing else is attached to
    segments: list[DataFrame] = field(default_factory=list)  # (node, start, end), in the order of contraction
    empty: bool = False


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges whose source has a way in and whose target has a way out."""
    has_in = edges.select(F.col("target").alias("source")).distinct()
    has_out = edges.select(F.col("source").alias("target")).distinct()
    return edges.join(has_in, "source", "left_semi").join(has_out, "target", "left_semi")


def _chain_nodes(edges: DataFrame) -> DataFrame:
    """(node, before, after) of nodes with one way in and one way out, no self-loops."""
    ways_in = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"), F.min("source").alias("before")).where("n = 1 and before <> node")
    ways_out = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n"), F.min("target").alias("after")).where("n = 1 and after <> node")
    return ways_in.drop("n").join(ways_out.drop("n"), "node")


def _tails(chain: DataFrame, count: int, trace: Trace) -> tuple[DataFrame, DataFrame | None]:
    """(node, tail) with the last node of each node's chain, and (node, component) of rings, if there are any.

    Pointers go on by 1, 2, 4, ... nodes.  When they span more nodes than there
    are, those still going are on rings, and the smallest node they have passed
    names the ring.  Only pointers that still move are joined.
    """
    follows = chain.select(F.col("node").alias("at"), F.lit(True).alias("goes_on"))
    state = staged(
        chain.join(follows, F.col("after") == F.col("at"), "left").select(
            "node", F.when(F.col("goes_on"), F.col("after")).otherwise(F.col("node")).alias("tail"), F.coalesce("goes_on", F.lit(False)).alias("moving"),
            F.when(F.col("goes_on"), F.least("node", "after")).otherwise(F.col("node")).alias("least"),
        )
    )
    span, left = 1, state.where("moving").count()
    while left and span <= count:
        ahead = state.select(F.col("node").alias("at"), F.col("tail").alias("next"), F.col("moving").alias("still"), F.col("least").alias("lower"))
        moved = state.where("moving").join(ahead, F.col("tail") == F.col("at")).select(
            "node", F.col("next").alias("tail"), F.col("still").alias("moving"), F.least("least", "lower").alias("least")
        )
        state = staged(state.where("not moving").unionByName(moved))
        span, left = span * 2, state.where("moving").count()
        trace("doubling", left)
    rings = state.where("moving").select("node", F.col("least").alias("component")) if left else None
    return state.where("not moving").select("node", "tail"), rings


def reduced(edges: DataFrame, trace: Trace = _silent, chains: bool = False) -> Reduced:
    """Peel, and contract chains where peeling gets slow; edges are distinct (source, target).

    Ends when peeling changes nothing.  With ``chains`` what is left is contracted
    too, as long as that takes out a tenth of the edges.
    """
    out = Reduced(edges, edges.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0))
    size = edges.count()
    while size:
        rest = staged(_peeled(_peeled(out.edges)))
        left = rest.count()
        trace("peeling", left)
        stuck = left == size
        if left and (stuck and chains or not stuck and left > 0.95 * size):
            chain = staged(_chain_nodes(rest))
            links = chain.count()
            if links and not (stuck and links < 0.1 * left):
                tails, rings = _tails(chain, links, trace)
                out.rings = out.rings if rings is None else out.rings.unionByName(rings)
                ends = chain.join(tails, "node")
                # a chain is known by its last node: who leads into its first one, and where the last one leads
                heads = ends.join(chain.select(F.col("node").alias("before")), "before", "left_anti").select("tail", F.col("before").alias("start"))
                spans = heads.join(chain.select(F.col("node").alias("tail"), F.col("after").alias("end")), "tail")
                segment = staged(tails.join(spans, "tail").select("node", "start", "end"))
                out.segments.append(segment)
                inner = chain.select(F.col("node").alias("inner"))
                kept = rest.join(inner, F.col("source") == F.col("inner"), "left_anti").join(inner, F.col("target") == F.col("inner"), "left_anti")
                rest = staged(kept.unionByName(segment.select(F.col("start").alias("source"), F.col("end").alias("target"))).distinct())
                left, stuck = rest.count(), False
                trace("contracting", left)
        out.edges = rest
        if stuck:
            break
        size = left
    out.empty = size == 0
    return out


def _edges(edges: DataFrame) -> DataFrame:
    return staged(edges.where(F.col("source").isNotNull() & F.col("target").isNotNull()).select("source", "target").distinct())


def has_cycles(edges: DataFrame, trace: Trace = _silent) -> DataFrame:
    """One row: does the graph have a directed cycle, self-loops included?

    What is left of the reduced graph has a way in and a way out at every node,
    which a finite graph without a cycle has not.
    """
    core = reduced(_edges(edges), trace)
    return edges.sparkSession.range(1).select(F.lit(not core.empty or not core.rings.isEmpty()).alias("has_cycles"))


def cyclic_core(edges: DataFrame, trace: Trace = _silent) -> DataFrame:
    """Edges left after nodes without a way in or a way out are peeled off again and again.

    These are the edges on cycles and on ways from one cycle to another.
    """
    given = _edges(edges)
    core = reduced(given, trace)
    alive = core.edges.select(F.explode(F.array("source", "target")).alias("node")).union(core.rings.select("node")).distinct()
    for segment in reversed(core.segments):
        alive = staged(alive)
        ends = lambda name: alive.select(F.col("node").alias(name))  # noqa: E731, B023
        alive = alive.union(segment.join(ends("start"), "start", "left_semi").join(ends("end"), "end", "left_semi").select("node")).distinct()
    alive = staged(alive)
    return given.join(alive.select(F.col("node").alias("source")), "source", "left_semi").join(
        alive.select(F.col("node").alias("target")), "target", "left_semi"
    )


def _farthest(edges: DataFrame, nodes: DataFrame, kind: str, trace: Trace) -> DataFrame:
    """(node, top): the largest node from which the node can be reached.

    Every round takes the largest top over the ways in, then the top of that top,
    which doubles the ways that are known.
    """
    tops = staged(nodes.select("node", F.col("node").alias("top")))
    while True:
        source = tops.select(F.col("node").alias("source"), F.col("top").alias("from"))
        best = edges.join(source, "source").groupBy("target").agg(F.max("from").alias("from"))
        new = tops.join(best, F.col("node") == F.col("target"), "left").select("node", F.col("top").alias("old"), F.greatest("top", F.coalesce("from", "top")).alias("top"))
        higher = new.select(F.col("node").alias("via"), F.col("top").alias("above"))
        new = staged(new.join(higher, F.col("top") == F.col("via"), "left").select("node", "old", F.greatest("top", F.coalesce("above", "top")).alias("top")))
        changed = new.where("top <> old").count()
        trace(kind, changed)
        tops = new.select("node", "top")
        if not changed:
            return tops


def strong_components(edges: DataFrame, trace: Trace = _silent) -> DataFrame:
    """Rows (node, component) of all nodes on a directed cycle; a component is named by its smallest node.

    After the reduction every node takes the largest node that reaches it as its
    colour; of a colour, the nodes that reach that node in turn are one component.
    They are taken out, edges between colours too, and the rest is reduced again.
    Rows with a null end are no edges, repeated ones count once.  There is no limit
    on rounds: every one of them takes out at least a component.
    """
    given = _edges(edges)
    loops = staged(given.where("source = target").select(F.col("source").alias("node")))
    rest, segments = staged(given.where("source <> target")), []
    found = loops.select("node", F.col("node").alias("group")).limit(0)
    while not rest.isEmpty():
        core = reduced(rest, trace, chains=True)
        segments += core.segments
        found = found.unionByName(core.rings.withColumnRenamed("component", "group"))
        # a chain from a node back to itself
        turns = core.edges.where("source = target").select(F.col("source").alias("node"))
        loops = staged(loops.union(turns))
        inner = staged(core.edges.where("source <> target"))
        if inner.isEmpty():
            break
        nodes = staged(inner.select(F.explode(F.array("source", "target")).alias("node")).distinct())
        colours = _farthest(inner, nodes, "colouring", trace)
        of = lambda end: colours.select(F.col("node").alias(end), F.col("top").alias(f"{end}_top"))  # noqa: E731, B023
        within = staged(inner.join(of("source"), "source").join(of("target"), "target").where("source_top = target_top").select("source", "target"))
        back = _farthest(within.select(F.col("target").alias("source"), F.col("source").alias("target")), nodes, "backward", trace)
        done = staged(colours.join(back.withColumnRenamed("top", "back"), "node").where("top = back").select("node", F.col("top").alias("group")))
        found = staged(found.unionByName(done))
        gone = done.select(F.col("node").alias("gone"))
        rest = staged(within.join(gone, F.col("source") == F.col("gone"), "left_anti").join(gone, F.col("target") == F.col("gone"), "left_anti"))
        trace("components", rest.count())
    # a node alone in its group is on a cycle only if it loops
    groups = staged(found)
    for segment in reversed(segments):
        of = lambda end: groups.select(F.col("node").alias(end), F.col("group").alias(f"{end}_group"))  # noqa: E731, B023
        named = segment.join(of("start"), "start", "left").join(of("end"), "end", "left")
        same = F.coalesce(F.col("start_group") == F.col("end_group"), F.lit(False))
        inside = named.where(same | (F.col("start") == F.col("end"))).select(
            "node", F.coalesce("start_group", "start").alias("group"), F.col("start").alias("opener")
        )
        # a chain that closes on a node without a group of its own makes one with it
        openers = inside.select(F.col("opener").alias("node"), "group").distinct().join(groups.select("node"), "node", "left_anti")
        groups = staged(groups.unionByName(inside.select("node", "group")).unionByName(openers))
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"), F.min("node").alias("component"))
    larger = groups.join(sizes.where("n > 1"), "group").select("node", "component")
    single = loops.distinct().join(larger.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return larger.unionByName(single)
