"""Recursive operators: closures, ancestry, components, rule-driven traversal.

Fixpoints are driver loops over tables in the shared folder. `closure` ranks the nodes of chains and pairs them as they are read; other
graphs double path lengths in each round, so n links take log2(n) rounds. `reach` walks from seeds and only joins what a round has
added. Both end on cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake._io import materialise
from quadlake.operators import _chains

#: Nodes of a chain that are paired at a time.
BLOCK = 256
#: Blocks whose pairs a task makes: they are small as files, and a reader would put many into one task.
TOGETHER = 500


def closure(edges: DataFrame) -> DataFrame:
    """a, b, depth: every b reachable from a over one link or more, with the fewest links. edges: a, b."""
    edges = edges.select("a", "b")
    if edges.schema["a"].dataType != edges.schema["b"].dataType:
        return _doubled(edges)
    runs = _chains.contracted(edges)
    if not runs.filter("a IS NULL OR b IS NULL").isEmpty() or not _chains.simple(runs):
        return _doubled(runs.select("a", "b"))
    places, rings = _chains.places(runs)
    found = _chain_pairs(materialise(_blocks(places)))
    return found.union(_doubled(places.filter("head IS NULL").select("a", "b"))) if rings else found


def _doubled(edges: DataFrame) -> DataFrame:
    """By rounds: paths of h links at most, and those of h links continued by them, give all up to 2 h. Each pair is made from the nodes
    that are h links away only, and pairs that are known are not written again."""
    known = new = materialise(edges.distinct().withColumn("depth", F.lit(1)))
    h = 1
    while not new.filter(F.col("depth") == h).isEmpty():
        far = new.filter(F.col("depth") == h).select("a", F.col("b").alias("m"))
        longer = far.join(known.select(F.col("a").alias("m"), "b", "depth"), "m").groupBy("a", "b").agg((F.min("depth") + h).alias("depth"))
        new = materialise(longer.join(known.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "depth"))
        known, h = known.union(new), 2 * h
    return known


def _blocks(places: DataFrame) -> DataFrame:
    """head, k, nodes: the nodes of a chain from place k * BLOCK on, in order."""
    node = places.filter("head IS NOT NULL").select("head", "pos", F.col("a").alias("node"))
    cut = node.groupBy("head", F.floor(F.col("pos") / BLOCK).alias("k")).agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("nodes"))
    return cut.select("head", "k", F.col("nodes.node").alias("nodes"))


def _chain_pairs(blocks: DataFrame) -> DataFrame:
    """All pairs of a chain, block by block; only blocks are shuffled, once for each later block of their chain."""
    dealt = blocks.repartition(blocks.count() // TOGETHER + 1, "head", "k")
    at = dealt.select("head", "k", "nodes", F.posexplode("nodes").alias("i", "a"))
    own = at.select("a", "i", F.posexplode(F.slice("nodes", F.col("i") + 2, BLOCK)).alias("j", "b")).select("a", "b", (F.col("j") + 1).alias("depth"))
    count = blocks.groupBy("head").agg(F.max("k").alias("most")).filter("most > 0")
    to = blocks.join(count, "head").filter("k < most").select("head", F.col("k").alias("from"), F.col("nodes").alias("xs"), F.explode(F.sequence(F.col("k") + 1, F.col("most"))).alias("k"))
    two = to.join(blocks, ["head", "k"]).select("from", "k", "nodes", F.posexplode("xs").alias("i", "a"))
    two = two.select("from", "k", "i", "a", F.posexplode("nodes").alias("j", "b"))
    return own.union(two.select("a", "b", ((F.col("k") - F.col("from")) * BLOCK + F.col("j") - F.col("i")).cast("int").alias("depth")))


def reach(edges: DataFrame, seeds: DataFrame, *, max_rounds: int | None = None) -> DataFrame:
    """seed, node, depth: nodes reached from each seed, itself at depth 0. seeds: node."""
    seen = new = materialise(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct())
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        step = new.join(edges.select(F.col("a").alias("node"), "b"), "node").select("seed", F.col("b").alias("node"), F.lit(rounds).alias("depth")).distinct()
        new = materialise(step.join(seen, ["seed", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen = seen.union(new)
        if rounds % 8 == 0:
            seen = materialise(seen)
    return seen


def has_cycle(edges: DataFrame) -> bool:
    return not closure(edges).filter("a = b").isEmpty()


def roots(edges: DataFrame) -> DataFrame:
    """node, root: the ends of the chains up from each node (a is below b)."""
    tops = edges.select(F.col("b").alias("root")).distinct().join(edges.select(F.col("a").alias("root")), "root", "left_anti")
    return closure(edges).join(tops, F.col("b") == F.col("root"), "left_semi").select(F.col("a").alias("node"), F.col("b").alias("root"))


def common_ancestors(parents: DataFrame, x: str, y: str) -> DataFrame:
    """node, depth_x, depth_y of all common ancestors of two nodes (themselves included), nearest first. parents: a (child), b."""
    spark = parents.sparkSession
    up = reach(parents, spark.createDataFrame([(x,), (y,)], "node string"))
    left, right = (up.filter(F.col("seed") == n).select("node", F.col("depth").alias(f"depth_{k}")) for k, n in (("x", x), ("y", y)))
    return left.join(right, "node").orderBy(F.col("depth_x") + F.col("depth_y"), "depth_x", "node")


def relation(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds relation to pairs (x, y): same, older (x is an ancestor of y), newer or unrelated."""
    above = closure(parents).select("a", "b")
    out = pairs.join(above.select(F.col("a").alias("y"), F.col("b").alias("x"), F.lit(True).alias("older")), ["x", "y"], "left")
    out = out.join(above.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(True).alias("newer")), ["x", "y"], "left")
    return out.select("x", "y", F.when(F.col("x") == F.col("y"), "same").when(F.col("older"), "older").when(F.col("newer"), "newer").otherwise("unrelated").alias("relation"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) by hooking to the smallest neighbour and jumping over labels."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("c"))
        hooked = labels.join(near, "node").select("node", F.least("component", "c").alias("c"), F.col("component").alias("old"))
        jumped = hooked.join(labels.select(F.col("node").alias("c"), F.col("component").alias("cc")), "c").select("node", F.least("c", "cc").alias("component"), "old")
        new = materialise(jumped)
        if new.filter("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.drop("old")


def nearest(up: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """The value that is declared on the node itself or else on the nearest node above it. up: a, b; values: node, value."""
    above = closure(up).select(F.col("a").alias("node"), F.col("b").alias("at"), "depth").union(values.select("node", F.col("node").alias("at"), F.lit(0)))
    found = above.join(values.select(F.col("node").alias("at"), value), "at")
    return found.groupBy("node").agg(F.min_by(value, F.struct("depth", "at")).alias(value))


def traverse(edges: DataFrame, kinds: DataFrame, rules: DataFrame, seeds: DataFrame, *, max_depth: int) -> DataFrame:
    """Nodes reached from typed seeds by rules (from_kind, p, to_kind, forward), each at its first depth.

    edges: s, p, o; kinds: node, kind; result: seed, node, kind, depth. Rules are joined once to the edges, in both directions.
    """
    typed = edges.join(kinds.select(F.col("node").alias("s"), F.col("kind").alias("s_kind")), "s").join(kinds.select(F.col("node").alias("o"), F.col("kind").alias("o_kind")), "o")
    ahead = typed.join(rules.filter("forward").select(F.col("from_kind").alias("s_kind"), "p", F.col("to_kind").alias("o_kind")), ["s_kind", "p", "o_kind"], "left_semi").select(F.col("s").alias("a"), F.col("o").alias("b"))
    back = typed.join(rules.filter("NOT forward").select(F.col("to_kind").alias("s_kind"), "p", F.col("from_kind").alias("o_kind")), ["s_kind", "p", "o_kind"], "left_semi").select(F.col("o").alias("a"), F.col("s").alias("b"))
    steps = materialise(ahead.union(back).distinct())
    return reach(steps, seeds, max_rounds=max_depth).join(kinds, "node").select("seed", "node", "kind", "depth")


def part_groups(parts: DataFrame, root_nodes: DataFrame) -> DataFrame:
    """node, root: every part below a root (whole a has part b); a part of several roots goes to the one of the lowest priority
    number, then to the nearest, then to the smallest. root_nodes: node, priority."""
    found = reach(parts, root_nodes.select("node")).join(root_nodes.select(F.col("node").alias("seed"), "priority"), "seed")
    return found.groupBy("node").agg(F.min_by("seed", F.struct("priority", "depth", "seed")).alias("root"))


def boundary(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes that a group refers to and that belong to another or to none: root, node."""
    out = edges.join(groups.select(F.col("node").alias("a"), "root"), "a").select("root", F.col("b").alias("node")).distinct()
    return out.join(groups, ["root", "node"], "left_anti")


def subsumption_edges(direct: DataFrame, members: DataFrame) -> DataFrame:
    """a (narrower), b (wider) from direct (a, b, kind) with kind subClassOf or equivalentClass, and members (cls, member, kind) with
    kind unionOf, disjointUnionOf or intersectionOf."""
    narrow = direct.select("a", "b")
    same = direct.filter("kind = 'equivalentClass'").select(F.col("b").alias("a"), F.col("a").alias("b"))
    union = members.filter("kind IN ('unionOf', 'disjointUnionOf')").select(F.col("member").alias("a"), F.col("cls").alias("b"))
    inter = members.filter("kind = 'intersectionOf'").select(F.col("cls").alias("a"), F.col("member").alias("b"))
    return narrow.union(same).union(union).union(inter).distinct()


def inverse_properties(inverse: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symmetric inverses (a, b), and sub-properties (a below b) with those of inverses added."""
    both = inverse.select("a", "b").union(inverse.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    carried = below.join(both.select("a", F.col("b").alias("ia")), "a").join(both.select(F.col("a").alias("b"), F.col("b").alias("ib")), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    return both, below.select("a", "b").union(carried).distinct()


def is_kind(instances: DataFrame, up: DataFrame, cls: str) -> DataFrame:
    """Nodes of instances (node, cls) whose class is the given one or below it."""
    low = closure(up).filter(F.col("b") == cls).select(F.col("a").alias("cls")).union(up.sparkSession.createDataFrame([(cls,)], "cls string"))
    return instances.join(low, "cls", "left_semi").select("node").distinct()


