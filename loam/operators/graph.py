"""The link graph: degrees, backlinks, hubs, clusters, cycles and stale parts, from (source, target) edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from loam.functions.text import HUB_DEGREE, path_dir
from loam.operators.components import connected_components
from loam.session import discard, written


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, indegree, outdegree): different sources, and different targets among the nodes."""
    known = edges.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target").distinct()
    into = known.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("indegree"))
    out = known.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("outdegree"))
    joined = nodes.select("id").join(into, "id", "left").join(out, "id", "left")
    return joined.na.fill(0, ["indegree", "outdegree"])


def orphans(degree: DataFrame) -> DataFrame:
    return degree.where("indegree = 0 AND outdegree = 0").select("id")


def no_backlinks(degree: DataFrame) -> DataFrame:
    return degree.where("indegree = 0 AND outdegree > 0").select("id")


def hubs(degree: DataFrame, threshold: int = HUB_DEGREE) -> DataFrame:
    """Nodes of ``threshold`` neighbours and more, those of most first; none if it isn't positive."""
    total = F.col("indegree") + F.col("outdegree")
    return degree.where((total >= threshold) & F.lit(threshold > 0)).select("id", total.alias("degree")).orderBy(F.desc("degree"), "id")


def backlinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, source): a row for each different source that links to a node, and one with a null source for nodes without.

    Rows, not lists, since a node may have any number of backlinks.
    """
    into = edges.select(F.col("target").alias("id"), "source").distinct()
    return nodes.select("id").join(into, "id", "left")


def top_referenced(edges: DataFrame, k: int = 10) -> DataFrame:
    counted = edges.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("references"))
    return counted.orderBy(F.desc("references"), "id").limit(k)


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id of each node's undirected component."""
    reached = connected_components(edges, "source", "target").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    return nodes.select("id").join(reached, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))


def reserved_members(cluster: DataFrame, reserved: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster) of the ``reserved`` files that link to a member of (id, cluster) or are linked by one: the first cluster that each reaches.

    They join a cluster and never two: the components are those of the concepts alone. Only the least cluster of each file is kept
    while edges are summed, so a file that links to everything is a row for each task.
    """
    own = reserved.select("id")
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("member")).union(edges.select("target", "source"))
    reached = ends.join(own, "id", "left_semi").join(cluster.select(F.col("id").alias("member"), "cluster"), "member")
    return reached.groupBy("id").agg(F.min("cluster").alias("cluster"))


def isolated_clusters(cluster: DataFrame) -> DataFrame:
    """One row: how many clusters there are, and how many of one node."""
    sizes = cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") == 1).alias("single"))


def _met(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorting: what is written has far more rows than its size on disk tells, and each round's would go to the driver to be broadcast."""
    return rows.join(other.hint("merge"), on, how)


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges (a, b) whose source has an edge in and whose target has one out."""
    into, out = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
    return _met(_met(edges, into, "a", "left_semi"), out, "b", "left_semi").select("a", "b")


def _thin(edges: DataFrame) -> DataFrame:
    """(v, next) of the nodes of (a, b) with one edge in and one out: the next node."""
    ends = edges.select(F.col("a").alias("v"), F.col("b").alias("next"), F.lit(0).alias("into")).union(edges.select("b", F.lit(None).cast("string"), F.lit(1)))
    counted = ends.groupBy("v").agg(F.count_if(F.col("into") == 0).alias("n_out"), F.sum("into").alias("n_in"), F.max("next").alias("next"))
    return counted.where("n_out = 1 AND n_in = 1").select("v", "next")


def _shortened(thin: DataFrame) -> DataFrame:
    """(v, next, last, steps, least, head, ring), written: each thin node led to where its path leaves a batch of the nodes' order.

    A task takes batches of neighbours in that order, whatever their number. A node that no other of its batch leads to is a ``head``,
    and the others are on the way of one; a ring within a batch is done, with its least node. Where nodes that follow
    each other have names that do, few heads are left; elsewhere all are heads, and nothing is lost.
    """

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, after = batch.column(0), batch.column(1)
            at = pc.fill_null(pc.index_in(after, value_set=v), -1).to_numpy(zero_copy_only=False)
            own = np.arange(len(at))
            hop, steps = np.where(at < 0, own, at), (at >= 0).astype(np.int64)
            least = own.copy()  # nodes are sorted, so a smaller node is a smaller place
            for _ in range(len(at).bit_length()):
                steps, least, hop = steps + steps[hop], np.minimum(least, least[hop]), hop[hop]
            head = np.ones(len(at), bool)
            head[at[at >= 0]] = False
            columns = [v, after.take(pa.array(hop)), v.take(pa.array(hop)), pa.array(steps + 1), v.take(pa.array(least)), pa.array(head), pa.array(at[hop] >= 0)]
            yield pa.RecordBatch.from_arrays(columns, ["v", "next", "last", "steps", "least", "head", "ring"])

    ordered = thin.select("v", "next").repartitionByRange("v").sortWithinPartitions("v")
    return written(ordered.mapInArrow(led, "v string, next string, last string, steps long, least string, head boolean, ring boolean"), "paths")


def _followed(thin: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each thin node leads to: ((v, to, last, steps), (v, root)), both written.

    The first has the nodes that lead out of the thin ones: where to, by which last thin node, and in how many steps. The second
    has those that go round, with the least node of their ring. Paths are first shortened, see :func:`_shortened`; then the pointers
    of what is left double, so a path of n heads takes about
    log n rounds: in each all that are as near as the pointers reach leave, and once none does only rings are left, whose
    least nodes are known when they no longer change. What lies on the way of a head gets the result of the head that it leads to.
    """
    short = _shortened(thin)
    start = short.where("head").select("v", "next", "last", "steps", "least")
    here = start.select(F.col("v").alias("next"), F.lit(True).alias("inner"))
    now = written(_met(start, here, "next", "left").select("v", "next", "last", "steps", "least", F.coalesce("inner", F.lit(False)).alias("inner")), "paths")
    before = None
    while True:
        seen = now.where("inner").agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "least").cast("decimal(38,0)"))).first()
        if not seen[0] or seen == before:
            break
        before = seen
        other = now.select(F.col("v").alias("next"), F.col("next").alias("far"), F.col("last").alias("far_last"), F.col("steps").alias("far_steps"), F.col("least").alias("far_least"), F.col("inner").alias("far_inner"))
        moved = _met(now.where("inner"), other, "next").select(
            "v", F.col("far").alias("next"), F.col("far_last").alias("last"), (F.col("steps") + F.col("far_steps")).alias("steps"), F.least("least", "far_least").alias("least"), F.col("far_inner").alias("inner")
        )
        last, now = now, written(now.where("NOT inner").union(moved), "paths")
        discard(last)
    ends = now.select(F.col("v").alias("next"), F.col("next").alias("far"), F.col("last").alias("far_last"), F.col("steps").alias("far_steps"), F.col("least").alias("root"), "inner")
    way = written(_met(short.where("NOT head AND NOT ring"), ends, "next", "left"), "paths")
    out = now.where("NOT inner").select("v", F.col("next").alias("to"), "last", "steps")
    out = out.union(way.where("NOT coalesce(inner, false)").select("v", F.coalesce("far", "next").alias("to"), F.coalesce("far_last", "last").alias("last"), F.col("steps") + F.coalesce("far_steps", F.lit(0))))
    rings = now.where("inner").select("v", F.col("least").alias("root")).union(way.where("inner").select("v", "root")).union(short.where("ring").select("v", "least"))
    out, rings = written(out, "paths"), written(rings, "rings")
    discard(now, way, short)
    return out, rings


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, least), written: the least node from which each node of the edges (a, b) is reached.

    Labels go along the edges and then jump: what reaches a node's label reaches the node, so long
    paths take about the logarithm of their length.
    """
    label = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("least", F.col("node"))
    label = written(label, "labels")
    while True:
        sent = _met(edges, label.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("least").alias("new"))
        best = written(_met(label, sent, "node", "left").select("node", F.col("least").alias("old"), F.least("least", "new").alias("least")), "labels")
        far = best.select(F.col("node").alias("least"), F.col("least").alias("jump"))
        now = written(_met(best, far, "least", "left").select("node", "old", F.least("least", "jump").alias("least")), "labels")
        discard(label, best)
        label = now.select("node", "least")
        if not now.where("least < old").limit(1).count():
            return label


def _coloured(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, root) of some strong components, the edges between what is in none of them), both written.

    Each node gets the least node that reaches it as its colour, and within its colour the least that it
    reaches: where both are the same, the node is in the component of that one.
    """
    colour = _least_reaching(left)
    ends = [colour.select(F.col("node").alias(end), F.col("least").alias(f"c{end}")) for end in "ab"]
    same = _met(_met(left, ends[0], "a"), ends[1], "b").where("ca = cb")
    same = written(same.select(F.col("b").alias("a"), F.col("a").alias("b"), "ca"), "scc")  # turned round
    back = _least_reaching(same.select("a", "b"))
    found = _met(back, colour.withColumnRenamed("least", "colour"), "node").where("least = colour").select("node", F.col("least").alias("root"))
    found = written(found, "scc")
    inside = [found.select(F.col("node").alias(end), F.col("root").alias(f"s{end}")) for end in "ab"]
    cyclic = _met(_met(same, inside[0], "a"), inside[1], "b").where("sa = sb").select(F.col("sa").alias("root")).distinct()
    rest = left
    roots = colour.where("node = least").select("node").union(found.select("node")).distinct()
    for end in "ab":
        rest = _met(rest, roots.select(F.col("node").alias(end)), end, "left_anti")
    done, rest = written(_met(found, cyclic, "root", "left_semi").select("node", "root"), "scc"), written(rest.select("a", "b"), "scc")
    discard(same, found)
    return done, rest


def _components(edges: DataFrame) -> DataFrame | None:
    """(node, root) of the nodes of (a, b), a written table without repeats, that lie on a cycle; a root stands for its component. None for none.

    What has no edge in or out is peeled, a few layers at a time. Then thin nodes, which have one edge in and one out, are left
    out: rings of them are components, and others belong to where they come from if that is where they lead to. So chains
    and long rings shrink to an edge in about the logarithm of their length, and so do trees, whose stems
    become thin as leaves are peeled. What is then left is coloured.
    """
    n_loops, before = edges.agg(F.count_if(F.col("a") == F.col("b")), F.count_if(F.col("a") != F.col("b"))).first()
    left, found = edges.where("a <> b"), None
    for _ in range(2):
        if before:
            last, left = left, written(_peeled(_peeled(left)), "scc")
            discard(last)
            now = left.count()
            before, shrunk = now, now < before
            if not shrunk:
                break
    if before:
        thin = written(_thin(left), "thin")
        if 8 * thin.count() >= before:
            out, rings = _followed(thin)
            inner = out.select(F.col("v").alias("b"), "to", "last")
            known = thin.select(F.col("v").alias("a"))
            entered = written(_met(_met(left, known, "a", "left_anti"), inner, "b", "left").select("a", F.coalesce("to", "b").alias("b"), "last"), "scc")
            found = _components(written(entered.select("a", "b").distinct(), "scc"))
            rooted = rings.select(F.col("v").alias("node"), "root")
            if found is not None:
                ends = [found.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")) for end in "ab"]
                round_ = _met(_met(entered.where("last IS NOT NULL"), ends[0], "a"), ends[1], "b").where("ra = rb").select("last", F.col("ra").alias("root"))
                rooted = rooted.union(_met(out, round_, "last").select(F.col("v").alias("node"), "root")).union(found)
            found = written(rooted, "scc")
        else:
            found, rest = _coloured(left)
            more = _components(rest)
            if more is not None:
                found = written(found.union(more), "scc")
    if not n_loops:
        return found
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    return written(loops if found is None else found.union(loops.join(found.select("node"), "node", "left_anti")), "scc")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, scc) of the nodes of (source, target) that lie on a cycle; ``scc`` is the smallest node of the component.

    See :func:`_components`; no nodes on cycles, or no edges, give no rows.
    """
    pairs = edges.select(F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    found = _components(written(pairs.distinct(), "edges"))
    if found is None:
        return edges.sparkSession.createDataFrame([], "node string, scc string")
    least = found.groupBy("root").agg(F.min("node").alias("scc"))
    return _met(found, least, "root").select("node", "scc")


def representative_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(scc, cycle): of each strong component, a shortest cycle through its least node.

    It starts with the least node's least successor in the component and returns by the least of the
    shortest paths; a loop on the least node is a cycle of its own.

    Nodes that lie between one edge in and one out are left out, so distances to the least node settle in as many rounds as the rest has edges
    on a path. Each node then knows its next one; what lies on the cycle is found by pointers of doubling length, and
    the cycle is put together once.
    """
    spark = edges.sparkSession
    components = written(components.select(F.col("node").cast("string").alias("node"), F.col("scc").cast("string").alias("scc")), "cycles")
    if not components.limit(1).count():
        return spark.createDataFrame([], "scc string, cycle array<string>")
    start = components.select(F.col("node").alias("a"), "scc")
    ends = components.select(F.col("node").alias("b"), F.col("scc").alias("other"))
    pairs = edges.select(F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b")).distinct()
    inner = written(_met(_met(pairs, start, "a"), ends, "b").where("scc = other").select("scc", "a", "b"), "cycles")
    first = written(inner.where("a = scc").groupBy("scc").agg(F.min("b").alias("s")), "cycles")
    loops = first.where("s = scc").select("scc", F.array("scc", "scc").alias("cycle"))
    first = first.where("s <> scc")
    ways = written(_met(inner.where("a <> b"), first.select("scc"), "scc", "left_semi").select("scc", "a", "b"), "cycles")
    if not ways.limit(1).count():
        return loops
    thin = written(_met(_thin(ways), first.select(F.col("scc").alias("v")), "v", "left_anti"), "cycles")
    out, _ = _followed(thin)
    # from each node that isn't thin: the first node of a way, where it leads, and its length
    leads = out.select(F.col("v").alias("b"), "to", "steps")
    arcs = _met(_met(ways, thin.select(F.col("v").alias("a")), "a", "left_anti"), leads, "b", "left")
    arcs = written(arcs.select("scc", "a", F.col("b").alias("first"), F.coalesce("to", "b").alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("w")), "cycles")
    far = written(first.select(F.col("scc").alias("to"), F.lit(0).cast("long").alias("d")), "cycles")
    before = None
    while True:
        seen = far.agg(F.count(F.lit(1)), F.sum("d")).first()
        if seen == before:
            break
        before = seen
        sent = _met(arcs, far, "to").select(F.col("a").alias("to"), (F.col("w") + F.col("d")).alias("d"))
        last, far = far, written(far.union(sent).groupBy("to").agg(F.min("d").alias("d")), "cycles")
        discard(last)
    tight = _met(_met(arcs.where("a <> scc"), far, "to"), far.select(F.col("to").alias("a"), F.col("d").alias("own")), "a").where("w + d = own")
    hops = tight.groupBy("scc", F.col("a").alias("v")).agg(F.min("first").alias("next"), F.min("own").alias("d"))
    between = _met(_met(_met(out, far, "to"), components.select(F.col("node").alias("v"), "scc"), "v"), thin, "v").select("scc", "v", "next", (F.col("steps") + F.col("d")).alias("d"))
    hops = written(hops.union(between), "cycles")
    on = written(_met(first, hops.select("scc", F.col("v").alias("s"), "d"), ["scc", "s"]).select("scc", F.col("s").alias("v"), "d"), "cycles")
    # a component of no more nodes than the cycle is all on it; pointers are doubled only in the others
    sizes = _met(hops.groupBy("scc").agg(F.count(F.lit(1)).alias("n")), on.select("scc", "d"), "scc")
    whole = written(sizes.where("n = d").select("scc"), "cycles")
    round_ = _met(hops, whole, "scc", "left_semi").select("scc", "v", "d")
    on, left = (written(_met(rows, whole, "scc", "left_anti"), "cycles") for rows in (on, hops))
    longest = on.agg(F.coalesce(F.max("d"), F.lit(0))).first()[0]
    jumps = [left.select("v", "next")]
    while 1 << len(jumps) < longest:
        again = jumps[-1].select(F.col("v").alias("next"), F.col("next").alias("far"))
        jumps.append(written(_met(jumps[-1], again, "next").select("v", F.col("far").alias("next")), "cycles"))  # the least node has none, so paths end there
    for jump in reversed(jumps if longest else []):
        ahead = _met(_met(on, jump, "v").select("scc", F.col("next").alias("v")), left.select("v", "d"), "v").select("scc", "v", "d")
        on = written(on.union(ahead).distinct(), "cycles")
    on = on.union(round_)
    path = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), "v"))), lambda x: x["v"])
    found = on.groupBy("scc").agg(path.alias("path"))
    return loops.union(found.select("scc", F.concat(F.array("scc"), "path", F.array("scc")).alias("cycle")))


def stale_clusters(cluster: DataFrame, times: DataFrame, now_ms: int, days: int) -> DataFrame:
    """(cluster, members, newest) where every dated member is older than ``days``; undated clusters are left out."""
    rows = cluster.join(times.select("id", "ts_ms"), "id", "left")
    out = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.max("ts_ms").alias("newest"))
    return out.where(F.col("newest") < F.lit(now_ms - days * 86_400_000))


def missing_indexes(paths: DataFrame, index_name: str = "index.md") -> DataFrame:
    """(dir): folders of files that hold no index file."""
    dirs = paths.select(path_dir(F.col("path")).alias("dir"))
    indexed = paths.where(F.col("path").rlike(f"(?:^|/){index_name.replace('.', chr(92) + '.')}$")).select(path_dir(F.col("path")).alias("dir"))
    return dirs.subtract(indexed)


def graph_stats(nodes: DataFrame, edges: DataFrame, degree: DataFrame) -> DataFrame:
    """One row: nodes, edges, broken edges, orphans."""
    a = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    b = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(~F.col("resolved")).alias("broken"))
    c = degree.agg(F.count_if((F.col("indegree") + F.col("outdegree")) == 0).alias("orphans"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # tables of one row
