"""Graph traversals, components, modularity, communities and searches over edge tables.

Traversals advance a frontier by one join a level and keep each node's least depth; what was visited leaves
by an anti join. Levels are written to the shared folder, so lineage doesn't grow and lost executors
cost nothing but a reread.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvasir.session import staged


def directed(edges: DataFrame, direction: str, source: str = "from_node", target: str = "to_node") -> DataFrame:
    """(x, y) in the direction out, in or both."""
    out, back = edges.select(F.col(source).alias("x"), F.col(target).alias("y")), edges.select(F.col(target).alias("x"), F.col(source).alias("y"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def bfs(steps: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, id, depth): nodes within ``depth`` steps (x, y) of each start (id), with their least depth."""
    seen = frontier = staged(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")))
    for d in range(1, depth + 1):
        near = frontier.join(steps, F.col("id") == F.col("x")).select("start", F.col("y").alias("id")).distinct()
        frontier = staged(near.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.union(frontier)
    return seen


def pair_distances(steps: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(start, target, distance): of each pair the least number of steps (x, y), where that is ``depth`` or less.

    Searched from both ends: all starts together half of the way, all targets together back the rest, so frontiers grow
    with the square root of what one side alone would visit. A shortest path has a node where both meet.
    """
    back = depth // 2
    pairs = staged(pairs.select("start", "target").distinct())
    ahead = bfs(steps, pairs.select(F.col("start").alias("id")).distinct(), depth - back).select("start", "id", F.col("depth").alias("d1"))
    behind = bfs(steps.select(F.col("y").alias("x"), F.col("x").alias("y")), pairs.select(F.col("target").alias("id")).distinct(), back)
    behind = behind.select(F.col("start").alias("target"), "id", F.col("depth").alias("d2"))
    met = pairs.join(ahead, "start").join(behind, ["target", "id"])
    return met.groupBy("start", "target").agg(F.min(F.col("d1") + F.col("d2")).alias("distance"))


def incident(seen: DataFrame, steps: DataFrame) -> DataFrame:
    """(start, x, y): steps from any visited node, those that leave the last layer included."""
    return seen.select("start", F.col("id").alias("x")).join(steps, "x").distinct()


def shortest_paths(steps: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, id, depth, path): one shortest outgoing path to each node, the least as a joined string."""
    seen = frontier = staged(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), F.col("id").alias("path")))
    for d in range(1, depth + 1):
        near = frontier.join(steps, F.col("id") == F.col("x")).select("start", F.col("y").alias("id"), F.concat_ws(">", "path", "y").alias("path"))
        near = near.join(seen.select("start", "id"), ["start", "id"], "left_anti").groupBy("start", "id").agg(F.min("path").alias("path"))
        frontier = staged(near.select("start", "id", F.lit(d).alias("depth"), "path"))
        seen = seen.union(frontier)
    return seen


def severity():
    """Of an affected node, from columns depth and kinds (array of edge types)."""
    strong = F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in ("implements", "extends", "imports", "calls")]))
    return F.when(F.col("depth") == 1, F.when(strong, "high").otherwise("medium")).when(F.col("depth") == 2, "medium").otherwise("low")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over the undirected edges (x, y); nodes without edges are their own.

    Each round every node takes the least label of its neighbours and then its label's label, so labels
    travel twice as far each time.
    """
    both = staged(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    label = staged(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("near"))
        step = staged(label.join(near, "id", "left").select("id", "component", F.least("component", "near").alias("next")))
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("far"))
        new = staged(step.join(jump, "next", "left").select("id", "component", F.least("next", "far").alias("next")))
        if new.where("component <> next").isEmpty():
            return label
        label = new.select("id", F.col("next").alias("component"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbour, weight): undirected, each neighbour once with its largest weight."""
    both = edges.select(F.col("x").alias("id"), F.col("y").alias("neighbour"), "weight").union(edges.select("y", "x", "weight"))
    return both.where("id <> neighbour").groupBy("id", "neighbour").agg(F.max("weight").alias("weight"))


def modularity(adj: DataFrame, community: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity): sum over communities of inside / W - resolution * (degree / 2W)^2, for a symmetric ``adj``."""
    c1, c2 = community.select("id", F.col("community").alias("c")), community.select(F.col("id").alias("neighbour"), F.col("community").alias("c2"))
    e = adj.join(c1, "id").join(c2, "neighbour")
    per = e.groupBy("c").agg(F.sum(F.when(F.col("c") == F.col("c2"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("degree"))
    total = adj.agg(F.sum("weight").alias("w2"))
    part = F.col("inside") / F.col("w2") - resolution * F.pow(F.col("degree") / F.col("w2"), 2)
    return per.crossJoin(total).agg(F.sum(part).alias("modularity"))  # one row


#: A move must raise the modularity by more than this; a round that raises it by less than LEAST_RISE is its level's last.
LEAST_GAIN, LEAST_RISE = 1e-9, 5e-4
#: Links of a block, whose nodes a task moves one after another; a graph has the more blocks the more links it has.
BLOCK = 1_000_000


def _sized(label: DataFrame) -> DataFrame:
    """(id, k, community, size): the nodes with their communities' sums of k, so that edges learn both in one join."""
    size = label.groupBy("community").agg(F.sum("k").alias("size"))
    return staged(label.join(size, "community").select("id", "k", "community", "size"))


def _settle(inner: list, outer: list | None, k: list, label: list, size: list, total: float, resolution: float, turns: int | None, unit: float) -> list:
    """What each node gained by moving one after another, until none gains or ``turns`` times each; ``label`` and ``size`` are changed.

    ``inner`` has of each node its links (node, weight), ``outer`` summed links to communities of nodes that stay, and gains are
    shares of ``unit``. After the first turn, nodes wait until a neighbour moves to another community; when none waits, all
    have one more turn.
    """
    gained, slack = [0.0] * len(k), 2e-12 * unit
    waiting, turn, moved = range(len(k)), 0, False
    while waiting and (turns is None or turn < turns):
        woken: set[int] = set()
        went = False
        for i in waiting:
            now, links = label[i], dict(outer[i]) if outer else {}
            for n, w in inner[i]:
                c = label[n]
                links[c] = links.get(c, 0.0) + w
            share = resolution * k[i] / total
            own = links.pop(now, 0.0) - share * (size[now] - k[i])
            gains = [w - share * size[c] for c, w in links.items()]
            most = max(gains, default=own)
            # Rounded, so that sums taken in another order choose alike; what can't be the most after that isn't rounded.
            stay, high = round(own / unit, 12), round(most / unit, 12)
            if high <= stay + LEAST_GAIN:
                continue
            to = min(c for c, g in zip(links, gains, strict=True) if g >= most - slack and round(g / unit, 12) == high)
            label[i], gained[i], went = to, gained[i] + high - stay, True
            size[now] -= k[i]
            size[to] += k[i]
            woken.update(n for n, _ in inner[i] if label[n] != to)
        turn, moved = turn + 1, went or (moved and len(waiting) < len(k))
        waiting = sorted(woken) if woken or not moved else range(len(k))
    return gained


def _block_moves(rows: pd.DataFrame, total: float, resolution: float, turns: int | None) -> pd.DataFrame:
    """One block's nodes, moved one after another (see _settle), while other blocks' nodes stay.

    Rows of kind 0 are the nodes, of kind 1 links between them, of kind 2 the summed links to other blocks' communities.
    Communities are numbered in their order.
    """
    rows = rows.sort_values(["id", "neighbour", "community"])
    numbers, names = pd.factorize(rows["community"], sort=True)
    size = rows.assign(community=numbers).groupby("community")["size"].max().tolist()
    own, place = rows[rows["kind"] == 0], {i: p for p, i in enumerate(rows["id"][rows["kind"] == 0])}
    k, before = own["k"].tolist(), numbers[rows["kind"] == 0].tolist()
    inner: list[list] = [[] for _ in k]
    outer: list[list] = [[] for _ in k]
    for i, n, c, w, kind in zip(rows["id"], rows["neighbour"], numbers.tolist(), rows["weight"], rows["kind"], strict=True):
        if kind == 1:
            inner[place[i]].append((place[n], w))
        elif kind == 2:
            outer[place[i]].append((c, w))
    label, inside = list(before), [0.0] * len(k)
    gained = _settle(inner, outer, k, label, size, total, resolution, turns, total)
    for i, now in enumerate(before):
        inside[i] = sum(w for n, w in inner[i] if before[n] == now) + sum(w for c, w in outer[i] if c == now)
    return own[["id", "k", "community", "size"]].assign(inside=inside, to=names.take(label), more=gained)


def _options(edges: DataFrame, label: DataFrame, total: float, resolution: float, blocks: int) -> DataFrame:
    """Of each node (id, k, community, size) its links inside its own community, the community it goes ``to`` in its block, and what it gains.

    A node's links to other blocks are summed by community before they get to its block.
    """
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    near = edges.join(label.select(F.col("id").alias("neighbour"), "community", "size"), "neighbour")
    inner = block("id") == block("neighbour")
    near = near.select("id", F.when(inner, F.col("neighbour")).otherwise(F.col("id")).alias("neighbour"), "community", "size", "weight", F.when(inner, 1).otherwise(2).alias("kind"))
    near = near.groupBy("id", "neighbour", "community", "kind").agg(F.max("size").alias("size"), F.sum("weight").alias("weight"))
    own = label.select("id", F.col("id").alias("neighbour"), "community", F.lit(0).alias("kind"), "size", F.lit(0.0).alias("weight"), "k")
    rows = own.unionByName(near.withColumn("k", F.lit(0.0))).withColumn("block", block("id"))
    kind = edges.schema["id"].dataType.simpleString()
    schema = f"id {kind}, k double, community {kind}, size double, inside double, to {kind}, more double"
    return rows.groupBy("block").applyInPandas(lambda r: _block_moves(r, total, resolution, None if blocks == 1 else 1), schema)


def _apart(moves: DataFrame) -> DataFrame:
    """Moves (id, community, to, more) of which no two touch one community, the greatest first."""
    touched = moves.select(F.explode(F.array("community", "to")).alias("c"), "id", "more")
    first = touched.groupBy("c").agg(F.min(F.struct((-F.col("more")).alias("less"), F.col("id").alias("id"))).alias("f")).select("c", F.col("f.id").alias("id"))
    free = first.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("id")
    return moves.join(free, "id", "left_semi")


def _moved(edges: DataFrame, label: DataFrame, total: float, resolution: float, blocks: int) -> DataFrame:
    """(id, k, community) after local moving, until no node gains, or only so little that the next level may do it.

    A single block's nodes move one after another, so one round is all. Several blocks move at once, each node once, by
    the other blocks' communities at the start of the round; of the moves a share (by a hash of the round and the node, at first a half)
    is made. A round that doesn't raise the modularity is taken back and the share halved; one that does doubles it
    again. Where the share holds hardly a node, those moves are made that touch no community twice; if those don't raise
    it either, moving ends.
    """
    best, step, bits, apart = None, 0, 1, False
    while True:
        state = staged(_options(edges, _sized(label), total, resolution, blocks))
        if blocks == 1:
            return state.select("id", "k", F.col("to").alias("community"))
        # Summed over nodes, k * size is the sum of the communities' squared sizes.
        moves = state.where(F.col("more") > LEAST_GAIN).select("id", "community", "to", "more")
        got = state.agg(F.sum("inside").alias("inside"), F.sum((F.col("more") > LEAST_GAIN).cast("int")).alias("moves"), F.sum(F.col("k") / total * F.col("size") / total).alias("squares")).first()
        quality, moving = (got["inside"] or 0.0) / total - resolution * (got["squares"] or 0.0), got["moves"] or 0
        rise = 1.0 if best is None else quality - best[0]
        if rise <= 1e-12 and best is not None:
            (quality, state, moving), bits = best, bits + 1
            moves = state.where(F.col("more") > LEAST_GAIN).select("id", "community", "to", "more")
            if apart:
                return state.select("id", "k", "community")
        elif not moving or rise < LEAST_RISE:
            return state.select("id", "k", "community")
        else:
            bits = max(1, bits - 1)
        best, apart = (quality, state, moving), moving < 2 << bits
        moves = _apart(moves) if apart else moves.where(F.pmod(F.xxhash64("id", F.lit(step)), F.lit(1 << bits)) == 0)
        label = state.select("id", "k", "community").join(moves.select("id", "to"), "id", "left").select("id", "k", F.coalesce("to", "community").alias("community"))
        step += 1


def _joined(inner: list, k: list, community: list, total: float, resolution: float) -> list:
    """Of each node its part: communities' nodes, merged one after another from single ones into well-connected parts (see _refined)."""
    part, size, n, every = list(range(len(k))), list(k), [1] * len(k), {}
    for i, c in enumerate(community):
        every[c] = every.get(c, 0.0) + k[i]
    own = [[(m, w) for m, w in links if community[m] == community[i]] for i, links in enumerate(inner)]
    whole = [sum(w for _, w in links) for links in own]
    cut = list(whole)
    enough = lambda w, k, i: w >= resolution * k * (every[community[i]] - k) / total
    ready = [i for i in range(len(k)) if enough(whole[i], k[i], i)]
    joined = True
    while joined:
        joined = False
        for i in ready:
            if n[part[i]] > 1:
                continue
            links: dict = {}
            for m, w in own[i]:
                links[part[m]] = links.get(part[m], 0.0) + w
            gain = {p: round((w - resolution * k[i] * size[p] / total) / total, 12) for p, w in links.items() if p != part[i] and enough(cut[p], size[p], i)}
            to = min(gain, key=lambda p: (-gain[p], p), default=None)
            if to is not None and gain[to] >= 0:
                n[part[i]], part[i], joined = 0, to, True
                size[to], n[to], cut[to] = size[to] + k[i], n[to] + 1, cut[to] + whole[i] - 2 * links[to]
    return part


def _block_parts(rows: pd.DataFrame, total: float, resolution: float) -> pd.DataFrame:
    """Whole communities' nodes with their parts (see _joined)."""
    own, links = rows[rows["kind"] == 0].sort_values("id"), rows[rows["kind"] == 1]
    place = {i: p for p, i in enumerate(own["id"])}
    inner: list[list] = [[] for _ in place]
    for i, n, w in zip(links["id"], links["neighbour"], links["weight"], strict=True):
        inner[place[i]].append((place[n], w))
    part = _joined(inner, own["k"].tolist(), own["community"].tolist(), total, resolution)
    return pd.DataFrame({"id": own["id"], "k": own["k"], "community": own["community"], "part": own["id"].take(part).to_numpy()})


def _leiden(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: np.ndarray, total: float, resolution: float) -> np.ndarray:
    """Of each node (a number) the least one of its community: all levels on a graph's links (x, y, w) both ways, whose nodes
    are linked to no others of the graph that ``total`` is the weight of."""
    node, label, first, unit = np.arange(len(k)), np.arange(len(k)), (x, y), float(k.sum()) or 1.0
    while True:
        order = np.lexsort((y, x))
        ends = np.searchsorted(x[order], np.arange(len(k) + 1)).tolist()
        pairs = list(zip(y[order].tolist(), w[order].tolist(), strict=True))
        inner = [pairs[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        label, size = label.tolist(), np.bincount(label, k, len(k)).tolist()
        _settle(inner, None, k.tolist(), label, size, total, resolution, None, unit)
        label = np.array(label, np.int64)
        if len(np.unique(label)) == len(k):
            return _least(label[node])
        names, part = np.unique(np.array(_joined(inner, k.tolist(), label.tolist(), total, resolution), np.int64), return_inverse=True)
        if len(names) == len(k):
            break
        node, k = part[node], np.bincount(part, k)
        label = np.unique(label[names], return_inverse=True)[1]
        x, y = part[x], part[y]
        key, at = np.unique((x * len(names) + y)[x != y], return_inverse=True)
        x, y, w = key // len(names), key % len(names), np.bincount(at, w[x != y], len(key))
    return _apart_within(label[node], *first)


def _least(of: np.ndarray) -> np.ndarray:
    """Of each place the first one with the same number."""
    _, first, at = np.unique(of, return_index=True, return_inverse=True)
    return first[at]


def _apart_within(of: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each node the least one that links (x, y) inside its community reach."""
    x, y = x[of[x] == of[y]], y[of[x] == of[y]]
    label = np.arange(len(of))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block_communities(rows: pa.Table, total: float, resolution: float) -> pa.Table:
    """Whole connected components' nodes (kind 0) and links (kind 1) as (id, community), a community named after its least id."""
    own, links = rows.filter(pc.equal(rows["kind"], 0)).sort_by("id"), rows.filter(pc.equal(rows["kind"], 1))
    ids = own["id"].combine_chunks()
    x, y = (pc.index_in(links[c], value_set=ids).to_numpy().astype(np.int64) for c in ("id", "neighbour"))
    of = _leiden(x, y, links["weight"].to_numpy(), own["k"].to_numpy(), total, resolution)
    return pa.table({"id": ids, "community": ids.take(pa.array(of))})


def _parts(edges: DataFrame, label: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, k, community, part) after refinement: communities of few links in blocks, the others by rounds of joins."""
    ends = edges.join(label.select("id", "community"), "id").join(label.select(F.col("id").alias("neighbour"), F.col("community").alias("c2")), "neighbour")
    own = staged(ends.where("community = c2").select("id", "neighbour", "weight", "community"))
    count = staged(own.groupBy("community").agg(F.count(F.lit(1)).alias("links")))
    got = count.agg(F.sum("links").alias("links"), F.max("links").alias("most")).first()
    few, many = label, None
    if (got["most"] or 0) > BLOCK:
        large = staged(count.where(F.col("links") > BLOCK).select("community"))
        few, many = label.join(large, "community", "left_anti"), label.join(large, "community", "left_semi")
        many = _refined(own.join(large, "community", "left_semi").select("id", "neighbour", "weight"), many, total, resolution)
        own = own.join(large, "community", "left_anti")
    rows = few.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("weight"), "community", "k", F.lit(0).alias("kind"))
    rows = rows.unionByName(own.withColumns({"k": F.lit(0.0), "kind": F.lit(1)}))
    kind = edges.schema["id"].dataType.simpleString()
    blocks = 1 + (got["links"] or 0) // BLOCK
    parts = rows.groupBy(F.pmod(F.xxhash64("community"), F.lit(blocks)).alias("block")).applyInPandas(lambda r: _block_parts(r, total, resolution), f"id {kind}, k double, community {kind}, part {kind}")
    return parts if many is None else parts.union(many)


def _refined(edges: DataFrame, label: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, k, community, part): each community's nodes, from single ones merged into well-connected parts.

    Only single nodes join, and only parts that stay where they are, so each part is connected. A node must be well
    linked to its community and its part must be, and joining must not lower the modularity. A single node goes to the
    part it gains most by; to another single node only if a hash puts it first of the two and the other doesn't go
    itself. Rounds go on while any node could join.
    """
    here = label.select("id", "k", "community")
    other = label.select(F.col("id").alias("neighbour"), F.col("community").alias("c2"))
    own = staged(edges.join(label.select("id", "community"), "id").join(other, "neighbour").where("community = c2").select("id", "neighbour", "weight"))
    whole = here.groupBy("community").agg(F.sum("k").alias("all"))
    links = own.groupBy("id").agg(F.sum("weight").alias("w"))
    enough = lambda w, k: w >= resolution * k * (F.col("all") - k) / total
    nodes = here.join(whole, "community").join(links, "id", "left").withColumn("well", enough(F.coalesce("w", F.lit(0.0)), F.col("k"))).select("id", "k", "community", "all", "well", F.col("id").alias("part"))
    step = 0
    while True:
        nodes = staged(nodes)
        near = own.join(nodes.select(F.col("id").alias("neighbour"), F.col("part").alias("to")), "neighbour").groupBy("id", "to").agg(F.sum("weight").alias("w"))
        met = staged(near.join(nodes.select("id", "part", "k", "well"), "id"))
        cut = met.where("part <> to").groupBy(F.col("part").alias("to")).agg(F.sum("w").alias("out"))
        parts = nodes.groupBy(F.col("part").alias("to")).agg(F.sum("k").alias("size"), F.count(F.lit(1)).alias("n"), F.max("all").alias("all"))
        parts = parts.join(cut, "to", "left").withColumn("whole", enough(F.coalesce("out", F.lit(0.0)), F.col("size"))).select("to", "size", "n", "whole")
        single = parts.where("n = 1").select(F.col("to").alias("part"))
        can = met.where("part <> to AND well").join(single, "part", "left_semi").join(parts.where("whole"), "to")
        can = can.withColumn("gain", F.round((F.col("w") - resolution * F.col("k") * F.col("size") / total) / total, 12)).where("gain >= 0")
        best = F.min(F.struct((-F.col("gain")).alias("less"), F.col("to").alias("to"), F.col("n").alias("n"))).alias("b")
        wish = staged(can.groupBy("id").agg(best).select("id", "b.to", (F.col("b.n") > 1).alias("held")))
        if wish.isEmpty():
            return nodes.select("id", "k", "community", "part")
        order = lambda c: F.struct(F.xxhash64(c, F.lit(step)), c)  # noqa: B023, E731
        goes = wish.where(F.col("held") | (order("id") > order("to")))
        best = goes.where("held").select("id", "to").union(goes.where("NOT held").join(goes.select(F.col("id").alias("to")), "to", "left_anti").select("id", "to"))
        nodes = nodes.join(best, "id", "left").select("id", "k", "community", "all", "well", F.coalesce("to", "part").alias("part"))
        step += 1


def _components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component, links): connected components of edges (id, neighbour) given both ways, with each node's number of links.

    Each node's first and last neighbour connect most of a component, by rounds over few rows; then the components of
    that are connected by the links between them, which are read once.
    """
    ends = staged(edges.groupBy("id").agg(F.min("neighbour").alias("a"), F.max("neighbour").alias("b"), F.count(F.lit(1)).alias("links")))
    label = connected_components(nodes.select("id"), ends.select(F.col("id").alias("x"), F.explode(F.array("a", "b")).alias("y")))
    c1, c2 = label.select("id", F.col("component").alias("x")), label.select(F.col("id").alias("neighbour"), F.col("component").alias("y"))
    across = staged(edges.where("id < neighbour").join(c1, "id").join(c2, "neighbour").where("x <> y").select("x", "y").distinct())
    if not across.isEmpty():
        far = connected_components(label.select(F.col("component").alias("id")).distinct(), across)
        label = label.join(far.select(F.col("id").alias("component"), F.col("component").alias("far")), "component").select("id", F.col("far").alias("component"))
    return staged(label.join(ends.select("id", "links"), "id", "left").select("id", "component", F.coalesce("links", F.lit(0)).alias("links")))


def communities(adj: DataFrame, resolution: float = 1.0, degrees: DataFrame | None = None) -> DataFrame:
    """(id, community): Leiden's method on a symmetric (id, neighbour, weight), each community named after its least id.

    Communities don't go beyond connected components, so those of up to BLOCK links are searched whole, each in one task, small
    ones several together, by the weight of the whole graph; larger ones by rounds (see _large). A community is connected.
    Deterministic. ``degrees`` (id, k) gives the nodes' weights where the graph is an aggregate itself.
    """
    edges = staged(adj.where("id <> neighbour").select("id", "neighbour", F.col("weight").cast("double").alias("weight")))
    first = staged(edges.groupBy("id").agg(F.sum("weight").alias("k")) if degrees is None else degrees.select("id", F.col("k").cast("double").alias("k")))
    total, links = first.agg(F.sum("k")).first()[0] or 1.0, edges.count()
    kind = edges.schema["id"].dataType.simpleString()
    whole = lambda rows: rows.groupBy("bin").applyInArrow(lambda t: _block_communities(t, total, resolution), f"id {kind}, community {kind}")
    nodes = first.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("weight"), "k", F.lit(0).alias("kind"))
    rows = nodes.unionByName(edges.withColumns({"k": F.lit(0.0), "kind": F.lit(1)}))
    if links <= BLOCK:
        return staged(whole(rows.withColumn("bin", F.lit(0))))
    of = _components(edges, first)
    size = of.groupBy("component").agg(F.sum("links").alias("all"))
    bins = 1 + links // BLOCK
    # Of a component of many links, its own number; of the others, one of a number that grows with the links.
    number = F.when(F.col("all") * 8 > BLOCK, F.xxhash64("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bins)))
    of = staged(of.join(size, "component").select("id", number.alias("bin"), (F.col("all") > BLOCK).alias("large")))
    small = rows.join(of.where("NOT large").select("id", "bin"), "id")
    found = staged(whole(small.repartition(16 * bins, "bin")))
    large = of.where("large").select("id")
    if large.isEmpty():
        return found
    return found.union(_large(staged(edges.join(large, "id")), staged(first.join(large, "id")), total, resolution))


def _large(edges: DataFrame, first: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, community) of components of many links, with the nodes' weights (id, k).

    Local moving, refinement into connected parts, and aggregation of the parts to the nodes of the next, smaller
    graph, until every community is one node there. A community is then connected; were one not refined, its
    connected components are taken apart.
    """
    member, label = first.select("id", F.col("id").alias("node")), first.withColumn("community", F.col("id"))
    whole_edges = edges
    while True:
        label = staged(_moved(edges, label, total, resolution, 1 + edges.count() // BLOCK))
        counts = label.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("community").alias("communities")).first()
        if counts["nodes"] == counts["communities"]:
            break
        parts = staged(_parts(edges, label, total, resolution))
        part = parts.select("id", "part")
        member = staged(member.join(part.withColumnRenamed("id", "node"), "node").select("id", F.col("part").alias("node")))
        smaller = staged(parts.groupBy(F.col("part").alias("id")).agg(F.sum("k").alias("k"), F.min("community").alias("community")))
        if smaller.count() == counts["nodes"]:
            break
        ends = edges.join(part, "id").select(F.col("part").alias("x"), "neighbour", "weight").join(part.select(F.col("id").alias("neighbour"), F.col("part").alias("y")), "neighbour")
        edges = staged(ends.where("x <> y").groupBy(F.col("x").alias("id"), F.col("y").alias("neighbour")).agg(F.sum("weight").alias("weight")))
        label = smaller
    of = staged(member.join(label.select(F.col("id").alias("node"), "community"), "node").select("id", "community"))
    if counts["nodes"] != counts["communities"]:
        inner = whole_edges.join(of, "id").join(of.select(F.col("id").alias("neighbour"), F.col("community").alias("c2")), "neighbour").where("community = c2")
        of = connected_components(of.select("id"), inner.select(F.col("id").alias("x"), F.col("neighbour").alias("y"))).withColumnRenamed("component", "community")
    least = of.groupBy("community").agg(F.min("id").alias("least"))
    return of.join(least, "community").select("id", F.col("least").alias("community"))


def hierarchy(adj: DataFrame, resolutions: tuple[float, ...] = (1.0, 0.5, 0.25)) -> DataFrame:
    """(level, id, community, parent): communities at each resolution, those of a level made of whole ones of the level
    before, whose communities are the nodes of its graph. A community's parent is the one at the level before that most
    of its members are in.
    """
    edges, degrees, member = staged(adj), None, None
    out, before = None, None
    for level, r in enumerate(resolutions):
        found = staged(communities(edges, r, degrees))
        now = found if member is None else staged(member.join(found.select(F.col("id").alias("node"), "community"), "node").select("id", "community"))
        if before is None:
            rows = now.withColumn("parent", F.lit(None).cast(now.schema["community"].dataType))
        else:
            votes = now.join(before.select("id", F.col("community").alias("parent")), "id").groupBy("community", "parent").agg(F.count(F.lit(1)).alias("n"))
            best = votes.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "parent"))).where("k = 1")
            rows = now.join(best.select("community", "parent"), "community", "left").select("id", "community", "parent")
        rows = rows.select(F.lit(level).alias("level"), "id", "community", "parent")
        out, before = rows if out is None else out.union(rows), now
        if level == len(resolutions) - 1:
            break
        k = edges.groupBy("id").agg(F.sum("weight").cast("double").alias("k")) if degrees is None else degrees
        degrees = staged(k.join(found, "id").groupBy(F.col("community").alias("id")).agg(F.sum("k").alias("k")))
        ends = edges.join(found, "id").join(found.select(F.col("id").alias("neighbour"), F.col("community").alias("c2")), "neighbour").where("community <> c2")
        edges = staged(ends.groupBy(F.col("community").alias("id"), F.col("c2").alias("neighbour")).agg(F.sum("weight").alias("weight")))
        member = now.select("id", F.col("community").alias("node"))
    return out


def local_search(edges: DataFrame, seeds: DataFrame, depth: int = 2, least: int = 3) -> DataFrame:
    """(id, depth, score): from seeds (id, score), each step over an edge (x, y, strength) of ``least`` or more
    multiplies by strength / 10 and .8 to the depth; a node keeps its first depth, there its best score.
    """
    strong = edges.where(F.col("strength") >= least)
    both = strong.select("x", "y", "strength").union(strong.select("y", "x", "strength"))
    seen = frontier = staged(seeds.select("id", F.lit(0).alias("depth"), F.col("score").cast("double").alias("score")))
    for d in range(1, depth + 1):
        near = frontier.join(both, F.col("id") == F.col("x")).select(F.col("y").alias("id"), (F.col("score") * (F.col("strength") / 10.0) * 0.8 ** d).alias("score"))
        near = near.groupBy("id").agg(F.max("score").alias("score")).join(seen.select("id"), "id", "left_anti")
        frontier = staged(near.select("id", F.lit(d).alias("depth"), "score"))
        seen = seen.union(frontier)
    return seen


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
