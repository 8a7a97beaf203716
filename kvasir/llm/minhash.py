"""Operator 9: near-duplicate documents by min-max hashing.

A document is the set of its distinct five-word shingles. Each of ``functions`` permutations gives two
signature values, the minimum and the maximum of the set under it, so a signature takes half the hash
evaluations of one minimum each. Four values of four different permutations form a band; documents with a
band in common are candidates. At similarity 0.75 a pair shares none of the 28 bands with a chance of
2.4e-5. Every link is confirmed on the two full shingle sets, taken from the texts.

Documents with one and the same set form a class with a number of its own, compared once. Links
within buckets are then found without pairing a bucket's members with each other:

1. All classes of a bucket are compared with the one of the smallest id, the hub; that joins groups of copies. A
   hub and all that are compared with it are a family.
2. A family that still holds several components gets a reference, first the hub's set. A member is then its
   edits, what it lacks of the reference c and what it adds. With l(x) lacking shingles, two members x and y
   are linked exactly if

       14 * common edits >= q(x) + q(y),   q(x) = 6 |x| + 14 l(x) - 7 |c|.

   A family is dealt into blocks of about ``BLOCK`` members and ``BLOCK_EDITS`` edits, and any two blocks meet in a
   group, which counts the common edits of all their pairs as products of matrices and writes no pairs but the links
   that join components. So a member's edits are sent as often as its family has blocks. Only families of more than
   ``BLOCKS`` blocks are divided, until their parts have no more: the steps 3 and 4.
3. The edits that most members have are moved into the reference. Members whose q is at most minus the least q
   are then linked with the member that has it, unseen.
4. Any other link needs common edits. With e(x) edits that others have, too, x can only be linked with a y of
   q(y) <= 14 e(x) - q(x), and the other way round; who has no such y leaves. Edits that the very same members of a
   family have are one edit, with their number as its weight. Edits are ordered by how few members have them; of a
   member that needs a weight k in common with anyone, only an edit with k or more from it on can be the first common
   one. The members that have such an edit, with their further edits, form a smaller family of at most half the size.
   Families of up to ``PAIRED`` members, and those that have no more pairs than their division would have rows, are
   compared pair by pair, by their edits; the larger ones go through step 2 again, less those that a level's links have
   joined to one component.

So no link between candidates that would join components is lost and no bucket or candidate list is capped. A division
never makes more rows than its families have pairs (sixteen members' pairs aside), and a family halves at least.

Sets are held as 64-bit hashes of their shingles. Ids may be of any type that has an order.

Defined cases: null and empty texts have an empty set and no links; fewer than five words are one shingle;
rows with a null id aren't linked and have a null component; repeated rows each get a row, all kept or none;
of rows that share an id but not a text, each is linked by its own text; texts of any length are shingled
whole; an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.llm.common import Stage
from kvasir.llm.components import components

WORDS, FUNCTIONS, ROWS = 5, 56, 4
REMEMBERED, LONG_WORD = 400_000, 64
#: A family's blocks have about so many members and edits at most; families of more blocks than the third are divided.
BLOCK, BLOCK_EDITS, BLOCKS = 1024, 500_000, 64
#: Parts of a divided family that have so many members are compared pair by pair; larger ones are dealt into blocks again.
PAIRED = 16
#: An edit that one pair of so many has is counted as a column of a matrix, a rarer one pair by pair; so many at once.
DENSE, COLUMNS, AT_ONCE = 64, 1024, 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """Bytes split at exactly space and \\x09-\\x0D; lower() on bytes changes A-Z only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None) -> frozenset[bytes]:
    """The set itself, of shingles as joined words."""
    w = words_of(text)
    if len(w) <= WORDS:
        return frozenset([b" ".join(w)] if w else [])
    return frozenset(map(b" ".join, zip(*(w[i:] for i in range(WORDS)), strict=False)))


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Signer:
    """Shingle hashes, min-max signatures and band keys."""

    def __init__(self, functions: int = FUNCTIONS, rows: int = ROWS, seed: int = 20240607):
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(0, 2**63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, functions, dtype=np.uint64)
        self.bands = 2 * functions // rows
        half, k = rows // 2, np.arange(functions)
        lows, highs = k.reshape(self.bands, half), np.roll(k, -functions // 2).reshape(self.bands, half)
        self.rows = np.concatenate((lows, highs + functions), axis=1)
        self.weights = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingles' 64-bit hashes, ascending."""
        w, known = words_of(text), self.known
        if not w:
            return np.zeros(0, np.uint64)
        ids = []
        for x in w:
            h = known.get(x)
            if h is None:
                h = xxhash.xxh3_64_intdigest(x)
                if len(x) <= LONG_WORD:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[x] = h
            ids.append(h)
        v = np.array(ids, np.uint64)
        n = max(1, len(v) - WORDS + 1)
        h = np.full(n, len(v) if len(v) < WORDS else WORDS, np.uint64)
        for i in range(min(WORDS, len(v))):
            h = h * np.uint64(0x9E3779B97F4A7C15) + v[i : i + n]
        return np.unique(_mix(h))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Minima and then maxima under each function."""
        low, high = np.full(len(self.mul), 2**64 - 1, np.uint64), np.zeros(len(self.mul), np.uint64)
        for at in range(0, len(shingles), 4096):
            h = self.mul[:, None] * shingles[None, at : at + 4096] + self.add[:, None]
            np.minimum(low, h.min(axis=1), out=low)
            np.maximum(high, h.max(axis=1), out=high)
        return np.concatenate((low, high))

    def keys(self, signature: np.ndarray) -> np.ndarray:
        h = (signature[self.rows] * self.weights).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return _mix(h).view(np.int64)


_signer: list[Signer] = []


def _signed() -> Signer:
    if not _signer:
        _signer.append(Signer())
    return _signer[0]


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signer = _signed()
    for batch in batches:
        sizes, sets, bands = [], [], []
        for text in batch.column(1):
            s = signer.shingles(text.as_py())
            sizes.append(len(s))
            sets.append(_digest(s))
            bands.append(signer.keys(signer.signature(s)) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["id", "n_shingles", "set_key", "bands"],
        )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sa, sb) to (a, b, n_a, n_b, common): the full sets' sizes and their intersection's."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        common = [len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pc.list_value_length(left).cast(pa.int64()), pc.list_value_length(right).cast(pa.int64()), pa.array(common, pa.int64())], names=["a", "b", "n_a", "n_b", "common"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (set_key, set): the set's hashes and their digest."""
    signer = _signed()
    for batch in batches:
        sets = [signer.shingles(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set_key", "set"])


LINKED = "common > 0 AND 100 * common >= 75 * (n_a + n_b - common)"


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) with their sets sa and sb."""
    return pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows with the component of a, which without links is a."""
    found = label.select(F.col("id").alias("a"), "component")
    return rows.join(found, "a", "left").withColumn("component", F.coalesce("component", "a"))


def _families(compared: DataFrame, label: DataFrame, sets: DataFrame, stage: Stage) -> DataFrame:
    """(g, a, component, q, edits) of the families with several components; the hub is a member without edits."""
    members = compared.select("a", "b", F.col("n_a").alias("n"), F.col("n_b").alias("c"))
    hubs = compared.groupBy("b").agg(F.max("n_b").alias("c")).select(F.col("b").alias("a"), "b", F.col("c").alias("n"), "c")
    rows = stage.table(_labelled(members.union(hubs), label))
    sizes = rows.groupBy("b").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    # A family of a hub and one more is compared already.
    mixed = stage.table(sizes.where("low <> high AND members > 2").select("b"))
    lacks, adds = F.array_except("sb", "sa"), F.array_except("sa", "sb")
    found = _with_sets(rows.join(mixed, "b"), sets).select(F.col("b").alias("g"), "a", "component", "n", "c", lacks.alias("lacks"), adds.alias("adds"))
    q = (6 * F.col("n") + 14 * F.size("lacks") - 7 * F.col("c")).cast("long")
    edits = F.transform(F.concat("lacks", "adds"), lambda x: F.struct(x.alias("x"), F.lit(1).alias("w")))
    return stage.table(found.select("g", "a", "component", q.alias("q"), edits.alias("edits")))


EDITS = "array<struct<x:bigint,w:int>>"


def _common(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], weights: np.ndarray, n: int, m: int) -> np.ndarray:
    """The weight of the edits that each of n members has in common with each of m; a side is its edits' members and numbers."""
    (rows, xs), (cols, ys) = left, right
    out, have, got = np.zeros((n, m)), np.bincount(xs, minlength=len(weights)), np.bincount(ys, minlength=len(weights))
    dense = have * got * DENSE >= n * m
    names = np.flatnonzero(dense)
    for at in range(0, len(names), COLUMNS):
        now, seat = names[at : at + COLUMNS], np.full(len(weights), -1)
        seat[now] = np.arange(len(now))
        a, b = np.zeros((n, len(now))), np.zeros((m, len(now)))
        here, there = seat[xs] >= 0, seat[ys] >= 0
        a[rows[here], seat[xs[here]]] = weights[xs[here]]
        b[cols[there], seat[ys[there]]] = 1
        out += a @ b.T
    rare = ~dense[xs] & (got[xs] > 0)
    rows, xs = rows[rare], xs[rare]
    order = np.argsort(ys, kind="stable")
    cols, first, times = cols[order], (np.cumsum(got) - got)[xs], got[xs]
    # An edit of a member on the left meets those who have it on the right.
    cuts = np.searchsorted(np.cumsum(times), np.arange(AT_ONCE, times.sum() + AT_ONCE, AT_ONCE), side="right")
    for a, b in itertools.pairwise([0, *cuts]):
        k = times[a:b]
        place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[a:b], k)
        np.add.at(out, (np.repeat(rows[a:b], k), cols[place]), np.repeat(weights[xs[a:b]], k).astype(float))
    return out


def _join_blocks(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """(g, i, j, block, a, component, q, edits) of two blocks i and j, or one, to links (a, b) that join all components that links between them join."""
    group = group.combine_chunks()
    block, ids, q = (group.column(c).to_numpy() for c in ("block", "a", "q"))
    names, component = np.unique(group.column("component").to_numpy(), return_inverse=True)
    found = []
    if len(names) > 1:
        edits = group.column("edits").combine_chunks()
        flat = pc.list_flatten(edits)
        member = np.repeat(np.arange(len(ids)), pc.list_value_length(edits).to_numpy())
        _, first, number = np.unique(flat.field("x").to_numpy(), return_index=True, return_inverse=True)
        weights = flat.field("w").to_numpy()[first].astype(np.int64)
        sides = []
        for k in (key[1].as_py(), key[2].as_py()):
            of = np.flatnonzero(block == k)
            seat = np.full(len(ids), -1)
            seat[of] = np.arange(len(of))
            mine = seat[member] >= 0
            sides.append((of, (seat[member[mine]], number[mine])))
        (left, a), (right, b) = sides
        linked = 14 * _common(a, b, weights, len(left), len(right)) >= q[left][:, None] + q[right][None, :]
        linked &= component[left][:, None] != component[right][None, :]
        root = np.arange(len(names))
        for r in np.flatnonzero(linked.any(axis=1)):
            to = right[linked[r]]
            for x, at in zip(*np.unique(root[component[to]], return_index=True), strict=True):
                if x != (own := root[component[left[r]]]):
                    found.append((ids[left[r]], ids[to[at]]))
                    root[root == x] = own
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _in_blocks(rows: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame | None]:
    """The links (a, b) that join components in the families of up to ``BLOCKS`` blocks, and the other families' rows; None: there are none."""
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.sum(F.size("edits")).alias("edits"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("edits") / BLOCK_EDITS)).cast("int")
    sizes = stage.table(sizes.select("g", blocks.alias("blocks")))
    here = rows.join(sizes.where(F.col("blocks") <= BLOCKS), "g").withColumn("block", F.pmod(F.xxhash64("a"), "blocks").cast("int"))
    here = here.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = here.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "a", "component", "q", "edits")
    links = stage.table(dealt.groupBy("g", "i", "j").applyInArrow(_join_blocks, "a long, b long"))
    large = sizes.where(F.col("blocks") > BLOCKS).select("g")
    return links, None if large.isEmpty() else stage.table(rows.join(large, "g"))


def _weight(edits: Column) -> Column:
    return F.aggregate(edits, F.lit(0).cast("long"), lambda t, e: t + e["w"])


def _merged(rows: DataFrame, stage: Stage, n: int) -> DataFrame:
    """The rows (g, a, component, q, edits) with each family's edits that the very same members have made one, of their
    weights' sum: a word changed is five shingles, and copies of one editing share all of it."""
    each = rows.select("g", "a", F.explode("edits").alias("e")).select("g", "a", "e.x", "e.w")
    # The members' sets are told apart by two 64-bit sums of their hashes.
    of = [F.expr("bit_xor(xxhash64(a))").alias("s1"), F.expr("bit_xor(xxhash64(a, 1))").alias("s2")]
    have = each.groupBy("g", "x").agg(F.count(F.lit(1)).alias("k"), F.max("w").alias("w"), *of)
    one = stage.table(have.groupBy("g", "k", "s1", "s2").agg(F.min("x").alias("x"), F.sum("w").cast("int").alias("w")).select("g", "x", "w"), n)
    left = each.select("g", "a", "x").join(one, ["g", "x"]).groupBy("g", "a").agg(F.collect_list(F.struct("x", "w")).alias("edits"))
    return stage.table(rows.drop("edits").join(left, ["g", "a"], "left").withColumn("edits", F.coalesce("edits", F.array().cast(EDITS))), n)


def _agreed(rows: DataFrame, stage: Stage, n: int) -> DataFrame:
    """The rows after the edits of most members have gone into the reference."""
    sizes = stage.table(rows.groupBy("g").agg(F.count(F.lit(1)).alias("members")), n)
    each = rows.select("g", F.explode("edits").alias("e")).groupBy("g", "e").agg(F.count(F.lit(1)).alias("k"))
    # Of most members' edits there are at most twice as many as a member has on average.
    turned = stage.table(each.join(sizes, "g").where("2 * k > members").groupBy("g").agg(F.collect_list("e").alias("most")), n)
    most = F.coalesce("most", F.array().cast(EDITS))
    not_mine = F.array_except(most, "edits")
    q = F.col("q") - 7 * _weight(most) + 14 * _weight(not_mine)
    return stage.table(rows.join(turned, "g", "left").select("g", "a", "component", q.alias("q"), F.concat(F.array_except("edits", most), not_mine).alias("edits")), n)


def _divided(rows: DataFrame, stage: Stage, n: int) -> tuple[DataFrame, DataFrame]:
    """One level: the links (a, b) that are certain or confirmed on the edits, and the smaller families that remain.

    ``n`` is the number of the rows' edits, by which the tables are dealt over tasks.
    """
    put = _agreed(_merged(rows, stage, n), stage, n)
    each = put.select("g", "a", F.explode("edits").alias("e")).select("g", "a", "e.x", "e.w")
    often = stage.table(each.groupBy("g", "x").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), n)
    # s: the weight of an edit and of all behind it.
    behind = Window.partitionBy("g", "a").orderBy(F.desc("k"), F.desc("x"))
    each = each.join(often, ["g", "x"]).withColumn("s", F.sum("w").over(behind.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = stage.table(each.groupBy("g", "a").agg(F.array_sort(F.collect_list(F.struct("k", "x", "w", "s"))).alias("e")), n)
    e = F.coalesce("e", F.array().cast("array<struct<k:bigint,x:bigint,w:int,s:bigint>>"))
    put = put.drop("edits").join(ranked, ["g", "a"], "left").withColumn("e", e).withColumn("room", 14 * _weight(F.col("e")) - F.col("q"))
    put = stage.table(put, n)
    best = stage.table(put.groupBy("g").agg(F.min(F.struct("q", "a", "component")).alias("best"), F.max("room").alias("most_room")), n)
    put = put.join(best, "g")
    sure = F.col("q") + F.col("best.q") <= 0
    certain = put.where(sure & (F.col("component") != F.col("best.component"))).select("a", F.col("best.a").alias("b"))
    put = put.withColumn("component", F.when(sure, F.col("best.component")).otherwise(F.col("component")))
    need = F.greatest(F.lit(1), F.ceil((F.col("q") + F.col("best.q")) / 14))
    firsts = F.filter("e", lambda t: t["s"] >= need)
    alive = stage.table(put.where("q <= most_room AND room >= best.q").withColumn("firsts", F.size(firsts)), n)
    sizes = alive.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("firsts").alias("rows")).where("low <> high")
    # A family is divided only where that makes fewer rows than it has pairs.
    mixed = stage.table(sizes.select("g", (F.col("n") * (F.col("n") - 1) <= 2 * F.col("rows")).alias("paired")), n)
    if mixed.isEmpty():
        return stage.table(certain, n), rows.limit(0)
    here = alive.join(mixed, "g")
    first = here.where("NOT paired AND firsts > 0").select("g", "a", "component", "q", F.posexplode(F.slice("e", F.lit(1), F.col("firsts"))).alias("pos", "at"))
    q = F.col("q") - 7 * F.col("at.w")
    first = stage.table(first.select("g", "a", F.col("at.x").alias("x"), "pos", "component", q.alias("q"), (14 * (F.col("at.s") - F.col("at.w")) - q).alias("room")), n)
    bounds = first.groupBy("g", "x").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("q").alias("least"), F.max("room").alias("most_room")).where("low <> high")
    inside = stage.table(first.join(stage.table(bounds.drop("low", "high"), n), ["g", "x"]).where("q <= most_room AND room >= least").drop("least", "most_room"), n)
    sizes = inside.groupBy("g", "x").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")).where("low <> high")
    inside = stage.table(inside.join(stage.table(sizes.select("g", "x", "members"), n), ["g", "x"]), n)
    few = inside.where(F.col("members") <= PAIRED).select("g", "x", "a", "component", "q", "room")
    few = few.union(here.where("paired").select("g", F.lit(0).cast("long").alias("x"), "a", "component", "q", "room"))
    other = few.select("g", "x", F.col("a").alias("b"), F.col("component").alias("component_b"), F.col("q").alias("q_b"), F.col("room").alias("room_b"))
    pairs = stage.table(few.join(other, ["g", "x"]).where("a > b AND component <> component_b AND q <= room_b AND q_b <= room").select("g", "a", "b").distinct(), n)
    edited = alive.select("g", "a", "q", F.transform("e", lambda t: F.struct(t["x"].alias("x"), t["w"].alias("w"))).alias("edits"))
    both = pairs.join(edited, ["g", "a"]).join(edited.select("g", F.col("a").alias("b"), F.col("q").alias("q_b"), F.col("edits").alias("edits_b")), ["g", "b"])
    linked = both.where(14 * _weight(F.array_intersect("edits", "edits_b")) >= F.col("q") + F.col("q_b")).select("a", "b")
    many = inside.where(F.col("members") > PAIRED).select("g", "x", "a", "pos", "component", "q").join(edited.select("g", "a", "edits"), ["g", "a"])
    further = F.slice("edits", F.col("pos") + 2, F.size("edits"))
    return stage.table(certain.union(linked), n), stage.table(many.select(F.xxhash64("g", "x").alias("g"), "a", "component", "q", further.alias("edits")), n)


def _joined(links: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """(component, now) of the components of the rows ``of`` (a, component) that links (a, b) between them join."""
    ends = links.join(of, "a").join(of.select(F.col("a").alias("b"), F.col("component").alias("component_b")), "b")
    joined = components(ends.select(F.col("component").alias("a"), F.col("component_b").alias("b")), name)
    return joined.select(F.col("id").alias("component"), F.col("component").alias("now"))


def _relabelled(smaller: DataFrame, rows: DataFrame, links: DataFrame, stage: Stage, n: int) -> DataFrame:
    """The smaller families with the components that a level's links between its rows have joined; those of one component go."""
    now = _joined(links, stage.table(rows.select("a", "component").distinct(), n), "minhash-level")
    found = stage.table(smaller.join(now, "component", "left").select("g", "a", F.coalesce("now", "component").alias("component"), "q", "edits"))
    mixed = found.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("g")
    return stage.table(found.join(stage.table(mixed, n), "g"))


def _weight_of(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.size("edits") + 1)).first()[0] or 0


def _further(compared: DataFrame, label: DataFrame, sets: DataFrame, stage: Stage) -> DataFrame | None:
    """Links (a, b), so that any two linked members of one hub's family end up in one component; None: no family to divide."""
    rows, found = _families(compared, label, sets, stage), None
    while rows is not None and not rows.isEmpty():
        links, rows = _in_blocks(rows, stage)
        found = links if found is None else found.union(links)
        if rows is not None:
            n = _weight_of(rows)
            links, smaller = _divided(rows, stage, n)
            found = found.union(links)
            # What a level has linked needs no further comparing in any family.
            rows = smaller if smaller.isEmpty() or links.isEmpty() else _relabelled(smaller, rows, links, stage, n)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_shingles (long), component_id, kept (boolean)."""
    stage, kind = Stage(docs.sparkSession, "minhash"), docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stage.table(source.mapInArrow(_sign, f"id {kind}, n_shingles long, set_key binary, bands array<long>"))
    grouped = signed.where("id IS NOT NULL AND n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    classes = stage.table(grouped.withColumn("class", F.monotonically_increasing_id()))
    members = classes.select("class", "rep", F.explode("bands").alias("key"))
    hubs = members.groupBy("key").agg(F.min(F.struct("rep", "class")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hubs = stage.table(hubs.select("key", F.col("hub.class").alias("hub")))
    pairs = stage.table(members.join(hubs, "key").where("class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct())
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    candidates = stage.table(classes.select("class", "set_key", "rep").join(ids, "class"))
    # Both sides are shuffled at every size: the candidates grow with the table.
    texts = source.join(candidates.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi").select("text")
    sets = texts.mapInArrow(_shingle_rows, "set_key binary, set array<long>").join(candidates.select("class", "set_key"), "set_key")
    sets = stage.table(sets.groupBy(F.col("class").alias("id")).agg(F.first("set").alias("set")))
    compared = stage.table(_with_sets(pairs, sets).select("a", "b", "sa", "sb").mapInArrow(_compare, "a long, b long, n_a long, n_b long, common long"))
    links = compared.where(LINKED).select("a", "b")
    label = stage.table(components(links, "minhash-star"))
    if (more := _further(compared, label, sets, stage)) is not None:
        # Only what the further links join is searched again.
        all_of = stage.table(candidates.select(F.col("class").alias("id")).join(label, "id", "left").select(F.col("id").alias("a"), F.coalesce("component", "id").alias("component")))
        now = stage.table(_joined(more, all_of, "minhash-all"))
        label = stage.table(all_of.join(now, "component", "left").select(F.col("a").alias("id"), F.coalesce("now", "component").alias("component")))
    label = stage.table(candidates.select(F.col("class").alias("id"), "rep").join(label, "id"))
    least = stage.table(label.groupBy("component").agg(F.min("rep").alias("least")))
    linked = label.join(least, "component").select(F.col("id").alias("class"), "least")
    class_of = stage.table(classes.select("class", "set_key", "rep").join(linked, "class", "left").select("set_key", F.coalesce("least", "rep").alias("component")))
    out = signed.select("id", "n_shingles", "set_key").join(class_of, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


#: The query over documents in DuckDB's SQL: all pairs with a common shingle, counted exactly.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s), x AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
r(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON c.id = n.doc_id
"""
