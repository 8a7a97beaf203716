"""Lookups, predicates, upserts, joins and workflow folds over memories, relations and code graphs."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.session import staged


def lower_any(array: str | Column, wanted: list[str]) -> Column:
    """Whether any element equals one of ``wanted``, whatever the case."""
    low = [w.lower() for w in wanted]
    return F.exists(array, lambda t: F.lower(t).isin(low))


def any_of(array: str | Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.col(array) if isinstance(array, str) else array, F.array(*[F.lit(w) for w in wanted]))


def newest(df: DataFrame, by: str, limit: int, *tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), *tie).limit(limit)


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """An upsert log's current rows: the first by ``order`` of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def restore(existing: DataFrame, incoming: DataFrame, key: str, strategy: str) -> DataFrame:
    """Import rows: ``skip`` keeps existing ones, ``overwrite`` replaces them, ``error`` returns the conflicts."""
    if strategy == "skip":
        return existing.unionByName(incoming.join(existing.select(key), key, "left_anti"))
    if strategy == "overwrite":
        return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)
    if strategy == "error":
        return incoming.join(existing.select(key), key, "left_semi")
    raise ValueError(f"no conflict strategy {strategy}")


def retain(df: DataFrame, key: list[str], keep: int, *order: Column) -> DataFrame:
    """The last ``keep`` rows of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def partial_update(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Supplied (non-null) fields replace the base's; ``touched`` tells updated rows."""
    u = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("touched"))
    out = base.join(u, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns], F.coalesce("touched", F.lit(False)).alias("touched"))


#: Path parts and endings that file lookup leaves out, and patterns that expertise ignores.
LOOKUP_EXCLUDED = ("/dist/", "/build/", "/generated/", "/__tests__/", "/coverage/")
LOOKUP_EXCLUDED_ENDS = (".spec.ts", ".spec.tsx", ".test.ts", ".test.tsx", ".d.ts")
IGNORED_FILES = (
    r"^\.git/", r"node_modules/", r"\.lock$", r"package-lock\.json$", r"yarn\.lock$", r"bun\.lock$", r"pnpm-lock\.yaml$",
    r"\.min\.(js|css)$", r"\.map$", r"dist/", r"build/", r"\.next/", r"coverage/",
)


def lookup_path(path: Column) -> Column:
    p = F.lower(path)
    parts = reduce(lambda a, b: a | b, [F.contains(p, F.lit(x)) for x in LOOKUP_EXCLUDED])
    ends = reduce(lambda a, b: a | b, [F.endswith(p, F.lit(x)) for x in LOOKUP_EXCLUDED_ENDS])
    return ~(parts | ends)


def ignored_file(path: Column) -> Column:
    return path.rlike("|".join(IGNORED_FILES))


def preview(text: Column, size: int = 150) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


# --- pair joins ----------------------------------------------------------------------------------


def jaccard(shared: Column, n_a: Column, n_b: Column) -> Column:
    return shared / (n_a + n_b - shared)


def overlap_coefficient(shared: Column, n_a: Column, n_b: Column) -> Column:
    return shared / F.least(n_a, n_b)


def set_jaccard(x: Column, y: Column) -> Column:
    low = lambda s: F.array_distinct(F.transform(s, F.lower))
    both, union = F.size(F.array_intersect(low(x), low(y))), F.size(F.array_union(low(x), low(y)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / union)


#: Sets of up to so many items are counted by their subsets.
COUNTED = 10


def _subsets(items: str) -> Column:
    """All subsets of an array of at most COUNTED items but the empty one."""
    masks = F.sequence(F.lit(1), F.expr(f"shiftleft(1, size({items}))") - 1)
    return F.transform(masks, lambda mask: F.filter(items, lambda _, i: F.getbit(mask, i) == 1))


def _links_by_counts(classes: DataFrame, score: Callable[[Column, Column, Column], Column], least: float) -> DataFrame:
    """(class_id, n_links, best) among classes of at most COUNTED items, by inclusion and exclusion.

    Each set adds to the counts of its subsets; a set's subsets then tell, for each size m, how many sets of that
    size share exactly j items with it. Rows grow with sets times their subsets, and no two sets meet.
    """
    parts = classes.select("class_id", "n", F.size("items").alias("k"), F.explode(_subsets("items")).alias("part"))
    counts = parts.groupBy("part", F.col("k").alias("m")).agg(F.sum("n").alias("c"))
    held = parts.select("class_id", "k", "part").join(counts, "part").groupBy("class_id", "k", "m", F.size("part").alias("i")).agg(F.sum("c").alias("c"))
    weight = lambda j: F.element_at(F.array(*[F.lit((-1) ** (i - j) * math.comb(i, j)) for i in range(1, COUNTED + 1)]), F.col("i"))
    exact = held.groupBy("class_id", "k", "m").agg(F.array(*[F.sum(F.col("c") * weight(j)) for j in range(1, COUNTED + 1)]).alias("e"))
    each = exact.select("class_id", "k", "m", F.posexplode("e").alias("j", "c")).withColumn("j", F.col("j") + 1)
    itself = (F.col("j") == F.col("k")) & (F.col("m") == F.col("k"))
    met = each.withColumn("others", F.col("c") - itself.cast("long")).withColumn("s", score(F.col("j"), F.col("k"), F.col("m"))).where("others > 0")
    return met.where(F.col("s") >= least).groupBy("class_id").agg(F.sum("others").alias("n_links"), F.max("s").alias("best"))


def _links_by_prefix(classes: DataFrame, score: Callable[[Column, Column, Column], Column], least: float, shared_least: Callable[[Column], Column]) -> DataFrame:
    """(class_id, n_links, best) over pairs of which one has more than COUNTED items, by a join of the rarest items.

    Two sets that share ``shared_least`` of their sizes share one of their rarest items, all less so many and one.
    """
    each = classes.select("class_id", "n", F.size("items").alias("k"), F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ranked = each.join(often, "item").withColumn("pos", F.row_number().over(Window.partitionBy("class_id").orderBy("often", "item")))
    first = ranked.where(F.col("pos") <= F.col("k") - shared_least(F.col("k")) + 1).select("class_id", "k", "item")
    large = first.where(F.col("k") > COUNTED).select(F.col("class_id").alias("other"), "item")
    one_way = first.join(large, "item").where(F.col("class_id") != F.col("other")).select("class_id", "other")
    pairs = one_way.union(one_way.select("other", "class_id")).distinct()
    own = classes.select("class_id", "items")
    theirs = classes.select(F.col("class_id").alias("other"), F.col("items").alias("items_b"), F.col("n").alias("others"))
    shared = pairs.join(own, "class_id").join(theirs, "other").select("class_id", "others", F.size("items").alias("k"), F.size("items_b").alias("m"), F.size(F.array_intersect("items", "items_b")).alias("j"))
    copies = classes.where((F.size("items") > COUNTED) & (F.col("n") > 1)).select("class_id", (F.col("n") - 1).alias("others"), *[F.size("items").alias(x) for x in "kmj"])
    met = shared.where("j > 0").union(copies).withColumn("s", score(F.col("j"), F.col("k"), F.col("m"))).where(F.col("s") >= least)
    return met.groupBy("class_id").agg(F.sum("others").alias("n_links"), F.max("s").alias("best"))


def overlap_links(
    rows: DataFrame, key: str, items: str, score: Callable[[Column, Column, Column], Column], least: float, shared_least: Callable[[Column], Column] = lambda k: F.lit(1)
) -> DataFrame:
    """(key, class_id, n_links, best): for each key the others whose items overlap with its own by ``least`` or more.

    Keys with the same items are one class, named after its smallest key, so copies cost nothing. n_links counts the
    other keys linked, best is the highest ``score(shared, n_a, n_b)``. Links of sets of up to COUNTED items are counted
    without pairing sets, whatever the items' frequencies; larger sets meet by their rarest items, of which
    ``shared_least`` (the least number of shared items by a set's size, for any partner) lets fewer suffice. Null and
    empty sets have no links.
    """
    own = rows.select(F.col(key), F.coalesce(F.array_sort(F.array_distinct(items)), F.array().cast("array<string>")).alias("items"))
    classes = own.groupBy("items").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("n"))
    few = _links_by_counts(classes.where(F.size("items").between(1, COUNTED)), score, least)
    links = few.union(_links_by_prefix(classes, score, least, shared_least)).groupBy("class_id").agg(F.sum("n_links").alias("n_links"), F.max("best").alias("best"))
    named = classes.select("items", "class_id").join(links, "class_id", "left")
    return own.join(named, "items").select(key, "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "best")


def band_links(rows: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """(key, n_links, gap): how many others are less than ``width`` from each key's whole-numbered ``at``, and the least gap.

    Keys at one time are counted first. A band's times and those of the bands beside it meet in one window, which so
    has at most three times ``width`` rows.
    """
    times = rows.groupBy(F.col(at).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    band = F.floor(F.col("t") / width)
    spread = times.select("t", "n", F.explode(F.array(band - 1, band, band + 1)).alias("band"), band.alias("own"))
    order = Window.partitionBy("band").orderBy("t")
    near = F.sum("n").over(order.rangeBetween(1 - width, width - 1)) - 1
    gap = F.when(F.col("n") > 1, F.lit(0).cast("long")).otherwise(F.least(F.col("t") - F.lag("t").over(order), F.lead("t").over(order) - F.col("t")))
    found = spread.select("t", "band", "own", near.alias("n_links"), gap.alias("gap")).where("band = own")
    found = found.select("t", "n_links", F.when(F.col("gap") < width, F.col("gap")).alias("gap"))
    return rows.select(F.col(key), F.col(at).alias("t")).join(found, "t").select(key, "n_links", "gap")


def unordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def without_related(candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """Candidates (source_id, target_id) not related yet in either direction."""
    have = relations.select(*unordered("source_id", "target_id")).distinct()
    c = candidates.select("*", *unordered("source_id", "target_id"))
    return c.join(have, ["lo", "hi"], "left_anti").drop("lo", "hi")


def without_same(candidates: DataFrame, relations: DataFrame, key: list[str]) -> DataFrame:
    """Candidates whose key no relation has yet, as (memory, node, type) across layers; null parts are equal to none."""
    return candidates.join(relations.select(*key).distinct(), key, "left_anti")


#: Pairs that one group of a path's memories makes with a row of its nodes, nodes a row, and pairs a task.
PAIRS_A_GROUP, NODES_A_ROW, PAIRS_A_TASK = 50_000_000, 20_000, 4_000_000


def documented(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(memory_id, node_id, confidence): memories (memory_id, name, file_path) with the first node (id, name, type,
    file_path) of their name at .9 and with the nodes, but modules, of their path at .75; the larger one of both.

    The pairs of a path are its memories times its nodes. They are made only after the join, whose rows are a memory and an
    array of nodes: each node is sent once for PAIRS_A_GROUP pairs of its row and each memory once for NODES_A_ROW nodes, so little
    is shuffled however many pairs there are. Pairs carry their confidence instead of being grouped: a memory given once has
    each node once.
    """
    refs = refs.distinct().withColumn("again", F.count(F.lit(1)).over(Window.partitionBy("memory_id")) > 1)
    first = nodes.groupBy("name").agg(F.min("id").alias("named"))
    refs = staged(refs.join(first, "name", "left").select("memory_id", "file_path", "named", "again"))
    at = staged(nodes.where("type <> 'module' AND file_path IS NOT NULL").select(F.col("id").alias("node_id"), "file_path").distinct())
    n = refs.groupBy("file_path").agg(F.count(F.lit(1)).alias("m")).join(at.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")), "file_path")
    of_all = lambda c, size: (1 + F.floor((c - 1) / size)).cast("int")
    n = n.select("file_path", (F.col("m") * F.col("n")).alias("pairs"), of_all(F.col("n"), NODES_A_ROW).alias("rows"))
    n = staged(n.withColumn("groups", of_all(F.col("pairs") / F.col("rows"), PAIRS_A_GROUP)))
    got = n.agg(F.sum("pairs").alias("pairs"), F.sum(F.col("rows") * F.col("groups")).alias("keys")).first()
    tasks = 1 + min((got["pairs"] or 0) // PAIRS_A_TASK, 2 * (got["keys"] or 0))
    n = n.drop("pairs")
    deal, every = lambda c, of: F.pmod(F.xxhash64(c), of).cast("int"), lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    x = refs.join(n, "file_path").withColumn("part", deal("memory_id", F.col("groups"))).withColumn("row", every("rows")).drop("rows", "groups")
    y = at.join(n, "file_path").groupBy("file_path", "groups", deal("node_id", F.col("rows")).alias("row")).agg(F.collect_list("node_id").alias("node_ids"))
    y = y.withColumn("part", every("groups")).drop("groups")
    key = ["file_path", "part", "row"]

    def by_path(x: DataFrame) -> DataFrame:
        met = x.repartition(tasks, *key).hint("merge").join(y.repartition(tasks, *key), key).select("memory_id", "named", F.explode("node_ids").alias("node_id"))
        return met.select("memory_id", "node_id", F.when(F.col("named") == F.col("node_id"), 0.9).otherwise(0.75).alias("confidence"))

    named = refs.where("named IS NOT NULL").withColumnRenamed("named", "node_id").join(at, ["node_id", "file_path"], "left_anti")
    named = named.select("memory_id", "node_id", F.lit(0.9).alias("confidence"), "again")
    once = by_path(x.where("NOT again")).union(named.where("NOT again").drop("again"))
    if refs.where("again").isEmpty():
        return once
    often = by_path(x.where("again")).union(named.where("again").drop("again"))
    return once.union(often.groupBy("memory_id", "node_id").agg(F.max("confidence").alias("confidence")))


def best_per_target(candidates: DataFrame, key: list[str]) -> DataFrame:
    """The surest candidate of each key, with all its reasons in order of method."""
    w = Window.partitionBy(*key)
    first = F.row_number().over(w.orderBy(F.desc("confidence"), "method"))
    reasons = F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("method", "reason")).over(w)), lambda s: s["reason"]))
    return candidates.withColumn("reasons", reasons).withColumn("_n", first).where("_n = 1").drop("_n", "reason")


#: Relation types by the pair's memory types, best rule first.
INFERENCE = (
    ("decision", "solution", "causes"), ("solution", "decision", "solves"), ("pattern", "architecture", "implements"), ("architecture", "pattern", "references"),
    ("solution", "pattern", "implements"), ("architecture", "decision", "references"), ("note", "decision", "references"), ("note", "solution", "references"), ("note", "architecture", "references"),
)


def infer_relation(source_type: Column, target_type: Column, newer: Column, title_jaccard: Column) -> Column:
    out = None
    for s, t, r in INFERENCE:
        hit = (source_type == s) & (target_type == t)
        out = F.when(hit, r) if out is None else out.when(hit, r)
    return out.when((source_type == target_type) & newer & (title_jaccard > 0.7), "supersedes").otherwise("related_to")


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two snapshots (path, hash): added, modified or deleted."""
    o, n = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return o.join(n, "path", "full_outer").withColumn("change", kind).where("change IS NOT NULL").select("path", "change")


# --- strings as bigram multisets -------------------------------------------------------------------


def cleaned(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\s+", "")


def _grams(clean: Column) -> Column:
    """The 2-letter parts of a string."""
    at = F.sequence(F.lit(1), F.greatest(F.length(clean) - 1, F.lit(1)))
    return F.filter(F.transform(at, lambda i: F.substring(clean, i, F.lit(2))), lambda g: F.length(g) == 2)


def _numbered(clean: Column) -> Column:
    """A string's bigrams, each with the number of times it has come so far: a set with the multiset's size."""
    each = lambda g: F.transform(g, lambda x, i: F.concat(x, (i - F.array_position(g, x)).cast("string")))
    return F.element_at(F.transform(F.array(F.array_sort(_grams(clean))), each), 1)


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two names' bigrams with their multiplicities; 1 for equal names, 0 where one has no bigram, null where one is null.

    The strings and then their bigrams are named by functions over arrays of one, so that each is made once a pair.
    """
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    n = lambda s: F.size(s["ga"]) + F.size(s["gb"])
    shared = lambda s: F.when((F.size(s["ga"]) == 0) | (F.size(s["gb"]) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(s["ga"], s["gb"])) / n(s))
    sets = lambda c: F.struct(_numbered(c["ca"]).alias("ga"), _numbered(c["cb"]).alias("gb"))
    return once(F.struct(cleaned(a).alias("ca"), cleaned(b).alias("cb")), lambda c: F.when(c["ca"] == c["cb"], 1.0).when(c["ca"].isNotNull() & c["cb"].isNotNull(), once(sets(c), shared)))


def gram_sets(forms: DataFrame) -> DataFrame:
    """(clean, n, grams): each string's bigrams, those that fewest strings have first.

    The i-th time a bigram occurs in a string is a bigram of its own, which makes multisets sets.
    """
    rows = forms.select("clean", F.explode(_grams(F.col("clean"))).alias("g")).groupBy("clean", "g").agg(F.count(F.lit(1)).alias("k"))
    rows = rows.select("clean", F.explode(F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda i: F.concat("g", i.cast("string")))).alias("gram"))
    often = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    ordered = rows.join(often, "gram").groupBy("clean").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("grams"))  # a name's
    return ordered.select("clean", F.size("grams").alias("n"), F.transform("grams", lambda s: s["gram"]).alias("grams"))


def dice_candidates(sets: DataFrame, least: float) -> DataFrame:
    """(ca, cb), ca < cb: the pairs that common rare bigrams, their lengths and the bigrams' places let be similar by ``least``.

    A string of n bigrams shares w = n * least / (2 - least) of them or more with any such partner, whatever its
    length. So of the n, the rarest n - w + 1 hold one that is shared, and the rarest n - w + 2 hold two where w is 2
    or more. From a threshold of a half on, strings meet by two bigrams, which few have together; by one only
    where both may share no more.
    """
    w = F.ceil(F.col("n") * (least / (2 - least)) - 1e-9).cast("int")
    first = lambda m: F.slice("grams", 1, F.least(F.col("n"), F.col("n") - w + m))
    single = sets.where(w < 2) if least >= 0.5 else sets
    keys = single.select("clean", "n", F.posexplode(first(1)).alias("pos", "key"))
    if least >= 0.5:
        twos = F.transform("p", lambda g, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda h, k: F.struct((i + 1 + k).alias("pos"), F.concat(g, F.lit(" "), h).alias("key"))))
        keys = keys.union(sets.withColumn("p", first(2)).select("clean", "n", F.explode(F.flatten(twos)).alias("t")).select("clean", "n", "t.pos", "t.key"))
    x = keys.select(F.col("clean").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa"), "key")
    y = keys.select(F.col("clean").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("pb"), "key")
    wanted = F.ceil((F.col("na") + F.col("nb")) * (least / 2) - 1e-9)
    most = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return x.join(y, "key").where((F.col("ca") < F.col("cb")) & (F.least("na", "nb") >= wanted) & (most >= wanted)).select("ca", "cb").distinct()


def dice_join(left: DataFrame, right: DataFrame, key: str, name: str, least: float) -> DataFrame:
    """(a, b, dice) for all pairs of keys whose names' Dice coefficient is ``least`` (over 0) or more.

    Names that are equal without case and white space are compared once. Null names have no pair.
    """
    x = left.select(F.col(key).alias("a"), cleaned(F.col(name)).alias("ca"))
    y = right.select(F.col(key).alias("b"), cleaned(F.col(name)).alias("cb"))
    forms = x.select(F.col("ca").alias("clean")).union(y.select("cb")).where("clean IS NOT NULL").distinct()
    sets = staged(gram_sets(forms))
    mine, other = sets.select(F.col("clean").alias("ca"), F.col("n").alias("na"), F.col("grams").alias("ga")), sets.select(F.col("clean").alias("cb"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    common = F.size(F.array_intersect("ga", "gb"))
    compared = dice_candidates(sets, least).join(mine, "ca").join(other, "cb").select("ca", "cb", (2.0 * common / (F.col("na") + F.col("nb"))).alias("dice"))
    near = staged(compared.where(F.col("dice") >= least))
    pairs = near.union(near.select("cb", "ca", "dice")).union(forms.select("clean", "clean", F.lit(1.0)))
    return pairs.join(x, "ca").join(y, "cb").select("a", "b", "dice")
