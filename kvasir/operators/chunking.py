"""Chunks of markdown and code, and code graphs from chunks, by windows over lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, start_line, end_line, level, header, headers, content): sections that start at headers.

    Headers inside code fences or front matter don't count. ``headers`` is the path of headers down to the
    section's own: of each level the last header, if no header of a lesser level came after it.
    """
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines_of(docs, key, text)
    fence = F.coalesce(F.sum(F.col("line").rlike("^\\s*(```|~~~)").cast("int")).over(before), F.lit(0)) % 2 == 1
    rule = (F.col("line") == "---").cast("int")
    opened = F.first("line").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "---"
    front = opened & (F.coalesce(F.sum(rule).over(before), F.lit(0)) < 2)
    level = F.when(~F.col("inside"), F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))).otherwise(0)
    rows = rows.withColumn("inside", fence | front).withColumn("level", level)
    rows = rows.withColumn("header", F.when(F.col("level") > 0, F.trim(F.regexp_replace("line", r"^#+\s+", ""))))
    rows = rows.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(upto))
    for j in range(1, 7):
        here = F.col("level") == j
        rows = rows.withColumn(f"h{j}", F.last(F.when(here, F.col("header")), True).over(upto)).withColumn(f"p{j}", F.last(F.when(here, F.col("pos")), True).over(upto))
    path = []
    for j in range(1, 7):
        less = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(f"p{i}", F.lit(-1)) for i in range(1, j)])
        path.append(F.when(F.col(f"p{j}") > less, F.col(f"h{j}")))
    rows = rows.withColumn("headers", F.filter(F.array(*path), lambda h: h.isNotNull()))
    out = rows.groupBy(key, "section").agg(
        (F.min("pos") + 1).alias("start_line"), (F.max("pos") + 1).alias("end_line"), F.max("level").alias("level"), F.max("header").alias("header"), F.min_by("headers", "pos").alias("headers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("content"),
    )
    return out.where(F.trim(F.regexp_replace("content", "\n", " ")) != "")


def word_tokens(line: Column) -> Column:
    return F.size(F.regexp_extract_all(line, F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"), F.lit(0)))


def pack_lines(docs: DataFrame, key: str, text: str, max_tokens: int = 512) -> DataFrame:
    """(key, chunk, start_line, end_line, tokens, content): lines in order, a new chunk where the next line doesn't fit."""

    @F.pandas_udf("array<int>")
    def place(counts: pd.Series) -> pd.Series:
        def one(xs):
            out, chunk, used = [], 0, 0
            for n in xs:
                if used and used + n > max_tokens:
                    chunk, used = chunk + 1, 0
                used += n
                out.append(chunk)
            return out

        return counts.map(one)

    lines = F.split(text, "\n", -1)
    rows = docs.select(key, lines.alias("lines"), F.transform(lines, word_tokens).alias("counts")).withColumn("chunks", place("counts"))
    each = rows.select(key, F.posexplode(F.arrays_zip("lines", "counts", "chunks")).alias("pos", "x")).select(key, "pos", "x.lines", "x.counts", "x.chunks")
    return each.groupBy(key, F.col("chunks").alias("chunk")).agg(
        (F.min("pos") + 1).alias("start_line"), (F.max("pos") + 1).alias("end_line"), F.sum("counts").alias("tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lines"))), lambda s: s["lines"]), "\n").alias("content"),
    )


FENCE = r"^\s*(```|~~~)"
#: A token with the white space before it, so that tokens in a row give their text back.
PIECE = r"\s*(?:[A-Za-z0-9_]+|[^\sA-Za-z0-9_])"


def packed_units(units: DataFrame, by: list[str], max_tokens: int) -> DataFrame:
    """(by, part, start_line, end_line, tokens, content) of units (by, start, piece, end, content), in the order of start and piece.

    A new part begins where the next unit doesn't fit; a unit of more than ``max_tokens``, and any with a piece of its
    own line, is a part by itself.
    """

    @F.pandas_udf("array<int>")
    def place(counts: pd.Series, alone: pd.Series) -> pd.Series:
        def one(numbers, single):
            out, part, used, held = [], 0, 0, False
            for n, by_itself in zip(numbers, single, strict=True):
                if held and (by_itself or used + n > max_tokens):
                    part, used, held = part + 1, 0, False
                out.append(part)
                if by_itself:
                    part += 1
                else:
                    used, held = used + n, True
            return out

        return pd.Series([one(x, y) for x, y in zip(counts, alone, strict=True)])

    each = F.struct("start", "piece", "end", word_tokens(F.col("content")).alias("tokens"), "content")
    rows = units.groupBy(*by).agg(F.array_sort(F.collect_list(each)).alias("units"))
    counts = F.transform("units", lambda u: u["tokens"])
    alone = F.transform("units", lambda u: (u["piece"] > 0) | (u["tokens"] > max_tokens))
    rows = rows.withColumn("parts", place(counts, alone)).select(*by, F.explode(F.arrays_zip("units", "parts")).alias("x"))
    texts = F.array_sort(F.collect_list(F.struct("x.units.start", "x.units.piece", "x.units.content")))
    return rows.groupBy(*by, F.col("x.parts").alias("part")).agg(
        F.min("x.units.start").alias("start_line"), F.max("x.units.end").alias("end_line"), F.sum("x.units.tokens").cast("long").alias("tokens"),
        F.array_join(F.transform(texts, lambda u: u["content"]), "\n").alias("content"),
    )


def markdown_chunks(docs: DataFrame, key: str, text: str, max_tokens: int = 256) -> DataFrame:
    """(key, chunk, start_line, end_line, level, headers, tokens, content): sections, split where they exceed ``max_tokens``.

    They are split between lines. A code fence is never split (one that isn't closed lasts to its section's end); a
    line of too many tokens is, between tokens, and white space at its end goes. A section's later chunks start with a
    comment that names its headers, unless they start with a #; it isn't counted in ``tokens``.
    """
    sections = markdown_sections(docs, key, text)
    small = word_tokens(F.col("content")) <= max_tokens
    lines = F.when(F.col("small"), F.array("content")).otherwise(F.split("content", "\n", -1))
    rows = sections.withColumn("small", small).select(key, "section", "start_line", "end_line", "small", F.posexplode(lines).alias("at", "line"))
    upto = Window.partitionBy(key, "section").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("fence", ~F.col("small") & F.col("line").rlike(FENCE))
    rows = rows.withColumn("open", F.sum(F.col("fence").cast("int")).over(upto) % 2 == 1)
    rows = rows.withColumn("unit", F.sum((F.col("fence") == F.col("open")).cast("int")).over(upto))
    units = rows.groupBy(key, "section", "unit").agg(
        F.min(F.col("start_line") + F.col("at")).alias("start"), F.max(F.when(F.col("small"), F.col("end_line")).otherwise(F.col("start_line") + F.col("at"))).alias("end"), F.max("fence").alias("code"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n").alias("content"),
    )
    tokens = F.regexp_extract_all("content", F.lit(PIECE), F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(max_tokens)), lambda i: F.array_join(F.slice("tokens", i + 1, max_tokens), ""))
    units = units.withColumn("tokens", F.when(~F.col("code"), tokens)).withColumn("long", F.size("tokens") > max_tokens)
    units = units.select(key, "section", "start", "end", F.col("long").cast("int").alias("more"), F.posexplode(F.when(F.col("long"), pieces).otherwise(F.array("content"))).alias("nth", "content"))
    units = units.select(key, "section", "start", "end", F.when(F.col("more") == 1, F.col("nth") + 1).otherwise(0).alias("piece"), "content")
    parts = packed_units(units, [key, "section"], max_tokens).join(sections.select(key, "section", "level", "headers"), [key, "section"])
    told = (F.col("part") > 0) & (F.size("headers") > 0) & ~F.startswith("content", F.lit("#"))
    comment = F.when(told, F.concat(F.lit("<!-- Context: "), F.array_join("headers", " > "), F.lit(" -->\n"))).otherwise("")
    chunk = F.row_number().over(Window.partitionBy(key).orderBy("section", "part")) - 1
    return parts.select(key, chunk.alias("chunk"), "start_line", "end_line", "level", "headers", "tokens", F.concat(comment, "content").alias("content"))


#: A line that starts a top-level definition: its kind and its name (this engine's own fallback for a syntax tree).
DEFINITION = r"^(?:export\s+)?(?:default\s+)?(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?(?:abstract\s+)?(function|class|interface|type|def|fn|func|struct|trait|enum)\s+([A-Za-z_][A-Za-z0-9_]*)"
IMPORT = r"^\s*(?:import|from|use|require|#include)\b"
MODULE = r"""^\s*(?:import\s+(?:[^'"]*\sfrom\s+)?['"]([^'"]+)['"]|from\s+([A-Za-z0-9_.]+)\s+import|import\s+([A-Za-z0-9_.]+)\s*$|use\s+([A-Za-z0-9_:]+))"""


def code_chunks(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk, start_line, end_line, kind, name, content): the import block, then one chunk a top-level definition."""
    rows = lines_of(files, key, text)
    kind = F.regexp_extract("line", DEFINITION, 1)
    rows = rows.withColumn("kind", F.when(kind != "", kind).when(F.col("line").rlike(IMPORT), "import")).withColumn("name", F.regexp_extract("line", DEFINITION, 2))
    order = Window.partitionBy(key).orderBy("pos")
    starts = F.col("kind").isNotNull() & ((F.col("kind") != "import") | ~F.lag("kind", 1).over(order).eqNullSafe(F.lit("import")))
    rows = rows.withColumn("chunk", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(key, "chunk").agg(
        (F.min("pos") + 1).alias("start_line"), (F.max("pos") + 1).alias("end_line"), F.min_by("kind", "pos").alias("kind"), F.min_by("name", "pos").alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("content"),
    )
    return out.where(F.trim(F.regexp_replace("content", "\n", " ")) != "").withColumn("kind", F.coalesce("kind", F.lit("module")))


#: Kinds of definitions that hold methods, and a line that starts one: an indented name with an opening bracket.
HOLDERS = ("class", "struct", "trait", "interface", "enum")
METHOD = r"^\s+(?:(?:public|private|protected|static|async|override|abstract|get|set|pub)\s+)*(?:(?:def|fn|func|function)\s+)?([A-Za-z_$][A-Za-z0-9_$]*)\s*(?:<[^>]*>)?\([^;]*[{:]\s*$"
NO_METHOD = r"^\s*(?:if|else|for|while|switch|catch|with|return|match|elif|try|do)\b"


def split_definitions(chunks: DataFrame, key: str, max_tokens: int = 512) -> DataFrame:
    """Code chunks with ``parent`` and ``part``, those of more than ``max_tokens`` split.

    A class is split before each of its methods, which are named with the class as parent (its head is a part of its
    own, what follows a method belongs to it); anything else is split between lines, as a kind ``..._partial``.
    """
    sized = chunks.withColumn("large", word_tokens(F.col("content")) > max_tokens)
    whole = sized.where("NOT large").select(key, "chunk", F.lit(0).alias("part"), "start_line", "end_line", "kind", "name", F.lit(None).cast("string").alias("parent"), "content")
    rows = sized.where("large").select(key, "chunk", "start_line", "kind", F.col("name").alias("parent"), F.posexplode(F.split("content", "\n", -1)).alias("at", "line"))
    method = F.col("kind").isin(*HOLDERS) & F.col("line").rlike(METHOD) & ~F.col("line").rlike(NO_METHOD)
    rows = rows.withColumn("indent", F.when(method, F.length(F.regexp_extract("line", r"^(\s*)", 1))))
    each = Window.partitionBy(key, "chunk")
    rows = rows.withColumn("least", F.min("indent").over(each))
    rows = rows.withColumn("part", F.sum((F.coalesce(F.col("indent"), F.lit(-1)) == F.col("least")).cast("int")).over(each.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    named = rows.where("least IS NOT NULL").groupBy(key, "chunk", "part", "parent", F.col("kind").alias("of")).agg(
        F.min(F.col("start_line") + F.col("at")).alias("start_line"), F.max(F.col("start_line") + F.col("at")).alias("end_line"), F.min_by("line", "at").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n").alias("content"),
    )
    head = F.col("part") == 0
    named = named.select(
        key, "chunk", F.col("part").cast("int").alias("part"), "start_line", "end_line", F.when(head, F.col("of")).otherwise("method").alias("kind"),
        F.when(head, F.col("parent")).otherwise(F.regexp_extract("first", METHOD, 1)).alias("name"), F.when(~head, F.col("parent")).alias("parent"), "content",
    )
    at = (F.col("start_line") + F.col("at")).alias("start")
    lines = rows.where("least IS NULL").select(key, "chunk", "kind", F.col("parent").alias("name"), at, F.lit(0).alias("piece"), (F.col("start_line") + F.col("at")).alias("end"), F.col("line").alias("content"))
    partial = packed_units(lines, [key, "chunk", "kind", "name"], max_tokens).select(key, "chunk", "part", "start_line", "end_line", F.concat("kind", F.lit("_partial")).alias("kind"), "name", F.lit(None).cast("string").alias("parent"), "content")
    return whole.unionByName(named).unionByName(partial)


def code_graph(chunks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, type, name, file), edges (from_node, to_node, edge_type)) of code chunks.

    Calls go to definitions of that name, in the same file if there is one, else to the first by id.
    """
    types = F.when(F.col("kind").isin("function", "def", "fn", "func"), "function").when(F.col("kind").isin("class", "struct", "enum"), "class").when(F.col("kind").isin("interface", "trait"), "interface").when(F.col("kind") == "type", "type")
    defs = chunks.where("name <> ''").select(F.concat_ws(":", key, types, "name").alias("id"), types.alias("type"), "name", F.col(key).alias("file"), "content")
    modules = chunks.select(F.col(key).alias("file")).distinct().select(F.concat("file", F.lit(":module")).alias("id"), F.lit("module").alias("type"), F.col("file").alias("name"), "file")
    called = defs.select(F.col("id").alias("from_node"), "file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))).alias("name"))
    targets = defs.where("type = 'function'").select("name", F.col("id").alias("to_node"), F.col("file").alias("target_file"))
    near = called.join(targets, "name").where("from_node <> to_node").withColumn("k", F.row_number().over(Window.partitionBy("from_node", "name").orderBy((F.col("file") != F.col("target_file")).cast("int"), "to_node")))
    calls = near.where("k = 1").select("from_node", "to_node", F.lit("calls").alias("edge_type"))
    heritage = lambda word, kind: defs.select("id", F.explode(F.regexp_extract_all("content", F.lit(rf"\b{word}\s+([A-Z][A-Za-z0-9_]*)"), F.lit(1))).alias("name")).join(defs.select("name", F.col("id").alias("to_node")), "name").select(F.col("id").alias("from_node"), "to_node", F.lit(kind).alias("edge_type"))
    parts = [F.regexp_extract("line", MODULE, k) for k in range(1, 5)]
    name = F.filter(F.array(*parts), lambda x: x != "")
    imports = chunks.where("kind = 'import'").select(F.col(key).alias("file"), F.explode(F.split("content", "\n")).alias("line")).select("file", F.explode(name).alias("target"))
    imports = imports.select(F.concat("file", F.lit(":module")).alias("from_node"), F.when(F.col("target").startswith("."), F.concat("target", F.lit(":module"))).otherwise(F.concat(F.lit("npm:"), "target")).alias("to_node"), F.lit("imports").alias("edge_type"))
    nodes = modules.unionByName(defs.select("id", "type", "name", "file"))
    return nodes, calls.union(heritage("extends", "extends")).union(heritage("implements", "implements")).union(imports).distinct()


def dyadic(begin: Column, end: Column) -> Column:
    """array of (power, place): the pieces [place << power, (place + 1) << power) that make up begin..end, 0 <= begin <= end.

    At most two a power, found by halving both ends, as many times as the end has binary digits.
    """
    odd = lambda c: c.bitwiseAND(1) == 1
    piece = lambda here, k, at: F.when(here, F.array(F.struct(k.alias("power"), at.alias("place")))).otherwise(F.array().cast(PIECES))

    def step(s, k):
        on = s["l"] < s["r"]
        out = F.concat(s["out"], piece(on & odd(s["l"]), k, s["l"]), piece(on & odd(s["r"]), k, s["r"] - 1))
        return F.struct(F.shiftright(s["l"] + s["l"].bitwiseAND(1), 1).alias("l"), F.shiftright(s["r"] - s["r"].bitwiseAND(1), 1).alias("r"), out.alias("out"))

    start = F.struct(begin.cast("long").alias("l"), (end.cast("long") + 1).alias("r"), F.array().cast(PIECES).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.least(F.length(F.bin(end.cast("long") + 1)), F.lit(POWERS))), start, step, lambda s: s["out"])


#: Lines are below two to this power.
POWERS = 40
PIECES = "array<struct<power:int,place:bigint>>"


def innermost(occurrences: DataFrame, ranges: DataFrame) -> DataFrame:
    """Occurrences (doc, occ, line) with the narrowest range (doc, symbol, begin, end) around them, ties to the first symbol.

    A range is cut at whole powers of two into at most two pieces a power, and a line lies in one piece's place at each
    power; so they meet by equal places, a power at a time, and never all ranges of a document. Of the ranges in one
    place the narrowest is kept before they meet, as of the ranges between the same lines before they are cut. Null lines, and ranges without an end, have no partner; a range may
    be given twice; a line is a whole number from 0.
    """
    ends = ranges.where("begin <= end").select("doc", "symbol", F.greatest(F.col("begin"), F.lit(0)).cast("long").alias("begin"), F.col("end").cast("long").alias("end"), (F.col("end") - F.col("begin")).alias("width")).where("begin <= end")
    best = F.min(F.struct("width", "symbol")).alias("best")
    ends = ends.groupBy("doc", "begin", "end").agg(best)
    pieces = ends.select("doc", "best", F.explode(dyadic(F.col("begin"), F.col("end"))).alias("p")).groupBy("doc", "p.power", "p.place").agg(F.min("best").alias("best"))
    # A line's places at the powers that its document's pieces have.
    used = pieces.select("doc", "power").distinct()
    lines = occurrences.where("line >= 0").select("doc", F.col("line").cast("long").alias("line")).distinct()
    asked = lines.join(used, "doc").withColumn("place", F.expr("shiftright(line, power)"))
    found = asked.join(pieces, ["doc", "power", "place"]).groupBy("doc", "line").agg(F.min("best").alias("best"))
    return occurrences.join(found.select("doc", F.col("line").alias("at"), "best.symbol"), "doc").where("line = at").select("doc", "occ", "line", "symbol")
