"""SCIP code indexes as tables, and their code graph.

An index is a protocol-buffers file of documents, each with its symbols and occurrences. ``read`` lists the files with
Spark's binary source; a task turns an index into its documents, one at a time, by the few fields that are used. All
else is DataFrames: symbols and occurrences are the documents' arrays exploded, and the graph comes from joins.

Defined cases: unknown fields are skipped; a file that ends within a field is an error that names it; ranges of three
numbers lie in one line, other lengths than three and four (or more) count as 0; lines are from 0, as in the index,
and from 1 in the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvasir.operators.chunking import innermost

SYMBOL = "struct<symbol:string,documentation:array<string>,kind:int,display_name:string,signature:string,enclosing_symbol:string,relationships:array<struct<symbol:string,is_reference:boolean,is_implementation:boolean,is_type_definition:boolean>>>"
OCCURRENCE = "struct<symbol:string,roles:int,range:array<int>,enclosing:array<int>>"
DOCUMENT = f"index string, path string, language string, symbols array<{SYMBOL}>, occurrences array<{OCCURRENCE}>"

# Numbers of the format's symbol kinds, by the graph's node types, and its roles' bits.
KINDS = {
    "function": (17, 26, 9, 18, 45, 80, 66, 70, 68), "class": (7, 49, 75, 11), "interface": (21, 42, 53), "type": (54, 55, 58, 56, 57, 59), "module": (29, 30, 16), "package": (35, 36, 64),
}
DEFINITION, IMPORT = 1, 2


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields: whole numbers, or the bytes of texts, messages and packed numbers."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = data[at]
            at += 1
            n |= (byte & 127) << shift
            if byte < 128:
                return n
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        if at + size > len(data):
            raise ValueError(f"field {key >> 3} ends after its message")
        yield key >> 3, data[at : at + size]
        at += size


def numbers(value: int | memoryview) -> list[int]:
    """A packed array of whole numbers, or one that isn't packed."""
    if isinstance(value, int):
        return [value]
    out, n, shift = [], 0, 0
    for byte in value:
        n |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(n)
            n = shift = 0
    return out


def _text(value: memoryview) -> str:
    return bytes(value).decode("utf-8", "replace")


def _one(data: memoryview, texts: dict[int, str], whole: dict[int, str] | None = None) -> dict:
    """The named fields of a message, the last of each."""
    found: dict = {}
    for n, v in fields(data):
        if n in texts:
            found[texts[n]] = _text(v)
        elif whole and n in whole:
            found[whole[n]] = v
    return found


def _symbol(data: memoryview) -> dict:
    out = {"symbol": "", "kind": 0, "display_name": "", "signature": None, "enclosing_symbol": None} | _one(data, {1: "symbol", 6: "display_name", 8: "enclosing_symbol"}, {5: "kind"})
    out["documentation"], out["relationships"] = [], []
    for n, v in fields(data):
        if n == 3:
            out["documentation"].append(_text(v))
        elif n == 4:
            r = _one(v, {1: "symbol"}, {2: "is_reference", 3: "is_implementation", 4: "is_type_definition"})
            out["relationships"].append({"symbol": r.get("symbol", "")} | {k: bool(r.get(k)) for k in ("is_reference", "is_implementation", "is_type_definition")})
        elif n == 7:
            out["signature"] = _one(v, {5: "text"}).get("text")
    return out


def _range(found: list[int]) -> list[int]:
    return [found[0], found[1], found[0], found[2]] if len(found) == 3 else found[:4] if len(found) > 3 else [0, 0, 0, 0]


def _occurrence(data: memoryview) -> dict:
    out: dict = {"symbol": "", "roles": 0, "range": [], "enclosing": []}
    for n, v in fields(data):
        if n == 1:
            out["range"] += numbers(v)
        elif n == 2:
            out["symbol"] = _text(v)
        elif n == 3:
            out["roles"] = v
        elif n == 7:
            out["enclosing"] += numbers(v)
    return out | {"range": _range(out["range"]), "enclosing": _range(out["enclosing"]) if out["enclosing"] else None}


def documents_of(index: bytes) -> Iterator[dict]:
    for n, v in fields(memoryview(index)):
        if n == 2:
            doc = {"path": "", "language": ""} | _one(v, {1: "path", 4: "language"})
            yield doc | {"symbols": [_symbol(x) for k, x in fields(v) if k == 3], "occurrences": [_occurrence(x) for k, x in fields(v) if k == 2]}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(index, path, language, symbols, occurrences): a row a document of the .scip files at ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.scip").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for doc in documents_of(content):
                        yield pd.DataFrame([{"index": name, **doc}])
                except (IndexError, KeyError, ValueError) as e:
                    raise ValueError(f"{name} is no SCIP index: {e}") from e

    return files.select("path", "content").mapInPandas(run, DOCUMENT)


def symbols(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.explode("symbols").alias("s")).select("path", "s.*")


def occurrences(docs: DataFrame) -> DataFrame:
    """(path, nth, symbol, roles, definition, range, enclosing)."""
    return docs.select("path", F.posexplode("occurrences").alias("nth", "o")).select("path", "nth", "o.*").withColumn("definition", F.col("roles").bitwiseAND(DEFINITION) != 0)


def node_type(kind: Column, symbol: Column, documentation: Column) -> Column:
    """The graph's type of a symbol by its kind or, where that is 0, by its documentation and its last descriptor; null: none."""
    told = F.lit(None).cast("string")
    for name, of in KINDS.items():
        told = F.when(kind.isin(*of), name).otherwise(told)
    doc, last = F.lower(F.array_join(documentation, " ")), F.element_at(F.split(symbol, " "), -1)
    has = lambda x: F.contains(doc, F.lit(x))
    guess = (
        F.when(has("interface "), "interface").when(has("class "), "class").when(doc.rlike(r"\btype\s+\w+"), "type").when(has("enum "), "class").when(has("function ") | has("method "), "function")
        .when(has("module ") | has("namespace "), "module").when(F.endswith(last, F.lit("().")), "function")
        .when(F.endswith(last, F.lit("#")), F.when(has("interface"), "interface").when(has("class"), "class").otherwise("type"))
        .when(F.endswith(last, F.lit("/")), "module").when(has("=>") & ~has("(property)"), "function").when((F.endswith(last, F.lit(":")) | F.endswith(last, F.lit("."))) & has("=>"), "function")
    )
    return F.when(kind != 0, told).otherwise(guess)


def symbol_name(symbol: Column) -> Column:
    """The last descriptor's name: without its sign, a number at its end, and the names around it."""
    last = F.element_at(F.split(symbol, "/"), -1)
    last = F.when((last == "") | F.contains(last, F.lit("`")), F.element_at(F.split(F.element_at(F.split(symbol, " "), -1), "/"), -1)).otherwise(last)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"\(\)\.?$", ""), "#$", ""), r"\.$", ""), ":$", "")
    inner = F.element_at(F.split(F.regexp_replace(bare, r"\d+$", ""), "#"), -1)
    return F.when(last == "", symbol).otherwise(inner)


def code_graph(syms: DataFrame, occs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of symbols and occurrences, as ``symbols`` and ``occurrences`` give them.

    Nodes are the symbols of a graph's type, at their definition's lines. Edges are their relationships, and from the
    innermost definition around each other occurrence to its symbol: an import by its role, else a call. A symbol that
    several documents have is the last path's node.
    """
    kind = node_type(F.col("kind"), F.col("symbol"), F.col("documentation"))
    named = syms.withColumn("type", kind).where("type IS NOT NULL").withColumn("name", F.when(F.col("display_name") != "", F.col("display_name")).otherwise(symbol_name(F.col("symbol"))))
    named = named.withColumn("id", F.concat_ws(":", "path", "type", "name"))
    around = F.coalesce("enclosing", "range")
    defined = occs.where("definition").select("path", "symbol", "nth", (F.col("range")[0] + 1).alias("start_line"), around[0].alias("begin"), around[2].alias("end"))
    last = defined.groupBy("path", "symbol").agg(F.max_by("start_line", "nth").alias("start_line"), (F.max_by("end", "nth") + 1).alias("end_line"))
    nodes = named.join(last, ["path", "symbol"], "left").select("id", "type", "name", "path", "start_line", "end_line", F.coalesce("signature", F.nullif("display_name", F.lit(""))).alias("signature"), "symbol")
    of = named.groupBy("symbol").agg(F.max_by("id", "path").alias("id"))
    to = of.select(F.col("symbol").alias("to_symbol"), F.col("id").alias("to_node"))
    r = F.col("r")
    relation = F.when(r["is_implementation"], "implements").when(r["is_type_definition"], "extends").when(r["is_reference"], "references")
    related = named.select("id", F.explode("relationships").alias("r")).select(F.col("id").alias("from_node"), r["symbol"].alias("to_symbol"), relation.alias("edge_type"))
    related = related.where("edge_type IS NOT NULL").join(to, "to_symbol").select("from_node", "to_node", "edge_type")
    used = occs.where("NOT definition").select(F.col("path").alias("doc"), F.struct("nth", "roles", F.col("symbol").alias("to_symbol")).alias("occ"), F.col("range")[0].alias("line"))
    ranges = defined.select(F.col("path").alias("doc"), "symbol", "begin", "end")
    held = innermost(used, ranges).select("symbol", "occ.to_symbol", F.when(F.col("occ.roles").bitwiseAND(IMPORT) != 0, "imports").otherwise("calls").alias("edge_type"))
    calls = held.join(of.withColumnRenamed("id", "from_node"), "symbol").join(to, "to_symbol").where("from_node <> to_node").select("from_node", "to_node", "edge_type")
    return nodes, related.union(calls).distinct()
