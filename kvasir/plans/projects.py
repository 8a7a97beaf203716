"""Queries over projects: tags, stacks, ignored files, notes, logs, code and its graph, all derived row by row from the tables.

Code, logs, notes and markdown are written out from table rows, so their SQL says what is in them without parsing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.functions import budget as b
from kvasir.functions.dictionaries import APP_ROUTER, CONFIGURED, RUNTIME, STACK, TAXONOMY
from kvasir.operators import chunking as c
from kvasir.operators import graphrag
from kvasir.operators import projects as p
from kvasir.operators import relational as r
from kvasir.plans.registry import query
from kvasir.plans.scoring import r6
from kvasir.plans.text import _DICE, values
from kvasir.sources import adapters as a
from kvasir.sources import files as s
from kvasir.sources import scip
from kvasir.sources.adapters import with_

QUOTE = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def case(key: str, given: list[str]) -> str:
    """adapters.pick in SQL."""
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {QUOTE(x)}" for i, x in enumerate(given[:-1])) + f" ELSE {QUOTE(given[-1])} END"


# --- tags ------------------------------------------------------------------------------------------

#: Spellings that documents' tags take in turn.
RAW = [" TS ", "Postgres", "Big  Data!", "kubernetes", "CI-CD", "K8S", "", "typscript", "ES6", "auth", "Auth N", "real-time", "Code Review", "perfomance"]
_NAMES = "(SELECT name, arg_max(canonical, nth) AS canonical FROM (" + " UNION ALL ".join(f"SELECT {n} AS nth, {QUOTE(c_)} AS canonical, unnest([{', '.join(QUOTE(x) for x in dict.fromkeys((c_, *al)))}]) AS name" for n, (c_, al, _, _) in enumerate(TAXONOMY)) + ") GROUP BY name)"
_SLUG = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def raw_tags(spark, d):
    """(doc_id, tags): three spellings a document, which may be the same tag."""
    k = F.col("doc_id")
    at = [a.pick((k * m + (k / 7).cast("long")) % len(RAW), RAW) for m in (1, 3, 5)]
    return a.read(spark, d, "documents").select("doc_id", F.array(*at).alias("tags"))


_RAW = "(SELECT doc_id, [" + ", ".join(case(f"(doc_id * {m} + doc_id // 7) % {len(RAW)}", RAW) for m in (1, 3, 5)) + "] AS tags FROM documents)"


@query("tag_normalise", f"SELECT doc_id, coalesce(x.canonical, nullif({_SLUG.format('tags[1]')}, '')) AS canonical, x.canonical AS strict FROM {_RAW} g LEFT JOIN {_NAMES} x ON lower(trim(g.tags[1])) = x.name")
def _(spark, d):
    """the canonical tag, and that of strict mode."""
    tags = p.taxonomy(spark)
    rows = raw_tags(spark, d).select("doc_id", F.col("tags")[0].alias("tag"))
    loose = p.normalise(rows, "tag", tags).withColumn("canonical", F.nullif("canonical", F.lit("")))
    return p.normalise(loose.withColumnRenamed("canonical", "found"), "tag", tags, strict=True).select("doc_id", F.col("found").alias("canonical"), F.col("canonical").alias("strict"))


@query("tag_list_normalise", f"""WITH e AS (SELECT doc_id, i, nullif(coalesce(x.canonical, {_SLUG.format('tag')}), '') AS c FROM (SELECT doc_id, i, tags[i] AS tag FROM {_RAW}, (SELECT unnest(range(1, 4)) AS i)) g LEFT JOIN {_NAMES} x ON lower(trim(tag)) = x.name),
f AS (SELECT doc_id, c, min(i) AS i FROM e WHERE c IS NOT NULL GROUP BY doc_id, c), l AS (SELECT doc_id, string_agg(c, '|' ORDER BY i) AS tags FROM f GROUP BY doc_id) SELECT documents.doc_id, coalesce(tags, '') AS tags FROM documents LEFT JOIN l ON l.doc_id = documents.doc_id""")
def _(spark, d):
    """F31 of a list: distinct canonical tags in order."""
    return p.normalise_list(raw_tags(spark, d), "doc_id", "tags", p.taxonomy(spark)).select("doc_id", F.concat_ws("|", "tags").alias("tags"))


_FORMS = "(" + " UNION ALL ".join(f"SELECT {n} AS nth, {QUOTE(c_)} AS canonical, unnest([{', '.join(QUOTE(x) for x in dict.fromkeys((c_, *al)))}]) AS form" for n, (c_, al, _, _) in enumerate(TAXONOMY)) + ")"
_SIM = f"CASE WHEN q = form THEN 1.0::DOUBLE WHEN length(q) < 2 OR length(form) < 2 THEN 0 ELSE {_DICE} END"


@query("tag_suggest", f"""WITH q AS (SELECT DISTINCT lower(trim(unnest(tags))) AS q FROM {_RAW}), s AS (SELECT q, nth, canonical, form, {_SIM} AS sim FROM
(SELECT q, nth, canonical, form, list_transform(range(1, length(regexp_replace(q, '\\s+', '', 'g'))), lambda i: substring(regexp_replace(q, '\\s+', '', 'g'), CAST(i AS INT), 2)) AS qg, list_transform(range(1, length(form)), lambda i: substring(form, CAST(i AS INT), 2)) AS cg FROM q CROSS JOIN {_FORMS} WHERE q <> '')),
t AS (SELECT q, nth, canonical, coalesce(max(CASE WHEN q = form AND form = canonical THEN 1.0::DOUBLE END), max(CASE WHEN q = form AND form <> canonical THEN 0.99::DOUBLE END), max(CASE WHEN form = canonical AND sim >= 0.3 THEN sim END), 0.95::DOUBLE * max(CASE WHEN form <> canonical AND sim >= 0.3 THEN sim END)) AS score FROM s GROUP BY q, nth, canonical)
SELECT q AS tag, canonical, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, nth) AS rank FROM t WHERE score IS NOT NULL QUALIFY rank <= 10""")
def _(spark, d):
    """F32: the ten best suggestions for every spelling that documents have."""
    asked = raw_tags(spark, d).select(F.explode("tags").alias("tag"))
    return p.suggest(asked, "tag", p.taxonomy(spark)).select("tag", "canonical", r6(F.col("score"), "score"), "rank")


_TAX = values([(c_, k, par or "") for c_, _, k, par in TAXONOMY], "canonical, category, parent")


@query("tag_hierarchy", f"""WITH n AS (SELECT x.canonical, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(tags) AS tag FROM {_RAW}) g JOIN {_NAMES} x ON lower(trim(tag)) = x.name GROUP BY 1)
SELECT parent, category, string_agg(t.canonical, ',' ORDER BY t.canonical) AS children, CAST(coalesce(sum(n), 0) AS BIGINT) AS documents FROM {_TAX} t LEFT JOIN n ON n.canonical = t.canonical GROUP BY parent, category""")
def _(spark, d):
    """each parent's and category's tags, and how many documents have them."""
    tags = p.taxonomy(spark)
    used = p.normalise(raw_tags(spark, d).select("doc_id", F.explode("tags").alias("tag")), "tag", tags, strict=True).where("canonical IS NOT NULL")
    used = used.select("doc_id", "canonical").distinct().groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    rows = tags.select("canonical", "category", F.coalesce("parent", F.lit("")).alias("parent")).join(used, "canonical", "left")
    return rows.groupBy("parent", "category").agg(F.concat_ws(",", F.array_sort(F.collect_list("canonical"))).alias("children"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("documents"))


# --- stacks, models, paths ---------------------------------------------------------------------------

DEPENDENCIES = [dep for _, _, deps in STACK for dep in deps] + ["left-pad", "lodash"]
FOUND = [path for path, _ in RUNTIME] + list(APP_ROUTER) + [path for _, path in CONFIGURED] + ["README.md"]
_PROJECT = f"(SELECT p_partkey // 6 AS project, {case(f'(p_partkey * 5 + p_size) % {len(DEPENDENCIES)}', DEPENDENCIES)} AS dep, {case(f'(p_partkey * 3 + p_size) % {len(FOUND)}', FOUND)} AS path FROM part)"
_RULES = values([(n, part, name, dep) for n, (part, name, deps) in enumerate(STACK) for dep in deps], "nth, part, name, dep")


@query("stack_detect", f"""WITH x AS {_PROJECT}, t AS (SELECT project, bool_or(path IN ('app', 'src/app')) AS router, bool_or(path = 'prisma/schema.prisma') AS prisma, bool_or(path = 'drizzle.config.ts') AS drizzle,
min(CASE path {' '.join(f"WHEN '{f}' THEN {n}" for n, (f, _) in enumerate(RUNTIME))} END) AS rt FROM x GROUP BY project), f AS (SELECT project, part, arg_min(name, nth) AS name FROM x JOIN {_RULES} r ON r.dep = x.dep GROUP BY project, part)
SELECT f.project, part, CASE WHEN name = 'Next.js' THEN CASE WHEN router THEN 'Next.js (App Router)' ELSE 'Next.js (Pages Router)' END WHEN name = 'Prisma' AND prisma OR name = 'Drizzle' AND drizzle THEN name || ' (configured)' ELSE name END AS name FROM f JOIN t ON t.project = f.project
UNION ALL SELECT project, 'runtime', CASE rt {' '.join(f"WHEN {n} THEN '{name}'" for n, (_, name) in enumerate(RUNTIME))} END FROM t WHERE rt IS NOT NULL""")
def _(spark, d):
    """six parts make a project; each tells a dependency and a file of it."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = a.read(spark, d, "part").select(F.expr("p_partkey div 6").alias("project"), a.pick((k * 5 + size) % len(DEPENDENCIES), DEPENDENCIES).alias("dep"), a.pick((k * 3 + size) % len(FOUND), FOUND).alias("path"))
    return p.stack(rows.select("project", "dep"), rows.select("project", "path"))


MODELS = [*b.WINDOWS, "another-model"]


@query("model_windows", f"SELECT event_id, model, CAST(w.n AS BIGINT) AS window_tokens FROM (SELECT event_id, {case(f'event_id % {len(MODELS)}', MODELS)} AS model FROM events) e LEFT JOIN {values(list(b.WINDOWS.items()), 'm, n')} w ON w.m = e.model")
def _(spark, d):
    """the context window of the model that each event names; a model that isn't known has none."""
    e = a.read(spark, d, "events").select("event_id", a.pick(F.col("event_id") % len(MODELS), MODELS).alias("model"))
    return e.join(F.broadcast(spark.createDataFrame(list(b.WINDOWS.items()), "model string, window_tokens long")), "model", "left")


FOLDERS = ["src/", "node_modules/x/", "dist/", "lib/build/", "coverage/", ".git/", "web/.next/", "docs/"]
ENDINGS = [".ts", ".lock", ".min.js", ".js.map", ".js", ".min.css", ".py", "/package-lock.json", "/yarn.lock"]


@query("ignored_files", f"SELECT path, regexp_matches(path, '{'|'.join(r.IGNORED_FILES)}') AS ignored FROM (SELECT {case(f'p_partkey % {len(FOLDERS)}', FOLDERS)} || p_brand || '_' || p_partkey || {case(f'p_size % {len(ENDINGS)}', ENDINGS)} AS path FROM part)")
def _(spark, d):
    """P10, of a file a part."""
    k = F.col("p_partkey")
    path = F.concat(a.pick(k % len(FOLDERS), FOLDERS), "p_brand", F.lit("_"), k.cast("string"), a.pick(F.col("p_size") % len(ENDINGS), ENDINGS))
    return a.read(spark, d, "part").select(path.alias("path")).withColumn("ignored", r.ignored_file(F.col("path")))


# --- logs, notes and markdown ----------------------------------------------------------------------


@query("git_log_source", "SELECT 'r' || o_custkey AS repo, 'Dev ' || (o_custkey % 23) AS author, 'dev' || (o_custkey % 23) || '@x.org' AS email, CAST(epoch(o_orderdate) AS BIGINT) AS ts_s, 'src/' || l_partkey || '.ts' AS file FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def _(spark, d):
    """A customer's orders as the log of a repository, parsed back."""
    o, line = a.read(spark, d, "orders"), a.read(spark, d, "lineitem")
    repo, dev = F.concat(F.lit("r"), F.col("o_custkey").cast("string")), (F.col("o_custkey") % 23).cast("string")
    head = F.concat(F.lit("Dev "), dev, F.lit("|dev"), dev, F.lit("@x.org|"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string"))
    heads = o.select(repo.alias("repo"), (F.col("o_orderkey") * 100).alias("n"), head.alias("line"))
    files = o.select("o_orderkey", repo.alias("repo")).join(line.select("l_orderkey", "l_linenumber", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    files = files.select("repo", (F.col("o_orderkey") * 100 + F.col("l_linenumber")).alias("n"), F.concat(F.lit("src/"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("line"))
    gaps = o.select(repo, F.col("o_orderkey") * 100 + 99, F.lit(""))
    return s.git_log(heads.union(files).union(gaps))


@query("markdown_import", "SELECT 'doc' || doc_id || '.md' AS path, CASE doc_id % 3 WHEN 0 THEN 'decision' ELSE 'note' END AS type, CASE doc_id % 3 WHEN 0 THEN 'Keep ' || coalesce(lang, '') || ' ' || doc_id ELSE '' END AS title, CASE doc_id % 3 WHEN 0 THEN 'Accepted' ELSE '' END AS status, CASE doc_id % 3 WHEN 0 THEN 'We keep ' || coalesce(source, '') || '.' ELSE '' END AS decision FROM documents WHERE doc_id % 3 <> 1")
def _(spark, d):
    """Documents as decision records, as notes too short to keep, and as plain notes."""
    k, text = F.col("doc_id"), lambda x: F.coalesce(x, F.lit(""))
    record = F.concat(F.lit("# Keep "), text("lang"), F.lit(" "), k.cast("string"), F.lit("\n\n## Status\nAccepted\n## Context\n"), F.repeat(F.concat(F.lit("Many rows of "), text("source"), F.lit(". ")), 12), F.lit("\n## Decision\nWe keep "), text("source"), F.lit("."))
    content = F.when(k % 3 == 0, record).when(k % 3 == 1, F.concat(F.lit("# Short "), k.cast("string"))).otherwise(F.repeat(F.concat(F.lit("plain text of "), text("source"), F.lit(" ")), 20))
    n = s.markdown_notes(a.read(spark, d, "documents").select(F.concat(F.lit("doc"), k.cast("string"), F.lit(".md")).alias("path"), content.alias("content")))
    return n.select("path", "type", "adr.title", "adr.status", "adr.decision")


@query("header_stack", """WITH t AS (SELECT conv_id, turn // 50 AS page, turn, role, row_number() OVER (PARTITION BY conv_id, turn // 50 ORDER BY turn) - 1 AS i FROM conversations)
SELECT DISTINCT conv_id, page, 1 AS start_line, 'Conversation ' || conv_id AS path FROM t UNION ALL SELECT conv_id, page, CAST(2 + 5 * i AS INT), 'Conversation ' || conv_id || ' > ' || role FROM t UNION ALL SELECT conv_id, page, CAST(3 + 5 * i AS INT), 'Conversation ' || conv_id || ' > ' || role || ' > turn ' || turn FROM t""")
def _(spark, d):
    """Conversations as markdown, fifty turns a page, with fences whose # lines are no headers."""
    turn = F.concat(F.lit("## "), "role", F.lit("\n### turn "), F.col("turn").cast("string"), F.lit("\n```\n# "), F.length(F.coalesce("text", F.lit(""))).cast("string"), F.lit("\n```"))
    t = a.read(spark, d, "conversations").select("conv_id", F.expr("turn div 50").alias("page"), F.struct("turn", turn.alias("m")).alias("s"))
    pages = t.groupBy("conv_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["m"]), "\n").alias("m"))  # fifty turns
    docs = pages.select(F.struct("conv_id", "page").alias("k"), F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), "m").alias("m"))
    return c.markdown_sections(docs, "k", "m").select("k.conv_id", "k.page", "start_line", F.concat_ws(" > ", "headers").alias("path"))


# --- code ------------------------------------------------------------------------------------------


def code_files(spark, d):
    """(file, code): eight parts a file, by size a function, a class with two methods or an interface each, that use one another."""
    k = F.col("p_partkey")
    n, half, third = k.cast("string"), F.expr("p_partkey div 2").cast("string"), F.expr("p_partkey div 3").cast("string")
    call = F.concat(F.lit("fn"), half, F.lit("(x)"))
    function = F.concat(F.lit("export function fn"), n, F.lit("(x) {\n  return "), call, F.lit("\n}"))
    holder = F.concat(F.lit("export class C"), n, F.lit(" extends C"), half, F.lit(" implements I"), third, F.lit(" {\n  run(x) {\n    "), call, F.lit("\n  }\n  stop() {\n    return 1\n  }\n}"))
    interface = F.concat(F.lit("export interface I"), n, F.lit(" {\n  a: string\n}"))
    code = F.when(F.col("p_size") % 3 == 0, function).when(F.col("p_size") % 3 == 1, holder).otherwise(interface)
    of = a.read(spark, d, "part").select(F.expr("p_partkey div 8").alias("f"), F.struct(k.alias("k"), code.alias("code")).alias("s"))
    files = of.groupBy("f").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["code"]), "\n").alias("code"))  # eight parts
    head = F.concat(F.lit("import { x } from './f"), F.expr("f div 2").cast("string"), F.lit("'\n"))
    return files.select(F.concat(F.lit("src/f"), F.col("f").cast("string"), F.lit(".ts")).alias("file"), F.concat(head, "code").alias("code"))


_DEFS = """df AS (SELECT p_partkey AS k, p_partkey // 8 AS f, 'src/f' || (p_partkey // 8) || '.ts' AS file, CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'interface' END AS kind,
  CASE p_size % 3 WHEN 0 THEN 'fn' WHEN 1 THEN 'C' ELSE 'I' END || p_partkey AS name, CASE p_size % 3 WHEN 1 THEN 8 ELSE 3 END AS n,
  row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey) + 1 AS chunk FROM part),
ln AS (SELECT *, CAST(2 + sum(n) OVER (PARTITION BY f ORDER BY k) - n AS INT) AS a FROM df), hd AS (SELECT DISTINCT file, f FROM df)"""


@query("chunk_code", f"WITH {_DEFS} SELECT file, CAST(1 AS BIGINT) AS chunk, 'import' AS kind, '' AS name, 1 AS start_line, 1 AS end_line FROM hd UNION ALL SELECT file, chunk, kind, name, a, a + n - 1 FROM ln")
def _(spark, d):
    """A chunk for the imports and for each definition."""
    return c.code_chunks(code_files(spark, d), "file", "code").select("file", "chunk", "kind", "name", "start_line", "end_line")


@query("split_code_chunks", f"""WITH {_DEFS} SELECT file, CAST(1 AS BIGINT) AS chunk, 0 AS part, 1 AS start_line, 1 AS end_line, 'import' AS kind, '' AS name, NULL AS parent FROM hd UNION ALL SELECT file, chunk, 0, a, a + n - 1, kind, name, NULL FROM ln WHERE kind <> 'class'
UNION ALL SELECT file, chunk, i, a + b, a + e, CASE i WHEN 0 THEN 'class' ELSE 'method' END, CASE i WHEN 0 THEN name WHEN 1 THEN 'run' ELSE 'stop' END, CASE i WHEN 0 THEN NULL ELSE name END FROM ln CROSS JOIN (VALUES (0, 0, 0), (1, 1, 3), (2, 4, 7)) v(i, b, e) WHERE kind = 'class'""")
def _(spark, d):
    """Definitions of more than 16 tokens by method."""
    return c.split_definitions(c.code_chunks(code_files(spark, d), "file", "code"), "file", 16).drop("content")


@query("graph_extraction", f"""WITH {_DEFS}, nd AS (SELECT *, file || ':' || kind || ':' || name AS id FROM df) SELECT x.id AS from_node, y.id AS to_node, 'calls' AS edge_type FROM nd x JOIN nd y ON y.name = 'fn' || (x.k // 2) WHERE x.kind <> 'interface' AND x.id <> y.id
UNION ALL SELECT x.id, y.id, 'extends' FROM nd x JOIN nd y ON y.name = 'C' || (x.k // 2) WHERE x.kind = 'class' UNION ALL SELECT x.id, y.id, 'implements' FROM nd x JOIN nd y ON y.name = 'I' || (x.k // 3) WHERE x.kind = 'class'
UNION ALL SELECT file || ':module', './f' || (f // 2) || ':module', 'imports' FROM hd""")
def _(spark, d):
    """Calls, inheritance and imports of the files' definitions."""
    return c.code_graph(c.code_chunks(code_files(spark, d), "file", "code"), "file")[1]


#: Kinds of symbols in turn: function, class, interface, type, none told, field (no node), module.
KINDS = [17, 7, 21, 54, 0, 15, 29]
_SCIP = """sy AS (SELECT p_partkey AS k, 'f' || (p_partkey // 8) || ':' || t || ':' || n AS id, t, n FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'fn' END AS n,
  CASE p_partkey % 7 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'interface' WHEN 3 THEN 'type' WHEN 4 THEN 'function' WHEN 6 THEN 'module' END AS t FROM part))"""


def scip_tables(spark, d):
    """(symbols, occurrences) as an index has them: parts are symbols, eight a document, and code edges their uses."""
    part, k = a.read(spark, d, "part"), F.col("p_partkey")
    of = lambda key: F.concat(F.lit("pkg f"), F.floor(key / 8).cast("string"), F.lit("/fn"), key.cast("string"), F.lit("()."))
    path = lambda key: F.concat(F.lit("f"), F.floor(key / 8).cast("string"))
    line = lambda key: (key % 8 * 10).cast("int")
    ints = lambda *x: F.array(*[(F.lit(v) if isinstance(v, int) else v).cast("int") for v in x])
    none = F.array().cast("array<struct<symbol:string,is_reference:boolean,is_implementation:boolean,is_type_definition:boolean>>")
    syms = part.select(
        path(k).alias("path"), of(k).alias("symbol"), F.array().cast("array<string>").alias("documentation"), a.pick(k % 7, KINDS).alias("kind"), F.when(k % 2 == 0, F.col("p_name")).otherwise("").alias("display_name"),
        F.lit(None).cast("string").alias("signature"), none.alias("relationships"),
    )
    defined = part.select(path(k).alias("path"), k.alias("nth"), of(k).alias("symbol"), F.lit(1).alias("roles"), ints(line(k), 0, line(k), 5).alias("range"), ints(line(k), 0, line(k) + 8, 0).alias("enclosing"))
    e = a.code_edges(spark, d).select(F.substring("from_node", 2, 20).cast("long").alias("x"), F.substring("to_node", 2, 20).cast("long").alias("y"), "edge_type")
    at = line(F.col("x")) + 1 + (F.col("y") % 7).cast("int")
    used = e.select(path(F.col("x")), F.col("y"), of(F.col("y")), F.when(F.col("edge_type") == "imports", 2).otherwise(8), ints(at, 4, at, 9), F.lit(None).cast("array<int>"))
    return syms, defined.union(used).withColumn("definition", F.col("roles").bitwiseAND(1) != 0)


@query("scip_nodes", f"WITH {_SCIP} SELECT id, t AS type, n AS name, 'f' || (k // 8) AS path, CAST(k % 8 * 10 + 1 AS INT) AS start_line, CAST(k % 8 * 10 + 9 AS INT) AS end_line FROM sy WHERE t IS NOT NULL")
def _(spark, d):
    """Symbols as nodes by their kinds, or by their descriptors where none is told."""
    return scip.code_graph(*scip_tables(spark, d))[0].select("id", "type", "name", "path", "start_line", "end_line")


@query("scip_edges", with_("code_edges", "").rstrip() + f",\n{_SCIP} SELECT DISTINCT f.id AS from_node, t.id AS to_node, CASE edge_type WHEN 'imports' THEN 'imports' ELSE 'calls' END AS edge_type FROM code_edges JOIN sy f ON from_node = 'p' || f.k JOIN sy t ON to_node = 'p' || t.k WHERE f.t IS NOT NULL AND t.t IS NOT NULL AND f.id <> t.id")
def _(spark, d):
    """Uses as calls and imports from the innermost definition around them."""
    return scip.code_graph(*scip_tables(spark, d))[1]


#: Sentences that the documents take in turn.
SENTENCES = [
    "We use PostgreSQL with Redis at Acme Corp. later Jane Smith designed Docker and Kubernetes.", "Redis and PostgreSQL were slow. now Acme Corp pays.", "Docker runs on Kubernetes. later Jane Smith said so of Docker.", "nothing here",
]


@query("graphrag_build")
def _(spark, d):
    """D11 over all documents, each a sentence and its source: every entity with its community's report."""
    docs = a.read(spark, d, "documents").select(a.memory_id(F.col("doc_id")).alias("id"), F.concat(a.pick(F.col("doc_id") % len(SENTENCES), SENTENCES), F.lit(" from "), F.coalesce("source", F.lit(""))).alias("content"))
    made = graphrag.build(docs)
    of = made["communities"].select(F.col("id").alias("alias"), "community")
    return made["entities"].join(of, "alias", "left").join(made["reports"], "community", "left").select("alias", "kind", "mentions", "title")
