"""Queries over text functions (F20-F61), over whole tables; where the fixtures' invented prose has nothing to find, phrases go before each row's own text."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.functions import budget as b
from kvasir.functions import text as t
from kvasir.operators import extraction as ex
from kvasir.operators import metrics as m
from kvasir.operators import relational as r
from kvasir.operators import vectors as v
from kvasir.plans.registry import query
from kvasir.plans.scoring import r6
from kvasir.sources import adapters as a
from kvasir.sources.adapters import NOW, with_

MESSAGES = [
    (1, "feat(auth): implement oauth login closes #12"), (2, "fix: crash on empty input, fixes #7 and PROJ-33"), (3, "refactor(db)!: move to columns"), (4, "docs: readme"),
    (5, "We decided to migrate the api config"), (6, "Patch the ui bug in env handling"), (7, "feat: small"), (8, "chore(ci): bump BREAKING CHANGE: drop node 14\nbody ABC-1"), (9, "Initial import"),
    (10, "feature(search): " + "long description of a feature " * 4), (11, "revert(ui): Fix db auth"),
]
QUERIES = [
    (1, "Which function calls parseQuery?"), (2, "Why was this decision made"), (3, "Show files for the UserService"), (4, "weather today"), (5, "the history of the class BaseHandler"),
    (6, "trace the flow across services"), (7, "  What   is load(x)?? "), (8, "policy and convention notes"),
]
SNIPPETS = [
    (1, "Use `parse.Query` and `run` in src/api/handler.ts with AuthService"), (2, "See ./lib/util.py, (web/app.tsx) or \"a.go\"; `run` again `run`"), (3, "UserController extends BaseHandlerFactory"), (4, "nothing here"),
]


def values(rows: list[tuple], names: str) -> str:
    """The rows as a DuckDB VALUES table."""
    lit = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, row)) + ")" for row in rows) + f") q({names}))"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def phrased(spark, d, table, key, rows, names, tails):
    """(k, names...): one row per row of the table, whose texts are phrases that take turns, each with its tail from the row."""
    k = F.col(key)
    texts = [F.concat(a.pick(k % len(rows), [row[i] for row in rows]), F.lit(sep), F.col(tail).cast("string")).alias(n) for i, (n, (sep, tail)) in enumerate(zip(names, tails, strict=True), 1)]
    return a.read(spark, d, table).select(k.cast("int").alias("k"), *texts)


def phrased_sql(table, key, rows, names, tails):
    """The same as a DuckDB subquery."""
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    case = lambda i: f"CASE {key} % {len(rows)} " + " ".join(f"WHEN {j} THEN {lit(row[i])}" for j, row in enumerate(rows)) + " END"
    texts = [f"{case(i)} || {lit(sep)} || CAST({tail} AS VARCHAR) AS {n}" for i, (n, (sep, tail)) in enumerate(zip(names, tails, strict=True), 1)]
    return f"(SELECT {key} AS k, {', '.join(texts)} FROM {table})"


_MESSAGES = ("orders", "o_orderkey", MESSAGES, ("m",), ((" #", "o_custkey"),))
_QUERIES = ("documents", "doc_id", QUERIES, ("q",), ((" ", "text"),))
_SNIPPETS = ("documents", "doc_id", SNIPPETS, ("s",), ((" ", "text"),))
_ENDINGS = [(1, "a."), (2, "lib/b.py."), (3, "c."), (4, "d/e."), (5, "readme")]
_PATHS = ("documents", "doc_id", _ENDINGS, ("path",), (("", "lang"),))
_MSG = phrased_sql(*_MESSAGES)
_OR = lambda words, x: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


@query("commit_classifier", f"""SELECT k, CASE WHEN regexp_matches(f, '(?i)^(feat|feature)(\\(.+\\))?!?:') AND (length(m) > 100 OR contains(lower(m), 'implement')) THEN 'decision' WHEN regexp_matches(f, '(?i)^fix(\\(.+\\))?!?:') THEN 'solution'
 WHEN regexp_matches(f, '(?i)^refactor(\\(.+\\))?!?:') THEN 'decision' WHEN {_OR(t.DECISION_WORDS, 'lower(m)')} THEN 'decision' WHEN {_OR(t.SOLUTION_WORDS, 'lower(m)')} THEN 'solution' END AS category FROM (SELECT CAST(k AS INT) AS k, m, string_split(m, chr(10))[1] AS f FROM {_MSG})""")
def _(spark, d):
    return phrased(spark, d, *_MESSAGES).select("k", t.commit_category(F.col("m")).alias("category"))


@query("commit_type", f"""SELECT CAST(k AS INT) AS k, CASE WHEN regexp_extract(m, '^([A-Za-z0-9_]+)(\\(.+\\))?!?:', 1) = '' THEN 'other' ELSE lower(regexp_extract(m, '^([A-Za-z0-9_]+)(\\(.+\\))?!?:', 1)) END AS kind, regexp_extract(m, '^[A-Za-z0-9_]+\\(([^)]+)\\)', 1) AS scope,
 contains(lower(m), 'breaking change') OR contains(lower(m), 'breaking:') OR contains(m, '!:') AS breaking, upper(c[1]) || c[2:] AS clean FROM (SELECT *, trim(string_split(regexp_replace(m, '(?i)^(feat|fix|docs|style|refactor|test|chore|perf|ci|build|revert)(\\(.+\\))?!?:\\s*', ''), chr(10))[1]) AS c FROM {_MSG})""")
def _(spark, d):
    m = F.col("m")
    return phrased(spark, d, *_MESSAGES).select("k", t.commit_type(m).alias("kind"), t.commit_scope(m).alias("scope"), t.is_breaking(m).alias("breaking"), t.clean_message(m).alias("clean"))


@query("issue_extract", f"SELECT CAST(k AS INT) AS k, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(m, '#([0-9]+)', 1), lambda x: '#' || x), list_transform(regexp_extract_all(m, '([A-Z]+-[0-9]+)', 1), lambda x: '#' || x)))), ',') AS issues FROM {_MSG}")
def _(spark, d):
    return phrased(spark, d, *_MESSAGES).select("k", F.concat_ws(",", F.array_sort(t.issues(F.col("m")))).alias("issues"))


@query("user_friendly", f"SELECT CAST(k AS INT) AS k, upper(c[1]) || c[2:] AS friendly FROM (SELECT k, {'regexp_replace(' * len(t.FRIENDLY)}m" + "".join(f", '{p}', '{w}', 'gi')" for p, w in t.FRIENDLY) + f" AS c FROM {_MSG})")
def _(spark, d):
    return phrased(spark, d, *_MESSAGES).select("k", t.user_friendly(F.col("m")).alias("friendly"))


_GOOD = f"w NOT IN ({', '.join(repr(w) for w in t.KEYWORD_STOPWORDS)}) AND (length(w) >= 3 OR (length(w) > 0 AND ({' OR '.join(f'starts_with(w, {p!r})' for p in t.TECHNICAL_PREFIXES)}))) AND NOT regexp_matches(w, '^[0-9]+$')"


@query("extract_keywords", f"SELECT doc_id, string_agg(w, '|' ORDER BY i) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, string_split_regex(trim(regexp_replace(lower(text), '[^a-z0-9_\\s-]', ' ', 'g'), ' ' || chr(10) || chr(9)), '\\s+') AS ws FROM documents)) WHERE {_GOOD} GROUP BY doc_id, w)) WHERE k <= 20 GROUP BY doc_id")
def _(spark, d):
    k = a.read(spark, d, "documents").select("doc_id", t.keywords(F.col("text")).alias("w")).where(F.size("w") > 0)
    return k.select("doc_id", F.concat_ws("|", "w").alias("keywords"))


@query("jaccard", with_("memories", "SELECT id, round(len(list_intersect(tags, ['en', 'src1'])) / CAST(len(list_distinct(list_concat(tags, ['en', 'src1']))) AS DOUBLE), 6) AS jaccard FROM memories"))
def _(spark, d):
    return a.memories(spark, d).select("id", r6(r.set_jaccard(F.col("tags"), F.array(F.lit("EN"), F.lit("src1"))), "jaccard"))


@query("overlap_coefficient", with_("memories", "SELECT id, round(CAST(len(list_intersect(related_files, ['src/en/g1.ts', 'src/src1/f1.ts', 'x.ts'])) AS DOUBLE) / 2, 6) AS overlap FROM memories"))
def _(spark, d):
    other = F.array(F.lit("src/en/g1.ts"), F.lit("src/src1/f1.ts"), F.lit("x.ts"))
    return a.memories(spark, d).select("id", r6(r.overlap_coefficient(F.size(F.array_intersect("related_files", other)), F.size("related_files"), F.size(other)), "overlap"))


@query("temporal_score", with_("memories", f"SELECT id, round(CASE WHEN abs(created_at - {NOW - 864000}) >= 604800 THEN 0.0::DOUBLE ELSE 1 - abs(created_at - {NOW - 864000}) / 604800.0::DOUBLE END, 6) AS score FROM memories"))
def _(spark, d):
    gap = F.abs(F.col("created_at") - (NOW - 864000))
    return a.memories(spark, d).select("id", r6(F.when(gap >= 604800, 0.0).otherwise(1 - gap / 604800.0), "score"))


_PAIRS = "CROSS JOIN (SELECT DISTINCT type AS t FROM memories)"


@query("infer_relation_type", with_("memories", f"SELECT DISTINCT type AS source_type, t AS target_type, CASE {' '.join(f'''WHEN type = '{s}' AND t = '{u}' THEN '{k}' ''' for s, u, k in r.INFERENCE)} WHEN type = t THEN 'supersedes' ELSE 'related_to' END AS relation FROM memories {_PAIRS}"))
def _(spark, d):
    kinds = a.memories(spark, d).select(F.col("type").alias("source_type")).distinct()  # five rows
    both = kinds.crossJoin(kinds.select(F.col("source_type").alias("target_type")))
    return both.select("source_type", "target_type", r.infer_relation(F.col("source_type"), F.col("target_type"), F.lit(True), F.lit(1.0)).alias("relation"))


_DICE = "2.0::DOUBLE * coalesce(list_sum(list_transform(list_distinct(qg), lambda g: least(len(list_filter(qg, lambda z: z = g)), len(list_filter(cg, lambda z: z = g))))), 0) / (len(qg) + len(cg))"


# --- queries ---------------------------------------------------------------------------------------

_Q = phrased_sql(*_QUERIES)
_TERMS = f"list_filter(string_split_regex(lower(q), '[^a-z0-9_]+'), lambda t: length(t) >= 3 AND t NOT IN ({', '.join(repr(w) for w in t.QUERY_STOPWORDS)}))"


@query("query_terms", f"SELECT CAST(k AS INT) AS k, array_to_string(list_sort(list_distinct({_TERMS})), '|') AS terms FROM {_Q}")
def _(spark, d):
    return phrased(spark, d, *_QUERIES).select("k", F.concat_ws("|", F.array_sort(t.query_terms(F.col("q")))).alias("terms"))


@query("matched_terms", with_("memories", "SELECT id, array_to_string(list_filter(['was', 'the', 'von', 'ion', 'heit', 'que', 'der', 'cion'], lambda t: contains(lower(content), t))[1:6], '|') AS matched FROM memories"))
def _(spark, d):
    terms = F.array(*[F.lit(x) for x in ("was", "the", "von", "ion", "heit", "que", "der", "cion")])
    return a.memories(spark, d).select("id", F.concat_ws("|", t.matched_terms(terms, F.col("content"))).alias("matched"))


@query("route_classify", f"SELECT CAST(k AS INT) AS k, CASE WHEN c AND NOT m THEN 'code' WHEN m AND NOT c THEN 'memory' ELSE 'hybrid' END AS route FROM (SELECT k, ({' OR '.join(f'''regexp_matches(lower(q), '{p}')''' for p in t.CODE_INTENT)} OR regexp_matches(q, '{t.CALL_INTENT}')) AS c, regexp_matches(lower(q), '{t.MEMORY_INTENT}') AS m FROM {_Q})")
def _(spark, d):
    return phrased(spark, d, *_QUERIES).select("k", t.route(F.col("q")).alias("route"))


_EDGES = "|".join((f"^{t.EDGE}", f"{t.EDGE}$")).replace("'", "''")


@query("cache_key", f"SELECT k, sha256(CASE WHEN b = '' THEN n ELSE b END) AS key FROM (SELECT *, regexp_replace(n, '{_EDGES}', '', 'g') AS b FROM (SELECT CAST(k AS INT) AS k, trim(regexp_replace(lower(q), '\\s+', ' ', 'g')) AS n FROM {_Q}))")
def _(spark, d):
    return phrased(spark, d, *_QUERIES).select("k", F.sha2(t.cache_query(F.col("q")), 256).alias("key"))


@query("code_entities", f"SELECT CAST(k AS INT) AS k, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(q, '\\b([A-Za-z]+[a-z][A-Z][A-Za-z0-9]*)\\b', 1), lambda n: lower(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'))))), '|') AS kebab FROM {_Q}")
def _(spark, d):
    return phrased(spark, d, *_QUERIES).select("k", F.concat_ws("|", F.array_sort(F.transform(t.code_entities(F.col("q")), t.kebab))).alias("kebab"))


_TICK_KIND = "CASE WHEN contains(n, '/') OR regexp_matches(n, '\\.[A-Za-z]+$') THEN 'file' WHEN regexp_matches(n, '^[A-Z]') THEN 'class' WHEN regexp_matches(n, '^[a-z][a-zA-Z0-9]*$') THEN 'function' ELSE 'generic' END"
_REF = lambda source, p, kind, part: f"SELECT k, s, '{source}' AS source, n, {kind} AS kind, {part} AS part FROM (SELECT DISTINCT k, s, unnest(regexp_extract_all(s, '{p}', 1)) AS n FROM sn)"
_REFS = " UNION ALL ".join((_REF("backtick", t.BACKTICK, _TICK_KIND, "'`' || n || '`'"), _REF("path", t.FILE_PATH.replace("'", "''"), "'file'", "n"), _REF("name", t.CLASS_NAME, "'class'", "n")))
_AT = "instr(s, part)"
_CUT = f"CASE WHEN {_AT} - 50 > 1 THEN '...' ELSE '' END || substring(s, greatest({_AT} - 50, 1), least({_AT} + length(part) + 50, length(s) + 1) - greatest({_AT} - 50, 1)) || CASE WHEN {_AT} + length(part) + 50 <= length(s) THEN '...' ELSE '' END"


@query("extract_code_refs", f"WITH sn AS (SELECT * FROM {phrased_sql(*_SNIPPETS)}) SELECT CAST(k AS INT) AS k, source, kind, n AS name, trim(replace({_CUT}, chr(10), ' ')) AS context FROM ({_REFS})")
def _(spark, d):
    """names, their kinds and what stands around them."""
    found = phrased(spark, d, *_SNIPPETS).select("k", F.explode(t.code_references(F.col("s"))).alias("r"))
    return found.select("k", "r.source", "r.kind", "r.name", "r.context")


@query("detect_code_language", f"SELECT CAST(k AS INT) AS k, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) {' '.join(f'''WHEN '{e}' THEN '{n}' ''' for e, n in t.LANGUAGES.items())} END AS language FROM {phrased_sql(*_PATHS)}")
def _(spark, d):
    return phrased(spark, d, *_PATHS).select("k", t.code_language(F.col("path")).alias("language"))


#: Language, kind, name and code that documents take in turn, before their own texts.
UNITS = [
    ("typescript", "function", "add", "/**\n * Adds *two* numbers.\n *\n * Well.\n */\nexport function add(a, b) {}"), ("python", "function", "f", 'def f():\n    """ Doc of f. """\n    pass'), ("python", "function", "g", "# helper\ndef g():\n    pass"),
    ("go", "function", "Run", "// Run does it.\n\n// More.\nfunc Run() {}\n// not this"), ("rust", "function", "main", "/// Runs it.\n//! Inner.\npub fn main() {}"), ("typescript", "class", "Box", "class Box {}\n\n\n"), ("sql", "other", "", "SELECT 1\n\n\n"),
    ("javascript", "other", "x", "const x = 1 // trailing"), ("typescript", "function", "h", "/** one line */\nfunction h() {}\n\n"), ("rust", "class", "S", "struct S;\n\n\n"),
]


def _units(spark, d):
    k = F.col("doc_id") % len(UNITS)
    lang, kind, name, code = (a.pick(k, [u[i] for u in UNITS]) for i in range(4))
    rows = a.read(spark, d, "documents").select("doc_id", lang.alias("language"), kind.alias("kind"), name.alias("name"), F.concat(code, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("code"))
    return rows.select("doc_id", t.code_summary(F.col("code"), F.col("language"), F.col("kind"), F.col("name")).alias("s")).select("doc_id", "s.*")


_TAKE = lambda i: f"CASE doc_id % {len(UNITS)} " + " ".join("WHEN {} THEN '{}'".format(n, u[i].replace("'", "''")) for n, u in enumerate(UNITS)) + " END"
_HEAD = lambda marks: f"(SELECT coalesce(string_agg(trim(substr(trim(y), {len(marks[0]) + 1})), ' ' ORDER BY i), '') FROM (SELECT y, i, count(*) FILTER (NOT regexp_matches(trim(y), '^({'|'.join(marks)})') AND trim(y) <> '') OVER (ORDER BY i) AS other FROM (SELECT unnest(ls) AS y, unnest(range(len(ls))) AS i)) WHERE other = 0 AND regexp_matches(trim(y), '^({'|'.join(marks)})'))"
_BLOCK = "array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_extract(code, '(?s)/\\*\\*\\s*\\n.*?\\*/'), '/\\*\\*|\\*/|\\*', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')"
_QUOTED = """'(?s)"{3}(.*?)"{3}|''{3}(.*?)''{3}'"""
_SUMMARY = f"""un AS (SELECT doc_id, {_TAKE(0)} AS language, {_TAKE(1)} AS kind, {_TAKE(2)} AS name, {_TAKE(3)} || chr(10) || coalesce(text, '') AS code FROM documents), ul AS (SELECT *, string_split(code, chr(10)) AS ls FROM un),
ud AS (SELECT *, CASE WHEN language IN ('typescript', 'javascript') THEN {_BLOCK} WHEN language = 'python' THEN trim(regexp_extract(code, {_QUOTED}, 1) || regexp_extract(code, {_QUOTED}, 2)) WHEN language = 'go' THEN {_HEAD(('//',))} WHEN language = 'rust' THEN {_HEAD(('///', '//!'))} ELSE '' END AS doc,
  coalesce(list_filter(list_transform(ls[1:3], lambda x: trim(regexp_extract(x, '//\\s*(.+)|#\\s*(.+)', 1) || regexp_extract(x, '//\\s*(.+)|#\\s*(.+)', 2))), lambda x: x <> '')[1], '') AS comment,
  coalesce(regexp_matches(list_filter(list_transform(ls, lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^(//|/\\*|\\*|#|$)'))[1], '^(export|public|pub) | (export|public|pub) '), false) AS public FROM ul),
us AS (SELECT doc_id, CASE WHEN doc <> '' THEN doc WHEN comment <> '' THEN comment ELSE CASE kind WHEN 'function' THEN 'Function ' WHEN 'class' THEN 'Class ' ELSE 'Code unit ' END || CASE name WHEN '' THEN 'anonymous' ELSE name END END AS summary,
  CASE WHEN doc <> '' THEN 'docstring' WHEN comment <> '' THEN 'comment' ELSE 'signature' END AS source, CAST(CASE WHEN doc <> '' THEN 0.9 WHEN comment <> '' THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence, (doc = '' AND comment = '') OR public AS needs_ai FROM ud)"""


@query("code_summary", f"WITH {_SUMMARY} SELECT * FROM us")
def _(spark, d):
    """what code says of itself, and whether a hybrid run asks a model."""
    return _units(spark, d)


@query("summary_stats", f"WITH {_SUMMARY} SELECT source, count(*) AS n, CAST(count(*) FILTER (needs_ai) AS BIGINT) AS needs_ai, round(avg(confidence), 6) AS confidence FROM us GROUP BY source")
def _(spark, d):
    """Summaries by where they come from."""
    return _units(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("needs_ai"), 1)).alias("needs_ai"), r6(F.avg("confidence"), "confidence"))


@query("entity_alias_normalise", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || '_' || p_name), '[_./-]', ' ', 'g'), '\\s+', ' ', 'g')) AS alias FROM part")
def _(spark, d):
    return a.read(spark, d, "part").select("p_partkey", t.entity_alias(F.concat(F.lit('"'), "p_brand", F.lit('"_['), "p_name", F.lit("]"))).alias("alias"))


_LEX = "CASE WHEN lower(name) = 'red box' THEN 1.0::DOUBLE WHEN contains(lower(name), 'red box') OR contains('red box', lower(name)) THEN 0.85 ELSE 0.75 * len(list_filter(['red', 'box'], lambda t: contains(lower(name), t))) / 2 END"


@query("lexical_entity_match", with_("entities", f"SELECT entity_id, round(CASE WHEN b > 0 THEN least(1.0::DOUBLE, b + least(0.12::DOUBLE, mentions / 100.0::DOUBLE) + least(0.08::DOUBLE, confidence * 0.08)) ELSE 0 END, 6) AS score FROM (SELECT *, {_LEX} AS b FROM entities)"))
def _(spark, d):
    terms = F.array(F.lit("red"), F.lit("box"))
    return a.entities(spark, d).select("entity_id", r6(t.lexical_entity_score(F.col("name"), F.lit("red box"), terms, F.col("mentions"), F.col("confidence")), "score"))


@query("fused_entity_score", with_("entities", "SELECT entity_id, round(CASE WHEN v > 0 AND confidence > 0 THEN least(1.0::DOUBLE, 0.72 * v + 0.28 * confidence) WHEN v > 0 THEN v ELSE confidence END, 6) AS score FROM (SELECT *, CAST(mentions % 5 AS DOUBLE) / 4 AS v FROM entities)"))
def _(spark, d):
    return a.entities(spark, d).select("entity_id", r6(t.fused_score((F.col("mentions") % 5).cast("double") / 4, F.col("confidence")), "score"))


MARKDOWN = [(1, "---\ntitle: A\ntags: x\n---\n# Head\ntext"), (2, "# No matter\n---\nx"), (3, "---\na: 1\n---\n")]
_MARKDOWN = ("documents", "doc_id", MARKDOWN, ("m",), (("\n", "text"),))


@query("extract_frontmatter", f"SELECT CAST(k AS INT) AS k, regexp_extract(m, '^---\\n((?:.|\\n)*?)\\n---\\n', 1) AS front FROM {phrased_sql(*_MARKDOWN)}")
def _(spark, d):
    return phrased(spark, d, *_MARKDOWN).select("k", t.frontmatter(F.col("m")).alias("front"))


BRANCHES = [(1, "feature/add_login-page"), (2, "fix/db"), (3, "main"), (4, "chore/bump-all__deps")]
_BRANCHES = ("orders", "o_orderkey", BRANCHES, ("b",), (("-", "o_custkey"),))


_PR = phrased_sql("orders", "o_orderkey", MESSAGES, ("m",), ((" #", "o_custkey"),))
_KINDS = "lower(regexp_extract(m, '(?i)^(feat|fix|docs|style|refactor|test|chore)(?:\\((.+)\\))?:', 1))"
_SAYS = [("feat", "'Adds ' || feat || ' new feature(s)'"), ("fix", "'Fixes ' || fix || ' bug(s)'"), ("refactor", "'Refactors ' || refactor || ' component(s)'"), ("docs", "'Updates documentation'"), ("test", "'Adds/updates tests'")]


@query("pr_summary", f"""WITH c AS (SELECT o_custkey AS pr, {_KINDS} AS kind, n FROM {_PR} p JOIN orders ON o_orderkey = p.k JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = p.k),
g AS (SELECT pr, count(*) AS commits, sum(n) AS files, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k, _ in _SAYS)} FROM c GROUP BY pr)
SELECT pr, CASE WHEN {' + '.join(k for k, _ in _SAYS)} = 0 THEN 'This PR includes ' || commits || ' commit(s) affecting ' || CAST(files AS BIGINT) || ' file(s).' ELSE concat_ws('. ', {', '.join(f'CASE WHEN {k} > 0 THEN {x} END' for k, x in _SAYS)}) || '.' END AS summary FROM g""")
def _(spark, d):
    """what a pull request does, by its commits' types; a customer's orders are one."""
    files = a.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("files"))
    orders = a.read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("pr")).join(files, "o_orderkey")
    said = phrased(spark, d, *_MESSAGES).withColumnRenamed("k", "o_orderkey")
    return m.pr_summary(orders.join(said, "o_orderkey"), "pr", "m", "files")


@query("branch_title", f"SELECT CAST(k AS INT) AS k, upper(c[1]) || c[2:] AS title FROM (SELECT k, regexp_replace(regexp_replace(b, '^(feature|feat|fix|bugfix|hotfix|chore|docs)/', ''), '[-_]+', ' ', 'g') AS c FROM {phrased_sql(*_BRANCHES)})")
def _(spark, d):
    return phrased(spark, d, *_BRANCHES).select("k", t.branch_title(F.col("b")).alias("title"))


@query("commit_message", "SELECT o_orderkey AS commit_id, kind || CASE WHEN dirs = 1 THEN '(' || scope || ')' ELSE '' END || ': update ' || files || ' file' || CASE WHEN files = 1 THEN '' ELSE 's' END AS message FROM (SELECT o_orderkey, CASE WHEN o_totalprice % 3 < 1 THEN 'feat' WHEN o_totalprice % 3 < 2 THEN 'fix' ELSE 'chore' END AS kind, min(p_brand) AS scope, count(DISTINCT p_brand) AS dirs, count(DISTINCT l_partkey) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)")
def _(spark, d):
    """type, scope and summary of a change from the facts of its files."""
    o, line, p = (a.read(spark, d, x) for x in ("orders", "lineitem", "part"))
    j = o.select("o_orderkey", "o_totalprice").join(line.select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(p.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    kind = F.when(F.col("o_totalprice") % 3 < 1, "feat").when(F.col("o_totalprice") % 3 < 2, "fix").otherwise("chore")
    g = j.groupBy("o_orderkey", kind.alias("kind")).agg(F.min("p_brand").alias("scope"), F.countDistinct("p_brand").alias("dirs"), F.countDistinct("l_partkey").alias("files"))
    scope = F.when(F.col("dirs") == 1, F.concat(F.lit("("), "scope", F.lit(")"))).otherwise("")
    return g.select(F.col("o_orderkey").alias("commit_id"), F.concat("kind", scope, F.lit(": update "), F.col("files").cast("string"), F.when(F.col("files") == 1, " file").otherwise(" files")).alias("message"))


# --- technology and entity extraction --------------------------------------------------------------

NOTES = [
    (1, "We use PostgreSQL and redis at Acme Corp, as Jane Smith said"), (2, "The team moved to Kubernetes. Data Platform Group wrote it, then Big Data Platform paid"), (3, "no entities here"), (4, "python or Rust? Python."),
    (5, "See the Observer Pattern and Error, Todo, Monday! Monday Morning. Ask Bo or Ann Lee"), (6, "Northwind Traders Labs uses Go, go, npm and the GitHub Actions of GitHub"),
]
# Word borders beside letters outside ASCII differ between engines, so the tail is plain.
_NOTES = ("documents", "doc_id", NOTES, ("s",), ((" ", "source"),))
_FOUND = lambda p, kind, sure: f"list_transform(regexp_extract_all(s, '{p}', 1), lambda x: {{'kind': {kind}, 'name': regexp_replace(regexp_replace(trim(x), '\\s+', ' ', 'g'), '(?i)^the\\s+', ''), 'sure': {sure}}})"
_INNER = f"regexp_replace(s, '([.!?]\\W){ex.CAPITALISED[2:]}', '\\1#', 'gs')"
_CAPITAL = f"list_transform(list_filter(regexp_extract_all({_INNER}, '{ex.CAPITALISED}', 1), lambda x: length(x) >= 4 AND x NOT IN ({', '.join(map(repr, ex.COMMON))})), lambda x: {{'kind': NULL::VARCHAR, 'name': x, 'sure': 0.3::DOUBLE}})"
_ENT = [_FOUND(p, "'TECHNOLOGY'", "0.6::DOUBLE") for p in ex.TECHNOLOGY] + [_FOUND(p, "'ORGANIZATION'", "0.5::DOUBLE") for p in ex.ORGANIZATION] + [_CAPITAL]
_NEAR = "substring(lower(s), greatest(spot - 50, 1), spot + length(name) + 50 - greatest(spot - 50, 1))"
_ANY = lambda words, x: " OR ".join(f"contains({x}, '{w}')" for w in words)
_KIND = f"CASE WHEN kind IS NOT NULL THEN kind WHEN {_ANY(ex.PERSON, _NEAR)} THEN 'PERSON' WHEN {_ANY(ex.CONCEPT, 'lower(name)')} THEN 'CONCEPT' ELSE 'OTHER' END"


@query("extract_entities", f"""WITH s AS (SELECT k, s, flatten([{', '.join(_ENT)}]) AS l FROM {phrased_sql(*_NOTES)}),
e AS (SELECT k, s, i, l[i].kind AS kind, l[i].name AS name, l[i].sure AS sure, instr(lower(s), lower(l[i].name)) AS spot FROM s, (SELECT unnest(range(1, 40)) AS i) WHERE i <= len(l)),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY k, lower(name) ORDER BY i) = 1) SELECT CAST(k AS INT) AS k, {_KIND} AS kind, name, sure AS confidence FROM f""")
def _(spark, d):
    """each document's entities with their kinds and confidences."""
    return ex.entities(phrased(spark, d, *_NOTES), "k", "s").select("k", "kind", "name", "confidence")


# --- dates, vectors, json, budget ------------------------------------------------------------------


@query("date_functions", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS epoch_s, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH, '%Y-%m-%d') AS three_months_ago FROM orders")
def _(spark, d):
    o = a.read(spark, d, "orders")
    ts = F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", F.unix_timestamp(ts).alias("epoch_s"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(F.add_months(F.to_date(ts), -3), "yyyy-MM-dd").alias("three_months_ago"))


@query("cosine_similarity", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = a.read(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", r6(v.cosine(F.col("embedding"), F.col("other")), "cosine"))


@query("mrl_truncate", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS first, round(CAST(embedding[16] AS DOUBLE) / sqrt(list_sum(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS last FROM embeddings")
def _(spark, d):
    h = a.read(spark, d, "embeddings").select("vec_id", v.truncate_normalise(F.col("embedding"), 16).alias("h"))
    return h.select("vec_id", r6(F.col("h")[0], "first"), r6(F.col("h")[15], "last"))


@query("to_fixed", "SELECT event_id, round(value, 2) AS fixed FROM events")
def _(spark, d):
    return a.read(spark, d, "events").select("event_id", F.round("value", 2).alias("fixed"))


@query("json_access", "SELECT CAST(props->>'k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return a.read(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("stable_json", """SELECT event_id, '{"props":{"k":' || (props->>'k') || ',"list":[{"x":' || CAST(round(value * 100) AS BIGINT) || ',"y":"' || event_type || '"},[],null]},"type":"' || event_type || '","user":' || user_id || '}' AS doc FROM events""")
def _(spark, d):
    """nested objects whose keys come in no order."""
    hundred, k = F.round(F.col("value") * 100).cast("long").cast("string"), F.get_json_object("props", "$.k")
    parts = ['{ "user" : ', F.col("user_id").cast("string"), ', "props":{"list":[{"y":"', F.col("event_type"), '", "x":', hundred, '.0},[], null],"k":', k, '}, "type":"', F.col("event_type"), '"}']
    return a.read(spark, d, "events").select("event_id", t.stable_json(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).alias("doc"))


def _budget_sql(ratios, low, high):
    got = {c: f"CAST(floor(total * {x}::DOUBLE) AS BIGINT)" for c, x in zip(b.CATEGORIES, ratios, strict=True)}
    got = {c: f"greatest({x}, {low[c]})" if c in low else x for c, x in got.items()}
    got = {c: f"least({x}, {high[c]})" if c in high else x for c, x in got.items()}
    first = ", ".join(f"{x} AS {c}" for c, x in got.items())
    may = {c: f"{c}0 < {high[c]}" if c in high else "TRUE" for c in b.CATEGORIES}
    who = "CASE " + " ".join(f"WHEN {may[c]} THEN '{c}'" for c in b.SURPLUS) + " END"
    second = ", ".join(f"{c}0 + CASE WHEN who = '{c}' THEN greatest(over, 0) ELSE 0 END AS {c}1" for c in b.CATEGORIES)
    short, steps = "greatest(-over, 0)", []
    for c in b.DEFICIT:
        take = f"least(greatest({c}1 - {low.get(c, 0)}, 0), {short})"
        steps.append(f"CAST({c}1 - {take} AS BIGINT) AS {c}")
        short = f"({short} - {take})"
    return f"SELECT total, {', '.join(steps)} FROM (SELECT total, over, {second} FROM (SELECT *, {who} AS who FROM (SELECT total, total - (system + context + \"user\" + response) AS over, system AS system0, context AS context0, \"user\" AS user0, response AS response0 FROM (SELECT total, {first.replace('AS user', 'AS \"user\"')} FROM (SELECT DISTINCT CAST(n_chars AS BIGINT) + 10 AS total FROM documents)))))".replace(" AS user", ' AS "user"').replace('AS "user"0', "AS user0").replace('AS "user"1', "AS user1")


_LOW, _HIGH = {"system": 100, "response": 200}, {"context": 2000, "user": 300}
for _name, _r in b.RATIOS.items():

    @query(f"budget_{_name}", _budget_sql(_r, _LOW, _HIGH))
    def _(spark, d, ratios=_r):
        total = a.read(spark, d, "documents").select((F.col("n_chars") + 10).cast("long").alias("total")).distinct()
        return total.select("total", *[x.alias(c) for c, x in b.allocate(F.col("total"), ratios, _LOW, _HIGH).items()])


@query("regex_token_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]')) AS BIGINT) AS tokens FROM documents")
def _(spark, d):
    return a.read(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"), F.lit(0))).cast("long").alias("tokens"))


@query("truncate_tokens", f"SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '{t.TOKEN}'), 1, 64), '') AS head FROM documents")
def _(spark, d):
    """the first 64 tokens of each document."""
    return a.read(spark, d, "documents").select("doc_id", t.truncate_tokens(F.col("text"), 64).alias("head"))


@query("split_token_chunks", "SELECT doc_id, i // 48 AS chunk, array_to_string(list_slice(ws, i + 1, i + 64), ' ') AS content FROM (SELECT doc_id, ws, unnest(generate_series(0, greatest(len(ws) - 1, 0), 48)) AS i FROM (SELECT doc_id, string_split_regex(text, '\\s+') AS ws FROM documents))")
def _(spark, d):
    """Windows of 64 words that overlap by 16."""
    w = a.read(spark, d, "documents").select("doc_id", F.split("text", r"\s+").alias("ws"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - 1, F.lit(0)), F.lit(48))).alias("i")
    return w.select("doc_id", "ws", at).select("doc_id", (F.col("i") / 48).cast("long").alias("chunk"), F.concat_ws(" ", F.slice("ws", F.col("i") + 1, F.lit(64))).alias("content"))
