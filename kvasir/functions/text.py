"""Text functions over commit messages, queries, code and names, as column expressions.

Patterns use ASCII classes and no look-around, so other engines read them alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of the commit classifier, by outcome.
DECISION_WORDS = (
    "decision", "chose", "decided", "migrat", "refactor", "architect", "restructur", "redesign", "overhaul",
    "breaking", "deprecat", "upgrade", "downgrade", "switch to", "move to", "replace", "implement new",
)
SOLUTION_WORDS = ("fix", "bug", "resolve", "issue", "error", "crash", "patch", "hotfix", "correct", "repair", "workaround")
# Short words that keyword extraction keeps when a word starts with them.
TECHNICAL_PREFIXES = (
    "api", "http", "https", "sql", "json", "xml", "html", "css", "js", "ts", "py", "go", "rust", "java", "cpp",
    "auth", "oauth", "jwt", "db", "env", "config", "async", "sync", "crud", "rest", "graphql",
)
# Words that query terms leave out.
QUERY_STOPWORDS = ("a", "an", "and", "are", "be", "by", "for", "from", "how", "if", "in", "is", "it", "of", "on", "or", "our", "the", "to", "what", "which", "who", "with")
#: Stop words of keyword extraction (this engine's own list).
KEYWORD_STOPWORDS = ("about", "also", "and", "are", "but", "can", "for", "from", "has", "have", "into", "its", "not", "that", "the", "their", "then", "there", "this", "was", "were", "will", "with", "you", "your")
# Plain words for a changelog's readers, in the order of replacement.
FRIENDLY = (
    (r"\bapi\b", "API"), (r"\bui\b", "interface"), (r"\bux\b", "user experience"), (r"\bauth\b", "authentication"), (r"\bconfig\b", "settings"), (r"\bdb\b", "database"),
    (r"\benv\b", "environment"), (r"refactor", "improve"), (r"implement", "add"), (r"\bfix\b", "resolve"), (r"\bbug\b", "issue"),
)
# Intents of the query router.
CODE_INTENT = (
    r"\b(call(ers?)?|callee|calls?|dependency|dependencies|import|implementation|implements|interface|class|function|method|impact|affected|break|references?|where.*defined|definition)\b",
    r"\b(trace|traverse|map|follow|flow|pipeline|chain|end-to-end|across)\b",
    r"\b(which|what|list|show)\b.{0,24}\b(files?|paths?)\b",
    r"\b(across|between)\b.{0,30}\b(apps?|packages?|services?|modules?)\b",
)
CALL_INTENT = r"[A-Za-z_][A-Za-z0-9_]*\("
MEMORY_INTENT = r"\b(decision|why|reason|tradeoff|history|adr|note|context|previous|past|policy|convention)\b"
# Shares of the sources by route: (rag, kag, graphrag, rag limit, graphrag limit).
ROUTES = {"code": (0.2, 0.65, 0.15, 8, 6), "memory": (0.75, 0.1, 0.15, 20, 8), "hybrid": (0.55, 0.3, 0.15, 16, 7)}
# Endings of class names, and file endings, in code references.
CLASS_ENDINGS = (
    "Service|Handler|Controller|Manager|Factory|Repository|Provider|Store|Client|Helper|Util|Config|Options|Props|State|Context|Hook|Plugin|Middleware|Router|Model|Entity|Schema|Type|Interface|Validator|"
    "Parser|Builder|Resolver|Adapter|Wrapper"
)
FILE_ENDINGS = "ts|tsx|js|jsx|py|go|rs|java|c|cpp|h|hpp"
BACKTICK = r"`([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)`"
FILE_PATH = rf"(?m)(?:^|\s|[\"'`(])([./]?(?:[A-Za-z0-9_-]+/)*[A-Za-z0-9_-]+\.(?:{FILE_ENDINGS}))\b"
CLASS_NAME = rf"\b([A-Z][a-zA-Z0-9]+(?:{CLASS_ENDINGS}))\b"
# File endings to languages.
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "sql": "sql"}


def any_contained(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def commit_category(message: Column) -> Column:
    """decision, solution or null: by conventional prefix, then by keyword."""
    low, first = F.lower(message), F.element_at(F.split(message, "\n"), 1)
    feature = first.rlike(r"(?i)^(feat|feature)(\(.+\))?!?:") & ((F.length(message) > 100) | F.contains(low, F.lit("implement")))
    out = F.when(feature, "decision").when(first.rlike(r"(?i)^fix(\(.+\))?!?:"), "solution").when(first.rlike(r"(?i)^refactor(\(.+\))?!?:"), "decision")
    return out.when(any_contained(low, DECISION_WORDS), "decision").when(any_contained(low, SOLUTION_WORDS), "solution")


def commit_type(message: Column) -> Column:
    t = F.lower(F.regexp_extract(message, r"^([A-Za-z0-9_]+)(\(.+\))?!?:", 1))
    return F.when(t == "", "other").otherwise(t)


def commit_scope(message: Column) -> Column:
    return F.regexp_extract(message, r"^[A-Za-z0-9_]+\(([^)]+)\)", 1)


def is_breaking(message: Column) -> Column:
    low = F.lower(message)
    return F.contains(low, F.lit("breaking change")) | F.contains(low, F.lit("breaking:")) | F.contains(message, F.lit("!:"))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))


def clean_message(message: Column) -> Column:
    bare = F.regexp_replace(message, r"(?i)^(feat|fix|docs|style|refactor|test|chore|perf|ci|build|revert)(\(.+\))?!?:\s*", "")
    return capitalised(F.trim(F.element_at(F.split(bare, "\n"), 1)))


def issues(message: Column, prefix_all: bool = True) -> Column:
    """Issue numbers; the changelog writes all with a #, others leave Jira keys plain."""
    jira = F.regexp_extract_all(message, F.lit(r"([A-Z]+-[0-9]+)"), F.lit(1))
    jira = F.transform(jira, lambda x: F.concat(F.lit("#"), x)) if prefix_all else jira
    numbers = F.transform(F.regexp_extract_all(message, F.lit(r"#([0-9]+)"), F.lit(1)), lambda x: F.concat(F.lit("#"), x))
    return F.array_distinct(F.concat(numbers, jira))


def keywords(text: Column, limit: int = 20) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s-]", " ")), r"\s+")
    technical = lambda w: reduce(lambda a, b: a | b, [F.startswith(w, F.lit(p)) for p in TECHNICAL_PREFIXES])
    good = lambda w: ~w.isin(*KEYWORD_STOPWORDS) & ((F.length(w) >= 3) | ((F.length(w) > 0) & technical(w))) & ~w.rlike("^[0-9]+$")
    return F.slice(F.array_distinct(F.filter(words, good)), 1, limit)


def query_terms(query: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(query), "[^a-z0-9_]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*QUERY_STOPWORDS)))


def matched_terms(terms: Column, text: Column, limit: int = 6) -> Column:
    low = F.lower(text)
    return F.slice(F.filter(terms, lambda t: F.contains(low, t)), 1, limit)


def route(query: Column) -> Column:
    low = F.lower(query)
    code = reduce(lambda a, b: a | b, [low.rlike(p) for p in CODE_INTENT]) | query.rlike(CALL_INTENT)
    memory = low.rlike(MEMORY_INTENT)
    return F.when(code & ~memory, "code").when(memory & ~code, "memory").otherwise("hybrid")


# The signs that are cut off at a query's ends.
EDGE = r"""[\s"'`.,!?;:()\[\]{}<>~_-]+"""


def cache_query(query: Column) -> Column:
    """Lower case, single spaces, no punctuation at the ends unless there is nothing else."""
    t = F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))
    bare = F.regexp_replace(t, f"^{EDGE}|{EDGE}$", "")
    return F.when(bare == "", t).otherwise(bare)


def entity_alias(value: Column) -> Column:
    bare = F.regexp_replace(F.lower(value), r"[\"'`\[\](){}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[_./-]", " "), r"\s+", " "))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def user_friendly(message: Column) -> Column:
    return capitalised(reduce(lambda t, pr: F.regexp_replace(t, "(?i)" + pr[0], pr[1]), FRIENDLY, message))


# Words that look like class names and aren't.
NO_CLASS = (
    "JavaScript", "TypeScript", "Python", "Service", "Handler", "Controller", "Manager", "Factory", "Repository", "Provider", "Interface", "Component", "Function", "Class", "Method", "Object", "Array", "String",
    "Number", "Boolean", "Promise", "Async", "Await", "Import", "Export", "Module", "Package", "Version", "Update", "Delete", "Create", "Read",
)


def reference_kind(name: Column) -> Column:
    """Of a name in back ticks: file, class, function or generic."""
    file = F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")) | name.rlike(r"\.[A-Za-z]+$")
    return F.when(file, "file").when(name.rlike("^[A-Z]"), "class").when(name.rlike("^[a-z][a-zA-Z0-9]*$"), "function").otherwise("generic")


def around(text: Column, part: Column, size: int = 50) -> Column:
    """The first place of a part in the text with ``size`` letters on both sides, dots where that cuts, in one line."""
    at = F.instr(text, part)
    start, end = F.greatest(at - size, F.lit(1)), F.least(at + F.length(part) + size, F.length(text) + 1)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "...").otherwise(""))
    return F.trim(F.replace(cut, F.lit("\n"), F.lit(" ")))


def code_references(text: Column) -> Column:
    """Distinct (source, kind, name, context): names in back ticks, file paths and class names but common words, in that order."""
    names = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1)))
    entry = lambda source, kind, name, part: F.struct(F.lit(source).alias("source"), kind.alias("kind"), name.alias("name"), around(text, part).alias("context"))
    ticks = F.transform(names(BACKTICK), lambda n: entry("backtick", reference_kind(n), n, F.concat(F.lit("`"), n, F.lit("`"))))
    files = F.transform(names(FILE_PATH), lambda n: entry("path", F.lit("file"), n, n))
    classes = F.transform(F.filter(names(CLASS_NAME), lambda n: ~n.isin(*NO_CLASS)), lambda n: entry("name", F.lit("class"), n, n))
    return F.concat(ticks, files, classes)


def code_language(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ending)


def frontmatter(markdown: Column) -> Column:
    return F.regexp_extract(markdown, r"^---\n((?:.|\n)*?)\n---\n", 1)


def code_entities(query: Column) -> Column:
    """Identifiers in a query: words with an inner capital."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(r"\b([A-Za-z]+[a-z][A-Z][A-Za-z0-9]*)\b"), F.lit(1)))


def kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2"))


def lexical_entity_score(name: Column, query: Column, terms: Column, mentions: Column, confidence: Column) -> Column:
    """1 if equal, .85 if one contains the other, else 3/4 of the share of terms in the name; with small bonuses."""
    low = F.lower(name)
    hit = F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.greatest(F.size(terms), F.lit(1))
    base = F.when(low == query, 1.0).when(F.contains(low, query) | F.contains(query, low), 0.85).otherwise(0.75 * hit)
    bonus = F.least(F.lit(0.12), mentions / 100.0) + F.least(F.lit(0.08), confidence * 0.08)
    return F.when(base > 0, F.least(F.lit(1.0), base + bonus)).otherwise(0.0)


def fused_score(vector: Column, lexical: Column) -> Column:
    return F.when((vector > 0) & (lexical > 0), F.least(F.lit(1.0), 0.72 * vector + 0.28 * lexical)).when(vector > 0, vector).otherwise(lexical)


def _leading(lines: Column, marks: tuple[str, ...]) -> Column:
    """The lines that begin with a mark, up to the first line of anything else, without the mark, in one."""
    marked = lambda x: reduce(lambda a, b: a | b, [F.startswith(F.trim(x), F.lit(m)) for m in marks])
    other = F.array_position(F.transform(lines, lambda x: ~marked(x) & (F.trim(x) != "")), True)
    head = F.when(other > 0, F.slice(lines, F.lit(1), other.cast("int") - 1)).otherwise(lines)
    return F.array_join(F.transform(F.filter(head, marked), lambda x: F.trim(F.substring(F.trim(x), len(marks[0]) + 1, 1_000_000))), " ")


def docstring(code: Column, language: Column) -> Column:
    """The documentation that a language's own form gives, or an empty text."""
    lines = F.split(code, "\n")
    block = F.regexp_replace(F.regexp_extract(code, r"(?s)/\*\*\s*\n.*?\*/", 0), r"/\*\*|\*/|\*", "")
    block = F.array_join(F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    quoted = r"""(?s)"{3}(.*?)"{3}|'{3}(.*?)'{3}"""
    python = F.trim(F.concat(F.regexp_extract(code, quoted, 1), F.regexp_extract(code, quoted, 2)))
    script = language.isin("typescript", "tsx", "javascript", "jsx")
    return F.when(script, block).when(language == "python", python).when(language == "go", _leading(lines, ("//",))).when(language == "rust", _leading(lines, ("///", "//!"))).otherwise("")


def first_comment(code: Column) -> Column:
    """The first comment in the first three lines, or an empty text."""
    pattern = r"//\s*(.+)|#\s*(.+)"
    said = F.transform(F.slice(F.split(code, "\n"), 1, 3), lambda x: F.trim(F.concat(F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2))))
    return F.coalesce(F.get(F.filter(said, lambda x: x != ""), F.lit(0)), F.lit(""))


def exported(code: Column) -> Column:
    """Whether the first line that is no comment says so."""
    lines = F.transform(F.split(code, "\n"), lambda x: F.trim(x))
    first = F.get(F.filter(lines, lambda x: ~x.rlike(r"^(//|/\*|\*|#|$)")), F.lit(0))
    return F.coalesce(first.rlike("^(export|public|pub) | (export|public|pub) "), F.lit(False))


def code_summary(code: Column, language: Column, kind: Column, name: Column, least: float = 0.6) -> Column:
    """(summary, source, confidence, needs_ai): documentation, else a first comment, else what the signature says.

    A hybrid run leaves to a model what is less sure than ``least``, and what is exported.
    """
    doc, comment = docstring(code, language), first_comment(code)
    named = F.when(F.coalesce(name, F.lit("")) == "", "anonymous").otherwise(name)
    said = F.concat(F.when(kind == "function", "Function ").when(kind == "class", "Class ").otherwise("Code unit "), named)
    sure = F.when(doc != "", 0.9).when(comment != "", 0.7).otherwise(0.5)
    return F.struct(
        F.when(doc != "", doc).when(comment != "", comment).otherwise(said).alias("summary"), F.when(doc != "", "docstring").when(comment != "", "comment").otherwise("signature").alias("source"),
        sure.alias("confidence"), ((sure < least) | exported(code)).alias("needs_ai"),
    )


def branch_title(branch: Column) -> Column:
    bare = F.regexp_replace(branch, "^(feature|feat|fix|bugfix|hotfix|chore|docs)/", "")
    return capitalised(F.regexp_replace(bare, "[-_]+", " "))


def stable_json(text: Column) -> Column:
    """The JSON text with the keys of all objects, nested ones too, in order and no white space; null if it isn't JSON
    or names a key twice. Whole numbers lose their decimals; numbers written with an exponent keep Spark's form.
    """
    sorted_keys = F.to_json(F.try_parse_json(text))
    return F.regexp_replace(sorted_keys, r'("(?:[^"\\]|\\.)*+")|(-?\d+)\.0(?![\dE])', "$1$2")


#: A token with the white space before it: a run of word letters or a single other sign.
TOKEN = r"\s*(?:[A-Za-z0-9_]+|[^\sA-Za-z0-9_])"


def truncate_tokens(text: Column, limit: int) -> Column:
    """The text up to its ``limit``-th token, whole tokens only; what follows the last one, white space too, goes."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), 1, limit), "")
