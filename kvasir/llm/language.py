"""Operator 10: language identification by spans.

Words are runs of letters and their combining marks. The script of a word (by code-point ranges) leaves only the languages that were
seen in that script; each candidate language scores the word by the log-likelihood of its letter pairs and
triples under that language; and the Viterbi path over the words, with a penalty for every change of
language, labels spans of one language in mixed text. A document's language is the one with most letters on
the path, its score their share. A run of over ``LONG_WORD`` letters, as in unspaced scripts, is a sequence of
pieces, each a step of the path with a script of its own; the pieces' letter pairs and triples are the run's.

``fit`` learns the letter statistics from a bounded sample: at most ``per_language`` labelled rows of each
language, the first of each of 64 salts by a hash of their ids, whole texts; the rows it may learn from are the caller's to choose.
Of each language the ``max_grams`` most frequent pairs and triples are kept, so that none crowds out another's,
and all its scripts. Prediction sees texts only.

Defined cases: null texts, and texts without a letter, are ``und`` with score 0 and no spans; words in a
script that no language was seen in may be any language; ties go to the language first in order; without
labelled rows, all is ``und``; repeated rows each get a row; texts of any length are labelled whole; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.llm.common import Stage

# First code points of script ranges, and their scripts.
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other"),
)
_starts = [a for a, _ in RANGES]
#: A letter and what follows it of letters and combining marks; number forms such as a half aren't letters.
_words = regex.compile(r"\p{L}[\p{L}\p{M}]*")
REMEMBERED, LONG_WORD, GROUP_WORDS = 400_000, 40, 200_000


def script(word: str) -> str:
    return RANGES[bisect.bisect_right(_starts, ord(word[0])) - 1][1]


def grams(word: str) -> list[str]:
    """Letter pairs and triples of the word with its ends marked."""
    return _starting(f"^{word}$")


def _starting(piece: str) -> list[str]:
    """Letter pairs and triples of a piece with marked ends; the pair of the two letters beyond it is the next one's."""
    last = len(piece) - (1 if piece[-1] == "$" else 2)
    return [piece[i : i + 2] for i in range(last)] + [piece[i : i + 3] for i in range(len(piece) - 2)]


def cuts(word: str) -> list[int]:
    """Starts of the word's pieces, and its end; the last piece has two letters at least."""
    return [0, *range(LONG_WORD, len(word) - 1, LONG_WORD), len(word)]


def pieces(word: str) -> list[str]:
    """The word's pieces in lower case, the word's ends marked; each but the last goes on for two more letters."""
    at, low = cuts(word), word.lower()
    if len(low) != len(word):  # only a dotted capital I becomes two
        shift = itertools.accumulate((word.count("\u0130", a, b) for a, b in itertools.pairwise(at)), initial=0)
        at = [a + n for a, n in zip(at, shift, strict=True)]
    return [("^" if a == 0 else "") + (low[a : b + 2] if b < len(low) else f"{low[a:]}$") for a, b in itertools.pairwise(at)]


class LanguageModel:
    def __init__(self, counts: dict[str, dict[str, int]], scripts: dict[str, dict[str, int]], penalty: float = 12.0, rare_script: float = 0.01):
        """counts: language -> gram -> count; scripts: language -> script -> letters."""
        self.languages, self.penalty, self.uid = sorted(counts), penalty, uuid.uuid4().hex
        names = sorted({g for c in counts.values() for g in c})
        self.gram = {g: i for i, g in enumerate(names)}
        table = np.full((len(names) + 1, len(self.languages)), 0.5)
        for j, lang in enumerate(self.languages):
            for g, n in counts[lang].items():
                table[self.gram[g], j] += n
        self.log = np.log(table / table.sum(axis=0)) if self.languages else table
        seen = {s for c in scripts.values() for s in c}
        share = {s: np.array([scripts[x].get(s, 0) >= rare_script * max(1, sum(scripts[x].values())) for x in self.languages]) for s in seen}
        self.allowed = {s: ok for s, ok in share.items() if ok.any()}

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods, one row a word; languages not written in its script have a prohibitive one."""
        return self.score_pieces([f"^{w}$" for w in words])

    def score_pieces(self, words: list[str]) -> np.ndarray:
        """As score_words, of pieces with marked ends."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        none, at, starts = len(self.gram), [], []
        for w in words:
            starts.append(len(at))
            at += [self.gram.get(g, none) for g in _starting(w)]
        out = np.add.reduceat(self.log[at], starts, axis=0)
        for i, w in enumerate(words):
            ok = self.allowed.get(script(w.lstrip("^")))
            if ok is not None and not ok.all():
                out[i, ~ok] = -1e6
        return out.astype(np.float32)


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word of each text; text i's words are scores[offsets[i]:offsets[i + 1]].

    Texts of like length advance together, a word at a time.
    """
    n_lang = scores.shape[1]
    small = np.min_scalar_type(n_lang)
    path, sizes = np.zeros(len(scores), small), np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        least = sizes[order[at]]
        end = at + 1
        while end < len(order) and sizes[order[end]] <= 2 * least and sizes[order[end]] * (end + 1 - at) <= GROUP_WORDS:
            end += 1
        docs = order[at:end]
        at, longest, d = end, int(sizes[docs].max()), np.arange(len(docs))
        seat = np.arange(longest)[:, None] < sizes[docs][None, :]
        source = np.where(seat, offsets[docs][None, :] + np.arange(longest)[:, None], 0)
        e = scores[source] * seat[:, :, None]
        back = np.empty((longest, len(docs), n_lang), small)
        keep = np.broadcast_to(np.arange(n_lang, dtype=small), (len(docs), n_lang))
        best = e[0].astype(np.float64)
        for t in range(1, longest):
            arg = best.argmax(axis=1)
            change = (best[d, arg] - penalty)[:, None]
            moves = change > best
            back[t] = np.where(moves, arg[:, None], keep)
            best = np.where(moves, change, best) + e[t]
        state = best.argmax(axis=1)
        label = np.empty((longest, len(docs)), small)
        for t in range(longest - 1, -1, -1):
            label[t] = state
            if t:
                state = back[t, d, state]
        path[source[seat]] = label[seat]
    return path


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, what, name, n): the batch's gram and script counts."""
    for batch in batches:
        by: dict[str, tuple[Counter, Counter]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            g, s = by.setdefault(lang, (Counter(), Counter()))
            for w, n in Counter(_words.findall((text or "").lower())).items():
                at = cuts(w)
                for a, b, piece in zip(at, at[1:], pieces(w), strict=False):
                    s[script(w[a:b])] += n * (b - a)
                    for x in _starting(piece):
                        g[x] += n
        rows = [(lang, what, k, n) for lang, both in by.items() for what, c in zip("gs", both, strict=True) for k, n in c.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "what", "name", "n"]
        )


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, max_grams: int = 60_000) -> LanguageModel:
    """A model of the rows that have a text and a language (see above for the sample)."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    # By a hash, an equal number of each salt, so that no task ranks a whole language.
    draw = F.xxhash64("id", F.lit("language sample"))
    salts = min(64, per_language)
    first = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("draw", "id")) <= per_language // salts
    chosen = rows.select("id", "lang").withColumn("draw", draw).withColumn("salt", F.pmod("draw", F.lit(salts))).withColumn("first", first).where("first")
    chosen = chosen.select("id").distinct()
    sample = rows.join(F.broadcast(chosen), "id", "left_semi")  # at most per_language ids a language
    tally = sample.select("lang", "text").mapInArrow(_tally, "lang string, what string, name string, n long")
    total = Stage(labelled.sparkSession, "language").table(tally.groupBy("lang", "what", "name").agg(F.sum("n").alias("n")))
    sizes = total.where("what = 'g'").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a language
    large = [r["lang"] for r in sizes if r["n"] > max_grams]
    top = total.where((F.col("what") == "s") | ~F.col("lang").isin(large)).collect()  # max_grams and a few rows a language, as below
    for lang in large:
        top += total.where((F.col("what") == "g") & (F.col("lang") == lang)).orderBy(F.desc("n"), "name").limit(max_grams).collect()
    counts: dict[str, dict[str, int]] = {}
    scripts: dict[str, dict[str, int]] = {}
    for r in top:
        counts.setdefault(r["lang"], {})
        scripts.setdefault(r["lang"], {})
        (counts if r["what"] == "g" else scripts)[r["lang"]][r["name"]] = r["n"]
    return LanguageModel(counts, scripts)


SPANS = "array<struct<lang:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_known: dict[str, tuple[dict[str, int], list[np.ndarray]]] = {}


def _places(text: str) -> list[tuple[int, int]]:
    """Starts and ends of the text's words, of long ones those of their pieces, in code points."""
    out = []
    for m in _words.finditer(text):
        if m.end() - m.start() <= LONG_WORD:
            out.append(m.span())
        else:
            out += itertools.pairwise(m.start() + a for a in cuts(m[0]))
    return out


def _found(text: str, words: list[str]) -> list[tuple[int, int]]:
    """As _places, of a text whose words, none of several pieces, are known: each is the next that begins behind the last."""
    out, at = [], 0
    for w in words:
        at = text.index(w, at)
        out.append((at, at := at + len(w)))
    return out


def _spans(places: list[tuple[int, int]], labels: np.ndarray, names: list[str]) -> list[dict]:
    """Runs of one language, from their first word's start to their last word's end, in code points."""
    cut = np.flatnonzero(np.diff(labels)) + 1
    firsts, lasts = [0, *cut.tolist()], [*(cut - 1).tolist(), len(labels) - 1]
    return [{"lang": names[labels[a]], "start": places[a][0], "end": places[b][1]} for a, b in zip(firsts, lasts, strict=True)]


def label(texts: list[str | None], model: LanguageModel) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text."""
    if not model.languages:
        return [("und", 0.0, [])] * len(texts)
    known, table = _known.setdefault(model.uid, ({}, [np.zeros((0, len(model.languages)), np.float32), np.zeros(0, np.int64)]))
    if len(known) > REMEMBERED:
        known.clear()
        table[:] = table[0][:0], table[1][:0]
    found, new, sizes_of_new = [], [], []
    for t in texts:
        # Words are cut in the text as it is, so that spans fit it; lower() may change a text's length.
        words = _words.findall(t) if t else []
        ids, cut = list(map(known.get, words)), False
        if None in ids:
            ids = []
            for w in words:
                i = known.get(w)
                if i is None:
                    # A piece's key has a space, as a word of 42 letters may be like a piece of a longer one.
                    got = pieces(w)
                    cut = cut or len(got) > 1
                    for piece, key in zip(got, [f" {x}" for x in got] if len(got) > 1 else [w], strict=True):
                        if (i := known.get(key)) is None:
                            i = known[key] = len(known)
                            new.append(piece)
                            sizes_of_new.append(len(w))
                        ids.append(i)
                    continue
                ids.append(i)
        found.append((ids, words, cut))
    if new:
        table[:] = np.concatenate((table[0], model.score_pieces(new))), np.concatenate((table[1], np.array(sizes_of_new)))
    sizes = np.array([len(x) for x, _, _ in found])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.fromiter(itertools.chain.from_iterable(x for x, _, _ in found), np.int64, int(offsets[-1]))
    path = viterbi(table[0][ids], offsets, model.penalty)
    letters_of = table[1][ids]
    out = []
    for k, (t, (_, words, cut)) in enumerate(zip(texts, found, strict=True)):
        if not words:
            out.append(("und", 0.0, []))
            continue
        labels, letters = path[offsets[k] : offsets[k + 1]], letters_of[offsets[k] : offsets[k + 1]]
        places = None
        if cut:  # a piece's letters in the text aren't known from its lower case
            places = _places(t)
            letters = np.fromiter((b - a for a, b in places), np.int64, len(places))
        share = np.bincount(labels, weights=letters, minlength=len(model.languages))
        best = int(share.argmax())
        if places is None and share[best] == letters.sum():
            # A word begins with a letter, so it can't be found before the first one, nor after the last word's start.
            spans = [{"lang": model.languages[best], "start": t.find(words[0]), "end": t.rfind(words[-1]) + len(words[-1])}]
        else:
            spans = _spans(places or _found(t, words), labels, model.languages)
        out.append((model.languages[best], float(share[best] / share.sum()), spans))
    return out


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row: id, lang_pred, score, spans: array of (lang, start, end).

    ``keep`` names the columns to pass through in place of the id, so that a filter needs no join.
    """
    kept = keep or [id_col]
    rows = docs.select(*[F.col(c) for c in kept], F.col(text_col).cast("string").alias("text_"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{fields}, lang_pred string, score double, spans {SPANS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                got = label(batch.column(len(kept)).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], _ARROW)],
                    names=[*kept, "lang_pred", "score", "spans"],
                )

    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose id's CRC-32 leaves 1 by 3; null ids aren't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_on_fold(docs: DataFrame, id_col: str = "doc_id") -> LanguageModel:
    """The model learnt from the documents that aren't held out."""
    return fit(docs.where(~held_out(id_col)), id_col)
