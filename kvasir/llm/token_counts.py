"""Operator 5: word-piece token counts by a linear longest-match automaton.

The vocabulary's trie has failure links: where no child matches, the link leads to the state reached after
the longest piece of what was read is taken, and the number of pieces taken on the way is precomputed. So
a word's greedy longest-match piece count takes one pass and no piece is ever built.

The vocabulary is a public byte-level one: words carry their leading space, so word-initial pieces are
those with a space, and each single byte is a piece, so every text has a count. For vocabularies without
that, a word with no match counts as one unknown piece.

Defined cases: null and empty texts have no tokens; a word or text of any length is read whole in linear
time; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the vocabulary's public pre-token pattern.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED, LONG_WORD = 500_000, 64


class Automaton:
    def __init__(self, pieces: Iterable[bytes]):
        self.child: dict[int, int] = {}
        ends, child = [False], self.child
        order: list[tuple[int, int, int]] = []  # (node, parent, byte)
        for piece in sorted(set(pieces), key=lambda p: (len(p), p)):
            node = 0
            for c in piece:
                key = node << 8 | c
                if key not in child:
                    child[key] = len(ends)
                    order.append((len(ends), node, c))
                    ends.append(False)
                node = child[key]
            ends[node] = node != 0
        depth = [0] * len(ends)
        for node, parent, _ in order:
            depth[node] = depth[parent] + 1
        #: The link of each node (-1: none) and the number of pieces taken by following it.
        self.link, self.taken = [-1] * len(ends), [0] * len(ends)
        for node, parent, c in sorted(order, key=lambda x: depth[x[0]]):
            if ends[node]:
                self.link[node], self.taken[node] = 0, 1
                continue
            at, taken = self.link[parent], self.taken[parent]
            while at >= 0 and at << 8 | c not in child:
                taken += self.taken[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.taken[node] = child[at << 8 | c], taken

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match segmentation; 1 where there is none."""
        child, link, taken = self.child, self.link, self.taken
        node = n = 0
        for c in word:
            while (to := child.get(node << 8 | c)) is None:
                if link[node] < 0:
                    return 1
                n += taken[node]
                node = link[node]
            node = to
        while node:
            if link[node] < 0:
                return 1
            n += taken[node]
            node = link[node]
        return n


_loaded: dict[str, tuple] = {}


def load(path: str) -> tuple:
    """(automaton, remembered counts) of a local vocabulary file of base64 pieces and ranks."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = (Automaton(base64.b64decode(line.split()[0]) for line in f if line.strip()), {})
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row: id, n_words (pre-tokens), n_tokens (word pieces), both long.

    ``keep`` names the columns to pass through in place of the id.
    """
    kept = keep or [id_col]
    columns = [c for c in kept if c != text_col]
    rows = docs.select(*columns, F.col(text_col).cast("string").alias(text_col))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", n_words long, n_tokens long"
    at = [rows.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = load(vocabulary_path)
        words = regex.compile(WORDS).findall
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(len(columns)):
                found = words(text.as_py() or "")
                total = 0
                for w in found:
                    n = known.get(w)
                    if n is None:
                        n = automaton.count(w.encode())
                        if len(w) <= LONG_WORD:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[w] = n
                    total += n
                n_words.append(len(found))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*kept, "n_words", "n_tokens"])

    return rows.mapInArrow(run, schema)
