"""Operator 12: a quality classifier of supervised subword embeddings.

A text's features are its words (runs of no white space), their letter n-grams of 3 to 5 code points with the word's
ends marked, and its word pairs; a pair of equal words is one feature whatever the word. Each is hashed to one of
2^bits slots, and a slot has a learned vector. A document is the average of its features' vectors, and a softmax over
the two classes scores it. A vector meets a score only through its product with the output layer, and products of an
average are averages of products, so a prediction adds up one number a feature.

``fit`` learns from a bounded sample: of each class at most ``per_class`` labelled rows, the first of each of 64 salts
by a hash of their ids, whole texts. In each of ``turns`` jobs every shard of the sample runs ``epochs`` passes of
numpy's stochastic gradient descent, a document at a time, from the common vectors, and the shards' vectors are
averaged by the documents they saw; the driver gets that one model. A shard's features are held in its task, at most 2^bits slots a document. Shards
and their order come from hashes of ids, so a fit is repeatable.

Defined cases: null and empty texts have no feature and score as the softmax of the bias; labels other than 0 and 1,
and null ones, are not learned from; a document with both labels teaches both; without labelled rows every score is
0.5; repeated rows each get a row; texts of any length are read whole; an empty table gives no rows. Other columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.llm.common import Stage

N_GRAMS = (3, 4, 5)
#: Odd factors of the hashes; letters and rows that are read at once.
STEP, SPREAD, PAIR = (np.uint64(n) for n in (0x100000001B3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
AT_ONCE, ROWS_AT_ONCE = 4_000_000, 4000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * SPREAD
    return (h ^ (h >> np.uint64(29))) * SPREAD


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(h) >> np.uint64(64 - bits)).astype(np.int64)


def word_features(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of different words: a hash each, the slots of the words and their n-grams, and the number of each slot's word."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - start[owner]
    power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(int(size.max()), STEP))))
    whole = np.add.reduceat(_mixed(code) * power[place], start)
    slots, owners = [_slot(whole, bits)], [np.arange(len(words))]
    rest = size[owner] - place
    h = code
    for n in range(2, max(N_GRAMS) + 1):
        h = h[:-1] * STEP + code[n - 1 :]
        if n in N_GRAMS:
            inside = np.flatnonzero(rest[: len(h)] >= n)
            slots.append(_slot(h[inside] + np.uint64(n), bits))
            owners.append(owner[inside])
    return whole, np.concatenate(slots), np.concatenate(owners)


def read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The texts' words as numbers of the different words, each text's number of words, and the different words."""
    parts = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat = parts.flatten()
    text = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)[full]
    return ids, np.bincount(text[full], minlength=len(parts)), coded.dictionary.to_pylist()


def pair_features(ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the word pairs of each text, and their texts."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    a, b = ids[:-1], ids[1:]
    same_text = np.flatnonzero(text[:-1] == text[1:])
    a, b = a[same_text], b[same_text]
    return _slot(np.where(a == b, PAIR, hashes[a] * PAIR + hashes[b]), bits), text[same_text]


def features(texts: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its different slots, and how often each occurs."""
    ids, sizes, words = read(texts)
    hashes, slots, owner = word_features(words, bits)
    order = np.argsort(owner, kind="stable")
    slots, count = slots[order], np.bincount(owner, minlength=len(words))
    first = np.concatenate(([0], np.cumsum(count)))
    pairs, text = pair_features(ids, sizes, hashes, bits)
    word_end, pair_end = np.cumsum(sizes), np.cumsum(np.bincount(text, minlength=len(sizes)))
    out = []
    for i in range(len(sizes)):
        used, times = np.unique(ids[word_end[i] - sizes[i] : word_end[i]], return_counts=True)
        own = np.concatenate([slots[first[w] : first[w + 1]] for w in used]) if len(used) else np.zeros(0, np.int64)
        pair = pairs[pair_end[i - 1] if i else 0 : pair_end[i]]
        slot, at = np.unique(np.concatenate((own, pair)), return_inverse=True)
        weight = np.concatenate((np.repeat(times, count[used]) if len(used) else np.zeros(0), np.ones(len(pair))))
        n = np.bincount(at, weights=weight, minlength=len(slot)).astype(np.int64)
        out.append((slot.astype(np.int32), n.astype(np.min_scalar_type(int(n.max())) if len(n) else np.uint8)))
    return out


class QualityModel:
    """``vectors``: slots x size; ``output``: size x 2; ``bias``: 2."""

    def __init__(self, bits: int = 16, size: int = 8, seed: int = 12):
        self.bits = bits
        self.vectors = np.random.default_rng(seed).uniform(-1 / size, 1 / size, (1 << bits, size)).astype(np.float32)
        self.output, self.bias = np.zeros((size, 2)), np.zeros(2)

    def learn(self, docs: list[tuple[np.ndarray, np.ndarray, int]], rate: float, rng: np.random.Generator) -> None:
        """One pass of gradient descent over (slots, times, class), a document a step, in random order."""
        for i in rng.permutation(len(docs)):
            slots, times, wanted = docs[i]
            share = (times / max(times.sum(), 1.0)).astype(np.float32)
            rows = self.vectors[slots]
            mean = (share @ rows).astype(np.float64) if len(slots) else np.zeros(self.output.shape[0])
            z = mean @ self.output + self.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[wanted] -= 1.0
            back = self.output @ p
            self.output -= rate * np.outer(mean, p)
            self.bias -= rate * p
            if len(slots):
                # The step of a vector goes by its share of the document, on the scale of the greatest share.
                self.vectors[slots] = rows - (rate * (share / share.max()))[:, None] * back.astype(np.float32)

    def products(self) -> tuple[np.ndarray, float]:
        """What each slot adds to the log-odds of class 1, and the bias."""
        return self.vectors.astype(np.float64) @ (self.output[:, 1] - self.output[:, 0]), float(self.bias[1] - self.bias[0])


def scores(texts: pa.Array, gain: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """The probability of class 1 of each text."""
    ids, sizes, words = read(texts)
    hashes, slots, owner = word_features(words, bits)
    word_gain, word_count = np.bincount(owner, weights=gain[slots], minlength=len(words)), np.bincount(owner, minlength=len(words))
    text = np.repeat(np.arange(len(sizes)), sizes)
    pairs, pair_text = pair_features(ids, sizes, hashes, bits)
    total = np.bincount(text, weights=word_gain[ids], minlength=len(sizes)) + np.bincount(pair_text, weights=gain[pairs], minlength=len(sizes))
    n = np.bincount(text, weights=word_count[ids], minlength=len(sizes)) + np.bincount(pair_text, minlength=len(sizes))
    return 1.0 / (1.0 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -700, 700)))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of parts of the rows that are read at once; a long text is a part of its own at most."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_ONCE))
        end = min(max(end, at + 1), at + ROWS_AT_ONCE, len(texts))
        yield at, end
        at = end


def _sampled(labelled: DataFrame, per_class: int) -> DataFrame:
    """(id, wanted): of each class an equal number of each salt of a hash of the ids, so no task ranks a whole class."""
    salts = min(64, per_class)
    rows = labelled.where("wanted IN (0, 1) AND id IS NOT NULL").distinct().withColumn("draw", F.xxhash64("id", F.lit("quality sample")))
    rank = F.row_number().over(Window.partitionBy("wanted", "salt").orderBy("draw", "id"))
    return rows.withColumn("salt", F.pmod("draw", F.lit(salts))).withColumn("rank", rank).where(F.col("rank") <= per_class // salts).select("id", "wanted")


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 3000, turns: int = 3, epochs: int = 4, shards: int = 8,
    rate: float = 0.5, bits: int = 16, size: int = 8, seed: int = 12,
) -> QualityModel:
    """A model of the labelled documents; which rows it may learn from is the caller's to choose."""
    model = QualityModel(bits, size, seed)
    stage = Stage(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("wanted"))
    # Labels may name documents that the caller has taken out, which mustn't use up the sample.
    chosen = stage.table(_sampled(labelled.join(rows.select("id").distinct(), "id", "left_semi"), per_class))
    shard = F.pmod(F.xxhash64("id", F.lit("quality shard")), F.lit(shards)).cast("int")
    sample = rows.join(F.broadcast(chosen), "id")  # at most 2 * per_class ids
    sample = stage.table(sample.select(shard.alias("shard"), F.xxhash64("id", "text", F.lit("quality order")).alias("draw"), "wanted", "text"))

    def pass_of(turn: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, number = pdf.sort_values(["draw", "wanted"]), int(pdf["shard"].iloc[0])
            texts = pa.array(pdf["text"], pa.string())
            docs = [f for a, b in slices(texts) for f in features(texts.slice(a, b - a), bits)]
            docs = [(slot, n, int(y)) for (slot, n), y in zip(docs, pdf["wanted"], strict=True)]
            mine = QualityModel(bits, size, seed)
            mine.vectors, mine.output, mine.bias = now[0].copy(), now[1].copy(), now[2].copy()
            rng = np.random.default_rng((seed, turn, number))
            for epoch in range(epochs):
                mine.learn(docs, rate * (1 - (turn * epochs + epoch) / (turns * epochs)), rng)
            return pd.DataFrame({"shard": [number], "n": [len(docs)], "vectors": [mine.vectors.tobytes()], "output": [np.vstack((mine.output, mine.bias)).tobytes()]})

        now = (model.vectors, model.output, model.bias)
        return run

    def averaged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        share = pdf["n"] / pdf["n"].sum()
        vectors = sum(np.frombuffer(v, np.float32) * np.float32(n) for v, n in zip(pdf["vectors"], share, strict=True))
        output = sum(np.frombuffer(o) * n for o, n in zip(pdf["output"], share, strict=True))
        return pd.DataFrame({"vectors": [vectors.tobytes()], "output": [output.tobytes()]})

    for turn in range(turns):
        trained = sample.groupBy("shard").applyInPandas(pass_of(turn), "shard int, n long, vectors binary, output binary")
        got = trained.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(averaged, "vectors binary, output binary").first()  # of one model a shard
        if got is None:
            break
        model.vectors = np.frombuffer(got["vectors"], np.float32).reshape(1 << bits, size)
        last = np.frombuffer(got["output"]).reshape(size + 1, 2)
        model.output, model.bias = last[:-1], last[-1]
    return model


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row: id, score (0 to 1, of class 1), predicted (int). ``keep`` names the columns to pass through in place of the id."""
    kept = keep or [id_col]
    rows = docs.select(*[F.col(c) for c in kept], F.col(text_col).cast("string").alias("text_"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    gain, bias = model.products()
    bits = model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            got = [scores(texts.slice(a, b - a), gain, bias, bits) for a, b in slices(texts)]
            p = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return rows.mapInArrow(run, f"{fields}, score double, predicted int")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose id's CRC-32 leaves 1 by 3; null ids aren't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_on_fold(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """The model learnt from the labelled documents that aren't held out."""
    return fit(docs.where(~held_out()), labels.where(~held_out()))
