"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms: its words (hashed), the shapes of its words (runs of capitals, small letters,
digits and each punctuation mark, hashed) and how often words repeat the one before. Weights are logarithmic
counts times inverse document frequency; words, shapes and repetition are each scaled to length one, so that
style counts as much as wording. A truncated singular value decomposition of a bounded, labelled sample
gives the latent directions.

The labelled sample's unit vectors (at most ``sample`` x ``rank`` floats) are broadcast. Every document is
projected and multiplied with all of them, exactly, in blocks; its ``neighbours`` most similar labelled
vectors vote with their similarity as weight, together with a small vote for the sample's mean label.

The sample is bounded by ``sample`` (documented parameter); it takes the labelled rows of least hash, and
never held-out ones. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts have no terms and get the sample's mean label as score; without any
label the mean is 0.5; a document labelled more than once counts once for each label row; of rows with one id and
different texts the least text is learnt from; a null id is never held out nor labelled; repeated rows are scored each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, SHAPES, REPEATS = 1536, 500, 12
TERMS = WORDS + SHAPES + REPEATS
#: Terms that a task remembers before it starts anew.
REMEMBER = 500_000
RUNS = re.compile(rb"([A-Z]+)|([a-z\x80-\xff]+)|([0-9]+)|([^A-Za-z0-9\x80-\xff])")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Terms(dict):
    """Packed term numbers of words: the word's place and its shape's."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        shape = RUNS.sub(lambda m: b"A" if m[1] else b"a" if m[2] else b"0" if m[3] else m[4], word)
        self[word] = n = (xxhash.xxh3_64_intdigest(word.lower()) % WORDS) << 16 | (WORDS + xxhash.xxh3_64_intdigest(shape) % SHAPES)
        return n


def term_counts(texts: list[bytes], terms: Terms) -> np.ndarray:
    """Counts (texts x TERMS) of whole texts; the last columns say which share of words repeats the one before."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        packed = np.fromiter(map(terms.__getitem__, words), np.int64, len(words))
        out[i, :WORDS + SHAPES] = np.bincount(packed >> 16, minlength=WORDS + SHAPES) + np.bincount(packed & 0xFFFF, minlength=WORDS + SHAPES)
        share = (packed[1:] == packed[:-1]).mean() if len(words) > 1 else 0.0
        distinct = len(np.unique(packed)) / min(len(words), WORDS)
        out[i, WORDS + SHAPES + int(share * 5.999)] = 1
        out[i, WORDS + SHAPES + 6 + int(min(distinct, 1.0) * 5.999)] = 1
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic counts times idf, each part scaled to length one."""
    x = np.log1p(counts) * idf
    for a, b in ((0, WORDS), (WORDS, WORDS + SHAPES), (WORDS + SHAPES, TERMS)):
        part = x[:, a:b]
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class LatentModel:
    """idf, latent directions, unit vectors and labels of the sample."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        x = weighted(counts, self.idf)
        # right singular vectors, from the terms' Gram matrix
        values, vectors = np.linalg.eigh(x.T @ x)
        self.directions = np.ascontiguousarray(vectors[:, np.argsort(values)[::-1][:rank]], np.float32)
        self.vectors = unit(x @ self.directions).astype(np.float32)

    def scores(self, counts: np.ndarray, neighbours: int, trust: float) -> np.ndarray:
        n = min(neighbours, len(self.labels))
        if not n:
            return np.full(len(counts), self.prior)
        empty = counts.sum(axis=1) == 0
        cosine = unit(weighted(counts, self.idf) @ self.directions) @ self.vectors.T
        # to five digits, and of equal ones the first of the sample: ties are the same in every block
        rank = np.rint(cosine * -1e5).astype(np.int64) * len(self.labels) + np.arange(len(self.labels))
        nearest = np.argpartition(rank, n - 1, axis=1)[:, :n]
        weight = np.maximum(np.take_along_axis(cosine, nearest, axis=1), 0.0)
        weight[empty] = 0
        votes = (weight * self.labels[nearest]).sum(axis=1)
        return np.clip((votes + trust * self.prior) / (weight.sum(axis=1) + trust), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4096, rank: int = 64) -> LatentModel:
    """Learn from at most ``sample`` labelled documents that aren't held out."""
    chosen = (
        labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).select("doc_id", "quality")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = term_counts([(text.as_py() or "").encode()], terms)[0]
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([at.astype(np.int32).tobytes()]), pa.array([counts[at].tobytes()])], names=["label", "at", "n"])

    # the sample is bounded, so its ids may be broadcast and its term counts may come to the driver
    chosen = chosen.withColumn("n", F.monotonically_increasing_id())
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("n", "quality").agg(F.min("text").alias("text")).select(F.col("quality").cast("int"), "text")
    rows = known.mapInArrow(count, "label int, at binary, n binary").collect()
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.float32)
    order = np.lexsort((counts @ np.arange(TERMS), [r["label"] for r in rows])) if rows else []
    return LatentModel(counts[order], np.array([r["label"] for r in rows], np.float32)[order] if rows else np.zeros(0), rank)


def score_quality(docs: DataFrame, model: LatentModel, neighbours: int = 15, trust: float = 0.25, block: int = 256) -> DataFrame:
    """(doc_id, text_key, score), one row per row of ``docs``; ``text_key`` is ``xxhash64(text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays: broadcasts aren't pickled by value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, model = Terms(), LatentModel.__new__(LatentModel)
        vars(model).update(shared.value)
        for batch in batches:
            ids, keys, texts = batch.columns
            for first in range(0, len(texts), block):
                part = [(t.as_py() or "").encode() for t in texts.slice(first, block)]
                score = model.scores(term_counts(part, terms), neighbours, trust)
                yield pa.RecordBatch.from_arrays([ids.slice(first, block), keys.slice(first, block), pa.array(score.astype(np.float64))], names=["doc_id", "text_key", "score"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, score double")


def classify(docs: DataFrame, labels: DataFrame, train: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    scored = score_quality(docs, fit(docs if train is None else train, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns; a row is accepted by its id and its text, since ids may repeat."""
    kept = score_quality(docs, fit(docs, labels)).where(F.col("score") >= threshold).select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    return docs.join(kept, (F.xxhash64(docs["text"]) == kept["kept_key"]) & docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
