"""Document quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.blocks import column_bytes, sliced
from shelfwise.llm.shared import settled

BUCKETS = 2048
LENGTHS = 32
LEVELS = 16
SHAPE = 20.0
DIMENSIONS = 64
SAMPLE = 4096
NEIGHBOURS = 31
SHARPNESS = 8
THRESHOLD = 0.3
_COLUMNS = BUCKETS + LENGTHS + LEVELS


def _novelty(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document the share of distinct ones among all its 8-byte strings, 1 where it has none."""
    n = len(offsets) - 1
    if len(data) < 8:
        return np.ones(n)
    grams = data.astype(np.uint64)
    for size in (1, 2, 4):
        grams = grams[:-size] | grams[size:] << np.uint64(8 * size)
    total = np.maximum(np.diff(offsets) - 7, 0)  # strings that run over a document's end are left where they are
    held = np.flatnonzero(total)
    start = offsets[:-1][held]
    end = start + total[held]
    for a, b in zip(start.tolist(), end.tolist()):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[start] = True
    before = np.concatenate([[0], np.cumsum(new)])
    out = np.ones(n)
    out[held] = (before[end] - before[start]) / total[held]
    return out


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document the counts of its hashed byte trigrams."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    if len(data) < 3:
        return np.zeros((n, BUCKETS), np.int64)
    wide = data.astype(np.uint32)
    grams = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    cell = np.repeat(np.arange(n) * BUCKETS, sizes)[:-2]
    cell += (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)
    across = np.unique(np.concatenate([offsets[1:] - 1, offsets[1:] - 2]))  # these run over a document's end
    cell[across[(across >= 0) & (across < len(cell))]] = n * BUCKETS
    return np.bincount(cell, minlength=n * BUCKETS)[: n * BUCKETS].reshape(n, BUCKETS)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document the logarithms of its trigrams' counts, and its shape: length to a power of two, and each level that novelty falls short of."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, _COLUMNS), np.float32)
    out[:, :BUCKETS] = np.log1p(_trigrams(data, offsets), dtype=np.float32)
    out[np.arange(n), BUCKETS + np.minimum(np.log2(sizes + 1).astype(int), LENGTHS - 1)] = 1
    level = np.minimum(_novelty(data, offsets) * LEVELS, LEVELS - 1).astype(int)
    out[:, BUCKETS + LENGTHS :] = SHAPE * (np.arange(LEVELS) > level[:, None])
    return out


def _blocks(column: pa.Array, made=features) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = column_bytes(column)
    for a, b in sliced(offsets, 1 << 20):
        for c in range(a, b, 1024):
            d = min(b, c + 1024)
            yield c, d, made(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: its documents, and how many of them hold each trigram bucket."""
    total, held = 0, np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, counts in _blocks(batch.column(0), _trigrams):
            total += len(counts)
            held += np.count_nonzero(counts, axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([held.tolist()], pa.list_(pa.int64()))], ["n", "held"])


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, counts in _blocks(batch.column(1)):
            rows = [r.tobytes() for r in counts]
            named = [batch.column(j).slice(a, b - a) for j in (0, 2)]
            yield pa.RecordBatch.from_arrays([*named, pa.array(rows, pa.binary())], ["label", "id", "row"])


@dataclass
class Voters:
    """Weights of the columns, their latent directions, and the labelled vectors in them."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, logs: np.ndarray) -> np.ndarray:
        """Unit vectors; a row without any weight stays zero."""
        x = (logs * self.weights) @ self.directions
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, logs: np.ndarray) -> np.ndarray:
        """Labels of the nearest by cosine, each weighted by a power of its similarity; the labels' mean where none is similar.

        The products with all labelled vectors are exact; ties at the rim fall to the first in the table.
        """
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(logs), prior)
        near = self.latent(logs) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1), prior)


def _leading(x: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of the unit rows of ``x``, by subspace iteration from a fixed start."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    q = np.random.default_rng(3).standard_normal((x.shape[1], DIMENSIONS + 16)).astype(np.float32)
    for _ in range(8):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, turned = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ turned.T)[:, :DIMENSIONS])


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Voters:
    """Latent directions and labelled vectors from ``sample`` labelled documents; column weights from all documents.

    ``docs`` (id, text), ``labels`` (id, label 0 or 1). The sample holds the labelled documents whose
    ids have the smallest hashes, those of one id by their features, so it is the same in every
    run. A trigram bucket's weight is 1 + log(N / df).
    """
    spread = docs.select("text").mapInArrow(_document_frequencies, "n long, held array<long>")
    spread = settled(spread)
    total = spread.agg(F.sum("n")).first()[0] or 0
    by_column = spread.select(F.posexplode("held").alias("column", "n")).groupBy("column").agg(F.sum("n").alias("n"))
    held = np.zeros(BUCKETS)
    for row in by_column.collect():  # one number for each of the fixed buckets
        held[row["column"]] = row["n"]
    weights = np.ones(_COLUMNS, np.float32)
    weights[:BUCKETS] = np.where(held > 0, 1 + np.log(max(total, 1) / np.maximum(held, 1)), 0)
    chosen = labels.filter("id is not null and label is not null").distinct().orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    counted = docs.join(F.broadcast(chosen), "id").select("label", "text", "id").mapInArrow(_sample_counts, "label long, id long, row binary")
    rows = counted.orderBy(F.xxhash64("id"), "id", "label", "row").limit(sample).collect()
    if not rows:
        return Voters(weights, np.zeros((_COLUMNS, DIMENSIONS), np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    logs = np.stack([np.frombuffer(r["row"], np.float32) for r in rows])
    voters = Voters(weights, _leading(logs * weights), np.zeros((0, DIMENSIONS), np.float32), np.array([r["label"] for r in rows], np.float64))
    voters.vectors = voters.latent(logs).astype(np.float32)
    return voters


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for batch in batches:
            for a, b, counts in _blocks(batch.column(1)):
                score = np.clip(voters.score(counts), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score.round(6))], ["id", "score"])

    return run


def held_out(id: Column) -> Column:
    """Rows never learned from: crc32 of the id's digits is divisible by 5."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, held_out, score, predicted): how likely label 1 is, for every document's whole text.

    Byte trigrams are hashed, counted, damped by a logarithm, weighted by their rarity in all
    documents and projected on the leading directions of a labelled sample of ``sample`` rows (the
    only bound; ids with crc32 divisible by 5 are never in it). The sample's vectors go to all
    tasks (``sample`` x 64 numbers); each document is compared with every one of them in blocks.

    Defined cases: null and empty texts have their length as only feature and are scored by it;
    rows that repeat an id are scored each; a row without id is scored and not held out; labelled
    ids without a document, null labels and other columns are ignored; without labels all score 0.5.
    """
    slim = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    known = labels.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label")).filter(~held_out(F.col("id")))
    shared = docs.sparkSession.sparkContext.broadcast(fit(slim, known, sample=sample))
    scores = slim.mapInArrow(_scored(shared), "id long, score double")
    return scores.select(
        F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
