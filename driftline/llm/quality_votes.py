"""Quality classifier: nearest labelled documents vote, weighted by similarity.

Every text becomes a vector of hashed word and word-shape frequencies and of
repetition measures; a latent-semantic projection of labelled vectors gives
``DIMENSIONS`` coordinates. The labelled vectors are broadcast, every document
is compared with all of them by exact cosines in blocks, and the labels of the
``NEIGHBOURS`` nearest (more on a tie) are averaged with weights that grow with
similarity.

Labels are learned from at most ``REFERENCES`` rows, the smallest by a hash of
the id, which bounds what is broadcast at about ``REFERENCES * DIMENSIONS * 4``
bytes. No label, language, source or id is an input of a score.

Defined cases: an empty or null text scores 0; where nothing is labelled every
score is 0.5; labels that are null or not 0 or 1 are not learned from; a
document with several labels counts once for each; repeated rows give one row
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import crc_remainder, slices, texts_of

REFERENCES = 4096
DIMENSIONS = 48
NEIGHBOURS = 25
#: Weight of a neighbour: its cosine to this power.
SHARPNESS = 8
WORD_FEATURES, SHAPE_FEATURES, MEASURES = 768, 248, 8
FEATURES = WORD_FEATURES + SHAPE_FEATURES + MEASURES
#: Shares of the three parts in a vector's squared length.
PART_WEIGHTS = (0.2, 0.5, 0.3)
CACHE_WORDS = 250_000
_SHAPE = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x39 if 0x30 <= b <= 0x39 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+")


class _Places(dict):
    """word -> its places among the word and the shape features, packed into one integer."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_SHAPE))
        found = self[word] = zlib.crc32(word.lower()) % WORD_FEATURES << 16 | zlib.crc32(shape) % SHAPE_FEATURES
        return found


def features(words: list[bytes], places: _Places) -> np.ndarray:
    """The vector of a text's words; all zero for none."""
    out = np.zeros(FEATURES, np.float32)
    if not words:
        return out
    counts = Counter(words)
    at = np.fromiter(map(places.__getitem__, counts), np.int64, len(counts))
    n = np.fromiter(counts.values(), np.float64, len(counts))
    out[:WORD_FEATURES] = np.sqrt(np.bincount(at >> 16, n, minlength=WORD_FEATURES))
    out[WORD_FEATURES:-MEASURES] = np.sqrt(np.bincount(at & 0xFFFF, n, minlength=SHAPE_FEATURES))
    total = len(words)
    adjacent = sum(map(eq, words, words[1:])) / total
    pairs = len(set(zip(words, words[1:]))) / max(1, total - 1)
    top = float(n.max()) / total
    out[-MEASURES:] = [adjacent, 1 - adjacent, 1 - pairs, pairs, top, 1 - top, 0.2 * np.log10(total), 0.5]
    edges = (0, WORD_FEATURES, FEATURES - MEASURES, FEATURES)
    for a, b, weight in zip(edges, edges[1:], PART_WEIGHTS):
        out[a:b] *= np.sqrt(weight) / max(1e-9, float(np.linalg.norm(out[a:b])))
    return out


def vectors(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and each text's features as packed 32-bit floats."""
    schema = docs.select(*keep).schema.add("features", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places()
        for batch in slices(batches):
            packed = [features(t.encode().split(), places).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(packed, pa.binary())], names=[*keep, "features"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


class Model:
    """Labelled latent-semantic vectors and the projection that made them."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        self.labels = labels.astype(np.float32)
        document_share = (sample > 0).mean(axis=0) if len(sample) else np.zeros(FEATURES)
        rarity = np.log((1 + len(sample)) / (1 + document_share * len(sample))) + 1
        rarity[WORD_FEATURES:] = 1
        self.rarity = rarity.astype(np.float32)
        weighted = (sample * self.rarity).astype(np.float64)
        _, axes = np.linalg.eigh(weighted.T @ weighted)
        self.axes = np.ascontiguousarray(axes[:, ::-1][:, :dimensions], np.float32)
        self.references = self.project(sample)

    def project(self, raw: np.ndarray) -> np.ndarray:
        out = (raw * self.rarity) @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, raw: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Similarity-weighted mean label of the nearest references of each row."""
        if not len(self.labels):
            return np.full(len(raw), 0.5)
        cosines = np.maximum(self.project(raw) @ self.references.T, 0)
        k = min(neighbours, len(self.labels))
        least = np.partition(cosines, -k, axis=1)[:, -k : len(self.labels) - k + 1]
        weights = np.where(cosines >= least, cosines.astype(np.float64) ** SHARPNESS, 0)
        total = weights.sum(axis=1)
        votes = np.divide(weights @ self.labels, total, out=np.full(len(raw), 0.5), where=total > 0)
        return np.where(raw.any(axis=1), np.clip(votes, 0, 1), 0.0)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out_remainder: int = 1, references: int = REFERENCES) -> Model:
    """Learn from at most ``references`` labelled rows that are not held out."""
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (crc_remainder("doc_id", modulus) != held_out_remainder))
    chosen = train.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(references)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # A repeated id would exceed the bound, so the same order cuts again.
    rows = vectors(texts, "doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "features").limit(references).select("label", "features").collect()
    sample = np.frombuffer(b"".join(r["features"] for r in rows), np.float32).reshape(-1, FEATURES)
    return Model(sample, np.array([r["label"] for r in rows], np.int64))


def classify(docs: DataFrame, model: Model, *keep: str, score: str = "score") -> DataFrame:
    """The columns ``keep`` of every document and its score, in a column that none of them may be named like."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, voters = _Places(), shared.value
        for batch in slices(batches):
            raw = np.stack([features(t.encode().split(), places) for t in texts_of(batch)]) if batch.num_rows else np.zeros((0, FEATURES), np.float32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(voters.score(raw), pa.float64())], names=[*keep, score])

    columns = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*columns).mapInArrow(run, schema)
