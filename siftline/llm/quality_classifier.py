"""Quality by compression: a text is like the kind whose dictionary shortens it more.

Two zstandard raw-content dictionaries hold good and bad labelled text. Each whole text is compressed in pieces with
either, and (size with bad - size with good) / bytes, the normalised difference, becomes a probability by a logistic
curve fitted to labelled texts, each half by dictionaries of the other, weighted back to the labels' true shares.

Learning takes a bounded sample: per class up to SAMPLE labelled texts of up to SAMPLE_CHARS characters, those with the
smallest hashes. Scoring reads every byte. Null and empty texts score as the mean difference; without labels of both
classes the score is the share of good labels (1 if there are none). A doc_id labelled more than once counts once by its
mean label; repeated documents are scored row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import crc32_mod, forget, materialize, table

SAMPLE = 1200
SAMPLE_CHARS = 20_000
DICTIONARY = 1 << 19
PIECE = 1 << 10
#: So many bytes of the labelled texts' mean difference are added to each text: a phrase among few words decides little.
SHORT = 256
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    mean: float = 0.0
    piece: int = PIECE


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes):
    def one(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress

    return one(good), one(bad)


def difference(text: bytes, model: Model) -> float:
    """(size with the bad dictionary - size with the good one) / bytes, drawn to the mean by SHORT bytes."""
    if not text or not model.good:
        return model.mean
    good, bad = _compressors(model.good, model.bad)
    view, total = memoryview(text), 0
    for at in range(0, len(text), model.piece):
        part = view[at : at + model.piece]
        total += len(bad(part)) - len(good(part))
    return (total + SHORT * model.mean) / (len(text) + SHORT)


def score(text: bytes, model: Model) -> float:
    return float(1 / (1 + np.exp(-np.clip(model.slope * difference(text, model) + model.offset, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic curve over the columns of x and a constant, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_mod: int, held_rest: int, sample: int, chars: int) -> tuple[dict[int, list[str]], dict[int, int]]:
    """Texts by class, a bounded sample in hash order, and how many labels each class has.

    Only doc_ids outside the held-out remainder are read; sampling takes whole texts of up to `chars` characters.
    """
    votes = labels.filter(F.col(label).isNotNull() & (crc32_mod("doc_id", held_mod) != held_rest))
    votes = votes.groupBy("doc_id").agg((F.avg(label) > 0.5).cast("int").alias("y"))
    counts = {int(r["y"]): int(r["count"]) for r in votes.groupBy("y").count().collect()}
    usable = F.col("text").isNotNull() & (F.length("text") <= chars)
    found = docs.filter(usable).select("doc_id").join(votes, "doc_id").groupBy("doc_id", "y").agg(F.xxhash64("doc_id").alias("_h"))
    found = materialize(found, "labelled")
    ids = {y: [r["doc_id"] for r in found.filter(F.col("y") == y).orderBy("_h", "doc_id").limit(sample).collect()] for y in (0, 1)}
    forget(found)
    # Only ids are shuffled and sorted; the texts of these few are read by a filter. Of several texts of an id the least counts.
    texts = docs.filter(F.col("doc_id").isin(ids[0] + ids[1]) & usable).groupBy("doc_id").agg(F.min("text").alias("text"))
    held = {r["doc_id"]: r["text"] for r in texts.collect()}
    out = {y: [held[i] for i in ids[y]] for y in (0, 1)}
    return out, counts


def _dictionaries(good: list[bytes], bad: list[bytes]) -> Model:
    """Of either kind as much, up to DICTIONARY bytes."""
    size = min(DICTIONARY, sum(map(len, good)), sum(map(len, bad)))
    return Model(b"\n".join(good)[:size], b"\n".join(bad)[:size], 0.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_mod: int = 4, held_rest: int = 2, sample: int = SAMPLE) -> Model:
    texts, counts = labelled(docs, labels, label, held_mod, held_rest, sample, SAMPLE_CHARS)
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    if min(len(texts[0]), len(texts[1])) < 4:
        share = min(max((n_good + 1e-3) / (n_good + n_bad + 1e-3), 1e-3), 1 - 1e-3)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    halves = {y: ([t.encode() for t in ts[::2]], [t.encode() for t in ts[1::2]]) for y, ts in texts.items()}
    x, y, weight, n_bytes = [], [], [], []
    for own, other in ((0, 1), (1, 0)):  # each half is measured with dictionaries of the other one
        model = _dictionaries(halves[1][own], halves[0][own])
        for label, n in ((0, n_bad), (1, n_good)):
            part = halves[label][other]
            x += [[difference(t, model)] for t in part]
            y += [float(label)] * len(part)
            weight += [n / len(texts[label])] * len(part)
            n_bytes += map(len, part)
    x, weight, n_bytes = np.array(x), np.array(weight) * len(y) / (n_good + n_bad), np.array(n_bytes)
    # x is drawn to 0 so far; the mean over all bytes replaces that 0.
    mean = float((weight * x[:, 0] * (n_bytes + SHORT)).sum() / max(1.0, (weight * n_bytes).sum()))
    x[:, 0] += SHORT * mean / (n_bytes + SHORT)
    slope, offset = logistic(x, np.array(y), weight)
    model = _dictionaries([t.encode() for t in texts[1]], [t.encode() for t in texts[0]])
    return Model(model.good, model.bad, float(slope), float(offset), mean)


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [score(t.as_py() or b"", model) for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _scores(it, model), "doc_id long, score double")


def _kept(batches: Iterator[pa.RecordBatch], model: Model, at: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(at).cast(pa.binary())
        yield batch.filter(pa.array([score(t.as_py() or b"", model) >= least for t in texts], pa.bool_()))


def keep_good(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of docs whose text scores at least `least`, all columns as they are."""
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _kept(it, model, at, least), docs.schema)


def op8_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
