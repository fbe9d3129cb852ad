"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks, trained on labelled sentences.

The kernel of two strings sums, over all subsequences of ORDER characters that both hold, DECAY to the power of the
lengths they span: gaps and inserted characters lower it, but do not break it. It is taken between units of a sentence and
landmarks. Units are the sentence's words as lower-case letters only (punctuation and digits inside a word are dropped,
runs of single letters are joined), in pieces of up to UNIT bytes that overlap by half, and its neighbouring words written as
one: two of up to UNIT - 1 letters together, or three of up to 4 letters each, so that a gap may cross a space. A normalised kernel
counts from LEAST on, if unit and landmark have a common subsequence of at least SHARE of the landmark, else it is 0.

Landmarks are words of labelled texts and their stems, of either class: those whose share of toxic texts differs from that of the
others by CONTRAST standard errors, taken in turn by how much they differ and how little the landmarks so far span them (a pivoted
Cholesky decomposition of the kernel matrix). A sentence's features are its units' largest normalised kernels with
each landmark, whitened by the landmarks' own matrix. A linear SVM (squared hinge) is trained on sentences in a few rounds: for each toxic
labelled text its sentence with the largest decision and all with a positive one, against the other texts' sentences with the
largest; toxic ones also train with an inserted character.
A text's score is a logistic curve over its largest decision and the number of positive ones, fitted to labelled texts.

Learning takes a bounded sample: per class up to SAMPLE labelled texts of up to 20,000 characters by smallest hash. Scoring
reads whole texts. The result is a function of the rows alone: all orders are fixed. Null and empty texts have no units and score
lowest; without labels of both classes the score is the share of toxic labels (0 if there are none). Repeated rows are scored row
by row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import crc32_mod, table
from siftline.llm.quality_classifier import labelled, logistic

ORDER = 3
DECAY = 0.7
UNIT = 11
SHARE = 0.8
LEAST = 0.4
LANDMARKS = 40
CONTRAST = 4.5
CANDIDATES = 400
SAMPLE = 1500
CACHE = 1 << 19
_BLOCK = 1 << 13
#: Between sentences; no text holds it after control characters are dropped but as a mark.
END = b"\1"
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or b == 1 else 32 for b in range(256))
_DROP = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122 or b in (1, 32) or 9 <= b <= 13))
_SPELLED = re.compile(rb"(?<!\S)(?:[a-z] ){2,}[a-z](?!\S)")
_SENTENCE = re.compile(rb"[.!?]+\s+|\n+")


def words(text: bytes) -> list[bytes]:
    """Words as letters only, END between sentences; letters one at a time count as one word."""
    found = _SENTENCE.sub(b" \1 ", text.replace(END, b" ")).translate(_KEEP, _DROP).split()
    if sum(map((1).__eq__, map(len, found))) >= 3:
        found = _SPELLED.sub(lambda m: m.group().replace(b" ", b""), b" ".join(found)).split()
    return found


def _pieces(word: bytes) -> list[bytes]:
    """The word behind a mark of its start; a long one in pieces."""
    w = b"^" + word
    return [w] if len(w) <= UNIT else [w[at : at + UNIT] for at in range(0, len(w) - UNIT // 2, UNIT // 2)]


def units(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct units, unit, sentence, text of each sentence): the units of all places, made once for all texts."""
    found = [words(t) for t in texts]
    tokens = [w for f in found for w in (END, *f)]
    distinct = list(dict.fromkeys([END, *tokens]))
    n = len(distinct)
    number = dict(zip(distinct, range(n), strict=True))
    flat = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    sentence = np.cumsum(flat == 0) - 1
    text = np.repeat(np.arange(len(found)), [len(f) + 1 for f in found])[flat == 0]
    size = np.array(list(map(len, distinct)))
    pieces = [[], *map(_pieces, distinct[1:])]
    first = np.cumsum([0, *map(len, pieces)])
    strings, unit, place = [p for ps in pieces for p in ps], [], []
    there = np.flatnonzero(flat)
    for k in range(max(map(len, pieces))):
        held = there[first[flat[there] + 1] - first[flat[there]] > k]
        unit.append(first[flat[held]] + k), place.append(sentence[held])
    for width in (2, 3):
        parts = [flat[k : max(0, len(flat) - width + 1) + k] for k in range(width)]
        ok = np.logical_and.reduce([p > 0 for p in parts]) & (sum(size[p] for p in parts) < UNIT)
        if width == 3:
            ok &= np.logical_and.reduce([size[p] <= 4 for p in parts])
        codes, to = np.unique(sum(p[ok] * n**k for k, p in enumerate(parts)), return_inverse=True)
        unit.append(to + len(strings)), place.append(sentence[: len(ok)][ok])
        columns = [[distinct[c] for c in (codes // n**k % n).tolist()] for k in range(width)]
        strings += [b"^" + b"".join(x) for x in zip(*columns, strict=True)]
    return strings, np.concatenate(unit), np.concatenate(place), text


def _padded(strings: list[bytes]) -> np.ndarray:
    width = max(map(len, strings), default=0) or 1
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def _paired(s: np.ndarray, t: np.ndarray, order: int, decay: float) -> np.ndarray:
    """The kernel of each row of s with the same row of t; rows are padded with zeros."""
    n, width = len(s), t.shape[1]
    out, square, decay = np.zeros(n, np.float32), np.float32(decay * decay), np.float32(decay)
    # inner[i][j]: subsequences of length i within s so far and the first j characters of t, weighted by the distance to both ends
    inner = [np.zeros((width, n), np.float32) for _ in range(order)]
    inner[0][:] = 1
    for c in range(s.shape[1]):
        same = np.where((s[:, c] == t.T) & (s[:, c] > 0), square, np.float32(0))
        out += (same * inner[order - 1]).sum(axis=0)
        for i in range(order - 1, 0, -1):
            run = np.zeros(n, np.float32)
            for j in range(width):
                inner[i][j] = inner[i][j] * decay + run
                run = run * decay + same[j] * inner[i - 1][j]
    return out


def kernels(strings: list[bytes], landmarks: list[bytes], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The subsequence kernel of each string with each landmark."""
    s, t = _padded(strings), _padded(landmarks)
    return _paired(np.repeat(s, len(t), axis=0), np.tile(t, (len(s), 1)), order, decay).reshape(len(s), len(t))


def own_kernel(strings: list[bytes]) -> np.ndarray:
    s = _padded(strings)
    return _paired(s, s, ORDER, DECAY)


def _common(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of each row of s with each of t, by bits: one addition a character."""
    masks = np.zeros((256, len(t)), np.uint16)  # UNIT bits and a carry
    for j in range(t.shape[1]):
        masks[t[:, j], np.arange(len(t))] |= np.uint16(1 << j)
    masks[0] = 0
    v = np.full((len(s), len(t)), (1 << t.shape[1]) - 1, np.uint16)
    for c in range(s.shape[1]):
        m = masks[s[:, c]]
        v = (v + (v & m)) | (v & ~m)
    return t.shape[1] - np.bitwise_count(v & np.uint16((1 << t.shape[1]) - 1)).astype(np.int64)


def matched(strings: list[bytes], landmarks: tuple[bytes, ...], own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, landmark, normalised kernel) of the kernels that count, by string."""
    t = _padded(list(landmarks))
    least = np.ceil(SHARE * np.array(list(map(len, landmarks)))).astype(np.int64)
    rows, cols, values = [], [], []
    for at in range(0, len(strings), _BLOCK):
        s = _padded(strings[at : at + _BLOCK])
        i, j = np.nonzero(_common(s, t) >= least)
        if len(i):
            u, to = np.unique(i, return_inverse=True)
            self_ = _paired(s[u], s[u], ORDER, DECAY)[to]
            rows.append(i + at), cols.append(j)
            values.append(_paired(s[i], t[j], ORDER, DECAY) / np.sqrt(np.maximum(self_, 1e-9) * own[j]))
            held = values[-1] >= LEAST
            rows[-1], cols[-1], values[-1] = rows[-1][held], cols[-1][held], values[-1][held]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in (rows, cols, values))


@dataclass(frozen=True)
class Model:
    landmarks: tuple[bytes, ...]
    own: np.ndarray  # the landmarks' kernels with themselves
    weights: np.ndarray  # of features: SVM weights times the Nyström whitening
    offset: float
    curve: tuple[float, float, float]  # of the largest decision, log of positive sentences, constant
    share: float
    key: str = ""


#: What a worker process knows of units: those without a kernel that counts, and the others' kernels. Emptied when full.
_known: dict[str, tuple[set[bytes], dict[bytes, tuple[np.ndarray, np.ndarray]]]] = {}


def _learn(strings: list[bytes], model: Model) -> dict[bytes, tuple[np.ndarray, np.ndarray]]:
    """The kernels that count of the units that have any; those not known yet are looked up."""
    none, some = _known.setdefault(model.key, (set(), {}))
    if len(none) + len(some) > CACHE:
        none.clear(), some.clear()
    new = [s for s in dict.fromkeys(strings) if s not in none and s not in some]
    rows, cols, values = matched(new, model.landmarks, model.own)
    edges = np.searchsorted(rows, np.arange(len(new) + 1))
    for r in np.unique(rows).tolist():
        some[new[r]] = cols[edges[r] : edges[r + 1]], values[edges[r] : edges[r + 1]]
    none.update(s for s in new if s not in some)
    return some


def sentence_features(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(text, features) of each sentence with kernels that count: the largest of its units with each landmark."""
    strings, unit, place, text = units(texts)
    some = _learn(strings, model)
    hit = np.fromiter((s in some for s in strings), bool, len(strings))
    held = hit[unit]
    unit, place = unit[held], place[held]
    which, row = np.unique(place, return_inverse=True)
    x = np.zeros((len(which), len(model.landmarks)), np.float32)
    found = {u: some[strings[u]] for u in np.unique(unit).tolist()}
    for u, r in zip(unit.tolist(), row.tolist(), strict=True):
        cols, values = found[u]
        x[r, cols] = np.maximum(x[r, cols], values)
    return text[which], x


def _features(text: np.ndarray, x: np.ndarray, n: int, model: Model) -> np.ndarray:
    """The largest decision of each of n texts and log(1 + positive sentences), from the features of their sentences; a sentence without
    kernels that count has the offset."""
    out = np.tile([model.offset, 0.0], (n, 1))
    d = np.round(x.astype(np.float64) @ model.weights + model.offset, 6)
    np.maximum.at(out[:, 0], text, d)
    out[:, 1] = np.log1p(np.bincount(text[d > 0], minlength=n))
    return out


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    if not model.landmarks:
        return np.full(len(texts), model.share)
    x = _features(*sentence_features(texts, model), len(texts), model)
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.curve[:2]) + model.curve[2], -30, 30)))


def starts(text: bytes) -> set[bytes]:
    """Words of 4 letters or more, and their first 4 to UNIT - 1 letters, behind the mark of the start."""
    found = {w for w in words(text) if len(w) >= 4}  # END is shorter
    return {b"^" + w[:n] for w in found for n in range(4, min(len(w), UNIT - 1) + 1)}


def choose(toxic: list[bytes], other: list[bytes], most: int = LANDMARKS) -> tuple[tuple[bytes, ...], np.ndarray]:
    """(landmarks, contrast of each): words or stems whose share of texts differs between the classes."""
    held = [Counter(p for t in ts for p in starts(t)) for ts in (other, toxic)]
    n0, n1 = len(other), len(toxic)
    names = [w for w in held[0].keys() | held[1].keys() if held[0][w] + held[1][w] >= 3]
    k0, k1 = (np.array([h[w] for w in names], np.float64) for h in held)
    p = (k0 + k1) / (n0 + n1)
    z = (k1 / n1 - k0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1))
    contrast = {w: c for w, c in zip(names, z.tolist(), strict=True) if abs(c) >= CONTRAST}
    names = sorted(contrast, key=lambda w: (-round(abs(contrast[w]), 6), -len(w), w))[:CANDIDATES]
    if not names:
        return (), np.zeros(0)
    own = own_kernel(names)
    gram = kernels(names, names).astype(np.float64) / np.sqrt(np.outer(own, own))
    weight = np.round([abs(contrast[w]) for w in names], 6)
    left, columns, chosen = np.diag(gram).copy(), [], []
    while len(chosen) < min(most, len(names)):
        gain = np.where(left >= 0.6, weight * left, 0.0)  # others are spanned by the landmarks so far
        if not gain.max():
            break
        best = max(np.flatnonzero(gain >= 0.9 * gain.max()).tolist(), key=lambda i: (len(names[i]), -i))  # rather words than their stems
        column = gram[:, best] - sum((c * c[best] for c in columns), np.zeros(len(names)))
        columns.append(column / np.sqrt(left[best]))
        left = left - columns[-1] ** 2
        left[best] = 0.0
        chosen.append(best)
    return tuple(names[i] for i in chosen), np.array([contrast[names[i]] for i in chosen])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """L2-regularised squared hinge by Newton steps over the examples inside the margin."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        inside = y * (x @ w) < 1
        a, b, g = x[inside], y[inside], c * weight[inside]
        new = np.linalg.solve(ridge + (a * g[:, None]).T @ a, (a * g[:, None]).T @ b)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


def inserted(unit: bytes, at: int) -> bytes:
    """unit with one letter more, by its place in the sample: no randomness."""
    k = 2 + at % max(1, len(unit) - 2)
    return unit[:k] + bytes([97 + (7 * at + len(unit)) % 26]) + unit[k:]


def fit(toxic: list[bytes], other: list[bytes], counts: dict[int, int]) -> Model:
    """A model of labelled texts; counts weigh the classes as they are among all labels."""
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    landmarks, contrast = choose(toxic, other) if toxic and other else ((), np.zeros(0))
    if not landmarks:
        return Model((), np.zeros(0), np.zeros(0), 0.0, (0.0, 0.0, 0.0), share)
    own = own_kernel(list(landmarks))
    gram = kernels(list(landmarks), list(landmarks)).astype(np.float64) / np.sqrt(np.outer(own, own))
    levels, vectors = np.linalg.eigh(gram)
    white = vectors @ np.diag(1 / np.sqrt(np.maximum(levels, 1e-3))) @ vectors.T
    model = Model(landmarks, own, np.zeros(0), 0.0, (0.0, 0.0, 0.0), share, hashlib.sha256(b"\n".join(landmarks)).hexdigest())

    nothing = np.zeros((1, len(landmarks)), np.float32)  # a sentence without kernels that count: every text has one at least
    every = other + toxic
    parts = [(at, *sentence_features(every[at : at + 512], model)) for at in range(0, len(every), 512)]
    text, found = np.concatenate([t + at for at, t, _ in parts]), np.concatenate([x for _, _, x in parts])
    edges = np.searchsorted(text, np.arange(len(every) + 1))
    each = [np.concatenate([found[i:j], nothing]) for i, j in zip(edges, edges[1:])]
    bags = each[: len(other)], each[len(other) :]
    noisy = {}
    for k, w in enumerate(landmarks):
        x = np.zeros((4, len(landmarks)), np.float32)
        rows, cols, values = matched([inserted(w, k + n) for n in range(4)], landmarks, own)
        x[rows, cols] = values
        noisy[k] = x
    weights, offset = contrast / np.abs(contrast).max(), -0.5
    for _ in range(4):
        decide = lambda x: np.round(x @ weights + offset, 6)
        witness = np.concatenate([b[(d > 0) | (np.arange(len(b)) == d.argmax())] for b in bags[1] for d in [decide(b)]])
        hard = np.concatenate([b[np.argsort(-decide(b), kind="stable")[:3]] for b in bags[0]])
        # a toxic sentence's clearest word, had a letter been inserted
        clear = [noisy[int(k)] for x in witness if x[k := np.round(x * weights, 6).argmax()] > 0.9 and weights[k] > 0]
        x = np.concatenate([witness, *clear, hard]).astype(np.float64) @ white
        y = np.repeat([1.0, -1.0], [len(x) - len(hard), len(hard)])
        weight = np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum()) * len(y) / 2
        w, offset = _svm(x, y, weight)
        weights = white @ w
    model = replace(model, weights=weights.astype(np.float32), offset=offset)
    y = np.repeat([0.0, 1.0], [len(other), len(toxic)])
    weight = np.where(y == 1, counts[1] / len(toxic), counts[0] / len(other)) * len(y) / total
    curve = logistic(_features(text, found, len(y), model), y, weight, ridge=1e-2)
    return replace(model, curve=tuple(map(float, curve)))


def train(docs: DataFrame, labels: DataFrame, held_mod: int = 5, held_rest: int = 0, sample: int = SAMPLE) -> Model:
    texts, counts = labelled(docs, labels, "toxic", held_mod, held_rest, sample, 20_000)
    return fit([t.encode() for t in texts[1]], [t.encode() for t in texts[0]], counts)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(texts, model), pa.float64())], ["doc_id", "score"])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _scored(it, model), "doc_id long, score double")


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
