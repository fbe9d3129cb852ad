"""Language identification by language-bitmask n-gram filters.

One Bloom filter a language, stored bit-sliced: slot s holds a mask whose bit l is slot s of language l's filter, so the
AND of an n-gram's slots returns all languages that may contain it at once. A text's n-grams are looked up, the bits
are counted per language, and each count c of n is corrected for the filter's rate of false positives p (the share of
its slots that are set, to the power of the hashes): (c - n p) / (1 - p). The largest corrected count decides.

N-grams are of NGRAM bytes of UTF-8 text in which A-Z are lower-cased and all other ASCII but a-z is one space; the
whole text counts, each n-gram once. Filters are filled from a bounded sample, about SAMPLE texts a language chosen by hash, of longer ones a
piece of SAMPLE_CHARS characters, with the n-grams that at least two of its texts hold (one, if there are under 20 texts) and
that are not far more usual elsewhere (FAIR): quotations do not make an n-gram a language's own. Every language that a learnable row has is learned.
Null texts and texts without a letter are `und` with score 0, as all texts are if nothing was learned; ties go to the
language with the most training rows, then by name. Repeated rows are scored row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import crc32_mod, table

NGRAM = 5
SLOTS = 1 << 21
HASHES = 2
SAMPLE = 300
SAMPLE_CHARS = 20_000
#: A language holds an n-gram if its share of texts with it is at least so much of the largest such share.
FAIR = 0.1
_CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    masks: np.ndarray  # (words of 64 languages, slots)
    rates: np.ndarray  # of false positives, a language


def ngrams(text: bytes) -> np.ndarray:
    """64-bit mixes of the text's n-grams, each once: a line said often has one say. Long texts are read in chunks."""
    data = b" " + b" ".join(text.translate(_TABLE).split()) + b" "
    parts = []
    for at in range(0, max(1, len(data) - NGRAM + 1), _CHUNK):
        b = np.frombuffer(data[at : at + _CHUNK + NGRAM - 1], np.uint8)
        n = max(0, len(b) - NGRAM + 1)
        h = b[:n].astype(np.uint64)
        for k in range(1, NGRAM):
            h = (h << np.uint64(8)) | b[k : n + k]
        parts.append(np.unique(h))
    return (parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))) * np.uint64(0x9E3779B97F4A7C15)


def _slots(h: np.ndarray, slots: int) -> list[np.ndarray]:
    bits = np.uint64(slots.bit_length() - 1)
    return [((h if i == 0 else h * np.uint64(0xC2B2AE3D27D4EB4F + 2 * i)) >> (np.uint64(64) - bits)).astype(np.int64) for i in range(HASHES)]


def counts(text: bytes, model: Model) -> tuple[np.ndarray, int]:
    """How many of the text's n-grams each language's filter holds, and how many there are."""
    found, h = np.zeros(len(model.languages), np.int64), ngrams(text)
    places = _slots(h, model.masks.shape[1])
    for w, masks in enumerate(model.masks):
        held = masks[places[0]]
        for p in places[1:]:
            held &= masks[p]
        for i in range(min(64, len(found) - 64 * w)):
            found[64 * w + i] += np.count_nonzero(held & np.uint64(1 << i))
    return found, len(h)


def identify(text: str | None, model: Model) -> tuple[str, float]:
    if text is None or not model.languages or not _LETTER.search(text):
        return "und", 0.0
    found, n = counts(text.encode("utf-8", "replace"), model)
    true = np.maximum(0, (found - n * model.rates) / (1 - model.rates))
    best = int(np.argmax(true))
    return model.languages[best], float(true[best] / true.sum()) if true.sum() > 0 else 0.0


def train(docs: DataFrame, held_mod: int = 3, held_rest: int = 1, sample: int = SAMPLE, slots: int = SLOTS) -> Model:
    """Filters of every lang value outside the held-out remainder."""
    seen = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = seen.filter(F.coalesce(crc32_mod("doc_id", held_mod), F.lit(-1)) != held_rest)
    sizes = seen.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row a language
    names = tuple(r["lang"] for r in sizes)
    masks = np.zeros((max(1, -(-len(names) // 64)), slots), np.uint64)
    # Each text's chance is sample / count of its language, drawn by its hash: no sort, a bounded result. Of a long text a piece is
    # learned, from a place that its hash gives.
    uniform = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("lang"), F.col("doc_id").cast("string"), F.col("text"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    rate = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["count"])))])[F.col("lang")] if sizes else F.lit(0.0)
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    piece = F.substr("text", (F.pmod(F.xxhash64("text"), spare + 1) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    texts: dict[str, list[str]] = {}
    for r in seen.filter(uniform < rate).select("lang", piece.alias("text")).toLocalIterator():
        texts.setdefault(r["lang"], []).append(r["text"])
    grams, shares, owner = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0, np.int64)]
    for i, name in enumerate(names):
        own = [ngrams(t.encode()) for t in texts.get(name, [])]
        found, held = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_counts=True)
        enough = held >= (2 if len(own) >= 20 else 1)
        grams.append(found[enough])
        shares.append(held[enough] / max(1, len(own)))
        owner.append(np.full(int(enough.sum()), i))
    gram, share, lang = np.concatenate(grams), np.concatenate(shares), np.concatenate(owner)
    _, same = np.unique(gram, return_inverse=True)
    most = np.zeros(same.max(initial=-1) + 1)
    np.maximum.at(most, same, share)
    kept = share >= FAIR * most[same]
    for i in range(len(names)):
        for p in _slots(gram[kept & (lang == i)], slots):
            masks[i // 64, p] |= np.uint64(1 << i % 64)
    rates = np.array([(np.count_nonzero(masks[i // 64] & np.uint64(1 << i % 64)) / slots) ** HASHES for i in range(len(names))])
    return Model(names, masks, rates)


def _identified(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [identify(t.as_py(), model) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs (doc_id, text).

    The filters, words x SLOTS x 8 bytes whatever the corpus, go out as one broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _identified(it, sent.value), "doc_id long, lang_pred string, score double")


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = languages(docs, train(docs))
    return out.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
