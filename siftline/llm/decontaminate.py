"""Benchmark decontamination by a distributed positional inverted index.

The index is a stored table of segments, each a block of documents with its words in order and, for each, the ascending list of its
places in the block's word sequence: all tokens of the corpus are posted, once. Documents in a block are parted by a gap, so no match
crosses them. Lists of one document stay in one segment: intersecting needs no shuffle, and a term that a third of all documents hold is spread over all
segments. A segment is one row of some megabytes, so the table's row groups are measured at every row: a task holds few segments,
however many it writes or reads. A phrase is found from its rarest term in the segment: its list, less the term's offset, is intersected with the lists of
the next rarer terms, less theirs, until none is left or all have agreed. Proximity asks for each term within a span around a
place of the rarest one instead.

The test set is cut into blocks of up to BLOCK_CHARS characters; each block is sent to all segments in turn, so nothing broadcast
grows with the test set, and the texts are read once however many blocks there are. Words are runs of a-z (A-Z lower-cased), digits and
non-ASCII characters.

Null and empty texts have no words; items without words match nothing; a null item_id counts as an empty name. Items that
repeat an id or a text count by id; repeated documents each return a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import LARGE_ROWS, materialize, numbered, table

WINDOW = 10
BLOCK_CHARS = 4_000_000
SEGMENT_WORDS = 1 << 19
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SEGMENT = "segment long, doc_ids array<long>, starts array<int>, n_words array<int>, terms array<binary>, ends array<int>, places array<int>"
FOUND = "segment long, ord int, doc_id long, n_words long, lows array<long>, highs array<long>, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass(frozen=True)
class Phrases:
    """A block of distinct windows over numbered terms."""

    numbers: dict[bytes, int]
    terms: np.ndarray  # (windows, WINDOW), -1 past the end of a short window
    lengths: np.ndarray
    items: list[tuple[str, ...]]  # a window's item ids


def item_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of up to `chars` characters (or one larger item), read one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").distinct().toLocalIterator():
        if block and size + len(row["text"] or "") > chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"] or "", (row["text"] or "").encode()))
        size += len(row["text"] or "")
    yield block


def phrases(items: list[tuple[str, bytes]], numbers: dict[bytes, int], window: int = WINDOW) -> Phrases:
    held: dict[tuple[int, ...], set[str]] = {}
    for name, text in items:
        ids = [numbers.setdefault(w, len(numbers)) for w in words(text)]
        for at in range(max(1, len(ids) - window + 1)) if ids else ():
            held.setdefault(tuple(ids[at : at + window]), set()).add(name)
    terms = np.full((len(held), window), -1, np.int32)
    for i, w in enumerate(held):
        terms[i, : len(w)] = w
    return Phrases(numbers, terms, np.array([len(w) for w in held], np.int64), [tuple(sorted(x)) for x in held.values()])


_FIELDS = [("doc_ids", pa.int64()), ("starts", pa.int32()), ("n_words", pa.int32()), ("terms", pa.binary()), ("ends", pa.int32()), ("places", pa.int32())]


def _segment(docs: list[tuple[int | None, np.ndarray]], numbers: dict[bytes, int], gap: int) -> pa.RecordBatch:
    """One row: the postings of documents (doc_id, numbers of its words in order)."""
    sizes = np.array([len(ids) for _, ids in docs])
    starts = np.concatenate(([0], np.cumsum(sizes + gap)[:-1]))
    term = np.concatenate([ids for _, ids in docs])
    place = np.arange(len(term)) + np.repeat(np.arange(len(docs)) * gap, sizes)
    order = np.argsort(term, kind="stable")
    ends = np.cumsum(np.bincount(term, minlength=len(numbers)))
    values = ([d for d, _ in docs], starts, sizes, list(numbers), ends, place[order])
    return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(t)) for v, (_, t) in zip(values, _FIELDS, strict=True)], [k for k, _ in _FIELDS])


def _index(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    docs, numbers, size = [], {}, 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            found = words(text.as_py() or b"")
            for w in dict.fromkeys(found):
                numbers.setdefault(w, len(numbers))
            docs.append((doc_id, np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))))
            size += len(found)
            if size >= SEGMENT_WORDS:
                yield _segment(docs, numbers, gap)
                docs, numbers, size = [], {}, 0
    if docs:
        yield _segment(docs, numbers, gap)


def build_index(docs: DataFrame, gap: int = WINDOW) -> DataFrame:
    """The table of segments over docs (doc_id, text), stored in the shared folder."""
    schema = SEGMENT.removeprefix("segment long, ")
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _index(it, gap), schema)
    return materialize(made.withColumn("segment", F.monotonically_increasing_id()), "positional-index", **LARGE_ROWS)


class Postings:
    """One segment's lists by the block's term numbers; a word that the segment has not got has an empty list."""

    def __init__(self, terms: pa.Array, ends: np.ndarray, places: np.ndarray, wanted: pa.Array):
        self.places = places
        here = pc.index_in(wanted, value_set=terms)
        known = pc.is_valid(here).to_numpy(zero_copy_only=False)
        at = here.fill_null(0).to_numpy().astype(np.int64)
        ends = np.concatenate(([0], ends)).astype(np.int64)
        self.low, self.high = np.where(known, ends[at], 0), np.where(known, ends[np.minimum(at + 1, len(ends) - 1)], 0)

    def of(self, term: int) -> np.ndarray:
        return self.places[self.low[term] : self.high[term]]

    def counts(self, terms: np.ndarray) -> np.ndarray:
        return np.where(terms >= 0, (self.high - self.low)[terms], np.iinfo(np.int64).max)

    def phrase(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Starts of the phrase: offset-adjusted lists, rarest first."""
        order = np.argsort(counts, kind="stable")
        starts = self.of(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            other = self.of(terms[k])
            at = np.searchsorted(other, starts + k)
            starts = starts[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == starts + k)]
        return starts

    def near(self, terms: np.ndarray, counts: np.ndarray, span: int) -> np.ndarray:
        """Places of the rarest term with every other term at most `span` words away."""
        order = np.argsort(counts, kind="stable")
        at = self.of(terms[order[0]])
        for k in order[1:]:
            if not len(at):
                break
            other = self.of(terms[k])
            next_ = np.searchsorted(other, at - span)
            at = at[(next_ < len(other)) & (other[np.minimum(next_, len(other) - 1)] <= at + span)]
        return at


def _matches(batches: Iterator[pa.RecordBatch], block: Phrases, span: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND for all documents of each segment: the places held by matches (merged) and the items."""
    widths, wanted = block.lengths, pa.array(list(block.numbers), pa.binary())
    for batch in batches:
        for s in range(batch.num_rows):
            segment, doc_ids, starts, n_words, terms, ends, places = (batch.column(i)[s] for i in range(7))
            doc_ids, starts = doc_ids.values.to_pylist(), starts.values.to_numpy().astype(np.int64)
            posted = Postings(terms.values, ends.values.to_numpy(), places.values.to_numpy().astype(np.int64), wanted)
            counts = posted.counts(block.terms)
            hits, owners = [], []
            for w in np.flatnonzero(counts.min(axis=1) > 0) if len(widths) else ():
                n = widths[w]
                if span is None:
                    low = posted.phrase(block.terms[w, :n], counts[w, :n])
                    high = low + n
                else:
                    at = posted.near(block.terms[w, :n], counts[w, :n], span)
                    low, high = at, at + 1
                if len(low):
                    hits.append(np.column_stack([low, high]))
                    owners.append(np.full(len(low), w))
            hit = np.concatenate(hits) if hits else np.zeros((0, 2), np.int64)
            owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
            doc = np.searchsorted(starts, hit[:, 0], side="right") - 1
            order = np.lexsort((hit[:, 0], doc))
            hit, owner, doc = hit[order], owner[order], doc[order]
            edges = np.searchsorted(doc, np.arange(len(starts) + 1))
            lows, highs, items = [], [], []
            for d in range(len(starts)):
                own = hit[edges[d] : edges[d + 1]]
                if not len(own):
                    lows.append([]), highs.append([]), items.append([])
                    continue
                top = np.maximum.accumulate(own[:, 1])
                new = np.concatenate(([True], own[1:, 0] > top[:-1]))
                lows.append(own[new, 0] - starts[d])
                highs.append(top[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(own) - 1]))] - starts[d])
                items.append(sorted({x for w in np.unique(owner[edges[d] : edges[d + 1]]) for x in block.items[w]}))
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(doc_ids, pa.int64()), n_words.values.cast(pa.int64()), pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                ["segment", "ord", "doc_id", "n_words", "lows", "highs", "items"],
            )


def _merged(lows, highs) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(zip(lows, highs, strict=True)):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        spans = [_merged(a, b) for a, b in zip(rows["lows"], rows["highs"], strict=True)]
        items = [sorted(set(x)) for x in rows["items"]]
        hit = [sum(b - a for a, b in s) for s in spans]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["n_words"], pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), pa.array([[{"low": a, "high": b} for a, b in s] for s in spans], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
        )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int | None = None, block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """For each block of items a table with a row of FOUND per document: merged word spans of exact matches, and items.

    With `slack`, proximity matches instead: all of a window's terms within window + slack - 1 words of its rarest.
    All blocks are matched against one stored index, so (segment, ord) names a document in all of them.
    """
    out = []
    gap = window if slack is None else 2 * (window + slack)
    span = None if slack is None else window + slack - 1
    lists = build_index(docs, gap).select("segment", "doc_ids", "starts", "n_words", "terms", "ends", "places")
    for items in item_blocks(benchmark, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(phrases(items, {}, window))
        out.append(lists.mapInArrow(lambda it, sent=sent: _matches(it, sent.value, span), FOUND))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of word numbers).

    With several blocks of items a document's rows, one a block, meet by its place in the index.
    """
    found, *more = matches(docs, benchmark, window, None, block_chars)
    for x in more:
        found = found.unionAll(x)
    if more:
        found = found.groupBy("segment", "ord").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            *[F.flatten(F.collect_list(c)).alias(c) for c in ("lows", "highs", "items")],
        ).select("segment", "ord", "doc_id", "n_words", "lows", "highs", "items")
    return found.mapInArrow(_digests, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<low: long, high: long>>")


def op5_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs without a benchmark window, all columns. Each row is judged by itself, whatever its doc_id."""
    rows = numbered(docs, "decontaminate-rows")
    found = contamination(rows.select(F.col("__row").alias("doc_id"), "text"), benchmark, window, block_chars)
    hit = found.filter("contaminated").select(F.col("doc_id").alias("__row"))
    return rows.join(hit, "__row", "left_anti").select(*docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {"op5_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1), lambda i: array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' '))) AS win FROM b WHERE len(w) > 0),
p AS (SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'win': array_to_string(list_slice(w, i, i + n - 1), ' ')}})) AS x FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n),
h AS (SELECT r, x.i AS i, p.n AS n, item FROM p JOIN q ON q.n = p.n AND q.win = x.win),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""}
