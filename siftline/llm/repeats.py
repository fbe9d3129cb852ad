"""Removal of repeated byte strings by prefix-free parsing and suffix arrays.

A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else in the corpus; texts are UTF-8, and
strings never cross texts. The method:

1. Parse. A rolling hash over GRAM bytes is taken at each place, and the least of SPAN hashes in a row (the first, if
   equal) triggers: phrases run from trigger to trigger. A string of LENGTH bytes holds a whole span, so its trigger, and
   the cut it makes, depend on its own bytes only, and equal strings are cut alike. Every string is thus a suffix of the
   phrase before its trigger followed by the parse from its trigger on.
2. Dictionary. The KEY bytes at a trigger belong to every string of that trigger. Keys that start at one place of the corpus
   only (counted over hashes, texts that occur often counting once) rule their strings out; for the others the context is
   taken: what may precede the trigger in such strings, and what may follow. Equal contexts are one dictionary entry.
3. Suffix order. Entries of one key are sorted by what follows the trigger (suffixes of the parse) and by what precedes it,
   read backwards (suffixes of dictionary phrases), with longest common prefixes. Two entries share the string with b bytes
   before the trigger if they agree on b bytes before and LENGTH - b after: both orders combined give the corpus order of
   the strings as far as it decides equality. All comparisons here are of bytes, not hashes.
4. A key with more than GROUP entries (a passage in very many surroundings) is not gathered in one place: its strings are
   dealt out, counted by 128-bit hash, and give the same result.

Suffix arrays are built a key at a time: one array over the corpus is not needed, as only strings with equal keys can be equal.
Texts that occur more than once are wholly repeated (if they have LENGTH bytes) and are parsed as one.

Null and empty texts have no bytes; repeated rows count as other places; rows are told apart by their text alone, so null or
repeated doc_ids do no harm; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import forget, materialize, release, table

LENGTH = 400
GROUP = 2000
GRAM = 8
_CHUNK = 1 << 20
_PAIRS = 24


def span_of(length: int) -> int:
    """The largest power of two that leaves a third of the string for the key."""
    return 1 << ((2 * length // 3).bit_length() - 1)


def triggers(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first, last): each trigger with the first and last start of the strings it belongs to."""
    n, span = len(text) - length + 1, span_of(length)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, n, _CHUNK):
        starts = min(_CHUNK, n - at)
        b = np.frombuffer(text, np.uint8, starts + span - 1 + GRAM - 1, at).astype(np.uint64)
        h = b[: len(b) - GRAM + 1].copy()
        for k in range(1, GRAM):
            h = (h << np.uint64(8)) | b[k : len(b) - GRAM + 1 + k]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        low = (h >> np.uint64(22) << np.uint64(22)) | np.arange(len(h), dtype=np.uint64)  # hash first, then the place
        step = 1
        while step < span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        place = (low[:starts] & np.uint64((1 << 22) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:] - 1, [starts - 1]))
        out.append((place[first] + at, first + at, last + at))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keys(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    digest, key = xxhash.xxh3_64_intdigest, length - span_of(length) + 1
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for t in batch.column(2).cast(pa.binary()):
            text = t.as_py() or b""
            view = memoryview(text)
            place, first, last = triggers(text, length)
            found = np.array([digest(view[a : a + key]) for a in place.tolist()], np.uint64).view(np.int64)
            for row, x in zip(rows, (found, place, first, last), strict=True):
                row.append(x)
        arrays = [pa.array(r, pa.list_(pa.int64())) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["t1", "t2", "key", "place", "first", "last"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For (t1, t2, text, found: array of key, place, first, last) a row for each: its context and that one's hash."""
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])
    for batch in batches:
        cols: list[list] = [[] for _ in schema]
        for t1, t2, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
            text = text.as_py()
            for f in found.as_py():
                a, first, last = f["place"], f["first"], f["last"]
                before, after = text[first:a], text[a : last + length]
                d = xxhash.xxh3_128_digest(len(before).to_bytes(4, "big") + before + after)
                c1, c2 = int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
                for col, x in zip(cols, (t1, t2, f["key"], a, first, last, c1, c2, before, after), strict=True):
                    col.append(x)
            if len(cols[0]) >= 16_384:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                cols = [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def suffix_array(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each string, longest common prefix of each in order with the one before)."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    rank = np.empty(len(strings), np.int64)
    rank[order] = np.arange(len(strings))
    width = max(map(len, strings), default=0) + 1
    size = np.array([len(strings[i]) for i in order])
    table_ = np.frombuffer(b"".join(strings[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(strings), width)
    same = table_[1:] == table_[:-1]
    lcp = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return rank, np.concatenate(([0], np.minimum(lcp, np.minimum(size[1:], size[:-1]))))


def _range_minima(rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest common prefixes of all pairs, from the array of neighbours."""
    n = len(rank)
    out = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        out[i, i + 1 :] = np.minimum.accumulate(lcp[i + 1 :])
    return np.maximum(out, out.T)[rank][:, rank]


def shared(before: list[bytes], after: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of a key's entries the numbers b of bytes before the trigger whose string another entry shares."""
    n = len(before)
    high = np.array([len(x) for x in before])
    low = length - np.array([len(x) for x in after])
    back_rank, back = suffix_array([x[::-1] for x in before])
    on_rank, on = suffix_array(after)
    out = [np.zeros(length + 1, bool) for _ in range(n)]
    if n <= _PAIRS:
        most = np.minimum(_range_minima(back_rank, back), np.minimum(high[:, None], high[None, :]))
        least = np.maximum(length - _range_minima(on_rank, on), np.maximum(low[:, None], low[None, :]))
        for i, j in np.argwhere((least <= most) & ~np.eye(n, dtype=bool)):
            out[i][least[i, j] : most[i, j] + 1] = True
    else:
        for b in range(int(low.min()), int(high.max()) + 1):
            there = np.flatnonzero((low <= b) & (b <= high))
            # entries with a common suffix of b bytes before, and a common prefix of length - b after, by their orders
            classes = np.cumsum(back < b)[back_rank[there]] * (n + 1) + np.cumsum(on < length - b)[on_rank[there]]
            _, which, count = np.unique(classes, return_inverse=True, return_counts=True)
            for i in there[count[which] > 1]:
                out[i][b] = True
    return [np.flatnonzero(x) for x in out]


def _runs(x: np.ndarray) -> list[dict]:
    if not len(x):
        return []
    cut = np.flatnonzero(np.diff(x) > 1)
    return [{"low": int(a), "high": int(b)} for a, b in zip(x[np.concatenate(([0], cut + 1))], x[np.concatenate((cut, [len(x) - 1]))], strict=True)]


_RUNS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def _decide(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For entries (key, c1, c2, before, after) sorted by key: (key, c1, c2, runs of shared b). A key spans batches."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)

    out: list[tuple] = []
    for key, group in groupby(rows(), key=lambda r: r[0]):
        entries = list(group)  # GROUP at most
        found = shared([r[3] for r in entries], [r[4] for r in entries], length) if len(entries) > 1 else []
        out += [(key, r[1], r[2], _runs(x)) for r, x in zip(entries, found) if len(x)]
        if len(out) >= 8192:
            yield _decided(out)
            out = []
    yield _decided(out)


def _decided(out: list[tuple]) -> pa.RecordBatch:
    k, c1, c2, runs = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(runs, _RUNS)], ["key", "c1", "c2", "runs"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, text, spans) to the text's removed bytes, runs and rest."""
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for t, spans in zip(batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), strict=True):
            text = t.as_py()
            removed = n_spans = at = 0
            kept = hashlib.sha256()
            for low, high in sorted((s["low"], s["high"]) for s in spans):
                if low > at or not n_spans:
                    kept.update(text[at:low])
                    n_spans += 1
                    at = low
                removed += max(0, high - at)
                at = max(at, high)
            kept.update(text[at:])
            out.append((removed, n_spans, kept.hexdigest()))
        r, n, k = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(r, pa.int64()), pa.array(n, pa.int64()), pa.array(k, pa.string())], ["t1", "t2", "n_removed", "n_spans", "kept_sha256"])


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the text's 128-bit name."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(t1, t2, text, spans): each text that occurs once and holds repeated bytes, with spans (low, high) that cover them."""
    named = _identified(docs)
    whole = named.filter(F.octet_length("text") >= length)
    parsed = whole.select("t1", "t2", "text").mapInArrow(lambda it: _keys(it, length), "t1 long, t2 long, key array<long>, place array<long>, first array<long>, last array<long>")
    parsed = materialize(parsed, "repeats-parse")
    each = parsed.select("t1", "t2", F.explode(F.arrays_zip("key", "place", "first", "last")).alias("f")).select("t1", "t2", "f.*")
    # Keys at two places or more; copies of a text are one place.
    place = F.xxhash64("t1", "t2", "place")
    often = each.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("key")
    often = materialize(often, "repeats-keys")  # a stored table: the join shuffles for itself, at every size, and can split a hot key
    some = each.join(often.hint("merge"), "key", "left_semi").groupBy("t1", "t2").agg(F.collect_set(F.struct("key", "place", "first", "last")).alias("found"))
    # The text of one row of each such name (the smallest doc_id; rows that tie there are equal in all that counts).
    first = named.filter(F.octet_length("text") >= length).groupBy("t1", "t2").agg(F.min("doc_id").alias("_first"), F.count("*").alias("n"))
    wanted = some.join(first, ["t1", "t2"])
    texts = named.join(wanted, ["t1", "t2"]).filter(F.col("doc_id").eqNullSafe(F.col("_first"))).select("t1", "t2", "text", "found", "n")
    texts = materialize(texts, "repeats-texts")
    contexts = texts.select("t1", "t2", "text", "found").mapInArrow(lambda it: _contexts(it, length), "t1 long, t2 long, key long, place long, first long, last long, c1 long, c2 long, before binary, after binary")
    contexts = materialize(contexts, "repeats-contexts")
    release(docs.sparkSession)
    entries = contexts.groupBy("key", "c1", "c2").agg(
        F.min(place).alias("_a"), F.max(place).alias("_b"), F.min("before").alias("before"), F.min("after").alias("after")
    ).withColumn("all", F.col("_a") != F.col("_b")).drop("_a", "_b")
    entries = materialize(entries, "repeats-dictionary")
    sizes = materialize(entries.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "repeats-sizes")
    told = entries.join(sizes.hint("merge"), "key")
    few = told.filter(F.col("m") <= group).select("key", "c1", "c2", "before", "after").repartition("key").sortWithinPartitions("key")
    decided = few.mapInArrow(lambda it: _decide(it, length), "key long, c1 long, c2 long, runs array<struct<low: long, high: long>>")
    decided = decided.select("key", "c1", "c2", F.explode("runs").alias("r")).select("key", "c1", "c2", "r.*")
    many = told.filter(F.col("m") > group).select("key", "c1", "c2", "before", "after", F.explode(F.sequence(length - F.octet_length("after"), F.octet_length("before"))).alias("b"))
    string = F.expr(f"concat(substring(before, length(before) - b + 1, b), substring(after, 1, {length} - b))")
    many = many.select("key", "c1", "c2", "b", F.xxhash64(string).alias("s1"), F.xxhash64(F.lit(1), string).alias("s2"))
    twice = many.groupBy("s1", "s2").agg(F.count("*").alias("k")).filter("k > 1").select("s1", "s2")
    dealt = many.join(twice, ["s1", "s2"], "left_semi").select("key", "c1", "c2", F.col("b").cast("long").alias("low"), F.col("b").cast("long").alias("high"))
    # Entries at two places or more share all their strings.
    full = entries.filter("all").select("key", "c1", "c2", (length - F.octet_length("after")).cast("long").alias("low"), F.octet_length("before").cast("long").alias("high"))
    found = full.unionAll(decided).unionAll(dealt)
    members = contexts.select("t1", "t2", "place", "key", "c1", "c2").join(found, ["key", "c1", "c2"])
    span = F.struct((F.col("place") - F.col("high")).alias("low"), (F.col("place") - F.col("low") + length).alias("high"))
    spans = materialize(members.groupBy("t1", "t2").agg(F.collect_set(span).alias("spans")), "repeats-spans")
    forget(parsed, often, contexts, entries, sizes)
    release(docs.sparkSession)
    return texts.filter("n = 1").select("t1", "t2", "text").join(spans, ["t1", "t2"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    cut = repeats(docs, length, group).mapInArrow(_cut, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string")
    rows = _identified(docs).select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("_sha"))
    rows = materialize(rows, "repeats-rows")
    copies = rows.filter(F.col("n_bytes") >= length).groupBy("t1", "t2").agg(F.count("*").alias("n")).filter("n > 1")
    # A text has either one row and perhaps spans, or several rows: one small table by name.
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    told = cut.select("t1", "t2", "n_removed", "n_spans", "kept_sha256").unionAll(copies.select("t1", "t2", F.lit(-1).cast("long"), F.lit(1).cast("long"), nothing))
    out = rows.join(told, ["t1", "t2"], "left")
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("n_removed") < 0, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
    )


def op2_repeats(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = {"op2_repeats": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT r, doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT r, unnest(list_transform(range(0, n - {LENGTH} + 1), lambda i: {{'i': i, 'h': md5(b[i + 1:i + {LENGTH}])}})) AS x FROM n WHERE n >= {LENGTH}),
g AS (SELECT x.h AS h FROM w GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT r, x.i AS i FROM w WHERE x.h IN (SELECT h FROM g)),
c AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH}, true)::INT AS cut FROM s),
k AS (SELECT r, i, sum(cut) OVER (PARTITION BY r ORDER BY i) AS k FROM c),
t AS (SELECT r, k, min(i) AS low, max(i) + {LENGTH} AS high FROM k GROUP BY r, k),
u AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS prev FROM t),
a AS (SELECT r, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS top, string_agg(hex(b[prev + 1:low]), '' ORDER BY low) AS kept FROM u JOIN n USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || hex(b[coalesce(top, 0) + 1:n]))) AS kept_sha256 FROM n LEFT JOIN a USING (r)"""}
