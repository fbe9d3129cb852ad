"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has bit i set if over half of its shingles' 64-bit hashes have it set. Two fingerprints that
differ in at most two of 64 bits agree on at least two of four 16-bit blocks, so equal pairs of blocks find all of
them. Fingerprints meet in buckets (pair of blocks, 32 bits); in a bucket of up to `pair_limit` distinct
fingerprints all pairs are joined and verified by Hamming distance. A larger bucket is split further instead:
members that differ in at most two of the other 32 bits both lie within one bit of a common value, so each member
is dealt to its 33 values, where at most 33 members meet, and is linked to the smallest there. That loses no link's
connection and its cost stays in proportion to the bucket. Texts with equal fingerprints count once throughout.

Null and empty texts have no words and fingerprint zero, which links like any other; null doc_ids take part but never name a
component unless all members lack one; repeated rows each return a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import forget, materialize, numbered, release
from siftline.llm.graph import components

WIDTH = 3
DISTANCE = 2
PAIR_LIMIT = 64
SEED = 42
#: For keep_similar: words of a shingle and the similarity of sets in hundredths.
SIMILAR_WIDTH = 5
SIMILAR = 80
ROUNDS = 2
#: Sets whose shingles are counted to order all by how usual they are, and slots of the counts.
USUAL_SETS = 20_000
SLOTS = 1 << 22
_CHUNK = 1 << 14


def _hashes(text: bytes, width: int) -> np.ndarray:
    """Unsigned 64-bit hashes of the text's shingles in order: A-Z lower-cased, words between ASCII white space."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1 :] if len(found) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(last)].tolist(), last.tolist(), strict=True)), np.uint64, len(last))


def _fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Signed 64-bit fingerprint of UTF-8 text."""
    return _fingerprint(_hashes(text, width))


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        found = [fingerprint(t.as_py() or b"", width) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of each row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _fingerprints(it, width), "doc_id long, fp long")


def links(fps: DataFrame, distance: int = DISTANCE, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """fps (fp, distinct) to links (a, b) that connect all fingerprints within `distance` <= 2 bits."""
    if distance > 2:
        raise ValueError("four blocks taken by two find distances of at most 2")
    blocks = [0xFFFF << (16 * i) for i in range(4)]
    masks = [a | b for a, b in combinations(blocks, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entries = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).cast("byte").alias("pair"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)
    ])).alias("e")).select("fp", "e.*")
    # Tables joined on what they were grouped by are stored first: the join shuffles for itself and can split a hot key.
    sizes = materialize(entries.groupBy("pair", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
    met = materialize(entries.join(sizes.hint("merge"), ["pair", "key"]), "simhash-blocks")
    some = met.filter(F.col("n") <= pair_limit).select("pair", "key", "fp")
    other = some.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance
    pairs = some.join(other, ["pair", "key"]).filter((F.col("fp") < F.col("b")) & near).select(F.col("fp").alias("a"), "b")
    # Large buckets: the value itself and those one bit away outside the bucket's blocks. For distance 1 (0), the
    # one bit counts for one side only (not at all).
    flips = {i: [0, *[(1 << k) - (1 << 64) if k == 63 else 1 << k for k in range(64) if not m >> k & 1]] for i, m in enumerate(masks)}
    hub = F.expr("CASE pair " + " ".join(f"WHEN {i} THEN array({', '.join(f'{x}L' if x != -(1 << 63) else '-9223372036854775807L - 1L' for x in v)})" for i, v in flips.items()) + " END")
    large = met.filter(F.col("n") > pair_limit).select("pair", "fp", F.explode(hub).alias("flip"))
    large = large.select("pair", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    if distance == 2:
        least = large.groupBy("pair", "hub").agg(F.min("fp").alias("m"), F.count("*").alias("k")).filter("k > 1")
        stars = large.join(least, ["pair", "hub"]).filter("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    else:
        own = met.filter(F.col("n") > pair_limit).select("pair", F.col("fp").alias("hub"))
        stars = large.join(own, ["pair", "hub"]).filter((F.col("fp") != F.col("hub")) & (F.lit(distance) == 1)).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return pairs.unionAll(stars)


def _rooted(prints: DataFrame, distance: int, pair_limit: int) -> DataFrame:
    """prints (doc_id, fp) to nodes (fp, first, root): the smallest doc_id of a fingerprint, the smallest fingerprint reachable."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp"), distance, pair_limit), "simhash-links")
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return materialize(nodes, "simhash-nodes")


def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fp, component_id): the smallest doc_id reachable over links."""
    prints = materialize(fingerprints(docs, width), "simhash-fingerprints")
    nodes = _rooted(prints, distance, pair_limit)
    named = materialize(nodes.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-components")
    nodes = nodes.join(named.hint("merge"), "root").select("fp", "component_id")
    return prints.join(nodes, "fp")


def op9_simhash(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """One row of docs for each component of rows, all columns: the first by doc_id (nulls last), text and place."""
    rows = numbered(docs, "simhash-rows")
    prints = materialize(fingerprints(rows.select(F.col("__row").alias("doc_id"), "text"), width), "simhash-fingerprints")
    nodes = _rooted(prints, distance, pair_limit).select("fp", "root")
    return _first_rows(rows, prints.join(nodes.hint("merge"), "fp").select(F.col("doc_id").alias("__row"), "root")).select(*docs.columns)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, text) to (node, shingles): the distinct shingles' hashes, ascending."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.unique(_hashes(t.as_py() or b"", width)).view(np.int64) for t in part.column(1).cast(pa.binary())]
            ends = np.concatenate(([0], np.cumsum(list(map(len, sets)))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["node", "shingles"])


def _keyed(batches: Iterator[pa.RecordBatch], width: int, usual: tuple[np.ndarray, np.ndarray], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (__row, text) to (__row, node, fp, n, keys): a hash of the shingle set, its fingerprint and size, and of its n shingles the
    n - ceil(n percent / 100) + 1 least usual ones.

    Two sets as similar as `percent` share more than the others alone can hold, so they meet in a key at least; any one order does.
    """
    slots, counts = usual
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            node, prints, sizes, keys = [], [], [], []
            for t in part.column(1).cast(pa.binary()):
                hashes = _hashes(t.as_py() or b"", width)
                prints.append(_fingerprint(hashes))
                x = np.unique(hashes)
                node.append(xxhash.xxh64_intdigest(x.tobytes(), SEED))
                x = x.view(np.int64)
                sizes.append(len(x))
                most = len(x) + (-len(x) * percent) // 100 + 1 if len(x) else 0
                if len(slots):
                    slot = x & (SLOTS - 1)
                    place = np.minimum(np.searchsorted(slots, slot), len(slots) - 1)
                    x = x[np.lexsort((x, np.where(slots[place] == slot, counts[place], 0)))]
                keys.append(x[:most])
            ends = np.concatenate(([0], np.cumsum(list(map(len, keys)))))
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), held], ["__row", "node", "fp", "n", "keys"])


def _usual(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of shingles and how many rows of a bounded sample hold them, if several do. It only orders shingles."""
    rate = min(1.0, USUAL_SETS / max(1, rows.count()))
    some = rows.filter(F.pmod(F.xxhash64("__row"), F.lit(1 << 20)) < int(rate * (1 << 20)))
    sets = some.select(F.col("__row").alias("node"), "text").mapInArrow(lambda it: _sets(it, width), "node long, shingles array<long>")
    slots = sets.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.count("*").alias("k"))
    found = slots.filter("k >= 8").toArrow()
    slot, k = found.column("slot").to_numpy(), found.column("k").to_numpy()
    order = np.argsort(slot)
    return slot[order], k[order]


def _alike(pairs: DataFrame, rows: DataFrame, firsts: DataFrame, width: int, percent: int, many: bool = False) -> DataFrame:
    """Of pairs (a, b) of nodes those whose shingle sets are similar: |both| / |either| >= percent / 100, in whole numbers.

    Only the pairs' own texts are read, from the first row of each node, and only their sets are stored. many: the texts are shuffled at
    any size, else where the pairs' rows are not few enough to go to all."""
    pairs = materialize(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs")
    nodes = materialize(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), "simhash-paired")
    wanted = materialize(firsts.select("node", "__row").join(nodes, "node"), "simhash-wanted")
    sets = rows.select("__row", "text").join(wanted.hint("merge") if many else wanted, "__row").select("node", "text")
    sets = materialize(sets.mapInArrow(lambda it: _sets(it, width), "node long, shingles array<long>"), "simhash-sets")
    release(rows.sparkSession)
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    near = F.size(F.array_intersect("sa", "sb")).cast("long") * (100 + percent) >= (F.size("sa").cast("long") + F.size("sb")) * percent
    found = materialize(pairs.join(one, "a").join(two, "b").filter(near).select("a", "b"), "simhash-alike")
    forget(pairs, nodes, wanted, sets)
    release(rows.sparkSession)
    return found


def _near_size(a: str, b: str, percent: int):
    return F.least(a, b).cast("long") * 100 >= F.greatest(a, b).cast("long") * percent


def _able(n: str, at: str, m: str, bt: str, percent: int):
    """Whether sets of n and m, with a common key at places `at` and `bt`, can be similar if it is their first: then all they share lies
    from it on in both. Similar sets have their first common shingle among the keys of both, so they pass there, if at no later key."""
    return F.least(F.col(n) - F.col(at), F.col(m) - F.col(bt)).cast("long") * (100 + percent) >= (F.col(n).cast("long") + F.col(m)) * percent


def similar_roots(rows: DataFrame, made: DataFrame, width: int = SIMILAR_WIDTH, percent: int = SIMILAR, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """rows (__row, text) and made (__row, node, fp, n, keys) to (node, root): components of all pairs as similar as `percent`,
    for nodes that share a key with another one.

    Blocks of bits cannot find a similarity of 0.8, where fingerprints differ by about 10 of 64 bits; they come first, as they join the
    closest sets cheaply. Then sets meet by their least usual shingles, which misses no pair. In keys of over `pair_limit` nodes all
    are held against one node, in ROUNDS rounds another one; last, the pairs of every key that are not yet in one component are compared, if it
    can be their first common one and they have enough keys in common.
    Every link is verified by the sets themselves.
    """
    each = made.select("node", "n", F.posexplode("keys").alias("at", "key"))
    shared = materialize(each.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("key"), "simhash-shared")
    # Most keys are one node's; where the others are few, they go to all and the keys are not shuffled.
    keys = materialize(each.join(shared, "key", "left_semi").distinct(), "simhash-keys")
    sizes = materialize(keys.groupBy("key").agg(F.count("*").alias("k")), "simhash-key-sizes")
    nodes = materialize(keys.select("node").distinct(), "simhash-open-nodes")
    firsts = made.select("__row", "node", "fp").join(nodes, "node", "left_semi").groupBy("node").agg(F.min_by(F.struct("__row", "fp"), "__row").alias("m"))
    firsts = materialize(firsts.select("node", "m.__row", "m.fp"), "simhash-firsts")
    forget(shared, nodes)
    release(rows.sparkSession)

    fps = materialize(firsts.groupBy("fp").agg(F.min("node").alias("first")), "simhash-first")
    met = links(fps.select("fp"), DISTANCE, pair_limit)
    by_bits = met.join(fps.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = firsts.select("fp", "node").join(fps.hint("merge"), "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = _alike(by_bits.unionAll(same), rows, firsts, width, percent)
    forget(fps)

    def current() -> DataFrame:
        """The keys that hold nodes of several components, with these."""
        roots = materialize(components(found, "simhash-similar"), "simhash-roots")
        held = keys.join(roots.withColumnRenamed("root", "__r").hint("merge"), keys["node"] == roots["node"], "left")
        held = materialize(held.select("key", keys["node"], "n", "at", F.coalesce("__r", keys["node"]).alias("root")), "simhash-held")
        open_ = held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
        open_ = materialize(open_.join(sizes, "key"), "simhash-open")
        out = materialize(held.join(open_.hint("merge"), "key"), "simhash-open-keys")
        forget(held, roots, open_)
        return out

    held = current()
    for i in range(ROUNDS):
        large = held.filter(F.col("k") > pair_limit)
        if large.isEmpty():
            break
        # First the set with the least before the key: what a group was made from, or the nearest to it. Then any one.
        by = F.struct("at", "node") if i == 0 else F.struct(F.xxhash64("node", F.lit(i)), "at")
        hubs = large.groupBy("key").agg(F.min_by(F.struct("node", "n", "at", "root"), by).alias("h"))
        hubs = materialize(hubs.select("key", F.col("h.node").alias("a"), F.col("h.n").alias("na"), F.col("h.at").alias("aa"), F.col("h.root").alias("ra")), "simhash-hubs")
        pairs = large.join(hubs.hint("merge"), "key").filter((F.col("root") != F.col("ra")) & _near_size("n", "na", percent) & _able("n", "at", "na", "aa", percent))
        new = _alike(pairs.select("a", F.col("node").alias("b")), rows, firsts, width, percent)
        forget(hubs)
        if new.isEmpty():
            continue
        found = found.unionAll(new)
        forget(held)
        held = current()
        release(rows.sparkSession)
    other = held.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("bt"), F.col("root").alias("rb"))
    able = _able("n", "at", "nb", "bt", percent)
    met = held.join(other.hint("merge"), "key").filter((F.col("node") < F.col("b")) & (F.col("root") != F.col("rb")) & _near_size("n", "nb", percent) & able)
    met = materialize(met.select(F.col("node").alias("a"), "b", F.col("n").alias("na"), F.col("nb")).distinct(), "simhash-met")
    # All keys that two of them have in common are open, as they hold both components.
    ends = materialize(met.select(F.col("a").alias("node")).unionAll(met.select("b")).distinct(), "simhash-ends")
    own = materialize(held.select("node", "key").join(ends.hint("merge"), "node").groupBy("node").agg(F.collect_set("key").alias("own")), "simhash-own-keys")
    one, two = (own.select(F.col("node").alias(c), F.col("own").alias(f"k{c}")) for c in "ab")
    met = met.join(one.hint("merge"), "a").join(two.hint("merge"), "b").withColumn("k", F.size(F.array_intersect("ka", "kb")))
    # What two sets share besides their common keys lies behind the keys of the one whose keys end first.
    behind = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    enough = (F.col("k") + F.greatest(behind("na"), behind("nb"))) * (100 + percent) >= (F.col("na").cast("long") + F.col("nb")) * percent
    found = found.unionAll(_alike(met.filter(enough).select("a", "b"), rows, firsts, width, percent, many=True))
    forget(held, keys, sizes, firsts, ends, own)
    return components(found, "simhash-similar")


def keep_similar(docs: DataFrame, width: int = SIMILAR_WIDTH, percent: int = SIMILAR, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """One row of docs for each group of rows linked by similar shingle sets, all columns; the first as in keep_first."""
    rows = numbered(docs, "simhash-rows")
    sent = rows.sparkSession.sparkContext.broadcast(_usual(rows, width))
    made = rows.select("__row", "text").mapInArrow(lambda it: _keyed(it, width, sent.value, percent), "__row long, node long, fp long, n int, keys array<long>")
    made = materialize(made, "simhash-keyed")
    roots = materialize(similar_roots(rows, made, width, percent, pair_limit), "simhash-node-roots")
    small = materialize(made.select("__row", "node"), "simhash-row-nodes")
    forget(made)
    rooted = small.join(roots.withColumnRenamed("node", "__n").hint("merge"), F.col("node") == F.col("__n"), "left").select("__row", F.coalesce("root", "node").alias("root"))
    return _first_rows(rows, rooted).select(*docs.columns)


def _first_rows(rows: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of rows, for each root of rooted (__row, root) the first by doc_id (nulls last), text and __row."""
    ids = rows.select("__row", F.col("doc_id").cast("long").alias("__id"))
    rooted = materialize(rooted.join(ids, "__row"), "simhash-rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("__id").alias("least"), F.count("*").alias("n")).filter("n > 1"), "simhash-least")
    several = materialize(rooted.join(least.hint("merge"), "root").select("__row", "root", F.col("__id").eqNullSafe(F.col("least")).alias("tied")), "simhash-several")
    groups = materialize(several.filter("tied").groupBy("root").agg(F.min("__row").alias("__row"), F.count("*").alias("n")), "simhash-groups")
    # Texts are read only where several rows share the least id, or lack one.
    many = several.filter("tied").join(groups.filter("n > 1").select("root").hint("merge"), "root").select("__row", "root")
    texts = rows.select("__row", F.coalesce("text", F.lit("")).alias("text")).join(many, "__row")
    kept = groups.filter("n = 1").select("__row").unionAll(texts.groupBy("root").agg(F.min(F.struct("text", "__row")).alias("m")).select("m.__row"))
    # What goes is less than what stays; the plan is the same at any size.
    gone = materialize(several.select("__row").join(materialize(kept, "simhash-kept"), "__row", "left_anti"), "simhash-gone")
    forget(rooted, least, several, groups)
    return rows.join(gone.hint("merge"), "__row", "left_anti")
