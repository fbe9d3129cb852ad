"""Secret scans with corpus-wide ownership frequency.

Candidates are found in each whole text: the base kinds by their patterns, and `opaque`, strings of 20 or more
characters that mix letters and digits with high entropy outside base spans. Each candidate's value is hashed, and
distinct repositories and owners are counted for every hash over the corpus, first by (hash, owner, repository), then by
(hash, owner), then by hash, so no value however common is gathered in one place. A value that more than MAX_OWNERS
owners hold is a copied example; others are live-looking. The method adds the live-looking `opaque` spans; base spans
always stay.

Offsets are code points, ends exclusive. Null and empty texts have no spans; a null owner is an owner of its own;
repeated rows are scanned row by row and count once as a repository; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from siftline.llm.common import materialize, table

#: Fixed patterns and least lengths of the base kinds, in their order; letters of `assign`'s names in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "opaque")
MIN_ASSIGN, MIN_ACCESS = 6, 20
MIN_ENTROPY = 3.5
MAX_OWNERS = 2

_SPAN = pa.struct([("kind", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("value_low", pa.int64()), ("hash", pa.string())])
_SPANS = from_arrow_type(pa.list_(_SPAN))


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _apart(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order, none of which meet."""
    lows: list[int] = []
    highs: list[int] = []
    for a, b in sorted(spans):
        if highs and a <= highs[-1]:
            highs[-1] = max(highs[-1], b)
        else:
            lows.append(a), highs.append(b)
    return lows, highs


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) by start, then kind in the order of KINDS."""
    out = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    lows, highs = _apart((a, b) for _, a, b, _ in out)
    for m in OPAQUE.finditer(text):
        value, i = m.group(), bisect_right(highs, m.start())
        base = i < len(lows) and lows[i] < m.end()
        if not base and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= MIN_ENTROPY:
            out.append(("opaque", m.start(), m.end(), m.start()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for t in batch.column(1):
            text = t.as_py() or ""
            spans.append([{"kind": k, "low": a, "high": b, "value_low": v, "hash": hashlib.sha256(text[v:b].encode("utf-8", "replace")).hexdigest()} for k, a, b, v in candidates(text)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], ["_row", "spans"])


def ownership(found: DataFrame) -> DataFrame:
    """found (hash, owner, repository) to (hash, n_owners, n_repositories)."""
    each = found.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    own = each.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return own.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, keep: tuple[str, ...] = (), name: str = "spans") -> DataFrame:
    """The columns `keep` of docs and `spans` (or `name`): array of (kind, low, high, value_low, hash, n_owners, live), by row.

    Rows meet their spans by a number given where the scan's result is stored; only rows with candidates take part
    in the counting and the join.
    """
    rows = docs.select(*[F.col(c).alias(f"_k_{c}") for c in keep], F.col(repository).cast("string").alias("_repository"), F.col(owner).cast("string").alias("_owner"), F.monotonically_increasing_id().alias("_r"), "text")
    schema = StructType([*rows.drop("text").schema, StructField("spans", _SPANS)])
    names = [f.name for f in schema]
    width = len(names) - 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(width - 1), batch.column(width)], ["_row", "text"])
            (done,) = _scan(iter([pair]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], done.column(1)], names)

    held = materialize(rows.mapInArrow(found, schema), "secrets-scan")
    spans = held.filter(F.size("spans") > 0).select("_r", "_repository", "_owner", F.explode("spans").alias("s"))
    owners = ownership(spans.select(F.col("s.hash").alias("hash"), F.col("_owner").alias("owner"), F.col("_repository").alias("repository")))
    owners = materialize(owners, "secrets-owners")  # a stored table: the join shuffles for itself and can split a value that most documents hold
    told = spans.select("_r", "s.*").join(owners.hint("merge"), "hash").withColumn("live", F.col("n_owners") <= max_owners)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("low", rank.alias("rank"), "kind", "high", "value_low", "hash", "n_owners", "live")
    told = told.filter((F.col("kind") != "opaque") | F.col("live")).groupBy("_r").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.expr("filter(array(named_struct('low', 0L, 'rank', 0L, 'kind', '', 'high', 0L, 'value_low', 0L, 'hash', '', 'n_owners', 0L, 'live', false)), x -> false)")
    some = held.filter(F.size("spans") > 0).drop("spans").join(told, "_r", "left").withColumn("spans", F.coalesce("spans", none))
    out = some.unionByName(held.filter(F.size("spans") == 0).withColumn("spans", none))
    return out.select(*[F.col(f"_k_{c}").alias(c) for c in keep], F.col("spans").alias(name))


def written(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["low"].cast("string"), s["high"].cast("string"))), ",")


def redact(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """docs with the values of live-looking spans replaced by [kind]; n_chars, where there is one, follows the text.

    Every document stays; widely copied examples stay as they are. Overlapping spans are replaced as one.
    """
    found = scan(docs, repository, owner, max_owners, tuple(docs.columns), "__spans")
    live = F.transform(F.filter("__spans", lambda s: s["live"]), lambda s: F.struct(s["value_low"].alias("low"), s["high"].alias("high"), s["kind"].alias("kind")))
    found = found.withColumn("__live", F.sort_array(live))
    merged = F.expr("""aggregate(__live, CAST(array() AS array<struct<low: bigint, high: bigint, kind: string>>), (done, s) ->
        CASE WHEN size(done) > 0 AND get(done, size(done) - 1).high > s.low
        THEN concat(slice(done, 1, size(done) - 1), array(named_struct('low', get(done, size(done) - 1).low, 'high', greatest(get(done, size(done) - 1).high, s.high), 'kind', get(done, size(done) - 1).kind)))
        ELSE concat(done, array(s)) END)""")
    found = found.withColumn("__live", merged)
    cut = F.expr("""concat(array_join(transform(__live, (s, i) -> concat(
        substring(text, CAST(coalesce(get(__live, i - 1).high, 0) + 1 AS int), CAST(s.low - coalesce(get(__live, i - 1).high, 0) AS int)), '[', s.kind, ']')), ''),
        substring(text, CAST(get(__live, size(__live) - 1).high + 1 AS int)))""")
    out = found.withColumn("text", F.when(F.size("__live") > 0, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__live") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op4_secrets(spark, sf_dir):
    out = scan(table(spark, sf_dir, "documents"), keep=("doc_id",))
    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    kinds = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS[:3]]
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return out.select("doc_id", *kinds, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), live)


def _found(kind: str, pattern: str, group: int) -> str:
    """SQL for the matches of one kind: starts follow from the lengths of the matches and of what lies between them."""
    pattern = pattern.replace("'", "''")
    return rf"""SELECT r, '{kind}' AS kind, {KINDS.index(kind) + 1} AS rank, unnest(list_transform(range(1, len(m) + 1), lambda k: {{
        'low': list_sum(list_transform(s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0), 'n': length(m[k]), 'v': g[k]}})) AS x
      FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS s FROM d)"""


# The same letters in either case, but no other characters that fold to them.
_ASSIGN = re.sub(r"[a-z]+(?=[|_)?])", lambda m: "".join(f"[{c.upper()}{c}]" for c in m[0]), "(password|passwd|secret|token|api_?key)") + ASSIGN.pattern.split(")", 1)[1]
SQL = {"op4_secrets": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({_found("assign", _ASSIGN, 2)}
  UNION ALL {_found("access", ACCESS.pattern, 0)}
  UNION ALL {_found("hex", HEX.pattern, 0)}
  UNION ALL {_found("opaque", OPAQUE.pattern, 0)}),
s AS (SELECT r, kind, rank, x.low::BIGINT AS low, (x.low + x.n)::BIGINT AS high, x.v AS v FROM f),
b AS (SELECT * FROM s WHERE kind = 'assign' AND length(v) >= {MIN_ASSIGN} OR kind = 'access' AND length(v) >= {MIN_ACCESS} OR kind = 'hex'),
o AS (SELECT * FROM s WHERE kind = 'opaque' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
        AND list_aggregate(string_split(v, ''), 'entropy') >= {MIN_ENTROPY}
        AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = s.r AND b.low < s.high AND s.low < b.high)),
c AS (SELECT * FROM b UNION ALL SELECT * FROM o),
own AS (SELECT v, count(DISTINCT coalesce('=' || source, '-')) <= {MAX_OWNERS} AS live FROM c JOIN d USING (r) GROUP BY v),
e AS (SELECT r, kind, rank, low, live, concat_ws(':', kind, low, high) AS w FROM c JOIN own USING (v) WHERE kind <> 'opaque' OR live),
z AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
        string_agg(w, ',' ORDER BY low, rank) FILTER (kind <> 'opaque') AS base, string_agg(w, ',' ORDER BY low, rank) AS spans FROM e GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live FROM d LEFT JOIN z USING (r)"""}
