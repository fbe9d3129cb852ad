"""The operators against plain versions of the same rules, on small fixtures and the smallest tables."""

import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import chat_format, decontaminate, graph, language_id, mixing, quality_classifier, quality_rules, repeats, secrets, simhash, toxicity
from siftline.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, sql in SQL.items():
        ours, theirs = (df[sorted(df.columns)].astype(str).sort_values("doc_id").reset_index(drop=True) for df in (QUERIES[name](spark, DATA).toPandas(), con.sql(sql).df()))
        assert ours.equals(theirs), name


# 1 ---------------------------------------------------------------------------------------------------------------------


def plain_chances(line, role, state):
    """A line's score for a state from the tables alone."""
    c = chat_format
    m = re.match(r"(?i)\s*(user|assistant|q):\s*", line)  # the only markers in these texts
    rest = line[m.end() :] if m else line
    shows = {"asks": rest.rstrip().endswith("?"), "greets": bool(re.match(r"(?i)\s*hi\b", rest)), "instructs": rest.lower().startswith("you are"), "lists": bool(re.match(r"\s*\d+\. ", rest)), "long": len(rest) > 200}
    log = lambda x: round(1000 * float(np.log(x)))
    out = sum(log(p[state] if shows[k] else 1 - p[state]) for k, p in c.CHANCES.items())
    mark = c.MARKERS[m[1].lower()] if m else c.MARKERS.get(role or "")
    return out + (0 if mark is None else log(c.MARKED if c.ROLES[state] == mark else c.MISMARKED))


def plain_states(group):
    """The best states of a conversation's lines by trying every sequence; the first of equals from the last line on."""
    lines = [(line, x[2] if i == 0 else None, i == 0) for x in group for i, line in enumerate((x[3] or "").split("\n"))]
    log = lambda x: round(1000 * float(np.log(x)))
    best = None
    for states in itertools.product(range(4), repeat=len(lines)):
        score, before = 0, 4
        for (line, role, first), s in zip(lines, states, strict=True):
            score += log((chat_format.BETWEEN_ROWS if first else chat_format.WITHIN_ROW)[before][s]) + plain_chances(line, role, s)
            before = s
        if best is None or (score, [-s for s in reversed(states)]) > best[:2]:
            best = score, [-s for s in reversed(states)], states
    return best[2]


def test_chat_equals_all_sequences(spark):
    r = random.Random(5)
    texts = ["User: hi?\nAssistant: yes", None, "", "You are a helper", "Q: what?", "1. a", "x" * 300]
    rows, size = [], {}
    while len(rows) < 40:  # of up to 6 lines a conversation
        row = (r.choice([*range(12), None]), r.randint(0, 40), r.choice(["user", "assistant", None, "bot", "weird"]), r.choice(texts))
        size[row[0]] = size.get(row[0], 0) + (row[3] or "").count("\n") + 1
        if size[row[0]] <= 6:
            rows.append(row)
        elif all(size.get(c, 0) >= 6 for c in [*range(12), None]):
            break
    key = lambda x: tuple((v is not None, v if isinstance(v, int) else (v or "").encode()) for v in (x[0], x[1], x[3], x[2]))
    want = []
    for _, group in itertools.groupby(sorted(rows, key=key), key=lambda x: x[0]):
        group = list(group)
        states, at = plain_states(group), 0
        for x in group:
            lines = [re.sub(r"(?i)^\s*(user|assistant|q):\s*", "", line) for line in (x[3] or "").split("\n")]
            runs = itertools.groupby(zip(states[at : at + len(lines)], lines, strict=True), key=lambda y: y[0])
            want += [(x[0], x[1], part, x[2], chat_format.ROLES[s], "\n".join(y[1] for y in run).strip("\n")) for part, (s, run) in enumerate(runs)]
            at += len(lines)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (1, 2, 512):
        got = [tuple(x)[:6] for x in chat_format.chat_format(df, block).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_chat_recovers_roles(spark):
    rows = [(1, 0, None, "You are a helpful assistant."), (1, 1, None, "Hi, what is the time?"), (1, 2, None, "It is noon."), (2, 0, "human", "User: a\nAssistant: b")]
    got = {(r["conv_id"], r["turn"], r["part"]): (r["role"], r["text"]) for r in chat_format.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t, 0][0] for t in range(3)] == ["system", "user", "assistant"]
    assert got[2, 0, 0] == ("user", "a") and got[2, 0, 1] == ("assistant", "b")


# 2 ---------------------------------------------------------------------------------------------------------------------


def removed(rows, length):
    seen = Counter(hashlib.md5(b[p : p + length]).digest() for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - length + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[hashlib.md5(b[p : p + length]).digest()] > 1:
                gone[p : p + length] = True
        gone = gone[: len(b)]
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, docs):
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op2_repeats"](spark, DATA).collect()} == removed(docs, 400)


@pytest.mark.parametrize("group", [2000, 3])
def test_repeats_of_low_entropy(spark, group):
    r = random.Random(3)
    base = ["".join(r.choice("ab c") for _ in range(60)) for _ in range(6)]
    rows = [(i, "".join(r.choice(base)[r.randint(0, 20) :] if r.random() < 0.4 else "".join(r.choice("abcdefghé") for _ in range(30)) for _ in range(r.randint(0, 14)))) for i in range(80)]
    rows += [(500, None), (501, ""), (502, "a" * 300), (503, "b" * 39), (504, "b" * 40)]
    got = {x[0]: tuple(x)[1:] for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, group).collect()}
    assert got == removed(rows, 40)


def test_suffix_array():
    words = [b"banana", b"band", b"", b"ban", b"banana"]
    rank, lcp = repeats.suffix_array(words)
    assert sorted(words) == [words[i] for i in np.argsort(rank)] and lcp.tolist() == [0, 0, 3, 6, 3]


# 3 ---------------------------------------------------------------------------------------------------------------------


def test_language(spark):
    out = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in out.collect())


def test_language_masks_are_exact_sets(spark):
    df = spark.createDataFrame([(i, t, lang, "s") for i, (t, lang) in enumerate([("alpha beta gamma", "x"), ("delta epsilon zeta", "y")] * 3) if zlib.crc32(str(i).encode()) % 3 != 1], "doc_id long, text string, lang string, source string")
    m = language_id.train(df)
    assert language_id.identify("beta alpha", m)[0] == "x" and language_id.identify("zeta", m)[0] == "y"
    assert language_id.identify("12 !", m) == ("und", 0.0) and language_id.identify(None, m) == ("und", 0.0)


# 4 ---------------------------------------------------------------------------------------------------------------------


def base_spans(text):
    patterns = (
        ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    return sorted((m.start(), n, kind, m.end()) for n, (kind, p, ok) in enumerate(patterns) for m in re.finditer(p, text or "") if ok(m))


def test_secrets(spark, docs):
    extra = [(10**6, 'secret=token"=abcdefgh é password : "hunter22" toKEN=ſabc KEY AKIAAKIA' + "Z" * 20 + " " + "ab01" * 6), (10**6 + 1, "apikey=xy, API_KEY = 'abcdef'")]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs + extra], "doc_id long, text string, source string")
    got = {r["doc_id"]: [s for s in r["spans"] if s["kind"] != "opaque"] for r in secrets.scan(df, keep=("doc_id",)).collect()}
    for i, t in docs + extra:
        assert [(s["low"], s["kind"], s["high"]) for s in got[i]] == [(a, k, b) for a, _, k, b in base_spans(t)]


def test_ownership(spark):
    wide, own = "token = 'AAAAbbbb1111'", "token = 'CCCCdddd2222'"
    df = spark.createDataFrame([(i, wide, f"s{i}") for i in range(5)] + [(9, own, "s9"), (10, own + " and " + wide, "s9")], "doc_id long, text string, source string")
    live = {r["doc_id"]: [s["live"] for s in r["spans"]] for r in secrets.scan(df, keep=("doc_id",)).collect()}
    assert live[0] == [False] and live[9] == [True] and live[10] == [True, False]
    text = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert text[0] == wide and text[9] == "token = '[assign]'" and text[10] == "token = '[assign]' and " + wide


def test_hot_values_are_split(spark):
    """The joins on a key that most rows share are cut into several tasks."""
    conf = {"adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "adaptive.advisoryPartitionSizeInBytes": "20KB", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in conf}
    other = F.concat(F.lit("token = 'Z"), F.md5(F.col("id").cast("string")), F.lit("'"))
    df = spark.range(100_000, numPartitions=16).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 != 0, "token = 'AAAAbbbb1111'").otherwise(other).alias("text"), F.lit("s").alias("source"))
    try:
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.{k}", v)
        for out in (secrets.scan(df, keep=("doc_id",)), simhash.near_duplicates(df)):
            assert len(out.collect()) == 100_000
            assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


# 5 ---------------------------------------------------------------------------------------------------------------------


def test_decontamination(spark, docs):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] + [("900", "the"), ("901", docs[0][1][:30])]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    find = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for name, t in items:
        w = find(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(name)
    want = {}
    for i, t in docs:
        w, hit, its = find(t), set(), set()
        for n in set(map(len, windows)):
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    its |= found
                    hit |= set(range(k, k + n))
        want[i] = (len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    for chars in (4_000_000, 800):
        got = {r["doc_id"]: tuple(r)[1:6] for r in decontaminate.contamination(df, bench, block_chars=chars).collect()}
        assert got == want


def test_proximity(spark):
    df = spark.createDataFrame([(1, "red x blue y green"), (2, "red " + "x " * 30 + "blue green"), (3, "green blue red")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "red blue green")], "item_id long, text string")
    near = {r["doc_id"] for m in decontaminate.matches(df, bench, slack=2) for r in m.collect() if r["items"]}
    assert near == {1, 3}


# 6, 8 ------------------------------------------------------------------------------------------------------------------


def test_string_kernel():
    def plain(s, t, p, decay):
        return sum(decay ** (i[-1] - i[0] + j[-1] - j[0] + 2) for i in itertools.combinations(range(len(s)), p) for j in itertools.combinations(range(len(t)), p) if all(s[a] == t[b] for a, b in zip(i, j, strict=True)))

    s, t = [b"idiot", b"idxiot", b"thation", b"io"], [b"idiot", b"clown"]
    assert np.allclose(toxicity.kernels(s, t), [[plain(a, b, toxicity.ORDER, toxicity.DECAY) for b in t] for a in s], atol=1e-5)
    assert np.allclose(toxicity.own_kernel(s), [plain(a, a, toxicity.ORDER, toxicity.DECAY) for a in s], atol=1e-5)
    s = np.frombuffer(b"".join(x.ljust(8, b"\0") for x in s), np.uint8).reshape(4, 8)
    assert toxicity._common(s, s[:1, :5]).ravel().tolist() == [5, 5, 2, 2]
    strings, unit, place, text = toxicity.units([b"You i-d-i-o-t, i d i o t! Stu pid.", b"", b"no"])
    held = {(strings[u].decode(), int(p), int(text[p])) for u, p in zip(unit, place, strict=True)}
    assert held == {("^you", 0, 0), ("^idiot", 0, 0), ("^youidiot", 0, 0), ("^idiotidiot", 0, 0), ("^stu", 1, 0), ("^pid", 1, 0), ("^stupid", 1, 0), ("^no", 3, 2)} | {x for x in held if x[1] == 3}


INSULTS = "trash pathetic idiot disgusting worthless stupid clown loser scum moron".split()  # those of the test tables
WRITTEN = {"gap": lambda w, k: w[:k] + " " + w[k:], "inserted": lambda w, k: w[:k] + "xqzv"[k % 4] + w[k:], "dotted": lambda w, k: ".".join(w), "spelled": lambda w, k: " ".join(w)}


def test_disguised_insults_are_caught(spark):
    """Held-out toxic texts, each of their insults with a gap across a space, a letter inserted, dotted or spelled: recall 0.9 or more."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    held = docs.join(labels.filter("toxic = 1").select("doc_id").distinct(), "doc_id").filter("crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0")
    texts = [r["text"] for r in held.select("text").collect() if re.search("|".join(INSULTS), r["text"])]
    clean = [r["text"].encode() for r in docs.join(labels.filter("toxic = 0").select("doc_id").distinct(), "doc_id").orderBy("doc_id").limit(400).select("text").collect()]
    assert len(texts) >= 40 and (toxicity.scores(clean, model) >= 0.5).mean() <= 0.03
    for write in WRITTEN.values():
        changed = [re.sub("|".join(INSULTS), lambda m: write(m[0], 1 + (m.start() + i) % (len(m[0]) - 1)), t).encode() for i, t in enumerate(texts)]
        assert (toxicity.scores(changed, model) >= 0.5).mean() >= 0.9


def test_toxicity_does_not_depend_on_hash_seeds():
    """Two interpreters with other orders of sets fit the same model and give the same scores."""
    code = """if 1:
        from siftline.llm import toxicity
        toxic = [f"so you are a {w} and a {v}. really." .encode() for w in ("idiot", "moron", "clown") for v in ("loser", "scum", "trash", "idiot")] * 3
        other = [f"the {a} of the {b} was fine. it is.".encode() for a in ("house", "garden", "street", "river") for b in ("town", "village", "north", "idiom")] * 4
        model = toxicity.fit(toxic, other, {0: 64, 1: 36})
        print(model.landmarks, toxicity.scores(toxic + other + [b"what an id iot", b""], model).tolist())"""
    root = str(Path(__file__).resolve().parents[2])
    out = [subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": seed, "PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout for seed in ("1", "2")]
    assert out[0] == out[1] and "^idiot" in out[0]


def test_language_filters_equal_plain_sets(spark):
    """Bit-sliced filters against a set of slots for each language, counts and corrected decisions included."""
    texts = {"en": ["the house of the town", "the road to the town"], "de": ["das haus in der stadt", "die strasse in der stadt"], "xx": ["zq zq zq"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate([(x, t) for x, ts in texts.items() for t in ts * 30])]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), slots=1 << 12)
    assert set(model.languages) == set(texts) and model.masks.shape == (1, 1 << 12)
    slots = {x: {p for p in range(1 << 12) if int(model.masks[0, p]) >> i & 1} for i, x in enumerate(model.languages)}
    grams = lambda t: {f" {t} ".encode()[k : k + 5] for k in range(len(t) + 2 - 4)}

    def places(g):
        h = int.from_bytes(g, "big") * 0x9E3779B97F4A7C15 % (1 << 64)
        return [h >> 52, h * 0xC2B2AE3D27D4EB51 % (1 << 64) >> 52]

    for x, ts in texts.items():
        # what only this language's texts hold is in its filter
        assert all(set(places(g)) <= slots[x] for t in ts for g in grams(t) if not any(g in grams(o) for y, os_ in texts.items() if y != x for o in os_))
    for t in ("the town house", "in der strasse", "zq zq", "the das zq road", "qqqqqqqq"):
        found = [sum(all(p in slots[x] for p in places(g)) for g in grams(t)) for x in model.languages]
        got, n = language_id.counts(t.encode(), model)
        assert got.tolist() == found and n == len(grams(t))
        rates = [(len(slots[x]) / (1 << 12)) ** 2 for x in model.languages]
        true = [max(0.0, (c - n * p) / (1 - p)) for c, p in zip(found, rates, strict=True)]
        lang, score = language_id.identify(t, model)
        assert lang == model.languages[true.index(max(true))] and abs(score - (max(true) / sum(true) if sum(true) else 0)) < 1e-12


def test_long_texts_teach_languages(spark):
    rows = [(i, "eins zwei drei vier " * 4000, "de") for i in range(6)] + [(i + 10, "one two three four", "en") for i in range(6)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert language_id.identify("eins zwei drei", model)[0] == "de" and language_id.identify("two three", model)[0] == "en"


def test_quality_scores_equal_plain_sizes():
    """The difference of whole-text sizes, piece by piece, with fresh compressors, and the curve over it."""
    good, bad = b"the quick brown fox jumps over the lazy dog. " * 40, b"BUY NOW!!! cheap pills $$$ click here. " * 40
    model = quality_classifier.Model(good, bad, 30.0, -1.0, 0.05, 64)

    def size(piece, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False).compress(piece))

    for text in (b"the quick brown fox " * 9, b"click here cheap pills " * 9, b"x", "größe".encode() * 50):
        pieces = [text[a : a + 64] for a in range(0, len(text), 64)]
        diff = (sum(size(p, bad) - size(p, good) for p in pieces) + 256 * 0.05) / (len(text) + 256)
        assert abs(quality_classifier.difference(text, model) - diff) < 1e-12
        assert abs(quality_classifier.score(text, model) - 1 / (1 + np.exp(-(30 * diff - 1)))) < 1e-12
    assert quality_classifier.score(b"the quick brown fox jumps " * 5, model) > 0.7 > quality_classifier.score(b"BUY NOW!!! cheap pills " * 5, model)


def auc(score, y):
    order = np.argsort(np.argsort(score))
    y = np.array(y) == 1
    return (order[y].mean() - (y.sum() - 1) / 2) / (~y).sum()


@pytest.mark.parametrize("name,label,least", [("op6_toxicity", "toxic", 0.85), ("op8_quality_classifier", "quality", 0.9)])
def test_classifiers_on_held_out_labels(spark, name, label, least):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", label).distinct()
    held = QUERIES[name](spark, d).filter("held_out").join(labels, "doc_id").select("score", label).collect()
    assert auc([r["score"] for r in held], [r[label] for r in held]) >= least


def test_quality_reads_whole_texts(spark):
    good, bad = b"plain words of good prose here " * 20, b"BUY!! NOW!! $$$ ### "
    m = quality_classifier.Model(good * 5, bad * 50, 50.0, 0.0)
    assert quality_classifier.score(good * 5 + bad * 400, m) < quality_classifier.score(good * 5, m)


# 7 ---------------------------------------------------------------------------------------------------------------------


def test_rules_against_plain_python(spark, docs):
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert got[i] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))


def test_rules_use_no_python(spark):
    plan = quality_rules.quality_rules(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# 9 ---------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> k & 1 for g in grams) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(grams)) if grams else 0


def joined(values, near):
    root = {x: x for x in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if near(a, b):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {x: find(x) for x in values}


def test_simhash(spark, docs):
    prints = {i: plain_fingerprint(t) for i, t in docs}
    group = joined(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r[0]: (r[1], r[2]) for r in QUERIES["op9_simhash"](spark, DATA).collect()}
    assert got == {i: (f"{p:016x}", group[i]) for i, p in prints.items()}


@pytest.mark.parametrize("limit", [64, 1])
def test_simhash_dense_buckets(spark, limit):
    r = random.Random(1)
    values = set()
    for _ in range(200):
        v = 0x9E3779B97F4A7C15
        for _ in range(r.randint(0, 6)):
            v ^= 1 << r.randrange(64)
        values.add(v - (1 << 64) if v >> 63 else v)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, limit)
    roots = {x["node"]: x["root"] for x in graph.components(links).collect()}
    want = joined(sorted(values), lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    assert {v: roots.get(v, v) for v in values} == want


def test_long_chain_of_links(spark):
    df = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in graph.components(df).collect()} == {1}


# 10 --------------------------------------------------------------------------------------------------------------------


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("c", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    weights, bound = {"a": 5, "b": 2, "c": 1, None: 5}, {"a": 20, "b": 2000, "c": 0, None: 1000}
    want, rest = {}, 1.5 * 1510
    while True:  # excess is shared again until none is above its bound
        free = [s for s in weights if s not in want]
        share = {s: rest * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if share[s] > bound[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = float(bound[s])
            rest -= bound[s]
    assert got == pytest.approx(want)


def test_mix(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    plan = mixing.plan(df)
    for r in plan.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("copies").alias("m")).collect():
        assert abs(r["n"] - r["t"]) < 0.05 * r["t"] and r["m"] <= 2
    key = lambda d: sorted((r["doc_id"], r["copies"]) for r in d.filter("copies > 0").collect())
    emitted = mixing.mix(df).groupBy("doc_id").agg(F.count("*").cast("int").alias("copies"))
    assert key(plan) == key(emitted) == key(mixing.plan(df.repartition(7)))


# pipeline --------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, d).cache()
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op8_quality_classifier"](spark, d).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= 0.7}
    first = stages[1](spark, good, d).cache()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in good.collect()}
    group = joined(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert sorted(r["doc_id"] for r in first.collect()) == sorted(set(group.values()))
    clean = stages[2](spark, first, d).cache()
    hit = {r["doc_id"] for r in QUERIES["op5_decontaminate"](spark, d).filter("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in first.collect()} - hit
    masked = stages[3](spark, clean, d)
    assert masked.count() == clean.count() and masked.columns == docs.columns
    assert corpus_pipeline.run(spark, d).count() > 0
