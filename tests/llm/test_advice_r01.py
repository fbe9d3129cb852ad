
import itertools
import random

import pytest

import corpus_pipeline
from siftline.llm import decontaminate, simhash

DOCS = "doc_id long, text string, lang string"


def test_keep_clean_judges_rows(spark):
    leak = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([("q", leak)], "item_id string, text string")
    rows = [(None, f"so {leak} so", "a"), (None, "clean without an id", "a"), (None, None, "a"), (1, leak, "a"), (1, "clean with the id", "a"), (2, "clean", None)]
    kept = decontaminate.keep_clean(spark.createDataFrame(rows, DOCS).repartition(3), bench)
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if leak not in (r[1] or ""))


def test_keep_first_keeps_one_row_of_each_component(spark):
    one, two, three = ("".join(f"{w}{i} " for i in range(40)) for w in ("alpha", "beta", "gamma"))
    rows = [(5, one, "a"), (7, one, "b"), (7, two, "c"), (None, one, "d"), (None, three, "e"), (None, three + " ", "f"), (9, three.upper(), "g"), (None, None, "h"), (None, "", "i")]
    kept = simhash.keep_first(spark.createDataFrame(rows, DOCS).repartition(3))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(r["lang"] for r in kept.drop("text").collect())[:3] == ["a", "c", "g"]
    assert kept.count() == 4 and kept.filter("lang IN ('h', 'i')").count() == 1


def shingle_set(text):
    found = text.lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def similar_groups(texts):
    """Brute force: the smallest number of each group of texts linked by a 5-word similarity of 0.8."""
    sets, root = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return root


def edited():
    """Texts with 0 to 8 words changed, over shared lines, in groups of up to 40; and short ones."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    line = " ".join(r.choices(words, k=25))
    texts = ["", "a", "a", "one two three", "One two  three", line, line + " x"]
    for size in (40, 12, *[3] * 15):
        base = r.choices(words, k=r.randint(30, 150))
        for _ in range(size):
            new = list(base)
            for _ in range(r.randint(0, 8)):
                new[r.randrange(len(new))] = r.choice(words)
            texts.append(" ".join(new) + (" " + line if r.random() < 0.3 else ""))
    return dict(enumerate(texts))


@pytest.mark.parametrize("limit", [64, 3])
def test_keep_similar_finds_all_of_brute_force(spark, limit):
    texts = edited()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], DOCS)
    kept = simhash.keep_similar(docs, pair_limit=limit)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(similar_groups(texts).values()))


def test_pipeline_stage_drops_similar_texts(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.keep_one_of_each(spark, docs, d)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(similar_groups(texts).values()))
