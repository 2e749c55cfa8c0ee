import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import jaccard
from quillon.llm.components import connected_components


def brute(rows, words, percent):
    """``doc_id, n_shingles, component_id, links`` by position, all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    root, links = list(range(len(rows))), Counter()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((rows[i][0], len(sets[i]), least[top(i)], links[i]) for i in range(len(rows))), key=str)


def _found(spark, rows, words, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(0)).withColumn("sig", F.lit("s")).withColumn("t", F.lit(1.0))
    got = jaccard.near_duplicates(df, words=words, percent=percent)
    return sorted(((r.id, r.n_shingles, r.component_id) for r in got.collect()), key=str)


def _near_copies(rng, n, length, vocabulary, edits):
    base = [rng.choice(vocabulary) for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (2, 50)])
def test_against_brute_force(spark, words, percent, monkeypatch):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = _near_copies(rng, 25, 120, vocabulary, 6) + _near_copies(rng, 10, 30, vocabulary, 2)
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(20)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))) for _ in range(20)] + texts[:5] * 2 + [None, "", "  \n", "One", "one", "ONE two", "É é"]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)]
    want = sorted((x[:3] for x in brute(rows, words, percent)), key=str)
    assert _found(spark, rows, words, percent) == want
    # The same through blocks of frequent shingles, cut small, and through shuffles instead of broadcasts.
    monkeypatch.setattr(jaccard, "DENSE", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 500)
    monkeypatch.setattr(jaccard, "CLASSES", 4)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    assert _found(spark, rows, words, percent) == want


def test_sketches_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 600), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 63, rng.integers(1, 600), dtype=np.uint64)]))
        assert jaccard.differing(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_keep_one(spark):
    a = " ".join(f"w{i}" for i in range(60))
    c = " ".join(f"z{i}" for i in range(30))
    rows = [(3, a), (1, a + " tail"), (1, a + " tail"), (2, c), (2, a), (None, c), (7, None), (8, ""), (2, "quite another text with the same id"), (None, "only one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("th", F.lit("x")).withColumn("row", F.lit(0))
    out = jaccard.keep_one(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, a + " tail"), (2, c), (7, None), (8, ""), (2, rows[8][1]), (None, "only one")], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).count() == 0 and jaccard.keep_one(df).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.id, r.component_id) for r in jaccard.near_duplicates(none).collect()) == [(1, 1), (2, 2)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7), (999, 999)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    assert {r.node: r.root for r in connected_components(df).collect()} == {x: top(x) for x in root}
    assert connected_components(df.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Short near copies of one text: chunks that meet one chunk, not each other, and still one component."""
    import time

    rng = random.Random(11)
    base = [f"w{i}" for i in range(44)]
    texts = set()
    while len(texts) < 20_000:
        w = list(base)
        w[rng.choice((0, 43))] = f"x{rng.randrange(10**9)}"
        texts.add(" ".join(w))
    rows = list(enumerate(sorted(texts)))
    start = time.time()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80).groupBy("component_id").count().collect()
    assert [tuple(r) for r in got] == [(0, 20_000)] and time.time() - start < 100


def test_shingles_of_some_documents_bring_no_pairs(spark, monkeypatch):
    """Shingles that 24 documents share, and nothing else: documents have rarer ones to be found by, so no pair is made for them."""
    rng = random.Random(3)
    phrases = [" ".join(f"p{i}x{k}" for k in range(3)) for i in range(1000)]
    held = [[] for _ in range(800)]
    for phrase in phrases:
        for d in rng.sample(range(800), 24):
            held[d].append(phrase)
    texts = [" ".join(f"{phrase} u{d}x{i} u{d}y{i} u{d}z{i}" for i, phrase in enumerate(mine)) for d, mine in enumerate(held)]
    rows = list(enumerate([*texts, *(t + " tail" for t in texts[:20])]))
    made, write = {}, jaccard.materialize

    def counted(df, label="step"):
        made[label] = write(df, label)
        return made[label]

    monkeypatch.setattr(jaccard, "materialize", counted)
    got = _found(spark, rows, 3, 90)
    assert [c for _, _, c in got] == [c for _, _, c, _ in brute(rows, 3, 90)] and sum(d != c for d, _, c in got) == 20
    assert made["jaccard-met"].count() < 100


def test_disk_of_done_steps_is_free(spark, monkeypatch):
    """While the last steps run, shuffle files and tables of earlier ones are gone."""
    import time
    from pathlib import Path

    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))) for i in range(4000)]
    rows += [(i + 4000, t + " tail") for i, (_, t) in enumerate(rows[:50])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dirs = [Path(d.getPath()) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: sum(p.stat().st_size for d in dirs for p in d.rglob("shuffle_*.data") if p.exists())
    made, write = {}, jaccard.materialize

    def kept(df, label="step"):
        made[label] = write(df, label)
        return made[label]

    monkeypatch.setattr(jaccard, "materialize", kept)
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = shuffled()
    got = jaccard.near_duplicates(df, words=5, percent=80)
    time.sleep(2)  # files go beside the job
    assert shuffled() - before < 1_000_000  # 120,000 entries of prefixes alone are more
    for label in ("prefixes", "groups", "met", "blocks"):
        assert not any(Path(f.removeprefix("file://")).exists() for f in made[f"jaccard-{label}"].inputFiles())
    assert got.where("id <> component_id").count() == 50
