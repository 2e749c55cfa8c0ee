import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import embeddings


def brute(rows, cosine):
    ok = [(v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) and k is not None) for _, v, k in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], dtype=np.float64), np.array(rows[j][1], dtype=np.float64)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[top(i)] = top(j)
    least = {}
    for i in range(n):
        t = top(i)
        if rows[i][0] is not None:
            least[t] = min(least.get(t, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], links[i], least.get(top(i))) for i in range(n)), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = []
    for g in range(12):
        base = rng.standard_normal(32)
        for i in range(12):
            noise = rng.standard_normal(32) * rng.choice([0.0, 0.05, 0.12, 0.2])
            out.append((len(out), [float(np.float32(x)) for x in base + noise], g % 3))
    out += [(len(out) + i, v, k) for i, (v, k) in enumerate([(None, 1), ([], 1), ([0.0] * 32, 1), ([float("nan")] * 32, 1), ([1.0, float("inf")], 1), (out[0][1], None), (out[0][1], 0), (out[0][1], 0), ([2 * x for x in out[0][1]], 0), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([-1.0, -2.0], 0)])]
    return [*out, (None, out[5][1], 0), (3, out[5][1], 1)]


@pytest.mark.parametrize("block", [2048, 3])
def test_against_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BUCKET", block)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("cls", F.lit(1)).withColumn("v", F.lit(2))
    want = brute([(i, None if v is None else [float(np.float32(x)) for x in v], k) for i, v, k in rows], 0.98)
    got = embeddings.near_duplicate_vectors(df)
    assert sorted(((r.id, r.n_links, r.component_id) for r in got.collect()), key=str) == want


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [2e200, 2e200], 0), (3, [1e-200, 1e-200], 0), (4, [1e308, -1e308], 0), (5, [5e-324, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_marks_rule_out_nothing_at_the_threshold():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((4000, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 24))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + (1 - 0.98**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    marks = [embeddings.signatures(x, 8, 2)[1] for x in (a, b)]
    apart = np.bitwise_count(marks[0] ^ marks[1]).sum(axis=1)
    assert apart.max() <= embeddings.most_apart(0.98, 1e-8) < 40 and apart.mean() < 12


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicate_vectors(df).count() == 0


def test_tables_follow_the_chance_to_miss():
    for most in (10, 1000, 10**6, 10**9):
        bits, tables = embeddings.table_sizes(most, 0.98, 1e-6)
        agree = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - agree) ** tables <= 1e-6
