import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import fingerprint as fp
from quillon.llm import neighbours
from quillon.llm.queries import op3_fingerprints


def _vectors(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", F.lit(1))
    return {r.doc_id: list(r.fingerprint) for r in fp.fingerprints(df).collect()}


def test_order_does_not_matter_but_content_does(spark):
    paras = [f"Paragraph number {i} says something." for i in range(30)]
    mixed = random.Random(1).sample(paras, len(paras))
    v = _vectors(spark, ["\n".join(paras), "\n".join(mixed), "\n".join(paras[:-1]), "\n".join([*paras, paras[0]]), None, "", "\n\n"])
    assert v[0] == v[1] and len({tuple(v[i]) for i in (0, 2, 3, 4)}) == 4
    assert v[4] == v[5] == v[6] == [0] * fp.WIDTH
    assert v[0][-1] == 30 and v[3][-1] == 31
    assert all(0 <= x < 1 << 32 for x in v[0][: fp.DENSE]) and all(0 <= x < 1 << 16 for x in v[0][fp.DENSE : -1])


def test_insertion_and_deletion_by_adding_vectors(spark):
    whole, a, b = "One. Two.\nThree.", "One. Three.", "Two."
    df = spark.createDataFrame([(whole, a, b)], "w string, a string, b string")
    row = df.select(
        (fp.combine(fp.vector(F.col("a")), fp.vector(F.col("b"))) == fp.vector(F.col("w"))).alias("put"),
        (fp.combine(fp.vector(F.col("w")), fp.vector(F.col("b")), -1) == fp.vector(F.col("a"))).alias("taken"),
    ).first()
    assert row.put and row.taken


def test_likeness_follows_the_shared_part(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        n = rng.choice([10, 40, 200])
        own = [f"Sentence {i} {k} {rng.random()}." for k in range(n)]
        share = rng.choice([0.0, 0.5, 0.9, 1.0])
        other = own[: int(n * share)] + [f"Other {i} {k} {rng.random()}." for k in range(n - int(n * share))]
        rows.append((share, " ".join(own), "\n".join(other)))
    df = spark.createDataFrame(rows, "share double, a string, b string")
    got = df.select("share", fp.likeness(fp.vector(F.col("a")), fp.vector(F.col("b"))).alias("l")).groupBy("share").agg(F.avg("l").alias("l"), F.min("l").alias("lo"), F.max("l").alias("hi")).collect()
    mean = {r.share: r.l for r in got}
    assert mean[1.0] == 1.0 and mean[0.0] < 0.2 and abs(mean[0.5] - 0.5) < 0.2 and abs(mean[0.9] - 0.9) < 0.1
    assert all(0 <= r.lo <= r.hi <= 1 for r in got)


def test_query_against_plain_python(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs.sort(key=lambda r: -r[0])
    got = {r.doc_id: r for r in op3_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    seen = {}
    for (d, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        n, k = len(t), len(t) // 3
        assert got[d].n_chars == n and got[d].edited_sha256 == hashlib.sha256((t[: n - k] + nxt[:k]).encode()).hexdigest()
        assert seen.setdefault(t, got[d].fingerprint) == got[d].fingerprint
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.8 * len(got)


@pytest.mark.parametrize("keys", [[], [5], [5, 5], [3, 1, 2], list(range(0, 5000, 7)), [None, 1, None], [-(1 << 62), 0, 1 << 62]])
def test_successors(spark, keys):
    from pyspark.sql import Window

    df = spark.createDataFrame([(k,) for k in keys], "k long")
    placed = neighbours.with_guests(df, F.col("k"), F.col("k"), rows_per_bucket=8)
    falling = Window.partitionBy("nb_bucket").orderBy("nb_guest", F.desc("nb_key"))
    got = placed.withColumn("next", F.lead("nb_key.k").over(falling)).where("nb_guest = 0").withColumn("nb_key", F.col("nb_key.k")).collect()
    order = sorted((neighbours.LOWEST if k is None else k for k in keys), reverse=True)
    assert sorted((r.nb_key, r.next) for r in got) == sorted(zip(order, order[1:] + order[:1]))


def test_plan_has_no_python(spark, sf_dir):
    plan = op3_fingerprints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _overlap(a, b):
    """Exact share of occurrences that two lists of paragraphs have in common."""
    a, b = Counter(a), Counter(b)
    return 2 * (a & b).total() / (a.total() + b.total())


def _held_against_overlap(spark, pairs):
    """Four standard errors of what is not shared: sqrt(2 / SKETCH) of 1 - overlap."""
    df = spark.createDataFrame([(i, "\n".join(a), "\n".join(b)) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    got = {r.i: r.l for r in df.repartition(8).select("i", fp.vector(F.col("a")).alias("a"), fp.vector(F.col("b")).alias("b")).select("i", fp.likeness(F.col("a"), F.col("b")).alias("l")).collect()}
    for i, (a, b) in enumerate(pairs):
        exact = _overlap(a, b)
        assert abs(got[i] - exact) <= 4 * (2 / fp.SKETCH) ** 0.5 * (1 - exact), (i, exact, got[i])
    return got


def test_likeness_counts_each_occurrence(spark):
    one, ten = ["The same line."], [f"Line {i} of another text." for i in range(10)]
    pairs = [
        (one * 1000, ten),
        (one * 1000, ten + one * 500),
        (one * 1000, one * 10),
        (one * 300 + ten * 30, ten * 40 + ["Third."] * 200),
        (one * 50 + ten, one * 49 + ten),
        (ten * 20, [f"Other {i}." for i in range(10)] * 20),
    ]
    got = _held_against_overlap(spark, pairs)
    assert got[0] < 0.5 and got[5] < 0.5 and got[4] > 0.95


def test_repeated_paragraphs_add_up(spark):
    df = spark.createDataFrame([("\n".join(["a", "b"] * 9), "\n".join(["b"] * 4), "\n".join(["a"] * 9 + ["b"] * 13))], "a string, b string, w string")
    assert df.select((fp.combine(fp.vector(F.col("a")), fp.vector(F.col("b"))) == fp.vector(F.col("w"))).alias("put")).first().put


def test_likeness_of_long_texts(spark):
    pairs = []
    for n in (1_250, 2_000, 20_000, 100_000):
        own, other = [f"Line {i}." for i in range(n // 2)], [f"Other {i}." for i in range(n // 2)]
        pairs += [(own, other), (own, own[: n // 3] + other[n // 3 :])]
    got = _held_against_overlap(spark, pairs)
    assert all(got[i] < 0.6 for i in range(0, len(pairs), 2))


def test_null_ids_spread_over_buckets(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 50 == 0, F.col("id")).alias("k"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    sizes = [r["count"] for r in neighbours.with_guests(df, F.col("k"), F.col("text"), rows_per_bucket=2000).where("nb_guest = 0").groupBy("nb_bucket").count().collect()]
    assert sum(sizes) == 200_000 and len(sizes) > 50 and max(sizes) <= 2.5 * 2000
    same = spark.range(20_000).select(F.lit(None).cast("long").alias("k"), F.lit("x").alias("text"))  # rows that agree in all
    assert neighbours.with_guests(same, F.col("k"), F.col("text")).where("nb_guest = 0").count() == 20_000


def test_an_edit_hashes_what_is_shared_once(spark):
    rows = [("a\nb\nc", "a\nb\nd"), ("a\nb", "a\nb"), ("a", "a\nb"), ("a\nb", "a"), ("", "x"), ("x", ""), (None, None), (None, "a"), ("x\ny", "y\nx"), ("One. Two. Thr", "One. Two. Xyz. Z")]
    df = spark.createDataFrame(rows, "text string, edited string").withColumn("fp_own", F.lit(1))
    for r in fp.fingerprints_of_edit(df, "text", "edited", "a", "b").withColumn("x", fp.vector(F.col("text"))).withColumn("y", fp.vector(F.col("edited"))).collect():
        assert (r.a, r.b) == (r.x, r.y), r.text
