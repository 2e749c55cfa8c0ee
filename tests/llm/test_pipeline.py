from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from quillon.llm import jaccard, mixing, toxicity
from quillon.llm.common import read_table
from tests.llm.test_bpe import reference  # noqa: F401
from tests.llm.test_jaccard import brute
from tests.llm.test_secrets import base


def test_stages_one_by_one(spark, sf_dir, reference):  # noqa: F811
    docs = read_table(spark, sf_dir, "documents").cache()
    rows = {r.doc_id: r for r in docs.collect()}

    clean = P.drop_toxic(spark, docs, sf_dir).cache()
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    g = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    weigh = g.reader().weigh
    assert {r.doc_id for r in clean.collect()} == {d for d, r in rows.items() if g.score(weigh(r.text or ""), len(r.text or "")) < 0.3}

    single = P.drop_near_copies(spark, clean, sf_dir).cache()
    assert single.columns == docs.columns
    left = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c if n else d for d, n, c, _ in brute(left, 5, 80)})

    masked = P.mask_secrets(spark, single, sf_dir).cache()
    assert masked.columns == docs.columns and masked.count() == single.count()
    for r in masked.collect():
        spans = base(rows[r.doc_id].text or "")
        assert not base(r.text or "") or "[SECRET]" in r.text
        assert (r.text == rows[r.doc_id].text) or "[SECRET]" in r.text
        assert not spans or "[SECRET]" in r.text
        assert r.n_chars == (len(r.text) if "[SECRET]" in (r.text or "") else rows[r.doc_id].n_chars)

    mixed = P.mix_sources(spark, masked, sf_dir).cache()
    assert mixed.columns == docs.columns
    size = lambda t: len((t or "").encode().split())
    sums = Counter()
    for r in masked.collect():
        sums[r.source] += size(r.text)
    goal, taken, times = mixing.targets(sums), Counter(), Counter()
    for r in mixed.collect():
        taken[r.source] += size(r.text)
        times[r.doc_id] += 1
    assert max(times.values()) <= 3
    largest = max(size(r.text) for r in masked.collect())
    assert all(abs(taken[s] - goal[s]) <= largest for s in goal)

    tokens = P.to_tokens(spark, mixed, sf_dir).collect()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert Counter(r.doc_id for r in tokens) == times
    assert all(list(r.ids) == reference.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in tokens)


def test_stages_take_odd_rows(spark, sf_dir):
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "some words in a row here", None, None, 3), (2, "some words in a row here", None, None, 3), (3, "token=abcdefghijklmnopqr " * 2000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, cols).withColumn("row", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("spans", F.lit(2.0)).withColumn("mx", F.lit(3)).withColumn("th", F.lit(4))
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in P.STAGES[:-1]:
            now = stage(spark, now, sf_dir).cache()
            assert now.columns == docs.columns
        assert P.to_tokens(spark, now, sf_dir).count() == now.count()


def test_run(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "tokens"]
    assert P.run(spark, sf_dir).count() > 0


def test_empty_classes_of_documents_stay(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert jaccard.keep_one(docs).count() == 3
