import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import langid, toxicity
from quillon.llm.queries import op4_toxicity, op8_language


def _held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def grammar():
    return toxicity.Grammar(lexicon={"moron": 2.0, "trash": 2.0, "vequ*": 2.0, "oaf": 0.5}, bias=-5.0, slope=0.5, dense=4.0)


@pytest.fixture(scope="module")
def weigh(grammar):
    return grammar.reader().weigh


def test_clauses_and_modifiers(weigh):
    plain = weigh("What a moron.")
    assert plain == 2.0
    assert weigh("You are a moron.") == weigh("Moron that you are") == plain + toxicity.DIRECTED
    assert 0 < weigh("He is not a moron.") < weigh("She said he is a moron.") < plain < weigh("He is a moron.")
    assert weigh("I will kill you") == weigh("you he will kill") == toxicity.THREAT and weigh("kill the process") == 0
    assert 0 < weigh("he said i will kill you") < toxicity.THREAT and weigh("I will not kill you") == 0
    assert weigh("a moron. More trash!\nthe vequina") == 6.0
    assert weigh("") == 0 and weigh("trashy novels") == 0 and weigh("A MORON") == 2.0
    assert toxicity.Grammar().reader().weigh("nothing learned, kill you") > 0


def test_isolated_words_weigh_nothing(weigh, grammar):
    for text in ("moron", "moron!", "Moron. Trash! moron\ntrash", "moron trash, moron"):
        assert weigh(text) == 0 and grammar.score(0.0, len(text)) < 0.3
    assert weigh("oaf, moron in a clause") == 2.0  # of what came before the first other word, the heaviest counts


def test_scores_of_clauses(weigh, grammar):
    score = lambda t: grammar.score(weigh(t), len(t))
    assert score("you are a moron") >= 0.3 > score("he said you are not a moron")
    assert score("they called him a moron and i told them never to say that") < score("you are a moron")


def test_negation_reaches_three_words(weigh):
    assert weigh("not a big moron") < 2.0 and weigh("not one of those very big moron") == 2.0


def _one_by_one(symbols):
    """Weight of a clause: each transducer reads all that the one before it wrote."""
    total = 0.0
    for make in toxicity.CASCADE:
        part = make()
        state, out = part.start, []
        for s in symbols:
            state, written, weight = part.step(state, s)
            out.append(written)
            total += weight
        symbols = out
    return total


def test_composition_is_the_cascade():
    table = toxicity.machine()
    rng = random.Random(4)
    for _ in range(3000):
        symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randrange(12))]
        state, total = 0, 0.0
        for s in symbols:
            state, weight = table[state][s]
            total += weight
        assert total == pytest.approx(_one_by_one(symbols))
    assert all(set(row) == set(toxicity.SYMBOLS) for row in table)


def test_long_texts_take_linear_time(weigh):
    import time

    took = {}
    for n in (200_000, 800_000):
        for text in ("abc moron " * (n // 10), "moron abc. " * (n // 11), "moron " * (n // 6), "x" * n + " moron", "moron! " * (n // 7)):
            start = time.time()
            weigh(text)
            took[n] = max(took.get(n, 0.0), time.time() - start)
    assert took[800_000] < 8 * took[200_000] + 0.5 and took[800_000] < 2


def test_fit_and_score(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    bad = ["zzmoron", "yyscum", "xxfool"]
    docs, labels = [], []
    for i in range(800):
        toxic = i % 8 == 0
        w = [rng.choice(words) for _ in range(60)]
        for _ in range(3 * toxic):
            w[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "s"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(None, None), (1000, ""), (1001, "a zzmoron " * 50_000), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("y", F.lit(2))
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    g = toxicity.fit(df, lab)
    got = toxicity.score(df, g).collect()
    assert all(0 <= r.toxicity <= 1 for r in got) and len(got) == len(docs)
    right = [(r.toxicity >= 0.3) == bool(labels[r.doc_id][1]) for r in got if r.doc_id is not None and r.doc_id < 800 and _held(r.doc_id)]
    assert sum(right) > 0.95 * len(right)
    by = {r.doc_id: r.toxicity for r in got}
    assert by[1000] == by[None] < 0.3 and by[1001] >= 0.3


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} {'badterm' if i % 5 == 0 else 'fine'} x") for i in range(400)], "doc_id long, text string")
    labels = [(i, int(i % 5 == 0)) for i in range(400)]
    flipped = [(i, 1 - y if _held(i) else y) for i, y in labels]
    one, two = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert one == two


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) == toxicity.Grammar()
    assert toxicity.score(docs.limit(0), toxicity.Grammar()).count() == 0


def test_toxicity_query(spark, sf_dir):
    got = op4_toxicity(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == _held(r.doc_id) and r.predicted == (r.score >= 0.3) for r in got)


def test_held_out_accuracy(spark):
    """At least nine of ten toxic documents, and at most one of a hundred others."""
    d = "/root/testdata/sf0.1"
    got = op4_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("toxic is not null")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0))


# -- languages ---------------------------------------------------------------------------------------
def test_normalise():
    as_text = lambda t: "".join(map(chr, langid.normalise(t)))
    assert as_text("Hello,  Wörld 12!") == " hello wörld " and as_text("12 !") == "" == as_text(None) and as_text("a") == " a "


def _naive(texts, order, discount, letters):
    """Interpolated Kneser-Ney by the definition, over dictionaries of strings."""
    from collections import Counter, defaultdict

    counts = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        s = "".join(map(chr, langid.normalise(t)))
        for k in counts:
            counts[k].update(s[i : i + k] for i in range(len(s) - k + 1))
    for k in range(1, order):
        left = defaultdict(set)
        for g in counts[k + 1]:
            left[g[1:]].add(g[0])
        counts[k] = Counter({g: len(left[g]) or 1 for g in counts[k]})

    def p(g):
        k = len(g)
        if k == 0:
            return 1.0 / letters
        near = {h: n for h, n in counts[k].items() if h[:-1] == g[:-1]}
        if not near:
            return p(g[1:])
        total = sum(near.values())
        return max(counts[k][g] - discount, 0) / total + discount * len(near) / total * p(g[1:])

    return p


def test_probabilities_are_kneser_ney(spark):
    import math

    texts = ["the cat sat on the mat", "that hat", "a bat and a rat at that"]
    rows = spark.createDataFrame([("en", t) for t in texts], "lang string, t string")
    m = langid._build(langid._count(rows).toPandas(), ["en"])
    letters = len(m.hashes[0]) + 1
    p = _naive(texts, langid.ORDER, langid.DISCOUNT, letters)
    for text in texts:
        x = langid.normalise(text)
        got = m._rows(x, langid.ORDER)[:, 0]
        s = "".join(map(chr, x))
        want = [math.log(p(s[i : i + langid.ORDER])) for i in range(len(s) - langid.ORDER + 1)]
        assert got == pytest.approx(want, abs=1e-9)


def test_langid_on_frames(spark):
    rng = random.Random(2)
    syllables = {"xx": ["ka", "to", "mi"], "yy": ["sch", "ung", "der"], "zz": ["éau", "oir", "que"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(20)), lang))
    rows += [(1000, None, "xx"), (1001, "123 !?", "xx"), (1002, "", None), (None, "katomi", None), (1003, "mika " * 300_000, None), (1004, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("t", F.lit(1)).withColumn("place", F.lit(2))
    models = langid.fit(df, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False)))
    got = langid.identify(df, models).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, _, lang in rows[:600])
    assert by[1000].lang_pred == by[1001].lang_pred == by[1002].lang_pred == "und" and by[1000].score == 0 and not by[1000].accepted
    assert by[1003].lang_pred == "xx" and by[None].lang_pred == "xx" and by[1004].lang_pred in syllables
    odd = langid.identify(spark.createDataFrame([(1, "wzwzwz pwpw vzvz wpwp " * 20)], "doc_id long, text string"), models).first()
    assert odd.lang_pred in syllables and not odd.accepted


def test_langid_without_rows(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    models = langid.fit(df, F.lit(True))
    assert langid.identify(df, models).first().lang_pred == "und" and langid.identify(df.limit(0), models).count() == 0


def test_language_query(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op8_language(spark, sf_dir).collect()
    assert len(got) == len(docs) and all(r.held_out == _held(r.doc_id) for r in got)
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert sum(right) >= 0.9 * len(right)
