import random

import pytest

from quillon.llm import bpe, common
from quillon.llm.queries import tokenizer

regex = pytest.importorskip("regex")
PATH, PATTERN = tokenizer()


@pytest.fixture(scope="module")
def encoder(spark):
    return bpe.Encoder(bpe.load_ranks(spark, PATH))


@pytest.fixture(scope="module")
def reference(spark):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(spark, PATH), special_tokens={})


def _encode(encoder, text):
    import numpy as np

    return np.frombuffer(bpe.encode_text(text, bpe._Remembered(encoder), regex.compile(PATTERN)), "<u4").tolist()


def test_random_texts(encoder, reference):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABC0123456789 \n\t'\"éüßñ漢字😀__--==    ́ٱ٢"
    for _ in range(3000):
        pool = letters[: rng.choice([2, 3, 10, 30, len(letters)])]
        text = "".join(rng.choice(pool) for _ in range(rng.choice([1, 5, 20, 80])))
        assert _encode(encoder, text) == reference.encode_ordinary(text), text


def test_long_pieces_take_linear_time(encoder, reference):
    for text in ("=" * 20000, "ab" * 10000, "na" * 5000 + "x", " " * 5000 + "y", "aab" * 3000):
        assert _encode(encoder, text) == reference.encode_ordinary(text)
    import time

    began = time.time()
    _encode(encoder, "abcabd" * 100_000)
    assert time.time() - began < 20


def test_small_vocabulary_with_backtracking():
    """Longest matches that must be given up: every text over two letters up to a length, against plain merging."""
    import itertools

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bb": 257, b"abb": 258, b"ba": 259, b"aba": 260, b"bbab": 261, b"abab": 262}

    def merged(text):
        parts = [bytes([c]) for c in text]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    encoder = bpe.Encoder(ranks)
    for n in range(1, 11):
        for text in itertools.product(b"ab", repeat=n):
            piece = bytes(text)
            assert encoder.encode(piece) == ([ranks[piece]] if piece in ranks else merged(piece)), piece


def test_frames(spark, reference):
    rows = [(1, "Hello, wörld! 123", "x"), (1, "Hello, wörld! 123", "x"), (None, None, None), (3, "", "y"), (4, "a " * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("ids", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))
    out = bpe.encode(df, PATH, PATTERN)
    got = {r.doc_id: list(r.ids) for r in out.collect()}
    assert out.count() == 5 and got[None] == [] and got[3] == []
    assert got[1] == reference.encode_ordinary(rows[0][1]) and got[4] == reference.encode_ordinary(rows[4][1])
    back = {r.doc_id: r.text for r in bpe.decode(out, PATH).collect()}
    assert back == {1: rows[0][1], None: "", 3: "", 4: rows[4][1]}
    assert bpe.encode(df.limit(0), PATH, PATTERN, digests=True).count() == 0


def test_memory_of_pieces_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    kept = bpe._Remembered(encoder)
    for i in range(100):
        assert kept[f"piece{i}"] == kept[f"piece{i}"]
    assert len(kept) <= 10 and len(kept.old) <= 10


def test_query_against_the_reference(spark, sf_dir, reference):
    import hashlib

    from quillon.llm.queries import op7_bpe

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = op7_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = reference.encode_ordinary(docs[r.doc_id])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_a_worker_holds_one_model():
    made = []

    def build(name):
        assert not common._HELD  # the one before is gone already
        made.append(name)
        return name

    common.forget()
    assert [common.held((n,), lambda n=n: build(n)) for n in "aabba"] == list("aabba")
    assert made == ["a", "b", "a"]
    common.forget()
    assert common.held(("a",), lambda: build("again")) == "again"
    common.forget()


def test_equal_vocabularies_have_one_mark():
    a = {b"a": 0, b"b": 1}
    assert bpe._mark(a) == bpe._mark(dict(reversed(a.items()))) != bpe._mark({b"a": 1, b"b": 0})
