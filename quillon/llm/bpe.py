"""Byte-level BPE by backtracking over longest matches.

Every token is a string of bytes; written as Latin-1 it is an ordinary string, which an Aho-Corasick
automaton can hold.  One run of the automaton over a piece gives, for each place, the longest token
that starts there.  The encoder takes longest matches and steps back to shorter ones when two
neighbours could not have come from the merges; whether they could is a property of the pair alone,
and is remembered.  A bit for each place says that no valid encoding goes through it, so that every
place is left at most once for each token that starts there and long pieces take linear time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import frugal, held

#: Pieces whose ids a worker remembers by default, in each of two generations (some 200 bytes a piece);
#: older ones are encoded again.
REMEMBERED = 300_000
#: Pairs of neighbours whose compatibility a worker remembers.
PAIRS = 300_000
#: Pieces joined at once, so that a very long text never stands in memory as a list of pieces.
AT_ONCE = 200_000


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks from a file of ``base64(token) rank`` lines, read on the driver by Spark or from its own disk."""
    if "://" in path:
        lines = [r.value for r in spark.read.text(path).collect()]
    else:
        with open(path, encoding="ascii") as f:
            lines = f.read().splitlines()
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x)}


class Encoder:
    """Encodes pieces to the ids that merging by rank gives."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.pair_of: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        #: Tokens that merging can make.  Others appear only where a whole piece equals them.
        self.reachable: set[int] = set()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.split[i] = (i, i)
                self.reachable.add(i)
                continue
            for cut in range(len(token) - 1, 0, -1):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is None or b is None or a >= i or b >= i or a not in self.reachable or b not in self.reachable:
                    continue
                if self._compatible(a, b):
                    self.split[i], self.pair_of[a, b] = (a, b), i
                    self.reachable.add(i)
                    break
        self.known.clear()  # pairs were judged while tokens of higher rank were missing
        self.automaton = ahocorasick.Automaton()
        for i in self.reachable:
            token = self.bytes_of[i]
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
            for cut in range(len(token) - 1, 0, -1):
                j = ranks.get(token[:cut])
                if j in self.reachable:
                    self.shorter[i] = j
                    break
        self.automaton.make_automaton()

    def _compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` can stand side by side: undo merges, latest first, and look for one that would have crossed."""
        limit = 1 << 60
        while True:
            made = self.pair_of.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            got = self.known[a, b] = self._compatible(a, b)
        return got

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        length = [0] * n
        for end, (size, i) in self.automaton.iter(piece.decode("latin-1")):
            at = end - size + 1
            if size > length[at]:
                length[at], longest[at] = size, i
        size_of, shorter, compatible = self.bytes_of, self.shorter, self.compatible
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while True:
            end = pos + len(size_of[token])
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                pos = end
                if pos == n:
                    return out
                token = longest[pos]
                continue
            less = shorter.get(token)
            while less is None:  # nothing fits here: the place is dead, and the token before must shrink
                dead[pos] = 1
                token = out.pop()
                pos -= len(size_of[token])
                less = shorter.get(token)
            token = less


class _Remembered(dict):
    """ids of pieces as little-endian bytes; two generations bound the memory."""

    def __init__(self, encoder: Encoder, most: int | None = None):
        super().__init__()
        self.encoder, self.old, self.most = encoder, {}, most or REMEMBERED

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = np.array(self.encoder.encode(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


def _mark(ranks: dict[bytes, int]) -> str:
    """The same for equal vocabularies, so that a worker goes on with its encoder when a later job brings one anew."""
    return hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()


def _worker(mark: str, shared, most: int | None = None) -> tuple[_Remembered, list[bytes]]:
    def build():
        ranks = shared.value
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            table[i] = t
        return _Remembered(Encoder(ranks), most), table

    return held(("bpe", mark, most), build)


def encode_text(text: str, remembered, pattern) -> bytes:
    """ids of a whole text as little-endian 32-bit integers; pieces are encoded one by one."""
    if len(text) < AT_ONCE:
        return b"".join([remembered[p] for p in pattern.findall(text)])
    pieces, out = (m[0] for m in pattern.finditer(text)), []
    while part := b"".join([remembered[p] for p in islice(pieces, AT_ONCE)]):
        out.append(part)
    return b"".join(out)


def decode_ids(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = False, remembered: int | None = None) -> DataFrame:
    """``keep`` columns, then ``n_tokens``, ``ids`` (array of int) and, if asked, digests of ids and of the decoded bytes.

    Null and empty texts have no ids.  Repeated rows are encoded alike.  Each text is handled alone,
    whole; a worker holds one batch, the vocabulary and a bounded memory of pieces.
    """
    spark = df.sparkSession
    ranks = load_ranks(spark, ranks_path)
    mark, shared = _mark(ranks), spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary file
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    kinds = [df.schema[c].dataType for c in keep]
    source = df.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    extra = [("n_tokens", "long")] + [("ids", "array<int>")] * ids + [("ids_sha256", "string"), ("decoded_sha256", "string")] * digests
    schema = ", ".join([f"`{c}` {k.simpleString()}" for c, k in zip(keep, kinds)] + [f"{c} {k}" for c, k in extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = _worker(mark, shared, remembered)
        cut = regex.compile(pattern)
        for batch in batches:
            blobs = [encode_text(t.as_py(), known, cut) for t in batch.column(len(keep))]
            cols = [batch.column(i) for i in range(len(keep))]
            cols.append(pa.array([len(b) // 4 for b in blobs], pa.int64()))
            if ids:
                ends = np.cumsum([0] + [len(b) // 4 for b in blobs]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), dtype="<i4"), pa.int32())))
            if digests:
                cols.append(pa.array([hashlib.sha256(b).hexdigest() for b in blobs], pa.string()))
                cols.append(pa.array([hashlib.sha256(decode_ids(b, table)).hexdigest() for b in blobs], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *[c for c, _ in extra]])

    return source.mapInArrow(frugal(run, holds=True), schema)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds ``out_col``: the text that ``ids_col`` stands for.  Null ids give null; bytes that are no UTF-8 become U+FFFD."""
    spark = df.sparkSession
    ranks = load_ranks(spark, ranks_path)
    mark, shared = _mark(ranks), spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("string")
    def back(ids):
        _, table = _worker(mark, shared)
        return ids.map(lambda x: None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace"))

    return df.withColumn(out_col, back(F.col(ids_col)))
