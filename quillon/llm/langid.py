"""Language identification by interpolated Kneser-Ney character models.

Texts become letters in lower case with one blank for whatever lies between words.  Each language
has a model of order ``ORDER``: absolute discounting, raw counts at the highest order, numbers of
distinct left neighbours below it, interpolated down to a uniform distribution over the letters seen.
The probabilities of all n-grams of any model stand in one sorted array of hashes for each order,
with a column for each language; a language that lacks an n-gram has its backed-off value there, so
scoring a place takes one search, and one more for each order that no model knows.

The language of the lowest cross-entropy per letter wins.  Confidence is calibrated on labelled rows
that the models have not seen; ``accepted`` rejects texts that are too unsure or that fit their own
language much worse than its calibration rows do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import frugal, materialize

ORDER = 4
DISCOUNT = 0.75
#: Rows of each language that the models are fitted on, at most about: those of the smallest hashes.
TRAINING_ROWS = 800
#: Letters that are scored at once, so that memory does not follow the length of a text.
AT_ONCE = 1 << 20

_CLASS: list[np.ndarray] = []
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 32."""
    if not _CLASS:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low[0])
        _CLASS.append(table)
    return _CLASS[0]


def normalise(text: str | None) -> np.ndarray:
    """Letters of a text with single blanks around words; empty without letters."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = _letters()[points]
    blank = x == 32
    if blank.all():
        return np.empty(0, np.uint32)
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # a blank right after a letter stays
    x = x[keep]
    return np.concatenate([[np.uint32(32)], x, [np.uint32(32)]] if x[-1] != 32 else [[np.uint32(32)], x]).astype(np.uint32)


def grams(x: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams that end at each place from ``order - 1`` on."""
    n = len(x) - order + 1
    h = np.full(max(0, n), order, np.uint64)
    for i in range(order):
        h = (h ^ x[i : i + n].astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(31)
    return h


@dataclass
class Models:
    langs: list[str] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)  # one sorted array for each order, 1 first
    logp: list[np.ndarray] = field(default_factory=list)  # a row for each hash, a column for each language
    floor: float = -12.0
    temper: float = 1.0
    least: float = 0.5
    usual: dict[str, tuple[float, float]] = field(default_factory=dict)  # mean and spread of the cross-entropy

    def total(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """Log-likelihood of the letters of ``x`` by language, and their number."""
        out, places = np.zeros(len(self.langs)), 0
        for at in range(ORDER - 1, max(len(x), ORDER), AT_ONCE):
            part = x[at - ORDER + 1 : at + AT_ONCE]
            n = min(ORDER, len(part))
            if not n or len(x) < 2:
                break
            rows = self._rows(part, n)
            out += rows.sum(axis=0)
            places += len(rows)
        return out, places

    def _rows(self, x: np.ndarray, order: int) -> np.ndarray:
        places = len(x) - order + 1
        out = np.full((places, len(self.langs)), self.floor)
        open_ = np.arange(places)
        for k in range(order, 0, -1):
            h = grams(x, k)[order - k :][open_]
            table = self.hashes[k - 1]
            if not len(table):
                continue
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[at] == h
            out[open_[hit]] = self.logp[k - 1][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def judge(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, confidence, cross-entropy per letter, and whether it is accepted."""
        x = normalise(text)
        if not len(x) or not self.langs:
            return "und", 0.0, float("nan"), False
        total, n = self.total(x)
        return self.decide(total, n)

    def decide(self, total: np.ndarray, n: int) -> tuple[str, float, float, bool]:
        z = total / max(1, n)
        best = int(np.argmax(z))
        e = np.exp((z - z[best]) * self.temper * math.sqrt(max(1, n)))
        score, lang, entropy = float(e[best] / e.sum()), self.langs[best], float(-z[best])
        mean, spread = self.usual.get(lang, (entropy, 1.0))
        slack = 4.0 * spread * (1.0 + 10.0 / math.sqrt(max(1, n)))
        return lang, score, entropy, score >= self.least and entropy <= mean + slack


def _count(rows: DataFrame) -> DataFrame:
    """``lang, k, gram, head, tail, n``: n-grams with the hashes of their first and last k - 1 letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "k", "gram", "head", "tail", "n"]
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("t")):
                x = normalise(t.as_py())
                if len(x):
                    by.setdefault(lang, []).append(np.concatenate([x, np.full(1, 0xFFFFFFFF, np.uint32)]))
            for lang, parts in by.items():
                x = np.concatenate(parts)
                for k in range(1, ORDER + 1):
                    if len(x) < k:
                        continue
                    fine = np.ones(len(x) - k + 1, bool)
                    for i in range(k):
                        fine &= x[i : i + len(fine)] != 0xFFFFFFFF  # n-grams do not cross texts
                    h = grams(x, k)
                    head = grams(x, k - 1)[: len(h)] if k > 1 else np.zeros(len(h), np.uint64)
                    tail = grams(x, k - 1)[1 : len(h) + 1] if k > 1 else np.zeros(len(h), np.uint64)
                    got, first, times = np.unique(h[fine], return_index=True, return_counts=True)
                    col = lambda a: pa.array(a.view(np.int64), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(got)), pa.array(np.full(len(got), k, np.int32)), col(got), col(head[fine][first]), col(tail[fine][first]), pa.array(times, pa.int64())], names=names
                    )

    return rows.mapInArrow(frugal(run), "lang string, k int, gram long, head long, tail long, n long").groupBy("lang", "k", "gram").agg(F.first("head").alias("head"), F.first("tail").alias("tail"), F.sum("n").alias("n"))


def _build(counts, langs: list[str]) -> Models:
    """Interpolated Kneser-Ney from the counts of each language."""
    models = Models(langs=langs)
    tables: list[dict] = []
    for lang in langs:
        own = counts[counts["lang"] == lang]
        by = {}
        for k in range(1, ORDER + 1):
            t = own[own["k"] == k]
            gram, head, tail, n = (t[c].to_numpy(np.int64).view(np.uint64) if c != "n" else t[c].to_numpy(float) for c in ("gram", "head", "tail", "n"))
            order = np.argsort(gram)
            by[k] = [gram[order], head[order], tail[order], n[order]]
        # Below the highest order, how many letters come before an n-gram counts, not how often it comes.
        for k in range(1, ORDER):
            tail, times = np.unique(by[k + 1][2], return_counts=True)
            at = np.minimum(np.searchsorted(tail, by[k][0]), max(0, len(tail) - 1))
            if len(tail):
                by[k][3] = np.where(tail[at] == by[k][0], times[at], 1).astype(float)
        tables.append(by)
    union = [np.unique(np.concatenate([t[k][0] for t in tables])) for k in range(1, ORDER + 1)]
    letters = max(1, len(union[0]) + 1)
    models.floor = math.log(1.0 / letters) - 2.0
    heads = [np.zeros(len(u), np.uint64) for u in union]
    tails = [np.zeros(len(u), np.uint64) for u in union]
    for t in tables:
        for k in range(1, ORDER + 1):
            at = np.searchsorted(union[k - 1], t[k][0])
            heads[k - 1][at], tails[k - 1][at] = t[k][1], t[k][2]

    prob: list[np.ndarray] = []
    for k in range(1, ORDER + 1):
        p = np.zeros((len(union[k - 1]), len(langs)))
        for j, t in enumerate(tables):
            gram, head, _, n = t[k]
            if k == 1:
                total = max(1.0, n.sum())
                lower = np.full(len(union[0]), 1.0 / letters)
                left = DISCOUNT * len(gram) / total if len(gram) else 1.0
                contexts = np.full(len(union[0]), left)
                sums = np.full(len(union[0]), total)
            else:
                seen, inverse, times = np.unique(head, return_inverse=True, return_counts=True)
                total = np.bincount(inverse, weights=n) if len(seen) else np.zeros(0)
                at = np.minimum(np.searchsorted(seen, heads[k - 1]), max(0, len(seen) - 1))
                known = (seen[at] == heads[k - 1]) if len(seen) else np.zeros(len(heads[k - 1]), bool)
                sums = np.where(known, total[at], 1.0) if len(seen) else np.ones(len(known))
                contexts = np.where(known, DISCOUNT * times[at] / sums, 1.0) if len(seen) else np.ones(len(known))
                place = np.minimum(np.searchsorted(union[k - 2], tails[k - 1]), len(union[k - 2]) - 1)
                there = union[k - 2][place] == tails[k - 1]
                lower = np.where(there, prob[k - 2][place, j], math.exp(models.floor))
            own = np.zeros(len(union[k - 1]))
            own[np.searchsorted(union[k - 1], gram)] = np.maximum(n - DISCOUNT, 0.0)
            p[:, j] = own / sums + contexts * lower
        prob.append(p)
    models.hashes, models.logp = union, [np.log(np.maximum(p, 1e-12)) for p in prob]
    return models


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAINING_ROWS) -> Models:
    """Models of all languages among the ``usable`` rows with a language, each fitted on at most about ``rows`` of them.

    Rows are taken by the smallest hashes of their ids; a fifth of them is kept for calibration.
    Without usable rows the models know no language, and every text is ``und``.  What reaches the
    driver are the distinct n-grams of that sample, counted on the executors: ``rows`` bounds them.
    """
    spark = docs.sparkSession
    labelled = docs.where(usable).where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.xxhash64(F.col(id_col), F.lit(9)).alias("place"))
    n = {r.lang: r.k for r in labelled.groupBy("lang").agg(F.count("*").alias("k")).collect()}
    if not n:
        return Models()
    share = F.lit(1.0)
    for lang, k in n.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / k))).otherwise(share)
    unit = F.pmod(F.col("place"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    held = F.pmod(F.shiftright("place", 32), F.lit(5)) == 0
    sample = materialize(labelled.where(unit < share).select("lang", "t", held.alias("held")), "lang-train")
    langs = sorted(n)
    models = _build(_count(sample.where("not held")).toPandas(), langs)

    shared = spark.sparkContext.broadcast(models)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, z, size = [], [], []
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("t")):
                x = normalise(t.as_py())
                if len(x):
                    total, k = m.total(x)
                    lang.append(name)
                    z.append(total.tolist())
                    size.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(z, pa.list_(pa.float64())), pa.array(size, pa.int64())], names=["lang", "z", "n"])

    got = sample.where("held").select("lang", "t").mapInArrow(frugal(totals), "lang string, z array<double>, n long").toPandas()
    if len(got):
        z = np.stack(got["z"].to_numpy()) / np.maximum(1, got["n"].to_numpy())[:, None]
        root = np.sqrt(np.maximum(1, got["n"].to_numpy()))[:, None]
        truth = np.array([langs.index(x) for x in got["lang"]])

        def loss(temper: float) -> float:
            e = (z - z.max(axis=1, keepdims=True)) * temper * root
            p = np.exp(e) / np.exp(e).sum(axis=1, keepdims=True)
            return float(-np.log(np.maximum(p[np.arange(len(p)), truth], 1e-6)).mean())

        models.temper = min((0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss)
        for j, lang in enumerate(langs):
            own = -z[truth == j, j]
            if len(own) >= 3:
                models.usual[lang] = float(own.mean()), float(max(own.std(), 0.02))
    return models


def identify(df: DataFrame, models: Models, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, then ``lang_pred, score, entropy, accepted`` of each whole text.

    Texts that are null or have no letter are ``und`` with score 0, a null entropy, not accepted.  The
    text alone decides, so ties and repeated rows come out alike.
    """
    shared = df.sparkSession.sparkContext.broadcast(models)  # bounded by the distinct n-grams of the training rows
    source = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string, score double, entropy double, accepted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.judge(t.as_py()) for t in batch.column(len(keep))]
            cols = [batch.column(i) for i in range(len(keep))]
            cols += [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            cols += [pa.array([None if g[2] != g[2] else g[2] for g in got], pa.float64()), pa.array([g[3] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "entropy", "accepted"])

    return source.mapInArrow(frugal(run), schema)
