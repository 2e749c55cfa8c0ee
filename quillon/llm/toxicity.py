"""Toxicity by a weighted pattern grammar of composed transducers.

A text is cut into clauses, and the words of a clause are read as symbols: insult (in six grades),
threat, target, negation, reported speech, or any other word.  Four weighted finite-state transducers
stand one behind the other, each given as a table of arcs ``(state, symbol) -> (state, symbol,
weight)``, and each reads what the one before it writes:

1. reported speech: insults and threats after a verb of saying become reported ones;
2. negation: insults within three words of a negation become negated ones, threats plain words;
3. target: an asserted insult with a target in its clause gets more weight, and a threat has weight
   only with a target, on either side;
4. insult: an insult has weight only inside a clause that says something with it.  A clause that is
   nothing but insults, an isolated word, weighs nothing.

They are composed into one machine (``compose``) whose weights are sums along its single path.  The
score of a document is a logistic function of the weights of its clauses, as a sum and for its length.

The insult lexicon is learned: words, and beginnings of words that inflect, that labelled toxic
documents have and others have not.  Threats, targets, negations and reporting verbs are fixed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import forget, frugal, materialize
from quillon.llm.jaccard import shingle_set
from quillon.session import ship

# The closed classes of the grammar.
THREATS = frozenset("kill hurt destroy murder beat burn shoot stab crush punish matar golpear destruir tuer frapper détruire töten schlagen vernichten".split())
TARGETS = frozenset("you your yours yourself he she him her they them people everyone tú usted ustedes vosotros tu vous toi ihr dich euch sie".split())
NEGATIONS = frozenset("not no never nobody isn't aren't wasn't don't doesn't didn't won't cannot can't nunca jamás ne pas jamais kein keine nicht nie niemals".split())
REPORTS = frozenset("said says say told wrote called quoted reported claimed dijo dice llamó dit écrit appelé sagte schrieb nannte".split())
CLAUSE_ENDS = ".!?;\n"

#: Labelled rows that the lexicon and the scale are fitted on, at most: those of the smallest hashes.
TRAINING_ROWS = 20_000
#: Log odds of standing in a toxic text that a term must have at least.
LEAST_ODDS = 0.3
_PREFIXES = (4, 5, 6, 7, 8)
#: Code points by which a text counts as longer when weights are taken for its length.
SHORT = 500
_WORD = regex.compile(r"[\p{L}\p{M}'’]+")

#: Grades of insults and the weight of a grade.
GRADES, STEP = 6, 0.5
INSULTS = tuple(f"i{k}" for k in range(1, GRADES + 1))
REPORTED = tuple(f"q{k}" for k in range(1, GRADES + 1))
NEGATED = tuple(f"x{k}" for k in range(1, GRADES + 1))
SYMBOLS = ("w", "y", "n", "r", "t", *INSULTS)  # word, target, negation, report, threat, insults
#: Words after a negation that it reaches.
REACH = 3
DIRECTED, THREAT, IF_REPORTED, IF_NEGATED = 1.0, 3.0, 0.3, 0.15
WEIGHT = {s: STEP * (i % GRADES + 1) * f for i, (s, f) in enumerate([(s, 1.0) for s in INSULTS] + [(s, IF_REPORTED) for s in REPORTED] + [(s, IF_NEGATED) for s in NEGATED])}


@dataclass(frozen=True)
class Transducer:
    """Arcs ``(state, symbol) -> (state, symbol, weight)``; a symbol without an arc stays itself, as does the state."""

    start: object
    arcs: dict

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (state, symbol, 0.0)


def reported_speech() -> Transducer:
    arcs = {(state, "r"): ("told", "w", 0.0) for state in ("own", "told")}
    arcs |= {("told", i): ("told", q, 0.0) for i, q in zip(INSULTS, REPORTED)}
    return Transducer("own", arcs | {("told", "t"): ("told", "tq", 0.0)})


def negation() -> Transducer:
    arcs: dict = {(left, "n"): (REACH, "w", 0.0) for left in range(REACH + 1)}
    for left in range(1, REACH + 1):
        arcs |= {(left, s): (left - 1, s, 0.0) for s in ("w", "y")}
        arcs |= {(left, s): (left - 1, x, 0.0) for same in (INSULTS, REPORTED) for s, x in zip(same, NEGATED)}
        arcs |= {(left, s): (left - 1, "w", 0.0) for s in ("t", "tq")}
    return Transducer(0, arcs)


def target() -> Transducer:
    """A state says whether a target came, whether an asserted insult came, and what threat still waits for a target."""
    arcs: dict = {}
    weight = {"": 0.0, "t": THREAT, "tq": THREAT * IF_REPORTED}
    for aimed in (False, True):
        for insulted in (False, True):
            for waiting in weight:
                state = (aimed, insulted, waiting)
                arcs[state, "y"] = ((True, insulted, ""), "w", weight[waiting] + (DIRECTED if insulted and not aimed else 0.0))
                arcs |= {(state, i): ((aimed, True, waiting), i, DIRECTED if aimed and not insulted else 0.0) for i in INSULTS}
                for t in ("t", "tq"):
                    worse = max(waiting, t, key=weight.get)
                    arcs[state, t] = (state, "w", weight[t]) if aimed else ((aimed, insulted, worse), "w", 0.0)
    return Transducer((False, False, ""), arcs)


def insult() -> Transducer:
    """States: nothing yet, only insults so far (the heaviest is the state), or a clause with other words."""
    arcs: dict = {("", "w"): ("clause", "w", 0.0)}
    for s in WEIGHT:
        arcs["", s] = (s, s, 0.0)
        arcs[s, "w"] = ("clause", "w", WEIGHT[s])
        arcs["clause", s] = ("clause", s, WEIGHT[s])
        arcs |= {(s, other): (max(s, other, key=WEIGHT.get), other, 0.0) for other in WEIGHT}
    return Transducer("", arcs)


def compose(first: Transducer, second: Transducer, symbols) -> Transducer:
    """One transducer that does what ``second`` does with what ``first`` writes: states are pairs, weights add up."""
    start = (first.start, second.start)
    arcs, open_, seen = {}, [start], {start}
    while open_:
        state = open_.pop()
        for symbol in symbols:
            a, middle, u = first.step(state[0], symbol)
            b, out, v = second.step(state[1], middle)
            arcs[state, symbol] = ((a, b), out, u + v)
            if (a, b) not in seen:
                seen.add((a, b))
                open_.append((a, b))
    return Transducer(start, arcs)


CASCADE = (reported_speech, negation, target, insult)


def machine() -> tuple[dict, ...]:
    """The composed grammar: for each state, 0 at the start, ``{symbol: (state, weight)}``."""
    whole = reported_speech()
    for part in CASCADE[1:]:
        whole = compose(whole, part(), SYMBOLS)
    number = {whole.start: 0}
    for state, _ in whole.arcs:
        number.setdefault(state, len(number))
    table: list[dict] = [{} for _ in number]
    for (state, symbol), (to, _, weight) in whole.arcs.items():
        table[number[state]][symbol] = (number[to], weight)
    return tuple(table)


def terms(word: str) -> list[str]:
    """A word and its beginnings; a beginning ends in ``*``."""
    return [word] + [word[:k] + "*" for k in _PREFIXES if len(word) > k]


def grade(weight: float) -> str:
    return INSULTS[min(GRADES, max(1, round(weight / STEP))) - 1]


_CLOSED = {w: s for s, words in (("y", TARGETS), ("t", THREATS), ("r", REPORTS), ("n", NEGATIONS)) for w in words}


@dataclass
class Grammar:
    """Weights of lexicon terms, and the scale of the logistic."""

    lexicon: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    slope: float = 1.0  # of the sum of weights
    dense: float = 3.5  # of the sum for a thousand code points

    def insult(self, word: str) -> float:
        get = self.lexicon.get
        return max((get(t, 0.0) for t in terms(word)), default=0.0)

    def symbol(self, word: str) -> str:
        """What the grammar reads a lower-case word as."""
        closed = _CLOSED.get(word.replace("’", "'"))
        if closed:
            return closed
        weight = self.insult(word)
        return grade(weight) if weight else "w"

    def reader(self) -> Reader:
        return Reader(self)

    def score(self, weight: float, length: int) -> float:
        total, dense = features(weight, length)
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.bias + self.slope * total + self.dense * dense))))


def features(weight, length):
    return np.log1p(weight), np.log1p(1000.0 * weight / (length + SHORT))


class Reader:
    """A grammar ready to read texts: the composed machine, and an automaton for the places where a clause can match at all."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.machine, self.symbols = grammar, machine(), {}
        self.places = ahocorasick.Automaton()
        for t in [*grammar.lexicon, *THREATS]:
            self.places.add_word(t.rstrip("*"), 1)
        self.places.make_automaton()

    def clause(self, words: list[str]) -> float:
        """Weight of the path that the machine takes over the words of one clause."""
        table, known, total = self.machine, self.symbols, 0.0
        row = table[0]
        for w in words:
            symbol = known.get(w)
            if symbol is None:
                if len(known) > 100_000:  # a memory only
                    known.clear()
                symbol = known[w] = self.grammar.symbol(w)
            state, weight = row[symbol]
            row = table[state]
            total += weight
        return total

    def weigh(self, text: str) -> float:
        """Sum over all clauses.  Every clause is read once, and every clause end looked up once: linear in the text."""
        low = text.lower()
        total, upto, size = 0.0, 0, len(low)
        ahead = dict.fromkeys(CLAUSE_ENDS, -1)  # where each clause end comes next
        for end, _ in self.places.iter(low):
            if end < upto:
                continue
            start = max(upto, *(low.rfind(c, upto, end) + 1 for c in CLAUSE_ENDS))
            for c, at in ahead.items():
                if at < end:
                    at = low.find(c, end)
                    ahead[c] = size if at < 0 else at
            upto = min(ahead.values())
            total += self.clause(_WORD.findall(low, start, upto))
        return total


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """``t, y`` of at most about ``rows`` labelled documents, those with the smallest hashes of ids; none that is held out."""
    wanted = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y")).where("y is not null and l_id is not null and crc32(cast(l_id as string)) % 4 <> 2")
    wanted = wanted.groupBy("l_id").agg(F.max("y").alias("y"))
    n = wanted.count()
    place = F.pmod(F.xxhash64("l_id", F.lit(3)), F.lit(1 << 30))
    wanted = wanted.where(place < F.lit(int((1 << 30) * min(1.0, rows / max(1, n))) + 1))
    # Bounded by `rows`, so it can be broadcast.
    return docs.select(F.col(id_col).alias("d_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(wanted), F.col("d_id") == F.col("l_id")).select("t", "y")


def _one_of_each(rows: DataFrame) -> DataFrame:
    """The rows without near copies: one for each least hash of five-word shingles.

    Near copies of a toxic text would make every rare word of it look toxic.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [int(s[0]) if len(s) else 0 for s in (shingle_set(t.as_py(), 5) for t in batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("y"), pa.array(np.array(least, dtype=np.uint64).view(np.int64))], names=["t", "y", "least"])

    return rows.mapInArrow(frugal(run), "t string, y int, least long").groupBy("least").agg(F.max_by("t", F.struct("y", "t")).alias("t"), F.max("y").alias("y")).select("t", "y")


def term_counts(text: str, of=terms) -> dict[str, int]:
    """How often each term comes in a text, on a scale of doublings (1, 2-3, 4-7, ...), so that one text that repeats itself cannot decide; "" stands for all words."""
    found: dict[str, int] = {"": 0}
    for w, times in Counter(_WORD.findall(text.lower())).items():
        for x in of(w):
            found[x] = found.get(x, 0) + times
        found[""] += times.bit_length()
    return {x: times if x == "" else times.bit_length() for x, times in found.items()}


def _term_counts(rows: DataFrame, only=None) -> DataFrame:
    """``term, n, k``: in how many rows each term comes, and how often; the empty term stands for all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = Counter(), Counter()
        of = terms
        if only is not None:
            known = only.value
            of = lru_cache(200_000)(lambda w: [x for x in terms(w) if x in known])  # a memory only
        for batch in batches:
            for t in batch.column("t"):
                found = term_counts(t.as_py(), of)
                n.update(found.keys())
                k.update(found)
            if len(n) > 1_000_000:
                yield _counted(n, k)
                n, k = Counter(), Counter()
        yield _counted(n, k)

    return rows.mapInArrow(frugal(run), "term string, n long, k long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def _counted(n: Counter, k: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([k[t] for t in n], pa.int64())], names=["term", "n", "k"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> Grammar:
    """A grammar fitted on at most about ``rows`` labelled documents that are not held out.

    Without any labelled toxic document only the fixed classes count.  Terms that a 400th of the toxic
    rows have reach the driver: at most 400 times as many as such a row has on the average, whatever
    the number of rows.
    """
    spark = docs.sparkSession
    sample = materialize(_one_of_each(training_rows(docs, labels, id_col, text_col, label_col, rows)), "tox-train")
    n = {r.y: r.k for r in sample.groupBy("y").agg(F.count("*").alias("k")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    grammar = Grammar()
    if not n_pos or not n_neg:
        return grammar
    support = max(3, n_pos // 400)
    # Terms that toxic rows have often enough, then how often the others have those.
    pos = {r.term: (r.n, r.k) for r in _term_counts(sample.where("y = 1")).where((F.col("n") >= support) | (F.col("term") == "")).collect()}
    only = spark.sparkContext.broadcast(frozenset(pos))
    neg = {r.term: (r.n, r.k) for r in _term_counts(sample.where("y = 0"), only).collect()}
    grammar.lexicon = lexicon(pos, neg)

    # The scale of the logistic, on the sample's weights.
    shared = spark.sparkContext.broadcast(grammar)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value.reader()
        for batch in batches:
            texts = batch.column("t").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([reader.weigh(t) for t in texts], pa.float64()), pa.array([len(t) for t in texts], pa.int64())], names=["y", "w", "n"])

    got = sample.mapInArrow(frugal(weights), "y int, w double, n long").toPandas()  # three numbers for each of the bounded rows
    x = np.column_stack(features(got["w"].to_numpy(float), got["n"].to_numpy(float)))
    grammar.bias, grammar.slope, grammar.dense = scale(x, (got["y"].to_numpy() > 0).astype(float))
    return grammar


def lexicon(pos: dict[str, tuple[int, int]], neg: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights of the terms that toxic texts have, from ``term: (rows, occurrences)`` of toxic and of other rows.

    A term's log odds are those of its occurrences, plain or for the length of all texts, whichever is
    less, at the lower end of an interval that the numbers of rows give.
    """
    longer = math.log(max(1, neg.get("", (0, 0))[1]) / max(1, pos.get("", (0, 0))[1]))
    out = {}
    for t, (n, k) in pos.items():
        other_n, other_k = neg.get(t, (0, 0))
        odds = math.log((k + 0.5) / (other_k + 0.5)) + min(0.0, longer) - math.sqrt(1 / (n + 0.5) + 1 / (other_n + 0.5))
        if t and odds > LEAST_ODDS:
            out[t] = min(GRADES * STEP, odds)
    return out


def scale(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Bias and slopes of a logistic, by Newton steps with a little ridge, so that separable rows stay finite; no slope falls below 0."""
    x = np.column_stack([np.ones(len(x)), x])
    rest, w = np.array([-2.0] + [1.0] * (x.shape[1] - 1)), np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - y) + 0.1 * (w - rest)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return (float(w[0]), *(float(max(v, 0.01)) for v in w[1:]))


def score(df: DataFrame, grammar: Grammar, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``df`` with a score from 0 to 1 of each whole text; null and empty texts weigh nothing.

    The text alone decides, so ties and repeated rows score alike.  A column named ``out_col`` is replaced.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(grammar)  # bounded as ``fit`` says
    held: list = []

    @F.pandas_udf("double")
    def scored(texts):
        if not held:
            forget()
            held.append(shared.value.reader())
        reader = held[0]
        return texts.map(lambda t: reader.grammar.score(reader.weigh(t), len(t)))

    return df.withColumn(out_col, scored(F.coalesce(F.col(text_col), F.lit(""))))
