"""A corpus pipeline of five stages over ``documents``.

Every stage works on all that its predecessor kept.  All but the last return the columns of
``documents``; the last returns tokens.  SQL cannot express the stages (learned weights, exact
set joins, flows, tokenizers), so the tests hold the pipeline against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, jaccard, mixing, secrets, toxicity
from quillon.llm.common import materialize, read_table
from quillon.llm.queries import TOXIC_FROM, tokenizer

ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that stages read, and the whole row beside them: other columns may have any name."""
    return docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject."""
    grammar = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(_packed(docs), grammar, out_col="toxicity").where(F.col("toxicity") < TOXIC_FROM).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a likeness of 0.8 or more."""
    return jaccard.keep_one(docs, words=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked parts of secrets masked."""
    found = secrets.scan(_packed(docs), base_col="base", linked_col="linked").withColumn("spans", secrets.all_spans(F.col("base"), F.col("linked")))
    found = found.withColumn("masked", secrets.redact(F.col("text"), F.col("spans")))
    masked = F.col("row").withField("text", F.col("masked")).withField("n_chars", F.length("masked").cast("long"))
    return found.select(F.when(F.size("spans") > 0, masked).otherwise(F.col("row")).alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, at most three times."""
    size = mixing.word_count(F.col("text"))
    packed = _packed(docs)
    cuts, _ = mixing.plan(packed, F.array("source"), size)
    taken = mixing.apply(packed, cuts, F.array("source"), size).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` of each document of the mix."""
    path, pattern = tokenizer()
    # Workers still hold what earlier stages left, so this one remembers fewer pieces.
    return bpe.encode(docs, path, pattern, keep=("doc_id", "lang", "source"), remembered=100_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written to the shared folder before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
