"""A corpus pipeline: language ID, line dedup, near-dedup, mixing and tokenising, each stage on all that the last one kept.

Every stage takes and, but for the last, returns the columns of documents, and passes others through, whatever their
names. The mix is the order of the rows, so of the files.

Edge cases: language ID rejects null and empty texts and those without a letter, so later stages see none in this order;
given one, line dedup leaves a null text null, and near-dedup, mixing and tokenising take null and empty texts as texts
without words (a text that line dedup empties stays). Null and repeated doc_ids are rows like others, but for near-dedup,
where rows that share an id are one document, of which the row with the first text stays, and null ids take no part and
stay. A null lang isn't learned from, a null source is a source whose lines stay, a null n_chars stays null unless line
dedup counts it anew. Equal scores go to the language first in order, equal deadlines to the source first in order, rows of
one hash to the smaller id. Long texts are handled whole. Empty tables give empty tables at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, language_id, line_dedup, mixing, near_dedup
from tidemark.llm.common import checkpointed, table

#: Documents whose best language has a lower cosine are rejected: the first for the shortest texts, whose vectors are mostly
#: noise, rising evenly to the second for texts of LONG characters and more, among which unlearned languages stay below.
LEAST_COSINE, LONG = (0.05, 0.15), 250


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in a learned language; those without, or in another, go."""
    prototypes = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"))))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    judged = language_id.predict(rows, prototypes)
    low, high = LEAST_COSINE
    least = low + (high - low) * F.least(F.length("text") / LONG, F.lit(1.0))
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= least)).select("row.*")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines on over a fiftieth of their source's documents; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs).select("row.*")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles."""
    return near_dedup.deduplicated(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a mix with the square roots of the sources' sizes as targets."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN, out="token_ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: SQL can't express the trained and hashed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
