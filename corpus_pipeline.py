"""From raw documents to packed training sequences.

STAGES: language ID, line dedup, MinHash near-dedup, mixing to target weights, best-fit packing. Each is
(name, function of (spark, docs, sf_dir)); all but the last return the columns of documents: doc_id, text, lang,
source, n_chars, whatever other columns docs has.

Defined cases, by stage. A text that is null or has no letter has no language and goes with the first stage; null lang and
source are values like others in mixing. A document keeps its place if it loses some of its lines, and goes if it loses
lines and nothing but ASCII white space is left of it; one that loses none stays as it is (one of white space alone has gone with the first stage). Of repeated rows and of equal texts one stays, that with the smallest doc_id;
rows without doc_id lose no line, are no near copies, and are never sampled. Texts of any length are worked on whole;
an empty table gives an empty result at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import language_id, line_dedup, minhash_dedup, mixing, packing
from tessella.llm.queries import tokenizer_path
from tessella.session import materialize, settle, ship, spread


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language; documents without one go."""
    named = language_id.identify(_columns(docs), keep=True)
    return named.filter(F.col("lang_pred") != language_id.UNKNOWN).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; a document that loses all its text goes."""
    out = line_dedup.dedup_lines(_columns(docs), keep=("lang", "source"))
    out = out.filter((F.col("n_dropped") == 0) | F.regexp_like("kept", F.lit(r"[^\x20\x09-\x0D]")))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return minhash_dedup.first_of_class(_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled by the probabilities raked to source, language and topic."""
    return mixing.sample(_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Automata, signatures, raking and the packing program have no SQL form; tests hold the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    ship(spark)

    def build() -> DataFrame:
        docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        return STAGES[-1][1](spark, docs, sf_dir)

    return settle(spark, build, "pipeline")
