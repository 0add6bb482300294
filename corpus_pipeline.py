"""A corpus pipeline of five stages, each of which calls one operator of wardline.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the shared
folder and rereads it as the next stage's documents. All stages but the last return the columns of
`documents` (others pass through under any name); the last returns what its token files hold.

Nulls, empty texts: language ID rejects null, empty and letterless texts; the later stages would keep them,
but for the mix, which takes no document without words. A null id is an id like others, smaller than all; a null
source is a source; a null language is only not learned from. Rows that repeat each other are scored alike,
near-dedup keeps one of them, and the mix takes them together as often as it plans. Ties go to the least id,
then to a hash of id and text. Texts of any length are read whole. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import decontaminate, language_id, mixing, near_dedup, token_files
from wardline.llm.common import cut, documents

#: Documents whose best language scores less are rejected, like those without letters.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without letters or of a lower score go."""
    scored = language_id.predict(docs, language_id.fit(docs))
    return scored.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; documents without words all stay."""
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty lies in a benchmark's passages."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows come several times where a source is short of its target."""
    return mixing.mixed_documents(docs, mixing.label_quality(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token-id files hold: doc_id, start, n_tokens, ids_crc32 of each row, in order of ids."""
    return token_files.op3_token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", source_mix),
    ("token-ID output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID and tokenizers have no SQL; tests/llm/test_brute.py holds run() against a brute-force version.
ORACLE_SQL = None
