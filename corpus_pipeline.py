"""The corpus pipeline: language, near duplicates, benchmark leaks, secrets, token ids.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns they were given.

* ``language_id`` drops documents whose text has no letter, or whose letters no
  learned language explains.
* ``ngram_jaccard_join`` keeps one document of each group of near duplicates: the
  one with the smallest id (null ids last).  Documents without words stay.
* ``benchmark_decontamination`` drops documents with a benchmark window.
* ``secret_scan`` replaces every finding in the text by ``[secret]`` and corrects
  ``n_chars`` where there is such a column.
* ``bpe_encoding`` returns the token count and digests per document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cootensor.llm import bpe, decontaminate, jaccard, langid, secrets
from cootensor.llm.frames import read_table
from cootensor.llm.queries import split, tokenizer_path
from cootensor.session import checkpoint_root

FOREIGN_LETTERS = 32      # shorter texts are never called foreign


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = langid.train(docs.where(~split(F.col("doc_id"), 3, 1)), F.col("doc_id"))
    got = langid.identify(docs, models, docs.columns)
    foreign = (F.col("bits_per_byte") > langid.FOREIGN_BITS) & (F.length("row.text") >= FOREIGN_LETTERS)
    return got.where((F.col("lang_pred") != "und") & ~foreign).select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = decontaminate.scan(docs, read_table(spark, sf_dir, "benchmark"), docs.columns)
    return got.where(~F.col("contaminated")).select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(secrets.scan(docs, docs.columns))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    enc = bpe.encoder(docs, tokenizer_path())
    return bpe.encode_digests(docs, enc, ["doc_id"]).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language_id", language_id), ("ngram_jaccard_join", ngram_jaccard_join),
          ("benchmark_decontamination", benchmark_decontamination), ("secret_scan", secret_scan),
          ("bpe_encoding", bpe_encoding)]

# Language ID is learned and the encoder is a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    root = f"{checkpoint_root(spark).rstrip('/')}/cootensor-llm/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
