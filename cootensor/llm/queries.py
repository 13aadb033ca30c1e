"""The registered query of each corpus operator, over the whole of its table, and its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, html, jaccard, langid, lexical, lm, mixing, neardup, periodic, secrets, substring
from .frames import read_table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; null for a null id."""
    return F.crc32(key.cast("string")) % modulus


def split(key: Column, modulus: int, held: int) -> Column:
    """Whether a row is held out (false for a null id)."""
    return F.coalesce(remainder(key, modulus) == held, F.lit(False))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of 5-word shingles, links at 75 %, component per document."""
    docs = read_table(spark, sf_dir, "documents")
    return jaccard.link(docs, ["doc_id"]).select("row.doc_id", "n_shingles", "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base findings and linked credentials per document."""
    docs = read_table(spark, sf_dir, "documents")
    return secrets.scan(docs, ["doc_id"]).select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held = split(F.col("doc_id"), 3, 1)
    models = langid.train(docs.where(~held), F.col("doc_id"))
    got = langid.identify(docs, models, ["doc_id"])
    return got.select("row.doc_id", split(F.col("row.doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of text that several documents share, and which of them are removed."""
    return substring.duplicates(read_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, and the number of blocks its site's template deleted."""
    pages = read_table(spark, sf_dir, "pages")
    return html.extract(pages, ["page_id", "url"]).select("row.page_id", "row.url", "text", "n_chars", "n_template")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a benchmark window."""
    docs, bench = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.scan(docs, bench, ["doc_id"]) \
        .select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.93 within labels, component per vector."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log-probability of every document, learned from the documents not held out."""
    docs = read_table(spark, sf_dir, "documents")
    got = lm.score(docs, ["doc_id"], split(F.col("doc_id"), 7, 2))
    return got.select("row.doc_id", "row.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered role and canonical rendering of every conversation row, learned from the conversations not held out."""
    turns = read_table(spark, sf_dir, "conversations")
    model = chat.train(turns, ~split(F.col("conv_id"), 3, 1))
    got = chat.format_turns(turns, model, ["conv_id", "turn"])
    return got.select("row.conv_id", "row.turn", split(F.col("row.conv_id"), 3, 1).alias("held_out"), "role_pred", "n_turns", "rendered")


def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    docs = read_table(spark, sf_dir, "documents")
    enc = bpe.encoder(docs, tokenizer_path())
    return bpe.encode_digests(docs, enc, ["doc_id"]).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document; sources weigh 1, 2, 3, repeating."""
    docs = read_table(spark, sf_dir, "documents")
    rows, stream = mixing.mix(docs, ["doc_id"], F.col("source"), F.col("text"), F.col("doc_id"))
    return mixing.taken(rows, stream).select("row.doc_id", "size", "source_size", "target", "taken")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words in every document, and the document without the repetitions, as digests."""
    docs = read_table(spark, sf_dir, "documents")
    got = periodic.scan(docs, ["doc_id"], echo=F.crc32(F.col("doc_id").cast("string")))
    best = periodic.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    got = got.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                     F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return got.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for every benchmark item."""
    docs, bench = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    got = lexical.search(docs, bench, F.col("doc_id"), ["item_id"], F.col("text"), F.col("text"))
    return got.select("row.item_id", "rank", "doc_id", "score")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_secret_scan, op3_language_id, op4_substring_dedup,
                                   op5_html_extraction, op6_benchmark_decontamination, op7_embedding_near_dedup,
                                   op8_lm_scoring, op9_chat_formatting, op10_bpe_encoding, op11_mixing,
                                   op12_periodic_runs, op13_ranked_search)}
