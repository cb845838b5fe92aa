"""A training-data pipeline in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as the next
stage's docs. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsift.llm import mixing, ngram_join, quality, sentencepiece_scan, suffix_dedup
from pairsift.llm.settings import MIX_SEED, MIX_WEIGHTS, REPEAT_BYTES, REPEAT_WORDS, tokenizer_file
from pairsift.session import bound_batches, scratch_path


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier scores at 0.5 or more; it learns from ``labels`` of documents in ``docs``."""
    bound_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    bound_batches(spark)
    return ngram_join.drop_near_copies(docs, width=5, num=4, den=5)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``REPEAT_BYTES`` bytes or ``REPEAT_WORDS`` words or more that also start anywhere else."""
    bound_batches(spark)
    return suffix_dedup.remove_repeats(docs, length=REPEAT_BYTES, words=REPEAT_WORDS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled; a repeated document is a repeated row."""
    return mixing.mix_sources(docs, MIX_WEIGHTS, MIX_SEED).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, n_pieces, round_trip): the pieces of each text, and whether decoding gives the text back."""
    bound_batches(spark)
    model = tokenizer_file("piece_bpe_32k.model")
    pieces = sentencepiece_scan.encode_pieces(docs.select("doc_id", "source", "text"), model)
    both = sentencepiece_scan.decode_pieces(pieces, model)
    return both.select("doc_id", "source", "ids", F.size("ids").alias("n_pieces"), sentencepiece_scan.round_trip().alias("round_trip"))


STAGES = [
    ("quality classifier", reject_low_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_to_weights),
    ("SentencePiece encoding", encode),
]

# the classifier, near copies at 0.8 and the tokenizer have no SQL; tests hold near copies, repeats
# and pieces of run() against brute force, and the classifier and the mixture (by their own stages there) on their own
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        path = scratch_path(spark, f"stage{k}")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
