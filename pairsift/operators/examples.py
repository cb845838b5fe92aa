"""Training-example tables: prompts, ids, labels, padded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsift.functions import examples as ex
from pairsift.functions import generation as gen
from pairsift.operators.ordering import add_row_index
from pairsift.profile import ENGLISH_OCCITAN, LangProfile

PAD_MULTIPLE = 8


def build_examples(df: DataFrame, profile: LangProfile = ENGLISH_OCCITAN) -> DataFrame:
    prompt = gen.build_prompt(F.col("src"), profile.causal_prompt)
    return df.withColumn("prompt", prompt).withColumn(
        "full", F.concat("prompt", "tgt", F.lit(profile.end_marker))
    )


def tokenize_column(df: DataFrame, tokenizer: ex.Tokenizer = ex.code_points, limit: int = ex.MAX_IDS) -> DataFrame:
    """Add input_ids, n_prompt, attention_mask and labels to ``prompt``/``full`` rows."""
    ids = df.withColumns(
        {
            "input_ids": ex.truncate_ids(tokenizer(F.col("full")), limit),
            "n_prompt": F.size(tokenizer(F.col("prompt"))),
        }
    )
    return ids.withColumns(
        {
            "attention_mask": F.transform("input_ids", lambda _: F.lit(1)),
            "labels": ex.mask_labels(F.col("input_ids"), F.col("n_prompt"), limit),
        }
    )


def tokenize_pairs(df: DataFrame, tokenizer: ex.Tokenizer = ex.code_points, profile: LangProfile = ENGLISH_OCCITAN) -> DataFrame:
    made = tokenize_column(build_examples(df, profile), tokenizer)
    return made.drop("src", "tgt", "prompt", "full", "n_prompt")


def tokenize_two_ways(
    df: DataFrame,
    order_by: list[str],
    teacher: ex.Tokenizer = ex.code_points,
    student: ex.Tokenizer = ex.byte_ids,
    profile: LangProfile = ENGLISH_OCCITAN,
) -> tuple[DataFrame, DataFrame]:
    """The same rows under two tokenizers, with a common ``idx``."""
    indexed = add_row_index(df, order_by)
    return tokenize_pairs(indexed, teacher, profile), tokenize_pairs(indexed, student, profile)


def pad_batches(
    df: DataFrame, batch_size: int = 8, side: str = "left", pad_id: int = 0, multiple: int = PAD_MULTIPLE
) -> DataFrame:
    """Pad every batch of ``batch_size`` consecutive ``idx`` values to its longest row,
    rounded up; a batch is a small window, never a hot one."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))
    width = (F.ceil(F.col("_max") / multiple) * multiple).cast("int")
    return (
        df.withColumn("batch_id", F.floor(F.col("idx") / batch_size))
        .withColumn("_max", longest)
        .withColumn("width", width)
        .withColumns(
            {
                "input_ids": ex.pad_array(F.col("input_ids"), F.col("width"), pad_id, side),
                "attention_mask": ex.pad_array(F.col("attention_mask"), F.col("width"), 0, side),
                "labels": ex.pad_array(F.col("labels"), F.col("width"), ex.IGNORE, side),
            }
        )
        .drop("_max")
    )
