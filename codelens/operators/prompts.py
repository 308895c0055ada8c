"""Instruction rows as text: training prompts, inference prompts, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions import text, vocab


def inference_prompt(instruction: Column, input_text: Column) -> Column:
    """The headed prompt, ending right after the response heading."""
    instruction, input_text = text.or_empty(instruction), text.or_empty(input_text)
    input_section = F.when(
        text.is_blank(input_text), F.lit("")
    ).otherwise(F.concat(F.lit(vocab.INPUT_HEADING), input_text, F.lit(vocab.SECTION_GAP)))
    return F.concat(
        F.lit(vocab.INSTRUCTION_HEADING),
        instruction,
        F.lit(vocab.SECTION_GAP),
        input_section,
        F.lit(vocab.RESPONSE_HEADING),
    )


def training_text(instruction: Column, input_text: Column, output: Column) -> Column:
    """The inference prompt followed by the expected output."""
    return F.concat(inference_prompt(instruction, input_text), text.or_empty(output))


def format_rows(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Instruction rows as (key, text); all source columns are dropped."""
    return rows.select(
        key, training_text(F.col("instruction"), F.col("input"), F.col("output")).alias("text")
    )


def extract_response(full: Column, prompt: Column) -> Column:
    """The stripped text after the prompt; null if the text does not start with it."""
    rest = F.substring(full, F.length(prompt) + 1, F.length(full))
    return F.when(F.startswith(full, prompt), text.strip(rest))


def limit_length(rows: DataFrame, max_tokens: int = 1024, column: str = "text") -> DataFrame:
    """Adds the whitespace-token count, an over-limit flag and the capped text.

    Counts whitespace-separated tokens; a model's own tokenizer counts more.
    Text within the limit is unchanged, longer text ends with its last allowed
    token, and the layout before that is kept.
    """
    counted = rows.withColumn("_tokens", text.tokens_with_lead(text.or_empty(F.col(column))))
    over = F.size("_tokens") > max_tokens
    capped = F.array_join(F.slice("_tokens", 1, max_tokens), "")
    return counted.withColumns({
        "n_tokens": F.size("_tokens"),
        "over_limit": over,
        "capped_text": F.when(over, capped).otherwise(text.or_empty(F.col(column))),
    }).drop("_tokens")
