"""Token and character budgets as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_A_TOKEN, PROMPT_CHARS, LEAST_CHARS, LEAST_WINDOW = 3, 10_000, 5_000, 2_048
#: The context sizes that a request is rounded up to.
BUCKETS = (2048, 3072, 4096, 6144, 8192, 12288, 16384, 24576, 32768, 49152, 65536, 131072)


def effective_window(native: Column, ratio: float) -> Column:
    """The share of a native window that is used, at least LEAST_WINDOW."""
    return F.greatest((native * max(0.01, min(ratio, 1.0))).cast("int"), F.lit(LEAST_WINDOW))


def output_budget(window: Column, prompt_chars: Column, least: int, cap: int) -> Column:
    """Tokens left for the answer; a quarter of the window where the prompt is unknown (0)."""
    left = F.when(prompt_chars > 0, window - F.floor(prompt_chars / CHARS_A_TOKEN)).otherwise((window * 0.25).cast("int"))
    return F.least(F.greatest(left, F.lit(max(least, 256))), F.lit(cap)).cast("int")


def knowledge_budget(window: Column, output: Column) -> Column:
    """Characters of context that fit beside the prompt and the answer."""
    return F.greatest(F.greatest(window - output, F.lit(1024)) * CHARS_A_TOKEN - PROMPT_CHARS, F.lit(LEAST_CHARS))


def context_bucket(needed: Column, window: Column) -> Column:
    """The smallest bucket that holds the need and a tenth more, never above the window."""
    wanted = F.least(F.greatest(needed * 1.1, F.lit(LEAST_WINDOW)), window)
    return F.least(window, F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, BUCKETS)), lambda b: b >= wanted)), window))


def answer_hint(chars: Column) -> Column:
    """Expected answer tokens of a text: at least three items, one a 500 characters."""
    return F.floor(F.greatest(F.lit(3), F.floor(chars / 500)) * 400 * 1.5)


def knowledge_cap(budget: Column, document_chars: Column, ratio: int = 3) -> Column:
    """Context characters: the budget, but no more than ``ratio`` times the document."""
    return F.least(budget, document_chars * ratio)


def cases_hint(max_cases: Column, chars: Column) -> Column:
    """Expected answer tokens: for a number of cases, if one is given, else by the text."""
    return F.when(max_cases > 0, F.floor(max_cases * 400 * F.lit(1.3))).otherwise(answer_hint(chars))


def reasoning_budget(model: Column, output: Column, window: Column, prompt_chars: Column) -> Column:
    """Models that think aloud get four times the tokens, bounded by what the window leaves."""
    thinks = F.lower(model).rlike("deepseek-r1|r1:|r1-|/r1")
    left = F.greatest(window - F.floor(prompt_chars / CHARS_A_TOKEN), output)
    return F.when(thinks, F.least(output * 4, left)).otherwise(output)


def output_limit(parameters: Column) -> Column:
    """The most tokens to ask of a model by its number of parameters; unknown counts as large."""
    known = F.coalesce(parameters, F.lit(0)) > 0
    return F.when(known & (parameters < 2_000_000_000), 2048).when(known & (parameters < 10_000_000_000), 4096).otherwise(8192)
