"""Sequential packing inside one row's array, as JVM folds with a struct for state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _open_piece(parts: Column, fits: Callable[[Column, Column], Column]) -> Column:
    """Joins neighbours by a blank line while they fit; a part that does not fit opens the next piece."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        joined = F.concat(state["open"], F.lit("\n\n"), part)
        return (
            F.when(state["open"] == "", F.struct(state["done"].alias("done"), part.alias("open")))
            .when(fits(state["open"], part), F.struct(state["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(F.array_append(state["done"], state["open"]).alias("done"), part.alias("open")))
        )

    return F.aggregate(parts, start, step, lambda s: F.filter(F.array_append(s["done"], s["open"]), lambda p: p != ""))


def merge_paragraphs(parts: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters, the joints not counted; a longer part stays alone."""
    return _open_piece(parts, lambda a, b: F.char_length(a) + F.char_length(b) <= limit)


def consolidate(parts: Column, target: int) -> Column:
    """Pieces of at most ``target`` characters, joints counted; a longer part stays alone."""
    return _open_piece(parts, lambda a, b: F.char_length(a) + 2 + F.char_length(b) <= target)


def batch_blocks(blocks: Column, budget: int) -> Column:
    """Context blocks in batches under a budget; no block gives one empty batch."""
    packed = consolidate(blocks, budget)
    return F.when(F.size(blocks) == 0, F.array(F.lit(""))).otherwise(packed)


def fit_budget(blocks: Column, budget: int) -> Column:
    """The blocks that fit what is left of a budget; one that does not fit is passed over, later ones may still fit."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))

    def step(state: Column, block: Column) -> Column:
        used = state["used"] + F.char_length(block)
        return F.when(used <= budget, F.struct(F.array_append(state["kept"], block).alias("kept"), used.alias("used"))).otherwise(state)

    return F.aggregate(blocks, start, step, lambda s: s["kept"])
