"""Splitting oversized items at natural boundaries by packing a structure tree.

A text is read as a tree: sections under headings of depth 1 to 6, paragraphs (blank lines), lines (list items, table rows),
sentences, words, characters. A node that fits the limit stays whole; siblings are merged, left to right, while they fit; only an
oversized node is entered. The cores of the pieces tile the text exactly. Each further piece is led by up to ``overlap``
characters of the piece before, starting at a word where one is in reach, and no piece exceeds the limit.

Spark filters the oversized items before any Python runs; the tree of one text is built inside one task, since pieces of one text
depend on each other. All lengths are code points. Null, empty and fitting texts give no pieces; an item without an id is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "item_kind STRING, item_id STRING, piece_no INT, start_pos BIGINT, core_pos BIGINT, end_pos BIGINT, text STRING"

#: Where a node of each level may be cut; the cut is at the end of the match. Headings come first, by depth.
_LEVELS = [regex.compile(rf"\n(?=#{{1,{depth}}}[ \t]+\S)") for depth in range(1, 7)] + [
    regex.compile(r"\n[ \t\r]*\n\s*"),
    regex.compile(r"\n(?=[ \t]*(?:[-*•+]|\d+[.)])[ \t])"),
    regex.compile(r"\r?\n"),
    regex.compile(r"[.!?…][\"'»”)\]]*\s+|[。！？]"),
    regex.compile(r"[;,:]\s+|[、，；]"),
    regex.compile(r"\s+"),
]
_JOINED = regex.compile(r"[\p{M}‍️]")


def _raw_cuts(text: str, start: int, end: int, limit: int) -> list[int]:
    """Cuts every ``limit`` characters, moved back so that no combining mark or CRLF is torn off its base."""
    cuts = []
    while end - start > limit:
        at = start + limit
        while at > start + limit // 2 and (_JOINED.match(text[at]) or text[at - 1 : at + 1] == "\r\n"):
            at -= 1
        cuts.append(at)
        start = at
    return cuts


def _cores(text: str, start: int, end: int, level: int, limit: int) -> Iterator[tuple[int, int]]:
    """Spans that tile [start, end), none longer than ``limit``."""
    if end - start <= limit:
        yield start, end
        return
    if level == len(_LEVELS):
        yield from pairwise([start, *_raw_cuts(text, start, end, limit), end])
        return
    cuts = [m.end() for m in _LEVELS[level].finditer(text, start, end) if start < m.end() < end]
    if not cuts:
        yield from _cores(text, start, end, level + 1, limit)
        return
    held = None  # siblings merged so far
    for a, b in pairwise([start, *cuts, end]):
        if held and b - held[0] <= limit:
            held = (held[0], b)
            continue
        if b - a <= limit:
            if held:
                yield held
            held = (a, b)
            continue
        parts = list(_cores(text, a, b, level + 1, limit))
        if held and parts[0][1] - held[0] <= limit:
            parts[0] = (held[0], parts[0][1])
        elif held:
            yield held
        yield from parts[:-1]
        held = parts[-1]
    if held:
        yield held


def split_spans(text: str, max_size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start with overlap, start of the core, end) of every piece, from 0."""
    overlap = max(0, min(overlap, max_size // 2))
    out: list[tuple[int, int, int]] = []
    for a, b in _cores(text, 0, len(text), 0, max_size - overlap):
        lead = max(a - overlap, out[-1][1]) if out else a
        if lead < a and lead > 0 and not text[lead - 1].isspace():
            space = regex.search(r"\s+", text, pos=lead, endpos=a)
            lead = space.end() if space else lead
        out.append((lead, a, b))
    return out


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in PIECES.split(", ")]
    for batch in batches:
        rows = []
        for kind, item, text, size, overlap in batch.itertuples(index=False):
            for n, (lead, a, b) in enumerate(split_spans(text, int(size), int(overlap)), 1):
                rows.append((kind, item, n, lead + 1, a + 1, b, text[lead:b]))
            if len(rows) > 2000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)


def split_oversized(items: DataFrame, item_kind: str, id_col: Column, text_col: Column, max_size: int, overlap: int) -> DataFrame:
    """The pieces (``PIECES``) of every item longer than ``max_size``; positions count from 1, ``end_pos`` is inclusive."""
    if max_size < 2 or overlap < 0:
        raise ValueError("max_size must be at least 2 and overlap at least 0")
    large = items.select(
        F.lit(item_kind).alias("item_kind"),
        id_col.cast("string").alias("item_id"),
        text_col.alias("text"),
        F.lit(max_size).alias("max_size"),
        F.lit(overlap).alias("overlap"),
    ).where(f"item_id IS NOT NULL AND char_length(text) > {int(max_size)}")
    return large.mapInPandas(_split_batches, PIECES)
