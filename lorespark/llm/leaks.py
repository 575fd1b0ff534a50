"""Evaluation texts leaking into training text: rare seeds, then Smith-Waterman alignment.

Seeds are runs of SEED words of a test item: of every NEAR words of the item the run that the fewest items have, so that a copy in which one word of
five is changed, put in or dropped still holds some (an item of fewer words is its own seed). A document is read once; its seeds vote
for the items they belong to and for how far the copy is shifted. The stretch of the document that the whole item may cover meets the item
where either all seeds of WINDOW words of the item (or of all of it, if shorter) vote for the same shift, as they do in every exact copy of these, or
a share of VOTES of all its seeds vote for nearly the same, as in an edited copy. The two are aligned by words:
the best local alignment (match +2, mismatch and gap -1) scores whole, partial, edited and paraphrased copies. A pair leaks if its score is
at least that of WINDOW words in a row (or of the whole item, if it has fewer) and either EDITED of the whole item's, as every edited or
paraphrased copy of most of an item has, or due to so many words in a row: texts of one subject share phrases that add up to less.
``longest_run`` says how many words are the same in a row.

At most SMALL_SET seeds are sent to the tasks at once; a larger test set takes several passes, by items, and its items are joined in a shuffle.

Defined results: null and blank texts leak nothing; items without a word are left out; repeated document or item rows give one
row per pair of ids; a document may leak several items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.shingles import WordHashes, rolled, words
from lorespark.plans.durable import durable

WINDOW, SEED, NEAR = 13, 3, 5
VOTES, LEAST_VOTES = 0.15, 4
BAND = 16  # words of drift within an edited copy, or a quarter of the item
EDITED = 0.35
SMALL_SET = 1_000_000  # seeds with their places that may be sent to every task: 24 MB
REGIONS = "doc_id BIGINT, item_id BIGINT, first_word INT, region_words STRING"
LEAKS = "doc_id BIGINT, item_id BIGINT, score DOUBLE, longest_run INT, last_word INT, needed INT, leaked BOOLEAN"


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, item_words, n_words, hashes of all runs by place) of each item with a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                ws = words(text)
                if ws:
                    n = min(SEED, len(ws))
                    rows.append((item, " ".join(ws), len(ws), rolled(known.of(ws), n)[: len(ws) - n + 1].view(np.int64)))
            yield pd.DataFrame(rows, columns=["item_id", "item_words", "n_words", "grams"])

    usable = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text").dropDuplicates(["item_id"])
    return usable.mapInPandas(run, "item_id BIGINT, item_words STRING, n_words INT, grams ARRAY<BIGINT>")


def seeds_of(items: DataFrame) -> DataFrame:
    """(item_id, n_words, seed, place): of every NEAR words of every item the run of SEED words that the fewest items have, with its place from 0."""
    places = items.select("item_id", F.posexplode("grams").alias("place", "seed"))
    rare = places.groupBy("seed").agg(F.countDistinct("item_id").alias("df"))
    ranked = places.join(rare, "seed").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("place", "df", "seed"))).alias("g"))
    held = NEAR - SEED + 1  # so many runs are in NEAR words
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("g") - (held - 1)))
    least = F.transform(starts, lambda s: F.array_min(F.transform(F.slice("g", s, held), lambda x: F.struct(x["df"], x["seed"], x["place"]))))
    chosen = ranked.select("item_id", F.explode(F.array_distinct(least)).alias("x")).select("item_id", "x.seed", "x.place")
    return chosen.join(items.select("item_id", "n_words"), "item_id").select("item_id", "n_words", "seed", "place")


@dataclass
class Seeds:
    """What a task needs of a part of the seeds: the sorted runs and, by offsets, each one's entries: its item, place, and so on."""

    run: np.ndarray
    offset: np.ndarray
    item: np.ndarray
    place: np.ndarray
    length: np.ndarray  # words of the item
    number: np.ndarray  # of the seed in its item, from 0
    count: np.ndarray  # seeds of the item
    before: np.ndarray  # place of the seed before it, or -1
    behind: np.ndarray  # place of the next one, or the number of the item's runs
    sizes: list[int]

    @classmethod
    def of(cls, part: pa.Table) -> Seeds:
        seed, item, place, length = (part[c].to_numpy().astype(np.int64) for c in ("seed", "item_id", "place", "n_words"))
        order = np.lexsort((place, item))
        seed, item, place, length = seed[order], item[order], place[order], length[order]
        new = np.ones(len(item), bool)
        new[1:] = item[1:] != item[:-1]
        start = np.nonzero(new)[0]
        group = np.cumsum(new) - 1
        count = np.diff(np.append(start, len(item)))[group] if len(item) else place
        before, behind = np.roll(place, 1), np.roll(place, -1)
        before[new] = -1
        last = np.roll(new, -1)
        behind[last] = (length - np.minimum(length, SEED) + 1)[last]
        number = np.arange(len(item)) - (start[group] if len(item) else 0)
        order = np.argsort(seed.view(np.uint64), kind="stable")
        run, first = np.unique(seed.view(np.uint64)[order], return_index=True)
        return cls(run, np.append(first, len(seed)), *(x[order] for x in (item, place, length, number, count, before, behind)), sorted({min(SEED, int(n)) for n in np.unique(length)}))

    def votes(self, flat: np.ndarray, owner: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the seeds in ``flat``, their entries here)."""
        at, entry = [], []
        for size in self.sizes if len(self.run) else []:
            grams = rolled(flat, size)
            slot = np.minimum(np.searchsorted(self.run, grams), len(self.run) - 1)
            hits = np.nonzero((place <= lengths[owner] - size) & (self.run[slot] == grams))[0]
            first, n = self.offset[slot[hits]], self.offset[slot[hits] + 1] - self.offset[slot[hits]]
            own = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(hits) else np.zeros(0, np.int64)
            right = np.minimum(self.length[own], SEED) == size  # a short item's whole text, not a run that hashes alike
            at.append(np.repeat(hits, n)[right])
            entry.append(own[right])
        return (np.concatenate(at), np.concatenate(entry)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _agreeing(seeds: Seeds, doc: np.ndarray, entry: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Which votes agree, see above."""
    good, item, number = np.zeros(len(doc), bool), seeds.item[entry], seeds.number[entry]
    if not len(doc):
        return good
    # the same shift: seeds that follow each other, over the places of a whole window
    order = np.lexsort((number, shift, item, doc))
    e = entry[order]
    first = _first(doc[order], item[order], shift[order], number[order] - np.arange(len(order)))
    start = np.nonzero(first)[0]
    end = np.append(start[1:], len(order)) - 1
    wide = seeds.behind[e[end]] - seeds.before[e[start]] - 1
    runs = seeds.length[e[start]] - np.minimum(seeds.length[e[start]], SEED) + 1
    good[order[(wide >= np.minimum(runs, WINDOW - SEED + 1))[np.cumsum(first) - 1]]] = True
    # nearly the same shift: a share of all seeds of the item
    width = np.maximum(BAND, seeds.length[entry] // 4)
    for half in (0, 1):
        band = (shift + half * (width // 2)) // width
        order = np.lexsort((number, band, item, doc))
        each = _first(doc[order], item[order], band[order], number[order])
        first = _first(doc[order], item[order], band[order])
        group = np.cumsum(first) - 1
        voted = np.bincount(group, weights=each)
        good[order[(voted >= np.maximum(LEAST_VOTES, VOTES * seeds.count[entry[order[first]]]))[group]]] = True
    return good


def regions(docs: DataFrame, seeds: pa.Table) -> DataFrame:
    """``REGIONS``: the stretches of each document that an item may cover, where enough seeds agree; overlapping ones of an item are one."""
    shared = docs.sparkSession.sparkContext.broadcast(Seeds.of(seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_seeds = WordHashes(), shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = [words(t) for t in batch.column("text").to_pylist()]
                lengths = np.array([len(ws) for ws in lists])
                flat = known.of([w for ws in lists for w in ws])
                if not len(flat):
                    continue
                owner = np.repeat(np.arange(len(lists)), lengths)
                place = np.arange(len(flat)) - (np.cumsum(lengths) - lengths)[owner]
                hit, entry = known_seeds.votes(flat, owner, place, lengths)
                n_words, item = known_seeds.length[entry], known_seeds.item[entry]
                shift = place[hit] - known_seeds.place[entry]
                good = _agreeing(known_seeds, owner[hit], entry, shift)
                doc, item, n_words, shift = owner[hit][good], item[good], n_words[good], shift[good]
                slack = 8 + n_words // 4
                low, high = np.maximum(shift - slack, 0), np.minimum(shift + n_words + slack, lengths[doc])
                order = np.lexsort((low, item, doc))
                out, ids = [], batch.column("doc_id").to_pylist()
                for k in order:
                    key = (doc[k], item[k])
                    if out and out[-1][0] == key and low[k] <= out[-1][2]:
                        out[-1][2] = max(out[-1][2], high[k])
                    else:
                        out.append([key, low[k], high[k]])
                yield pa.record_batch(
                    [pa.array([ids[d] for (d, _), _, _ in out], pa.int64()), pa.array([i for (_, i), _, _ in out], pa.int64()), pa.array([a + 1 for _, a, _ in out], pa.int32()),
                     pa.array([" ".join(lists[d][a:b]) for (d, _), a, b in out], pa.string())],
                    names=["doc_id", "item_id", "first_word", "region_words"],
                )

    return docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, REGIONS)


def align(doc: list[str], item: list[str]) -> tuple[int, int, int]:
    """(best local score, longest exact run, last document word of the best alignment from 1)."""
    codes = {w: n for n, w in enumerate(dict.fromkeys(item))}
    d = np.array([codes.get(w, -1) for w in doc])
    score, runs = np.zeros(len(d) + 1, np.int32), np.zeros(len(d) + 1, np.int32)
    ramp, best, longest, last = np.arange(len(d) + 1, dtype=np.int32), 0, 0, 0
    for w in item:
        same = d == codes[w]
        step = np.maximum(score - 1, 0)
        step[1:] = np.maximum(step[1:], score[:-1] + np.where(same, 2, -1))
        score = np.maximum.accumulate(step + ramp) - ramp  # gaps along the document
        runs[1:] = np.where(same, runs[:-1] + 1, 0)
        longest = max(longest, int(runs.max()))
        top = int(score.argmax())
        if score[top] > best:
            best, last = int(score[top]), top
    return best, longest, last


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``LEAKS``: every document and item whose seeds agree, aligned. ``score`` is the part of the item that the alignment gives (1 for a whole
    copy), ``needed`` the words in a row whose score makes a leak: WINDOW or the whole item."""
    ready = durable(item_words(items))
    seeds = durable(seeds_of(ready))
    passes = max(1, -(-seeds.count() // SMALL_SET))
    texts = ready.select("item_id", "item_words")
    pairs = None
    for n in range(passes):
        part = seeds.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n).toArrow()  # at most about SMALL_SET rows, however many items there are
        met = regions(docs, part).join(F.broadcast(texts) if passes == 1 else texts, "item_id")
        pairs = met if pairs is None else pairs.unionByName(met)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                item = r.item_words.split(" ")
                best, longest, last = align(r.region_words.split(" "), item)
                needed = min(WINDOW, len(item))
                score = best / (2 * len(item))
                leaked = best >= 2 * needed and (score >= EDITED or longest >= needed)
                rows.append((r.doc_id, r.item_id, score, longest, r.first_word + last - 1, needed, leaked))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEAKS.split(", ")])

    # few rows, costly ones: dealt out to all tasks
    scored = pairs.select("doc_id", "item_id", "first_word", "region_words", "item_words").repartition("doc_id", "item_id", "first_word").mapInPandas(run, LEAKS)
    best = F.max(F.struct("leaked", "longest_run", "score", "last_word", "needed")).alias("x")
    out = scored.groupBy("doc_id", "item_id").agg(best, F.max("score").alias("score"))
    return out.select("doc_id", "item_id", "score", "x.longest_run", "x.last_word", "x.needed", "x.leaked")
