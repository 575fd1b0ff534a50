"""Page boilerplate mixed with main content: consensus paths per host.

A page is text, one line per block, so a block's path is what its line generalises to: its letters with the site's name, digits and
decoration masked (menus, notices, footers), its first segment if it is a trail, its first word and shape if it names a person,
its first words if it is a date. The containers of a page are its runs of lines between blank lines, headings and the title; a container is
scored by how little of it is prose (the share of its words that stand in no sentence). A line's score is a third its container's and two thirds its
own; an opener is a line that leads a list of titles.

Every page votes once for each of its paths, with its line's score; Spark counts the votes and averages the scores per host, and over hosts
for sites with few pages. A path wins with the votes of a share of the pages, the more of them the more its containers look like prose
(SHARE to SENTENCE_SHARE), so that an article's own lines do not win; an opener wins if titles follow it on most pages. The pages are then read again with the winning paths of their host:
lines on a winning path are furniture, as are the titles under a winning opener; page title, headings, lists, table rows and
paragraphs stay. Votes are combined before each shuffle, and a host that owns a third of all pages joins its paths by broadcast.

Defined results: null and blank texts give no lines; a page without a host votes with its source name, or alone; pages fetched again
and equal texts under several addresses of a host vote once; blank lines are never furniture; line numbers count from 1 over all lines.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators.graph import components
from lorespark.operators.skew import attach_by_key
from lorespark.plans.durable import durable

SHARE, SENTENCE_SHARE, LEAST_PAGES, LEAST_HOSTS, OPENER_SHARE = 0.06, 0.15, 3, 4, 0.4
SMALL_HOST = 200  # pages

_LEAD, _TAIL = " \t\r\u2009\u200b\ufeff»›•*·-–>", " \t\r\u2009\u200b»›!"
_COUNT = re.compile(r"\s*\(\d+\)\Z")
_NO_LETTER = {c: None for c in range(128) if not chr(c).isalpha()}
_LETTERS = re.compile(r"[\W\d_]+")
_HEADING = re.compile(r"\s*(?:#{1,6}\s|\d+(?:\.\d+)+\s)")
_LIST = re.compile(r"\s*(?:[-*•·»›>–]\s|\d+[.)]\s|\|)")
_TRAIL = re.compile(r"\s*[»›>/|·]\s*")
_SENTENCE_END = re.compile(r"[.;:?!。][\"')\]]*\Z")
_NAMES = re.compile(r"(?:[^\W\d_a-z][\w'’.-]*\s*){1,4}\Z")


@dataclass(slots=True, frozen=True)
class Line:
    text: str
    key: str  # letters, decoration and the site's name masked
    paths: list[str]
    sentence: bool
    heading: bool
    titled: bool  # looks like a title: short, no sentence end


def _key(text: str) -> str:
    """The case-folded letters of the text."""
    return text.lower().translate(_NO_LETTER) if text.isascii() else _LETTERS.sub("", text.casefold())


@lru_cache(20_000)  # menus and footers are read once a task
def read_line(raw: str, site: str) -> Line | None:
    text = raw.replace("\xa0", " ").strip()
    if not text:
        return None
    bare = text.lstrip(_LEAD).rstrip(_TAIL)
    if bare.endswith(")"):
        bare = (bare[:-12] + _COUNT.sub("", bare[-12:])).rstrip(_TAIL)
    key = _key(bare)
    if len(site) > 3:
        key = key.replace(site, "@")
    n_words = bare.count(" ") + 1 if "  " not in bare and "\t" not in bare else len(bare.split())
    ends = not text.endswith("!") and bool(_SENTENCE_END.search(text, max(0, len(text) - 4)))
    paths = ["line:" + key] if key else ["mark:" + "".join(c for c in bare[:40] if not c.isspace())[:8]]
    heading = bool(_HEADING.match(raw))
    if text.startswith("|") and text.endswith("|") and len(text) > 2:
        return Line(text, key, [], False, False, False)  # a table row is content, however often it occurs
    if (ends and n_words >= 8) or n_words > 24 or "。" in text:
        return Line(text, key, paths, True, heading, False)
    listed = bool(_LIST.match(raw))
    titled = not ends and not heading and not listed and 2 <= n_words <= 14 and not any(c in bare for c in "|»›·") and not bare.startswith("©")
    parts = [p for p in _TRAIL.split(bare) if p] if any(c in bare for c in "»›>/|·") else []
    if len(parts) > 1:
        paths.append("trail:" + _key(parts[0]))
    digits = sum(map(str.isdigit, bare))
    if 2 < n_words <= 5 and not ends and not digits:
        first, rest = bare.split(maxsplit=1)
        if _NAMES.match(rest):
            paths.append("by:" + first.casefold())
    if digits >= 4 and n_words <= 12 and not listed and not heading:
        paths.append("dated:" + " ".join(map(_key, bare.split()[:2])))
    return Line(text, key, paths, False, heading, titled)


def title_line(lines: list[Line | None], url: str | None) -> int | None:
    """Where the page's own title is: the line that the address spells, else none."""
    if not url:
        return None
    slug = _LETTERS.sub("", url.rstrip("/").rsplit("/", 1)[-1].casefold())
    if len(slug) < 8:
        return None
    for n, line in enumerate(lines):
        if line and not line.sentence and len(line.key) >= 6:
            plain = _fold(line.key)
            if plain.startswith(slug) or (slug.startswith(plain) and len(plain) > 12):
                return n
    return None


def _fold(key: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", key) if not unicodedata.combining(c))


@lru_cache(1000)
def _site(host: str | None) -> str:
    return _LETTERS.sub("", (host or "").split(".")[0].casefold())


def line_scores(lines: list[Line | None], title: int | None) -> list[float]:
    """How much each line looks like furniture, 0 to 1: one third its container's score, two thirds its own."""
    out, run, bounds = [0.0] * len(lines), [], [n for n, x in enumerate(lines) if x is None or x.heading or n == title] + [len(lines)]
    start = 0
    for end in bounds:
        run = range(start, end)
        n_words = [len(lines[n].text.split()) for n in run]
        prose = sum(w for n, w in zip(run, n_words, strict=True) if lines[n].sentence)
        score = 1 - prose / max(1, sum(n_words))
        for n in run:
            out[n] = (score + 2 * (not lines[n].sentence)) / 3
        start = end + 1
    return out


VOTES = "host STRING, page BIGINT, path STRING, opens INT, score DOUBLE"


def page_votes(pages: DataFrame) -> DataFrame:
    """``VOTES``: once for each path of each page, by its best scored line; ``opens`` is 1 where titles follow the line, directly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page, url, text in zip(batch["host"], batch["page"], batch["page_url"], batch["text"], strict=True):
                lines = [read_line(x, _site(host)) for x in text.split("\n")]
                title, seen = title_line(lines, url), {}
                scores = line_scores(lines, title)
                before = None
                for n, line in enumerate(lines):
                    if not line:
                        continue
                    led, before = before is not None and before.titled, line
                    if line.heading or n == title:
                        continue
                    after = lines[n + 1 : n + 3]
                    opens = int(not led and len(after) == 2 and all(x and x.titled for x in after) and title not in (n + 1, n + 2))
                    for path in line.paths:
                        old = seen.get(path, (0, 0.0))
                        seen[path] = (max(opens, old[0]), max(scores[n], old[1]))
                rows += [(host, page, path, o, s) for path, (o, s) in seen.items()]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["host", "page", "path", "opens", "score"])
                    rows = []
            yield pd.DataFrame(rows, columns=["host", "page", "path", "opens", "score"])

    return pages.select("host", "page", "page_url", "text").mapInPandas(run, VOTES)


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, pages, paths, openers) with the winning paths of every host."""
    once = votes.groupBy("host", "path", "page").agg(F.max("opens").alias("opens"), F.max("score").alias("score"))
    counted = once.groupBy("host", "path").agg(F.count("*").alias("n"), F.avg("opens").alias("opens"), F.avg("score").alias("score"))
    counted = durable(counted)
    sizes = votes.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    shares = durable(counted.join(sizes, "host"))
    prose = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("score"))  # 0 for a short line among such, 1 for a sentence among such
    more = F.when(prose > 0.6, 1).otherwise(0)
    # what wins at many hosts wins at those with too few pages to vote
    local = F.col("n") >= F.greatest(2 + more, (0.03 + 0.07 * prose) * F.col("pages"))
    common = shares.where(local).groupBy("path").agg(F.count("*").alias("hosts"), F.avg("opens").alias("open_at"), F.avg("score").alias("score"))
    common = common.where(F.col("hosts") >= LEAST_HOSTS * (1 + more)).select("path", "open_at")
    needed = F.greatest(LEAST_PAGES + more, (SHARE + (SENTENCE_SHARE - SHARE) * prose) * F.col("pages"))
    own = shares.where(F.col("n") >= needed).select("host", "path", F.col("opens") >= OPENER_SHARE)
    # a host of many pages shows a common path on some of them, so that what is lent to one host is bounded as its own paths are
    lent = shares.where((F.col("pages") <= SMALL_HOST) | (F.col("n") >= 0.01 * F.col("pages"))).select("host", "path").join(common, "path").select("host", "path", F.col("open_at") >= OPENER_SHARE)
    won = own.union(lent).toDF("host", "path", "opener").groupBy("host", "path").agg(F.max("opener").alias("opener"))
    # a path needs a share of the pages, so a host has boundedly many
    per_host = won.groupBy("host").agg(F.collect_list("path").alias("paths"), F.collect_list(F.when(F.col("opener"), F.col("path"))).alias("openers"))
    return sizes.join(per_host, "host", "left")


def label(text: str, host: str | None, url: str | None, paths: set[str], openers: set[str]) -> list[int]:
    """Line numbers, from 1, of the furniture of a page."""
    lines = [read_line(x, _site(host)) for x in text.split("\n")]
    title = title_line(lines, url)
    name = lines[title].key if title is not None else None
    marked: set[int] = set()
    weak: list[int] = []
    for n, line in enumerate(lines):
        if line is None or n == title:
            continue
        if name and not line.sentence and line.key != name and line.key.endswith(name) and len([p for p in _TRAIL.split(line.text) if p]) > 1:
            marked.add(n)
        elif not line.heading and any(p in paths for p in line.paths):
            if any(p in openers for p in line.paths):
                marked.add(n)
            elif line.titled and len(line.text.split()) >= 4 and not any(p in paths for p in line.paths if not p.startswith("line:")):
                weak.append(n)  # a title that is linked from many pages, or a heading that reads like one
            else:
                marked.add(n)
    for n in range(len(lines)):
        if n in marked and any(p in openers for p in lines[n].paths):
            k = n + 1
            while k < len(lines) and lines[k] and k != title and (lines[k].titled or k in weak) and not lines[k].sentence and k not in marked:
                k += 1
            # one title before prose is a heading of the article, unless it is linked elsewhere too
            run = range(n + 1, k)
            if len(run) > 1 or (len(run) == 1 and (run[0] in weak or (k < len(lines) and k in marked))):
                marked.update(run)
    last = max((n for n, x in enumerate(lines) if x and n not in marked and n not in weak), default=-1)
    for n in weak:
        # before the title or after the last prose there is no article left that it could head
        if n < (title or 0) or n > last or n - 1 in marked or n + 1 in marked or n - 1 in weak or n + 1 in weak:
            marked.add(n)
    return [n + 1 for n in sorted(marked)]


def _voters(pages: DataFrame) -> DataFrame:
    """``pages`` with ``page``, the same for rows of a host that share their address or their text, directly or through others."""
    pages = pages.withColumn("page", F.xxhash64("host", F.coalesce("page_url", F.col("raw_id").cast("string"))))
    # hashes only, combined before the shuffle
    seen = pages.select("host", F.xxhash64("text").alias("same"), "page")
    texts = seen.groupBy("host", "same").agg(F.min("page").alias("first"), F.max("page").alias("other")).where("first < other").select("host", "same", "first")
    links = durable(seen.join(texts, ["host", "same"]).where("page <> first").select(F.col("first").alias("src"), F.col("page").alias("dst")).distinct())
    if links.isEmpty():
        return pages
    one = components(links, links.select(F.col("src").alias("id"))).withColumnsRenamed({"id": "page", "component": "one"})
    return pages.join(one, "page", "left").withColumn("page", F.coalesce("one", "page")).drop("one")


LABELLED = "raw_id BIGINT, furniture ARRAY<INT>, body STRING"


def extract(pages: DataFrame, with_body: bool = True) -> DataFrame:
    """``LABELLED`` of pages with raw_id, page_url, host and text: furniture line numbers, and the text without them."""
    ready = pages.where("raw_id IS NOT NULL AND text IS NOT NULL").withColumn("host", F.coalesce("host", F.concat(F.lit("?"), F.col("raw_id").cast("string"))))
    won = durable(winning_paths(durable(page_votes(_voters(ready)))))
    total = won.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    joined = attach_by_key(ready.select("host", "raw_id", "page_url", "text"), won, "host", "pages", total)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[set, set]] = {}
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.host not in known:
                    if len(known) > 200:
                        known.clear()
                    known[r.host] = (set(r.paths if r.paths is not None else ()), set(r.openers if r.openers is not None else ()))
                cut = label(r.text, r.host, r.page_url, *known[r.host])
                gone = set(cut)
                body = "\n".join(x for n, x in enumerate(r.text.split("\n"), 1) if n not in gone) if with_body else None
                rows.append((r.raw_id, cut, body))
            yield pd.DataFrame(rows, columns=["raw_id", "furniture", "body"])

    return joined.select("raw_id", "host", "page_url", "text", "paths", "openers").mapInPandas(run, LABELLED)
