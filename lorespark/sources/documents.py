"""Reading documents, pages and addresses as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.text import clean_text, strip

SUFFIXES = ("md", "txt", "pdf")
MOST_BYTES = 50 * 1024 * 1024


def source_type(path: Column) -> Column:
    """What a file is, by the first word that its path holds."""
    low = F.lower(path)
    return (
        F.when(F.contains(low, F.lit("feature")), "feature_doc")
        .when(F.contains(low, F.lit("rule")) | F.contains(low, F.lit("permission")), "system_rule")
        .when(F.contains(low, F.lit("product")) | F.contains(low, F.lit("guide")), "product_doc")
        .otherwise("unknown")
    )


def read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of all text files below ``folder``: documents (text, source_name, source_type), rejects (path, reason).

    Each file is one row read by one task; too large, unknown and empty files are reported, not raised. PDF needs a reader that is not part of this library.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).withColumn("suffix", suffix)
    text = clean_text(F.decode("content", "UTF-8"))
    reason = (
        F.when(~F.col("suffix").isin(*SUFFIXES), "unknown suffix")
        .when(F.col("suffix") == "pdf", "no PDF reader")
        .when(F.col("length") > MOST_BYTES, "too large")
    )
    known = files.withColumn("reason", reason).withColumn("text", F.when(reason.isNull(), text))
    known = known.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("text") == ""), "empty").otherwise(F.col("reason")))
    good = known.where("reason IS NULL").select("text", F.regexp_extract("path", r"([^/]+)$", 1).alias("source_name"), source_type(F.col("path")).alias("source_type"))
    return good, known.where("reason IS NOT NULL").select("path", "reason")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of the lines that are neither blank nor comments."""
    return spark.read.text(path).select(strip(F.col("value")).alias("url")).where("url <> '' AND NOT startswith(url, '#')")


#: Addresses that are never fetched.
BLOCKED = ("localhost", "127.0.0.1", "0.0.0.0", "::1")
#: An address as one number, or in hexadecimal or octal parts: it may be any of the private ones.
_SPELT = r"^(?:\d+|0x[0-9a-f.x]+|(?:\d+\.)*0\d+(?:\.\d+)*|\d+\.\d+|\d+\.\d+\.\d+)$"
_PRIVATE = r"^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|\[?(?:::1|f[cd][0-9a-f]{2}:|fe80:))"


def url_problem(url: Column) -> Column:
    """Why an address must not be fetched, or null. Names are not resolved here; that is the fetcher's part."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    return (
        F.when(~scheme.isin("http", "https") | url.isNull(), "scheme")
        .when(host == "", "no host")
        .when(host.isin(*BLOCKED), "blocked host")
        .when(host.rlike(_PRIVATE) | host.rlike(_SPELT), "private address")
    )


def is_excluded(url: Column, patterns: list[str]) -> Column:
    """Whether the address holds any of the patterns, ignoring case."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(F.lower(url), F.lit(p.lower()))
    return out


def wanted_urls(urls: DataFrame, patterns: list[str], limit: int | None = None) -> DataFrame:
    """(url): those that hold none of the patterns, each once, in the order of ``place``; the limit counts what is left."""
    kept = urls.where("url IS NOT NULL").where(~is_excluded(F.col("url"), patterns)).groupBy("url").agg(F.min("place").alias("place")).orderBy("place", "url")
    return (kept.limit(limit) if limit else kept).select("url")


def sitemap_locations(xml: Column) -> Column:
    """The page addresses of a sitemap, in whatever namespace."""
    return F.filter(F.transform(F.xpath(xml, F.lit("//*[local-name()='url']/*[local-name()='loc']/text()")), strip), lambda u: u != "")


#: What is dropped from a page and where its main part may stand.
DROPPED_TAGS = frozenset("script style nav header footer aside form button iframe noscript".split())
DROPPED_CLASSES = frozenset("nav navbar sidebar menu footer header navigation breadcrumb pagination toc table-of-contents".split())
DROPPED_ROLES = frozenset(("navigation", "banner", "contentinfo"))
MAIN_PARTS = (("tag", "main"), ("tag", "article"), ("class", "content"), ("class", "main-content"), ("id", "content"), ("id", "main"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
LEAST_TEXT = 100


class _Page(HTMLParser):
    """Collects text nodes with the main parts that they stand in; dropped subtrees are skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, frozenset[int]]] = []  # tag, dropped, parts
        self.texts: list[tuple[frozenset[int], bool, str]] = []
        self.seen: dict[int, int] = {}
        self.title = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID_TAGS:
            return
        held = dict(attrs)
        classes = set((held.get("class") or "").split())
        _, dropped, parts = self.open[-1] if self.open else ("", False, frozenset())
        dropped = dropped or tag in DROPPED_TAGS or bool(classes & DROPPED_CLASSES) or held.get("role") in DROPPED_ROLES
        for n, (kind, name) in enumerate(MAIN_PARTS):
            here = tag == name if kind == "tag" else name in classes if kind == "class" else held.get("id") == name
            if here and not dropped and n not in self.seen:
                self.seen[n] = 1
                parts = parts | {n}
        self.open.append((tag, dropped, parts))

    def handle_endtag(self, tag: str) -> None:
        for n in range(len(self.open) - 1, -1, -1):
            if self.open[n][0] == tag:
                del self.open[n:]
                return

    def handle_data(self, data: str) -> None:
        tag, dropped, parts = self.open[-1] if self.open else ("", False, frozenset())
        if tag == "title" and not self.title:
            self.title = data.strip()
        if not dropped and data.strip():
            self.texts.append((parts, any(t == "body" for t, _, _ in self.open), data.strip()))


def page_text(html: str) -> tuple[str, str]:
    """(title, text): the first main part that the page has, else its body, else all of it; '' if that is shorter than LEAST_TEXT."""
    page = _Page()
    page.feed(html)
    page.close()
    part = next((n for n in range(len(MAIN_PARTS)) if n in page.seen), None)
    chosen = [t for parts, _, t in page.texts if part in parts] if part is not None else [t for _, body, t in page.texts if body] or [t for _, _, t in page.texts]
    text = "\n".join(line for block in chosen for line in (x.strip() for x in block.split("\n")) if line)
    return page.title, text if len(text) >= LEAST_TEXT else ""


def html_documents(pages: DataFrame) -> DataFrame:
    """(url, text, source_name, source_type) of pages with url and html that hold enough text; the name is the title's first 100 characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(url, text, (title or url)[:100], "web_doc") for url, (title, text) in zip(batch["url"], map(page_text, batch["html"]), strict=True) if text]
            yield pd.DataFrame(rows, columns=["url", "text", "source_name", "source_type"])

    return pages.where("html IS NOT NULL AND url IS NOT NULL").select("url", "html").mapInPandas(run, "url STRING, text STRING, source_name STRING, source_type STRING")


def markdown_table(rows: Column) -> Column:
    """An array of rows (arrays of strings) as a Markdown table; null cells are empty, the rule below the first row is as wide as it."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: strip(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))
    rule = F.transform(rows[0], lambda c: F.lit("---"))
    table = F.concat(F.array(line(rows[0]), line(rule)), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line))
    return F.when((F.size(rows) > 0) & (F.size(rows[0]) > 0), F.array_join(table, "\n")).otherwise("")
