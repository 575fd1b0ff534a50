"""Lines repeated across one source's documents.

Every distinct line of a source becomes a masked form (digits, month names and names inside the line masked). Forms are clustered within
their source: all pairs of at least SIMILAR (Jaccard over words and word pairs) are found by the rarest words and word pairs of each form
and verified on the whole sets, and what they connect is a cluster. A cluster's document frequency is the number of its source's rows that hold any of its lines, and clusters
with enough of it are what is repeated: :func:`repeated_lines` gives every occurrence of every line of them, so that bylines with changing names
and notices with small edits go too. Each occurrence carries the number of rows that hold its very letters, for rules on lines alone.

Lines and forms that one row alone has are clustered like all others: many small edits of one notice are repeated together. A row counts
once for a line. Counts are combined before every shuffle, keys are (source, line), so a source that owns a third of all rows is spread over
all tasks, and a line that owns a large share of all lines is attached by broadcast.

Defined results: rows without a source or with null text are left out; blank texts count as rows of their source; lines without a letter
are left out; repeated raw_ids are separate rows; line numbers count from 1 over all lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.shingles import WordHashes, bit_columns, mixed, rolled
from lorespark.operators.graph import components
from lorespark.operators.skew import attach_by_key, small_side
from lorespark.plans.durable import durable

LEAST_ROWS, LEAST_SHARE = 5, 0.1
SIMILAR = 0.8
LEAST_COUNTERS, MOST_COUNTERS = 1 << 20, 1 << 24  # two bytes each
FEW_BITS = 128  # of a form, in each of its filed rows
FEW = [f"few_{k}" for k in range(FEW_BITS // 64)]
FORMS_OF_A_SHARE = 1000
#: Month names of the languages in use.
MONTHS = (
    "january|february|march|april|may|june|july|august|september|october|november|december|januar|februar|märz|mai|juni|juli|oktober|dezember|"
    "janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
)


_MONTH = re.compile(rf"\b(?:{MONTHS})\b", re.I)
_NAME = re.compile(r"(?<=[\s(\"'-])[^\W\d_a-zß-öø-ÿ][^\W\d_]+")
_NUMBER = re.compile(r"[\d#]+(?:[.,:/-][\d#]+)*")
_OTHER = re.compile(r"[^\w#@]+|_")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_NO_LETTER = {c: None for c in range(128) if not chr(c).isalpha()}
_BLANK = {c: " " for c in range(128) if not chr(c).isalpha() and chr(c) not in "#@"}


_has_digit = re.compile(r"\d").search


def letters(line: str) -> str:
    """The letters of a line, case-folded: by way of upper case, so that sharp s equals ss."""
    return line.lower().translate(_NO_LETTER) if line.isascii() else _NOT_LETTER.sub("", line.upper().lower())


def masked_form(line: str) -> str:
    """Numbers and the months beside them to ``#``, capitalised words after the first to ``@``, then lower case with single spaces."""
    out = _NUMBER.sub("#", _NAME.sub("@", _MONTH.sub("#", line) if _has_digit(line) else line))
    return " ".join(out.lower().translate(_BLANK).split()) if out.isascii() else _OTHER.sub(" ", out).lower().strip()


SEEN = "raw_id BIGINT, source_name STRING, line_no BIGINT, k BIGINT, f BIGINT, form STRING, new_line INT, new_form INT"


def read_lines(docs: DataFrame) -> DataFrame:
    """``SEEN``: every line with a letter, with the hash of its letters and of its masked form. ``new_line`` and ``new_form`` are 1
    where a row has them for the first time, so that their sums count rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lru_cache(20_000)(lambda line: (letters(line), masked_form(line)))  # lines that recur are read once a task
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                rows = []
                for raw_id, name, text in zip(*(c.to_pylist() for c in whole.slice(at, 500).columns), strict=True):
                    salt, lines, forms = name.encode(), set(), set()
                    for n, line in enumerate(text.split("\n"), 1):
                        own, form = read(line)
                        if own:
                            k, f = (xxhash.xxh3_64_intdigest(salt + b"\0" + x.encode()) - (1 << 63) for x in (own, form))
                            rows.append((raw_id, name, n, k, f, form, int(k not in lines), int(f not in forms)))
                            lines.add(k)
                            forms.add(f)
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SEEN.split(", ")])

    given = docs.where("raw_id IS NOT NULL AND source_name IS NOT NULL AND text IS NOT NULL")
    return given.select(F.col("raw_id").cast("bigint"), "source_name", "text").mapInArrow(run, SEEN)


def _own_grams(batch: pa.RecordBatch, known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, their form, how many each form has): the distinct words and word pairs of each form, as hashes salted by the source."""
    lists = [form.split() for form in batch.column("form").to_pylist()]
    lengths = np.array([len(ws) for ws in lists], np.int64)
    owner = np.repeat(np.arange(len(lists)), lengths)
    hashes = known.of([w for ws in lists for w in ws])
    pair = np.arange(len(hashes)) + 1 < np.cumsum(lengths)[owner]
    owners = np.concatenate([owner, owner[pair]])
    grams = mixed(np.concatenate([rolled(hashes, 1), rolled(hashes, 2)[pair]]) + known.of(batch.column("source_name").to_pylist())[owners])
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    return grams[new], owners[new], np.bincount(owners[new], minlength=len(lists))


def gram_counts(forms: DataFrame) -> np.ndarray:
    """How many forms meet each slot of a table of bounded size, up to 65535, never too few: it orders the grams, and a slot met once has one form."""
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (32 * forms.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = WordHashes(), np.zeros(counters, np.int32)
        for batch in batches:
            grams, _, _ = _own_grams(batch, known)
            slots, n = np.unique((grams % np.uint64(counters)).astype(np.int64), return_counts=True)
            met[slots] += n.astype(np.int32)
        slots = np.nonzero(met)[0]
        yield pa.record_batch([pa.array(slots.astype(np.int32)), pa.array(met[slots])], names=["slot", "n"])

    slots = forms.select("source_name", "form").mapInArrow(run, "slot INT, n INT")
    rows = slots.groupBy("slot").agg(F.least(F.sum("n"), F.lit(65535)).cast("int").alias("n")).where("n > 1").toArrow()
    counts = np.ones(counters, np.uint16)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts


_FILED = f"gram BIGINT, f BIGINT, size INT, {', '.join(f'{c} BIGINT' for c in FEW)}"


def _filed(forms: DataFrame, counts: np.ndarray) -> DataFrame:
    """``_FILED``: each form's rarest grams, one more than two forms of SIMILAR may differ by, less those that no other form has."""
    shared = forms.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            grams, owner, sizes = _own_grams(batch, known)
            if not len(grams):
                continue
            met = shared.value[(grams % np.uint64(len(shared.value))).astype(np.int64)]
            place = np.empty(len(grams), np.int64)
            place[np.lexsort((grams, met, owner))] = np.arange(len(grams)) - (np.cumsum(sizes) - sizes)[owner]
            spare = sizes - np.ceil(SIMILAR * sizes - 1e-9).astype(np.int64)
            keep = np.nonzero((place <= spare[owner]) & (met > 1))[0]
            at = pa.array(owner[keep])
            few = bit_columns(grams, owner, batch.num_rows, FEW_BITS)
            yield pa.record_batch(
                [pa.array(grams[keep].view(np.int64)), batch.column("f").take(at), pa.array(sizes.astype(np.int32)).take(at)] + [c.take(at) for c in few],
                names=["gram", "f", "size", *FEW],
            )

    return forms.select("source_name", "f", "form").mapInArrow(run, _FILED)


def _met(filed: DataFrame) -> DataFrame:
    """(a, b): forms that share a filed gram, and whose sizes and bits allow SIMILAR. The rows of a gram that many forms have are met in
    shares, each with each, so that no task makes all its pairs."""
    crowded = filed.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > FORMS_OF_A_SHARE)
    parts = small_side(durable(crowded.select("gram", F.ceil(F.col("n") / FORMS_OF_A_SHARE).cast("int").alias("shares"))))
    own = F.pmod(F.xxhash64("f"), F.col("shares")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    split = filed.join(parts, "gram").withColumn("own", own).withColumn("other", other).drop("shares")
    whole = filed.join(parts, "gram", "left_anti").withColumns({"own": F.lit(0), "other": F.lit(0)})
    rows = whole.unionByName(split)
    one, two = [
        rows.select("gram", F.col(mine).alias("own"), F.col(its).alias("other"), *[F.col(c).alias(f"{c}_{x}") for c in ("f", "size", *FEW)])
        for x, mine, its in (("a", "own", "other"), ("b", "other", "own"))
    ]
    shared = F.ceil(SIMILAR / (1 + SIMILAR) * (F.col("size_a") + F.col("size_b")) - 1e-9)
    lacks = lambda x, y: reduce(Column.__add__, [F.bit_count(F.col(f"{c}_{x}").bitwiseAND(F.bitwise_not(f"{c}_{y}"))) for c in FEW])
    near = (shared <= F.least("size_a", "size_b")) & (lacks("a", "b") <= F.col("size_a") - shared) & (lacks("b", "a") <= F.col("size_b") - shared)
    pairs = one.join(two, ["gram", "own", "other"]).where((F.col("f_a") < F.col("f_b")) & near)
    return pairs.select(F.col("f_a").alias("a"), F.col("f_b").alias("b")).distinct()


def similar_pairs(forms: DataFrame) -> DataFrame:
    """(src, dst): all pairs of forms (source_name, f, form) of a source whose grams are SIMILAR by Jaccard; none is left out.

    Grams have one order, rarest first. Two such forms share at least SIMILAR of either one's grams, so the rarest grams of one that are more
    than the rest hold one of the other's: all pairs meet. The words themselves decide.
    """
    met = durable(_met(durable(_filed(forms, gram_counts(forms)))))
    a, b = [forms.select(F.col("f").alias(x), F.col("form").alias(f"form_{x}")) for x in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(20_000)
        def read(form: str) -> set:
            ws = form.split()
            return {*ws, *zip(ws, ws[1:], strict=False)}

        def similar(x: set, y: set) -> bool:
            both = len(x & y)
            return both >= SIMILAR * (len(x) + len(y) - both) - 1e-9

        for batch in batches:
            ok = [similar(read(x), read(y)) for x, y in zip(batch.column("form_a").to_pylist(), batch.column("form_b").to_pylist(), strict=True)]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.record_batch([kept.column("a"), kept.column("b")], names=["src", "dst"])

    return met.join(a, "a").join(b, "b").select("a", "b", "form_a", "form_b").mapInArrow(run, "src BIGINT, dst BIGINT")


def clusters(forms: DataFrame) -> DataFrame:
    """(f, cluster) of distinct forms (source_name, f, form): what similar pairs connect, directly or through others."""
    links = durable(similar_pairs(forms))
    if links.isEmpty():
        return forms.select("f", F.col("f").alias("cluster"))
    joined = components(links, links.select(F.col("src").alias("id"))).select(F.col("id").alias("f"), "component")
    return forms.select("f").join(small_side(joined), "f", "left").select("f", F.coalesce("component", "f").alias("cluster"))


FOUND = "raw_id, line_no, source_name, cluster, held, line_rows, source_rows"


def repeated_lines(docs: DataFrame, least_rows: int = LEAST_ROWS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``FOUND``: every occurrence of a line whose cluster is repeated excessively within its source. ``held`` of the ``source_rows`` rows of its
    source hold a line of the cluster, ``line_rows`` its very letters."""
    sizes = docs.where("raw_id IS NOT NULL AND source_name IS NOT NULL AND text IS NOT NULL").groupBy("source_name").agg(F.count("*").alias("n"))
    seen = durable(read_lines(docs))
    enough = lambda c: (F.col(c) >= least_rows) & (F.col(c) >= least_share * F.col("n"))
    # a form that one row alone has may still be in a cluster that many rows have, so all are clustered
    units = seen.groupBy("source_name", "k").agg(F.sum("new_line").alias("df"), F.min(F.struct("f", "form")).alias("x"))
    units = durable(units.join(sizes, "source_name").select("source_name", "k", "df", "n", "x.f", "x.form"))
    shown = units.groupBy("source_name", "f").agg(F.min("form").alias("form"))
    of = durable(units.join(clusters(durable(shown)), "f").select("source_name", "k", "df", "n", "cluster"))
    # a cluster's rows are at most the sum of its lines' rows
    wide = of.groupBy("cluster").agg(F.sum("df").alias("most"), F.max("n").alias("n")).where(enough("most")).select("cluster")
    wanted = durable(of.join(wide, "cluster", "left_semi").select("k", "df", "n", "cluster"))
    met = durable(attach_by_key(seen.select("raw_id", "source_name", "line_no", "k"), wanted, "k", "df", seen.count()))
    # distinct raw_ids, but no fewer than the rows of its most frequent line: rows may share a raw_id
    held = met.groupBy("cluster", "raw_id").agg(F.max("df").alias("df"), F.max("n").alias("n")).groupBy("cluster").agg(F.greatest(F.count("*"), F.max("df")).alias("held"), F.max("n").alias("n"))
    found = attach_by_key(met, held.where(enough("held")).select("cluster", "held"), "cluster", "held", met.count())
    return found.withColumnsRenamed({"df": "line_rows", "n": "source_rows"}).select(*FOUND.split(", "))


def by_letters(found: DataFrame, least_rows: int = LEAST_ROWS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Of the occurrences in repeated clusters, those of lines that are repeated often enough letter by letter."""
    return found.where((F.col("line_rows") >= least_rows) & (F.col("line_rows") >= least_share * F.col("source_rows")))


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with each text less its found lines; ``removed`` says how many."""
    cut = found.groupBy("raw_id").agg(F.collect_set(F.col("line_no").cast("int")).alias("cut"))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("cut"), i + 1))
    out = docs.join(cut, "raw_id", "left")
    return out.withColumn("text", F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).withColumn(
        "removed", F.coalesce(F.size("cut"), F.lit(0))
    ).drop("cut")
