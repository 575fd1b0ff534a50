"""Relational operators on test suites: de-duplication, order, checks, scores, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import dedup_form, strip, tokens
from lorespark.plans.durable import durable

#: What the enumerated fields may hold.
PRIORITIES = ("high", "medium", "low")
TEST_TYPES = ("functionality", "ui", "performance", "integration", "usability", "database", "security", "acceptance")


def coerced(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The value in lower case without outer white space, or the default if it isn't allowed."""
    low = F.lower(strip(value))
    return F.when(low.isin(*allowed), low).otherwise(default)


def signature(use_case: Column, title: Column, steps: Column) -> Column:
    """What two cases must share to be the same: use case, title and steps without case and punctuation."""
    step_text = F.array_join(F.transform(F.filter(F.coalesce(steps, F.array().cast("array<string>")), lambda s: s.isNotNull()), dedup_form), " ")
    return F.concat_ws("|", dedup_form(use_case), dedup_form(title), step_text)


def first_by_signature(cases: DataFrame, order: list[str]) -> DataFrame:
    """The first case of each signature in the given order. One row a signature is kept per task before the shuffle, so a signature
    that owns a third of all rows costs no more than others; only keys are shuffled, the rows are joined back by case_id."""
    keyed = cases.select("case_id", F.xxhash64(signature(F.col("use_case"), F.col("test_case"), F.col("steps"))).alias("s"), F.struct(*order, "case_id").alias("o"))
    return cases.join(keyed.groupBy("s").agg(F.min("o").alias("o")).select("o.case_id"), "case_id", "left_semi")


def priority_rank(priority: Column) -> Column:
    low = F.lower(strip(F.coalesce(priority, F.lit(""))))
    return F.when(low == "high", 0).when(low == "low", 2).otherwise(1)  # an unknown or missing priority counts as medium


def prioritised(cases: DataFrame) -> DataFrame:
    """(case_id, suite_id, place): the order of a suite's cases by priority, number of dependencies, position and id.

    Places are counted in two steps, ranges of the sort key first, so no suite is sorted by one task.
    """
    key = F.struct(priority_rank(F.col("priority")).alias("p"), F.greatest(F.coalesce(F.size("dependencies"), F.lit(0)), F.lit(0)).alias("d"), F.coalesce("pos", F.lit(-1)).alias("pos"))
    keyed = cases.where("suite_id IS NOT NULL").select("case_id", "suite_id", key.alias("k"))
    # (priority, dependencies, position) groups of a suite are small; their sizes give each group's first place
    sizes = durable(keyed.groupBy("suite_id", "k").agg(F.count("*").alias("n")))
    before = Window.partitionBy("suite_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("suite_id", "k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("suite_id", "k").orderBy("case_id")
    return keyed.join(starts, ["suite_id", "k"]).select("case_id", "suite_id", (F.col("start") + F.row_number().over(inside)).alias("place"))


def missing_dependencies(cases: DataFrame) -> DataFrame:
    """(suite_id, case_id, dependency): dependencies that are no title of their suite, compared exactly."""
    wanted = cases.select("suite_id", "case_id", F.explode("dependencies").alias("dependency")).where("dependency IS NOT NULL AND suite_id IS NOT NULL").distinct()
    titles = cases.where("test_case IS NOT NULL").select("suite_id", F.col("test_case").alias("dependency")).distinct()
    return wanted.join(titles, ["suite_id", "dependency"], "left_anti").select("suite_id", "case_id", "dependency")


def quality(cases: DataFrame) -> Column:
    """0 to 1 by completeness: steps, expected results, preconditions, data, titles."""
    def n(c: str) -> Column:
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))

    use, title = F.coalesce(F.col("use_case"), F.lit("")), F.coalesce(F.col("test_case"), F.lit(""))
    score = (
        F.when(n("steps") >= 2, 0.30).when(n("steps") == 1, 0.15).otherwise(0.0)
        + F.when(n("expected_results") >= 1, 0.25).otherwise(0.0)
        + F.when(n("preconditions") >= 1, 0.15).otherwise(0.0)
        + F.when(n("test_data") >= 1, 0.15).otherwise(0.0)
        + F.when((use != "") & (F.char_length(title) > 10), 0.15).when((use != "") | (title != ""), 0.07).otherwise(0.0)
    )
    return F.round(score, 2)


def flattened(cases: DataFrame) -> DataFrame:
    """The export columns: lists joined by line feeds or commas, the map as 'key: value' lines in key order."""
    def lines(c: str, sep: str = "\n") -> Column:
        return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), sep).alias(c)

    data = F.array_join(F.transform(F.array_sort(F.map_entries("test_data")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), "\n")
    return cases.select(
        "case_id", "use_case", "test_case", coerced(F.col("test_type"), TEST_TYPES, "functionality").alias("test_type"), lines("preconditions"),
        F.coalesce(data, F.lit("")).alias("test_data"), lines("steps"), coerced(F.col("priority"), PRIORITIES, "medium").alias("priority"),
        lines("dependencies", ", "), lines("tags", ", "), lines("expected_results"), lines("actual_results"),
    )


def new_titles(cases: DataFrame, known: DataFrame) -> DataFrame:
    """Cases of a continuation whose title their suite does not have yet, ignoring case and outer white space."""
    key = F.lower(strip(F.coalesce(F.col("test_case"), F.lit(""))))
    have = known.select("suite_id", key.alias("t")).distinct()
    return cases.withColumn("t", key).join(have, ["suite_id", "t"], "left_anti").drop("t")


def wordings(cases: DataFrame) -> DataFrame:
    """(case_id, suite_id, pos, words): the first case of each set of words in a suite. Cases without a word are left out."""
    words = F.array_sort(F.array_distinct(tokens(F.concat_ws(" ", F.coalesce("use_case", F.lit("")), F.coalesce("test_case", F.lit(""))))))
    keyed = cases.where("suite_id IS NOT NULL").select("suite_id", words.alias("words"), F.struct(F.coalesce("pos", F.lit(-1)).alias("pos"), "case_id").alias("o"))
    first = keyed.where(F.size("words") > 0).groupBy("suite_id", "words").agg(F.min("o").alias("o"))
    return first.select("o.case_id", "suite_id", "o.pos", "words")


def similar_pairs(cases: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b), a before b: first wordings of one suite whose sets of words have a cosine above ``threshold``.

    Words are ordered rarest first. Two sets above the threshold share one of their first n - ceil(t^2 n) + 1 words, so only those are
    joined; that is exact, and common words stay out of the join.
    """
    heads = durable(wordings(cases))
    spread = heads.select("case_id", "suite_id", F.explode("words").alias("word"))
    df = spread.groupBy("word").agg(F.count("*").alias("df"))
    ranked = spread.join(df, "word").groupBy("case_id", "suite_id").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("r"))
    n = F.size("r")
    prefix = F.slice("r", F.lit(1), (n - F.ceil(F.lit(threshold * threshold) * n) + 1).cast("int"))
    filed = durable(ranked.select("case_id", "suite_id", F.explode(F.transform(prefix, lambda x: x["word"])).alias("word")).join(heads.select("case_id", "pos", F.size("words").alias("n")), "case_id"))
    x, y = [filed.select("suite_id", "word", *[F.col(c).alias(f"{c}_{s}") for c in ("case_id", "pos", "n")]) for s in "ab"]
    t2 = threshold * threshold
    met = x.join(y, ["suite_id", "word"]).where((F.struct("pos_a", "case_id_a") < F.struct("pos_b", "case_id_b")) & (F.least("n_a", "n_b") > t2 * F.greatest("n_a", "n_b")))
    pairs = met.select(F.col("case_id_a").alias("a"), F.col("case_id_b").alias("b")).distinct()
    wa, wb = heads.select(F.col("case_id").alias("a"), F.col("words").alias("wa")), heads.select(F.col("case_id").alias("b"), F.col("words").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    return pairs.join(wa, "a").join(wb, "b").where(shared * shared > t2 * F.size("wa") * F.size("wb")).select("a", "b")


def semantic_first(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ids that stay when, in order, an id is dropped if it is too similar to an earlier one that stays.

    ``vectors`` has id; ``pairs`` has (a, b), a before b, of all pairs above the threshold. Each round keeps what no open pair points at.
    """
    open_pairs, dropped = durable(pairs.select("a", "b").distinct()), None
    while not open_pairs.isEmpty():
        stay = open_pairs.select("a").distinct().join(open_pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = durable(open_pairs.join(stay, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        rest = open_pairs.join(stay, "a", "left_anti")
        rest = rest.join(gone.select(F.col("id").alias("b")), "b", "left_anti").join(gone.select(F.col("id").alias("a")), "a", "left_anti")
        open_pairs = durable(rest.select("a", "b"))
    return vectors.select("id") if dropped is None else vectors.select("id").join(dropped, "id", "left_anti")


def merged_in_order(parts: DataFrame, part_col: str, pos_col: str) -> DataFrame:
    """The cases of all parts of a suite with their place in it, by part and position; a part that gave nothing adds nothing.

    Sizes of parts come first, so no suite is sorted by one task. ``parts`` has suite_id and case_id.
    """
    sizes = parts.groupBy("suite_id", part_col).agg(F.count("*").alias("n"))
    before = Window.partitionBy("suite_id").orderBy(part_col).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("suite_id", part_col, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("suite_id", part_col).orderBy(pos_col, "case_id")
    known = parts.where("suite_id IS NOT NULL").withColumn(part_col, F.coalesce(part_col, F.lit(-1)))
    starts = starts.where("suite_id IS NOT NULL").withColumn(part_col, F.coalesce(part_col, F.lit(-1)))
    return known.join(starts, ["suite_id", part_col]).withColumn("place", F.col("start") + F.row_number().over(inside)).drop("start")


def completed(cases: DataFrame, missing: DataFrame, order: list[str]) -> DataFrame:
    """A suite with the cases that a checklist pass found missing behind its own, each signature once, its own first."""
    own, more = cases.withColumn("_added", F.lit(0)), missing.withColumn("_added", F.lit(1))
    return first_by_signature(own.unionByName(more, allowMissingColumns=True), ["_added", *order]).drop("_added")


def reviewed(cases: DataFrame, improved: DataFrame) -> DataFrame:
    """Of each suite the reviewer's cases if there are any with a title, else the suite as it was."""
    valid = improved.where(F.coalesce(strip(F.col("test_case")), F.lit("")) != "")
    suites = valid.select("suite_id").distinct()
    kept = cases.join(F.broadcast(suites) if suites.count() <= 1_000_000 else suites, "suite_id", "left_anti")
    return kept.unionByName(valid, allowMissingColumns=True)
