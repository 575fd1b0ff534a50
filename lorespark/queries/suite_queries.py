"""Test suites and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import modeljson as J
from lorespark.operators import suite as U
from lorespark.operators.skew import spread
from lorespark.sources.tables import table


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "test_cases")


def exact_dedup(spark, d):
    return U.first_by_signature(_cases(spark, d), ["suite_id", "pos"]).select("case_id", "suite_id", "test_case")


def enum_coerce(spark, d):
    return _cases(spark, d).select("case_id", U.coerced(F.col("test_type"), U.TEST_TYPES, "functionality").alias("test_type"), U.coerced(F.col("priority"), U.PRIORITIES, "medium").alias("priority"))


def prioritize(spark, d):
    return U.prioritised(_cases(spark, d))


def missing_dependencies(spark, d):
    return U.missing_dependencies(_cases(spark, d))


def quality_score(spark, d):
    cases = _cases(spark, d)
    return cases.select("case_id", U.quality(cases).alias("quality"))


def suite_quality(spark, d):
    """Mean quality and size of each suite, largest first."""
    cases = _cases(spark, d)
    return cases.groupBy("suite_id").agg(F.count("*").alias("cases"), F.round(F.avg(U.quality(cases)), 6).alias("mean_quality"))


def export_flatten(spark, d):
    return U.flattened(_cases(spark, d))


def continuation_new(spark, d):
    """Cases of the later half of each suite's positions whose title the earlier half lacks."""
    cases = _cases(spark, d).select("case_id", "suite_id", "pos", "test_case")
    return U.new_titles(cases.where("pos > 30"), cases.where("pos <= 30")).select("case_id", "suite_id")


def short_suites(spark, d):
    """Suites and use cases with fewer than five cases, which ask for more."""
    return _cases(spark, d).groupBy("suite_id", "use_case").agg(F.count("*").alias("cases")).where("cases < 5")


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Each case as a model would have written it: fenced, in prose, behind thoughts, under a key, with a trailing comma, with quotes inside quotes, cut off."""
    cases = _cases(spark, d).where("test_case IS NOT NULL")
    one = F.to_json(F.struct("use_case", "test_case", "priority", "steps", "tags"), {"ignoreNullFields": "false"})
    kind = F.pmod("case_id", F.lit(7))
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n["), one, F.lit("]\n```")))
        .when(kind == 1, F.concat(F.lit("Here are the cases:\n["), one, F.lit("]\nDone.")))
        .when(kind == 2, F.concat(F.lit("<think>[maybe]</think>\n"), one))
        .when(kind == 3, F.concat(F.lit('{"test_cases": ['), one, F.lit(",]}")))
        .when(kind == 4, F.concat(F.lit("["), one))
        .when(kind == 5, F.concat(F.lit('[{"test_case": "cut "here" too", "steps": ['), F.lit('"a"], "x": null}, '), one, F.lit(', {"use_case": "a "cut" off rep')))
        .otherwise(F.concat(F.lit('{"note": "", "ids": [1], "found": ['), one, F.lit(', {"steps": ["one", "tw')))
    )
    return cases.select("case_id", raw.alias("raw"))


def reply_cases(spark, d):
    """Replies parsed, repaired where truncated, and typed."""
    cases = J.read_replies(spread(_replies(spark, d)), "raw")
    # an outer generator infers no filter that would repeat the reading below it
    cases = cases.select("case_id", F.explode_outer("cases").alias("c")).where("c IS NOT NULL")
    return J.typed_cases(cases, "c").where("test_case <> 'cut \"here\" too'").select("case_id", "use_case", "test_case", F.size("steps").alias("n_steps"), F.array_join("tags", ",").alias("tags"))


def semantic_pairs(spark, d):
    """Cases of one suite whose use case and title share most of their words, between the first cases of each wording."""
    return U.similar_pairs(_cases(spark, d))


def semantic_dedup(spark, d):
    """Cases that stay when each is dropped if it is too similar to an earlier one that stays."""
    cases = _cases(spark, d).where("suite_id IS NOT NULL")
    heads = U.wordings(cases).select(F.col("case_id").alias("id"))
    return U.semantic_first(heads, U.similar_pairs(cases)).select(F.col("id").alias("case_id"))


def suite_merged(spark, d):
    """Each suite's cases in the order of their use cases' parts, numbered through."""
    cases = _cases(spark, d).select("case_id", "suite_id", "pos", F.floor(F.col("pos") / 10).alias("part"))
    return U.merged_in_order(cases, "part", "pos").select("case_id", "suite_id", "place")


def suite_completed(spark, d):
    """Suites of the first half of the positions, completed by those of the other half whose wording they lack."""
    cases = _cases(spark, d).where("suite_id IS NOT NULL").select("case_id", "suite_id", "pos", "use_case", "test_case", "steps")
    return U.completed(cases.where("pos <= 30"), cases.where("pos > 30"), ["suite_id", "pos"]).select("case_id", "suite_id")


def suite_reviewed(spark, d):
    """Every other suite was reviewed; the review kept its cases of high priority that have a title."""
    cases = _cases(spark, d).select("case_id", "suite_id", "test_case", "priority")
    improved = cases.where(F.pmod("suite_id", F.lit(2)) == 0).where("lower(trim(priority)) = 'high'")
    return U.reviewed(cases, improved).select("case_id", "suite_id")


def event_categories(spark, d):
    """Events by type, each counted once under the first category that matches."""
    kind = F.lower("event_type")
    return table(spark, d, "events", "event_type").agg(
        F.sum(F.when(F.contains(kind, F.lit("err")), 1).otherwise(0)).alias("errors"),
        F.sum(F.when(~F.contains(kind, F.lit("err")) & F.contains(kind, F.lit("sign")), 1).otherwise(0)).alias("signs"),
        F.sum(F.when(~F.contains(kind, F.lit("err")) & ~F.contains(kind, F.lit("sign")), 1).otherwise(0)).alias("others"),
    )


def stage_share(spark, d):
    """Each event type's value, its share of all, and whether it is the largest."""
    by = table(spark, d, "events", "event_type", "value").groupBy("event_type").agg(F.sum("value").alias("total"))
    whole = by.agg(F.sum("total").alias("whole"), F.max("total").alias("most"))  # one row
    return by.join(F.broadcast(whole)).select("event_type", F.round("total", 4).alias("total"), F.round(100 * F.col("total") / F.col("whole"), 4).alias("share"), (F.col("total") == F.col("most")).alias("bottleneck"))


def throughput(spark, d):
    """Events a second of each user, from first to last; 0 where no time passed."""
    at = F.col("ts").cast("timestamp")
    span = (F.max(F.unix_micros(at)) - F.min(F.unix_micros(at))) / 1e6
    by = table(spark, d, "events", "user_id", "ts").groupBy("user_id").agg(F.count("*").alias("n"), span.alias("seconds"))
    return by.select("user_id", "n", F.round(F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")).otherwise(0.0), 9).alias("rate"))


QUERIES = {
    f.__name__: f
    for f in (
        exact_dedup, enum_coerce, prioritize, missing_dependencies, quality_score, suite_quality, export_flatten, continuation_new, short_suites, reply_cases, semantic_pairs, semantic_dedup,
        suite_merged, suite_completed, suite_reviewed,
        event_categories, stage_share, throughput,
    )
}

_S = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
_LOW = "lower(" + _S + ")"
_FORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
_TYPE = f"CASE WHEN {_LOW.format('test_type')} IN {U.TEST_TYPES} THEN {_LOW.format('test_type')} ELSE 'functionality' END"
_PRIO = f"CASE WHEN {_LOW.format('priority')} IN {U.PRIORITIES} THEN {_LOW.format('priority')} ELSE 'medium' END"
_QUALITY = """round(CASE WHEN len(steps) >= 2 THEN 0.30 WHEN len(steps) = 1 THEN 0.15 ELSE 0 END + CASE WHEN len(expected_results) >= 1 THEN 0.25 ELSE 0 END
  + CASE WHEN len(preconditions) >= 1 THEN 0.15 ELSE 0 END + CASE WHEN cardinality(test_data) >= 1 THEN 0.15 ELSE 0 END
  + CASE WHEN coalesce(use_case, '') <> '' AND length(coalesce(test_case, '')) > 10 THEN 0.15 WHEN coalesce(use_case, '') <> '' OR coalesce(test_case, '') <> '' THEN 0.07 ELSE 0 END, 2)::DOUBLE"""
_LINES = "coalesce(array_to_string(list_filter({0}, lambda x: x IS NOT NULL), {1}), '') AS {0}"
_WORDINGS = r"""
WITH w AS (
  SELECT case_id, suite_id, coalesce(pos, -1) AS pos,
    list_sort(list_distinct(regexp_extract_all(lower(coalesce(use_case, '') || ' ' || coalesce(test_case, '')), '[\p{L}\p{N}_]+'))) AS t FROM test_cases WHERE suite_id IS NOT NULL),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY suite_id, t ORDER BY pos, case_id) AS n FROM w WHERE len(t) > 0) WHERE n = 1)
"""
_SIMILAR = """
SELECT x.case_id AS a, y.case_id AS b FROM h x JOIN h y ON x.suite_id = y.suite_id AND (x.pos, x.case_id) < (y.pos, y.case_id)
WHERE len(list_intersect(x.t, y.t)) ** 2 > 0.7225 * len(x.t) * len(y.t)"""
SQL = {
    "exact_dedup": f"""
SELECT case_id, suite_id, test_case FROM (SELECT *, row_number() OVER (PARTITION BY
  {_FORM.format('use_case')}, {_FORM.format('test_case')}, array_to_string(list_transform(list_filter(coalesce(steps, []), lambda s: s IS NOT NULL), lambda s: {_FORM.format('s')}), ' ')
  ORDER BY suite_id NULLS FIRST, pos NULLS FIRST, case_id) AS n FROM test_cases) WHERE n = 1""",
    "enum_coerce": f"SELECT case_id, {_TYPE} AS test_type, {_PRIO} AS priority FROM test_cases",
    "prioritize": f"""
SELECT case_id, suite_id, row_number() OVER (PARTITION BY suite_id ORDER BY
  CASE {_LOW.format("coalesce(priority, '')")} WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, coalesce(len(dependencies), 0), coalesce(pos, -1), case_id) AS place
FROM test_cases WHERE suite_id IS NOT NULL""",
    "missing_dependencies": """
SELECT DISTINCT suite_id, case_id, dependency FROM (SELECT suite_id, case_id, unnest(dependencies) AS dependency FROM test_cases WHERE suite_id IS NOT NULL) x
WHERE dependency IS NOT NULL AND NOT EXISTS (SELECT 1 FROM test_cases t WHERE t.suite_id = x.suite_id AND t.test_case = x.dependency)""",
    "quality_score": f"SELECT case_id, {_QUALITY} AS quality FROM test_cases",
    "suite_quality": f"SELECT suite_id, count(*) AS cases, round(avg({_QUALITY}), 6) AS mean_quality FROM test_cases GROUP BY suite_id",
    "export_flatten": f"""
SELECT case_id, use_case, test_case, {_TYPE} AS test_type, {_LINES.format('preconditions', 'chr(10)')},
  coalesce(array_to_string(list_transform(list_sort(map_entries(test_data)), lambda e: e.key || ': ' || coalesce(e.value, 'None')), chr(10)), '') AS test_data,
  {_LINES.format('steps', 'chr(10)')}, {_PRIO} AS priority, {_LINES.format('dependencies', "', '")}, {_LINES.format('tags', "', '")},
  {_LINES.format('expected_results', 'chr(10)')}, {_LINES.format('actual_results', 'chr(10)')} FROM test_cases""",
    "continuation_new": f"""
SELECT case_id, suite_id FROM test_cases a WHERE pos > 30 AND NOT EXISTS (
  SELECT 1 FROM test_cases b WHERE b.pos <= 30 AND b.suite_id = a.suite_id AND {_LOW.format("coalesce(b.test_case, '')")} = {_LOW.format("coalesce(a.test_case, '')")})""",
    "short_suites": "SELECT suite_id, use_case, count(*) AS cases FROM test_cases GROUP BY ALL HAVING count(*) < 5",
    "reply_cases": """
SELECT case_id, coalesce(nullif(use_case, ''), 'General Use Case') AS use_case, coalesce(nullif(test_case, ''), 'Untitled Test Case') AS test_case,
  coalesce(len(list_filter(steps, lambda s: s IS NOT NULL)), 0)::INT AS n_steps, coalesce(array_to_string(list_filter(tags, lambda s: s IS NOT NULL), ','), '') AS tags
FROM test_cases WHERE test_case IS NOT NULL""",
    "semantic_pairs": _WORDINGS + _SIMILAR,
    "suite_merged": """
SELECT case_id, suite_id, row_number() OVER (PARTITION BY suite_id ORDER BY coalesce(floor(pos / 10), -1), pos NULLS FIRST, case_id) AS place FROM test_cases WHERE suite_id IS NOT NULL""",
    "suite_completed": f"""
SELECT case_id, suite_id FROM (SELECT *, row_number() OVER (PARTITION BY
  {_FORM.format('use_case')}, {_FORM.format('test_case')}, array_to_string(list_transform(list_filter(coalesce(steps, []), lambda s: s IS NOT NULL), lambda s: {_FORM.format('s')}), ' ')
  ORDER BY CASE WHEN pos <= 30 THEN 0 ELSE 1 END, suite_id, pos, case_id) AS n FROM test_cases WHERE suite_id IS NOT NULL AND pos IS NOT NULL) WHERE n = 1""",
    "suite_reviewed": r"""
WITH v AS (SELECT case_id, suite_id FROM test_cases WHERE suite_id % 2 = 0 AND lower(trim(priority)) = 'high' AND regexp_matches(coalesce(test_case, ''), '[^\s\p{Z}]'))
SELECT case_id, suite_id FROM test_cases WHERE suite_id IS NULL OR suite_id NOT IN (SELECT suite_id FROM v) UNION ALL SELECT case_id, suite_id FROM v""",
    "event_categories": """
SELECT sum(CASE WHEN contains(lower(event_type), 'err') THEN 1 ELSE 0 END)::BIGINT AS errors,
  sum(CASE WHEN NOT contains(lower(event_type), 'err') AND contains(lower(event_type), 'sign') THEN 1 ELSE 0 END)::BIGINT AS signs,
  sum(CASE WHEN NOT contains(lower(event_type), 'err') AND NOT contains(lower(event_type), 'sign') THEN 1 ELSE 0 END)::BIGINT AS others FROM events""",
    "stage_share": """
WITH b AS (SELECT event_type, sum(value) AS total FROM events GROUP BY 1)
SELECT event_type, round(total, 4) AS total, round(100 * total / sum(total) OVER (), 4) AS share, total = max(total) OVER () AS bottleneck FROM b""",
    "throughput": """
WITH b AS (SELECT user_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY 1)
SELECT user_id, n, round(CASE WHEN seconds > 0 THEN n / seconds ELSE 0 END, 9) AS rate FROM b""",
}
