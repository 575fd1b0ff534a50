"""Sources and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import search as S
from lorespark.sources import documents as D
from lorespark.sources import store as K
from lorespark.sources.tables import table


def source_type(spark, d):
    return table(spark, d, "doc_sources", "source_name").select("source_name", D.source_type(F.col("source_name")).alias("kind"))


def _urls(spark: SparkSession, d: str) -> DataFrame:
    """The pages' addresses, some of them turned into ones that must not be fetched."""
    host = F.element_at(F.array(*[F.lit(h) for h in ("localhost", "10.0.0.7", "192.168.1.4", "172.20.3.3", "169.254.1.1", "172.32.0.1")]), (F.pmod("raw_id", F.lit(6)) + 1).cast("int"))
    url = (
        F.when(F.pmod("raw_id", F.lit(10)) == 0, F.regexp_replace("page_url", r"^https?://[^/]+", F.concat(F.lit("http://"), host)))
        .when(F.pmod("raw_id", F.lit(10)) == 1, F.replace("page_url", F.lit("https:"), F.lit("ftp:")))
        .otherwise(F.col("page_url"))
    )
    return table(spark, d, "raw_documents", "raw_id", "page_url").where("page_url IS NOT NULL").select("raw_id", url.alias("url"))


def url_guard(spark, d):
    return _urls(spark, d).select("raw_id", F.coalesce(D.url_problem(F.col("url")), F.lit("ok")).alias("problem"))


def url_exclude(spark, d):
    pages = table(spark, d, "raw_documents", "raw_id", "page_url").where("page_url IS NOT NULL")
    return pages.where(~D.is_excluded(F.col("page_url"), ["/Checkout/", "/archive/"])).select("raw_id", "page_url")


def sitemap_locations(spark, d):
    """One sitemap a hundred pages, written as XML and read back."""
    pages = table(spark, d, "raw_documents", "raw_id", "page_url").where("page_url IS NOT NULL")
    one = F.concat(F.lit("<url><loc> "), F.replace("page_url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    maps = pages.groupBy(F.floor(F.col("raw_id") / 100).alias("part")).agg(F.concat_ws("", F.collect_list(one)).alias("urls"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.col("urls"), F.lit("</urlset>"))
    return maps.select(F.explode(D.sitemap_locations(xml)).alias("page_url"))


def html_text(spark, d):
    """Pages written as HTML, with menu, script and footer around the lines, and read back."""
    lines = F.transform(F.split(F.regexp_replace("text", r"[&<>]", " "), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    html = F.concat(
        F.lit("<html><head><title>Page</title><script>var a = 1;</script></head><body><nav>Home</nav><div class='sidebar x'>Links</div><article>"),
        F.array_join(lines, ""), F.lit("</article><footer>Imprint</footer></body></html>"),
    )
    pages = table(spark, d, "raw_documents", "raw_id", "text").where("text IS NOT NULL")
    return D.html_documents(pages.select(F.col("raw_id").cast("string").alias("url"), html.alias("html"))).select("url", "text", "source_name")


def legacy_entries(spark, d):
    """Entries with a text and a vector; those without an id are called after their position."""
    rows = table(spark, d, "knowledge_chunks", "id", "pos", "text", "embedding").where("text IS NOT NULL AND size(embedding) > 0")
    rows = rows.withColumn("id", F.when(F.pmod("pos", F.lit(9)) != 0, F.col("id")))
    return K.with_default_ids(rows, "id", "pos").select("id", "pos")


def upsert_merge(spark, d):
    """The store after the later half of the batches was upserted over the earlier half."""
    rows = table(spark, d, "knowledge_chunks", "id", "batch_no", "pos", "source_name")
    return K.upserted(K.latest(rows.where("batch_no <= 10"), "id", ["batch_no", "pos"]), K.latest(rows.where("batch_no > 10"), "id", ["batch_no", "pos"]))


def point_lookup(spark, d):
    """The chunks that are parents of others, by id."""
    rows = table(spark, d, "knowledge_chunks", "id", "pos", "parent_id")
    return rows.join(rows.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi").select("id", "pos")


def chunk_type_counts(spark, d):
    return table(spark, d, "knowledge_chunks", "chunk_type").groupBy(F.coalesce("chunk_type", F.lit("standalone")).alias("chunk_type")).agg(F.count("*").alias("n"))


def chunks_by_source(spark, d):
    rows = table(spark, d, "knowledge_chunks", "id", "source_name").where(F.col("source_name").isNotNull())
    return rows.groupBy("source_name").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("chunks"))


def sha_manifest(spark, d):
    return K.manifest(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def page_tables(spark, d):
    """Lines of cells in a document, written as one Markdown table."""
    rows = F.transform(F.filter(F.split("text", r"\r?\n"), lambda x: x.startswith("| ")), lambda x: F.split(F.regexp_replace(x, r"^\| | \|\s*$", ""), r" \| "))
    docs = table(spark, d, "raw_documents", "raw_id", "text").where("text IS NOT NULL").select("raw_id", rows.alias("rows")).where("size(rows) > 0")
    return docs.select("raw_id", D.markdown_table(F.col("rows")).alias("markdown"))


QUERIES = {
    f.__name__: f
    for f in (
        source_type, url_guard, url_exclude, sitemap_locations, html_text, legacy_entries, upsert_merge, point_lookup, chunk_type_counts, chunks_by_source,
        sha_manifest, page_tables,
    )
}

_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
SQL = {
    "source_type": """
SELECT source_name, CASE WHEN contains(lower(source_name), 'feature') THEN 'feature_doc' WHEN contains(lower(source_name), 'rule') OR contains(lower(source_name), 'permission') THEN 'system_rule'
  WHEN contains(lower(source_name), 'product') OR contains(lower(source_name), 'guide') THEN 'product_doc' ELSE 'unknown' END AS kind FROM doc_sources""",
    "url_guard": """
SELECT raw_id, CASE WHEN raw_id % 10 = 0 THEN ['blocked host', 'private address', 'private address', 'private address', 'private address', 'ok'][raw_id % 6 + 1]
  WHEN raw_id % 10 = 1 THEN 'scheme' ELSE 'ok' END AS problem FROM raw_documents WHERE page_url IS NOT NULL""",
    "url_exclude": "SELECT raw_id, page_url FROM raw_documents WHERE page_url IS NOT NULL AND NOT contains(lower(page_url), '/checkout/') AND NOT contains(lower(page_url), '/archive/')",
    "sitemap_locations": "SELECT page_url FROM raw_documents WHERE page_url IS NOT NULL",
    "html_text": r"""
SELECT CAST(raw_id AS VARCHAR) AS url, t AS text, 'Page' AS source_name FROM (
  SELECT raw_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[&<>]', ' ', 'g'), chr(10)), lambda x: """
    + _STRIP.format("x")
    + "), lambda x: x <> ''), chr(10)) AS t FROM raw_documents WHERE text IS NOT NULL) WHERE length(t) >= 100",
    "legacy_entries": "SELECT CASE WHEN pos % 9 <> 0 AND id IS NOT NULL THEN id ELSE 'legacy-' || pos END AS id, pos FROM knowledge_chunks WHERE text IS NOT NULL AND len(embedding) > 0",
    "upsert_merge": """
SELECT id, batch_no, pos, source_name FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_no DESC, pos DESC) AS n FROM knowledge_chunks WHERE id IS NOT NULL) WHERE n = 1""",
    "point_lookup": "SELECT id, pos FROM knowledge_chunks WHERE id IN (SELECT parent_id FROM knowledge_chunks WHERE parent_id IS NOT NULL)",
    "chunk_type_counts": "SELECT coalesce(chunk_type, 'standalone') AS chunk_type, count(*) AS n FROM knowledge_chunks GROUP BY 1",
    "chunks_by_source": "SELECT source_name, count(*) AS rows, count(DISTINCT id) AS chunks FROM knowledge_chunks WHERE source_name IS NOT NULL GROUP BY 1",
    "sha_manifest": "SELECT doc_id AS name, sha256(text) AS sha256, strlen(text)::INT AS bytes FROM documents WHERE text IS NOT NULL",
}
