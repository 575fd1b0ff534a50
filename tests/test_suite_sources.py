from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lorespark import config
from lorespark.functions import modeljson as J
from lorespark.functions import prompts as P
from lorespark.operators import suite as U
from lorespark.plans import pipeline
from lorespark.sources import documents as D
from lorespark.sources import store as K
from lorespark.streaming import ingest as I

CASES = "case_id BIGINT, suite_id BIGINT, pos INT, use_case STRING, test_case STRING, steps ARRAY<STRING>, priority STRING, dependencies ARRAY<STRING>"


def test_exact_dedup_keeps_first(spark):
    rows = [(1, 1, 2, "Login!", "Valid login", ["a"], "low", None), (2, 1, 1, "login", "valid LOGIN", ["A"], "high", None), (3, 1, 3, None, None, None, None, None), (4, 1, 4, "x", None, [None], None, None)]
    kept = U.first_by_signature(spark.createDataFrame(rows, CASES), ["suite_id", "pos"])
    assert {r.case_id for r in kept.collect()} == {2, 3, 4}


def test_prioritised(spark):
    rows = [(1, 1, 1, "", "a", [], "low", []), (2, 1, 2, "", "b", [], " HIGH ", ["a", "b"]), (3, 1, 3, "", "c", [], "high", None), (4, 1, 4, "", "d", [], "odd", []), (5, 1, 1, "", "e", [], "low", [])]
    got = U.prioritised(spark.createDataFrame(rows, CASES)).orderBy("place").collect()
    assert [r.case_id for r in got] == [3, 2, 4, 1, 5]  # "odd" counts as medium


def test_missing_dependencies(spark):
    rows = [(1, 1, 1, "", "a", [], "low", ["b", "zz", None]), (2, 1, 2, "", "b", [], "low", None), (3, 2, 1, "", "zz", [], "low", None)]
    assert [(r.case_id, r.dependency) for r in U.missing_dependencies(spark.createDataFrame(rows, CASES)).collect()] == [(1, "zz")]


def test_semantic_first_is_greedy(spark):
    v = spark.createDataFrame([(i,) for i in range(1, 6)], "id BIGINT")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a BIGINT, b BIGINT")
    assert {r.id for r in U.semantic_first(v, pairs).collect()} == {1, 3, 5}


@pytest.mark.parametrize(
    ("raw", "titles"),
    [
        ('<think>[x]</think>[{"test_case": "a"}]', ["a"]),
        ('```json\n{"test_cases": [{"test_case": "a"}, {"test_case": "b"}, 3]}\n```', ["a", "b"]),
        ('Here: [{"test_case": "a",},]', ["a"]),
        ('[{"test_case": "a", "steps": ["x"]}, {"test_case": "b", "steps": ["lo', ["a"]),
        ('[{"test_case": "Press "Save" now"}]', ['Press "Save" now']),
        ('{"use_case": "u", "test_case": "single"}', ["single"]),
        ("no json", []),
        ("", []),
        (None, []),
    ],
)
def test_replies(spark, raw, titles):
    df = J.read_replies(spark.createDataFrame([(raw,)], "raw STRING"), "raw")
    typed = J.typed_cases(df.select(F.explode_outer("cases").alias("c")).where("c IS NOT NULL"), "c")
    assert [r.test_case for r in typed.collect()][: len(titles)] == titles


def test_typed_case():
    case = J.typed_case('{"steps": [{"step": 1, "note": null, "action": "Click"}, {}, 2.5, [1]], "expected_results": "s", "tags": " ", "test_data": [{"a": true}, {"a": 1, "b": null}, "x"]}')
    assert case["steps"] == ["step: 1, action: Click", "2.5"] and case["expected_results"] == ["s"] and case["tags"] == []
    assert case["test_data"] == {"a": "1", "b": "None"} and case["use_case"] == "General Use Case" and case["priority"] == "medium"
    assert J.typed_case(None)["steps"] is None


def test_page_text():
    body = "word " * 30
    html = f"<html><head><title>T</title></head><body><nav>menu</nav><div class='sidebar'>s<p>x</div><main><h1>H</h1><p>{body}</p><footer>f</footer></main><p>out</p></body></html>"
    assert D.page_text(html) == ("T", "H\n" + body.strip())
    assert D.page_text("<p>short</p>") == ("", "")


def test_url_problems(spark):
    urls = ["http://a.b/c", "ftp://a.b", "http://localhost/x", "https://10.1.2.3", "http://172.16.0.1", "http://172.32.0.1", "http:///x", None, "http://[::1]/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u STRING").select(D.url_problem(F.col("u"))).collect()]
    assert got == [None, "scheme", "blocked host", "private address", "private address", None, "no host", "scheme", "private address"]


def test_sitemap_and_table(spark):
    xml = '<urlset xmlns="x"><url><loc> http://a/1 </loc></url><url><loc>http://a/2</loc></url></urlset>'
    df = spark.createDataFrame([(xml, [["a", None], ["b", "c"]])], "x STRING, t ARRAY<ARRAY<STRING>>")
    row = df.select(D.sitemap_locations(F.col("x")).alias("u"), D.markdown_table(F.col("t")).alias("t")).first()
    assert row.u == ["http://a/1", "http://a/2"] and row.t == "| a |  |\n| --- | --- |\n| b | c |"


def test_read_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "product_guide.md").write_text("Hello\n\nPage 1 of 2\nworld")
    (tmp_path / "empty.txt").write_text(" \n")
    (tmp_path / "x.bin").write_bytes(b"1")
    good, bad = D.read_folder(spark, str(tmp_path))
    assert [tuple(r) for r in good.collect()] == [("Hello\nworld", "product_guide.md", "product_doc")]
    assert {r.reason for r in bad.collect()} == {"empty", "unknown suffix"}


def test_manifest(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "name STRING, content STRING")
    listed = K.manifest(files, "name", "content")
    now = K.manifest(spark.createDataFrame([("a", "1"), ("b", "changed")], "name STRING, content STRING"), "name", "content")
    broken = listed.withColumn("sha256", F.when(F.col("name") == "a", "xyz").otherwise(F.col("sha256")))
    assert {tuple(r) for r in K.verified(now, listed).collect()} == {("a", "ok"), ("b", "tampered"), ("d", "missing")}
    assert ("a", "malformed") in {tuple(r) for r in K.verified(now, broken).collect()}


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id STRING, v INT")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id STRING, v INT")
    assert {tuple(r) for r in K.upserted(old, new).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in K.latest(old.union(new), "id", ["v"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_stream_is_idempotent(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    doc = '{"doc_id": "1", "text": "' + "alpha beta. " * 80 + '", "source_name": "s", "source_type": "t"}\n'
    (source / "a.json").write_text(doc)
    I.ingest_stream(I.read_json_stream(spark, str(source)), store, str(tmp_path / "cp")).awaitTermination()
    first = spark.read.parquet(store).count()
    (source / "b.json").write_text(doc)  # the same document again
    I.ingest_stream(I.read_json_stream(spark, str(source)), store, str(tmp_path / "cp")).awaitTermination()
    assert first > 1 and spark.read.parquet(store).count() == first


def test_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([("1", "# Refunds\nRefunds are paid within five days.\n# Vouchers\nA voucher expires after a year.", "a.md", "t"), ("2", "Owls sit in trees at night and watch.", "b.md", "t")], "doc_id STRING, text STRING, source_name STRING, source_type STRING")
    pipeline.ingest(docs, str(tmp_path / "kb"))
    found = pipeline.search(spark, str(tmp_path / "kb"), spark.createDataFrame([("q", "when does a voucher expire")], "query_id STRING, query STRING"), 1).collect()
    assert "voucher" in found[0].text
    prompts = spark.createDataFrame([("p", "make")], "prompt_id STRING, prompt STRING")
    cases = pipeline.generated_cases(prompts, lambda p: f'```json\n[{{"test_case": "{p}", "steps": "one"}}]\n```').collect()
    assert cases[0].test_case == "make" and cases[0].steps == ["one"]


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"retrieval": {"top_k": 9, "unknown": 1}, "other": {}}')
    got = config.load(str(path), {"LORESPARK_RETRIEVAL_TOP_K": "7", "LORESPARK_QUALITY_SEMANTIC_THRESHOLD": "0.5"})
    assert got["retrieval"]["top_k"] == 7 and got["quality"]["semantic_threshold"] == 0.5 and "unknown" not in got["retrieval"]
    assert config.load(str(tmp_path / "none.json"), {}) == config.DEFAULTS


def test_durable_tables_can_be_released(spark):
    from lorespark.plans.durable import durable, release

    kept = durable(spark.range(5))
    files = kept.inputFiles()
    assert kept.count() == 5 and files
    release(kept)
    from pathlib import Path
    from urllib.parse import urlparse

    assert not Path(urlparse(files[0]).path).exists()


def test_first_rows(spark):
    from lorespark.operators.skew import first_rows

    df = spark.createDataFrame([("a", 2, 1), ("a", None, 5), ("b", 1, 1), ("b", 1, 1), (None, 0, 0)], "id STRING, batch INT, pos INT")
    assert sorted(map(tuple, first_rows(df, "id", ["batch", "pos"]).collect()), key=str) == [("a", None, 5), ("b", 1, 1), ("b", 1, 1)]


@pytest.mark.parametrize(
    ("text", "means"),
    [
        ('{"steps": ["Click the "Save" button"]}', {"steps": ['Click the "Save" button']}),
        ('{"a": "Go to "Leads" module", "b": "tab \\"x\\""}', {"a": 'Go to "Leads" module', "b": 'tab "x"'}),
        ('[{"a": "1"}, {"b": "2"},', [{"a": "1"}, {"b": "2"}]),
        ('[{"use_case": "In", "steps": ["1", "2",],}, {"use_case": "Out", "test_ca', [{"use_case": "In", "steps": ["1", "2"]}]),
        ('{"a": {"b": [1, -2.5e3, {"c": true, "d": "x', {"a": {"b": [1, -2500.0, {"c": True}]}}),
        ('[{"a": "x", "b": "y', [{"a": "x"}]),
        ('{"a": "", "b": [], "c": null}', {"a": "", "b": [], "c": None}),
        ("[", []),
    ],
)
def test_mended(text, means):
    assert json.loads(J.mended(text)) == means


def test_unknown_priority_counts_as_medium(spark):
    rows = [(1, 1, "low", 0), (2, 1, "??", 1), (3, 1, None, 2), (4, 1, "Medium ", 3), (5, 1, "HIGH", 4)]
    df = spark.createDataFrame([(*r, None) for r in rows], "case_id BIGINT, suite_id BIGINT, priority STRING, pos INT, dependencies ARRAY<STRING>")
    assert [r.case_id for r in U.prioritised(df).orderBy("place").collect()] == [5, 2, 3, 4, 1]


def test_graph_store(spark, tmp_path):
    folder = f"file://{tmp_path}/graph"
    assert K.load_graph(spark, folder) is None
    K.save_graph(spark.createDataFrame([("a", "b")], "src STRING, dst STRING"), spark.createDataFrame([("a",), ("b",)], "id STRING"), folder)
    nodes, edges = K.load_graph(spark, folder)
    assert nodes.count() == 2 and edges.count() == 1
    K.reset(spark, folder)
    K.reset(spark, folder)
    assert K.load_graph(spark, folder) is None
    (tmp_path / "a.json").write_text('{"nodes": [{"id": "x"}, {"id": "y"}], "links": [{"source": "x", "target": "y", "relation": "parent_of"}]}')
    (tmp_path / "b.json").write_text('{"nodes": [{"id": "z"}], "edges": [{"source": "z", "target": "x", "weight": 2}]}')
    (tmp_path / "c.json").write_text("{broken")
    nodes, edges = K.node_link(spark, f"file://{tmp_path}/*.json")
    assert {r.id for r in nodes.collect()} == {"x", "y", "z"} and {(r.src, r.dst, r.relation, r.weight) for r in edges.collect()} == {("x", "y", "parent_of", None), ("z", "x", None, 2)}


def test_prompts(spark):
    df = spark.createDataFrame([("doc", "ctx", "api", 3), ("doc", None, "web", 0), (None, "", None, None)], "d STRING, c STRING, a STRING, n INT")
    one, two, three = [r[0] for r in df.select(P.generation_prompt(F.col("d"), F.col("c"), F.col("a"), F.col("n"))).collect()]
    assert "ctx" in one and "exactly 3" in one and "malformed" in one and "known about" not in two and "exactly" not in two and "<<<DOCUMENT\n\nDOCUMENT>>>" in three
    long = spark.createDataFrame([("x" * 9000,)], "p STRING").select(F.length(P.within_window(F.col("p"), F.lit(2048), 0)), F.length(P.within_window(F.col("p"), F.lit(100), 0))).first()
    assert tuple(long) == ((2048 - 256) * 3, 0)
    joined = spark.createDataFrame([("[Context 1]\na\n\n[Context 2]\nb [x]",), ("",)], "c STRING").select(P.split_labelled(F.col("c"))).collect()
    assert [r[0] for r in joined] == [["[Context 1]\na", "[Context 2]\nb [x]"], []]


def test_suite_passes(spark):
    kind = "case_id BIGINT, suite_id BIGINT, pos INT, part INT, use_case STRING, test_case STRING, steps ARRAY<STRING>"
    rows = [(1, 1, 1, 0, "u", "One", ["a"]), (2, 1, 2, 0, "u", "two", None), (3, 2, 1, 1, "u", "x", None), (4, None, 1, None, "u", "y", None)]
    cases = spark.createDataFrame(rows, kind)
    more = spark.createDataFrame([(9, 1, 0, None, "u", "ONE!", ["A"]), (8, 1, 5, 1, "u", "three", None), (7, 2, 1, 0, "u", " ", None)], kind)
    assert {r.case_id for r in U.completed(cases, more, ["suite_id", "pos"]).collect()} == {1, 2, 3, 4, 7, 8}
    assert {r.case_id for r in U.reviewed(cases, more).collect()} == {9, 8, 3, 4}
    assert [(r.case_id, r.place) for r in U.merged_in_order(cases.unionByName(more), "part", "pos").where("suite_id = 1").orderBy("place").collect()] == [(9, 1), (1, 2), (2, 3), (8, 4)]
    assert U.reviewed(cases, more.limit(0)).count() == 4 and U.merged_in_order(cases.limit(0), "part", "pos").isEmpty()


def test_spelt_addresses_and_limits(spark):
    urls = ["http://2130706433/", "http://0x7f.1/", "http://0177.0.0.1/", "http://127.1/", "http://8.8.8.8/", "http://a1.example/", "http://1.example/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u STRING").select(D.url_problem(F.col("u"))).collect()]
    assert got == ["private address"] * 4 + [None] * 3
    listed = spark.createDataFrame([("http://a/x", 3), ("http://a/Login", 1), ("http://a/y", 2), ("http://a/y", 9), (None, 0)], "url STRING, place INT")
    assert [r.url for r in D.wanted_urls(listed, ["login"], 1).collect()] == ["http://a/y"] and D.wanted_urls(listed, []).count() == 3
