"""Readers, writers, page rules, graph expansion and streams."""

import json

from pyspark.sql import functions as F

from manylabel.operators import graph
from manylabel.plans import ingest as ingest_plans
from manylabel.sources import apps, datasets, markup, pages
from manylabel.streaming import ingest

PAGE = """<html><body><h1 itemprop="name"><span>Fun &amp; Games</span></h1>
<a itemprop="genre" href="/x">Role Playing</a>
<div><div>Updated</div><span><div><span>May 1</span></div></span></div>
<div><div>Content Rating</div><span><div><span><div>Teen</div><div>Fear, Blood</div></span></div></span></div>
<div><span>5</span><span style="w"></span><span title="120">x</span></div>
<div><span>4</span><span title="30">x</span></div>
<content><div jsname="sngebd">Line<br>two</div></content>
<span class="preview-overlay-container" data-docid="b"></span>
<span class="preview-overlay-container" data-docid="c"></span>
<span class="preview-overlay-container" data-docid="b"></span></body></html>"""


def test_csv_reads_quotes_lines_and_missing(spark, tmp_path):
    text = 'a "quoted" word,\nsecond line'
    rows = [("p1", "Word", text), ("p2", "NA", "n/a"), ("p3", None, "plain")]
    names = ["Package", "Category", "Description"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    path = str(tmp_path / "apps")
    apps.write_apps(df, path, header=False)
    got = {r["Package"]: r for r in apps.read_apps(spark, path, header=False, names=names).collect()}
    assert got["p1"]["Description"] == text
    assert got["p2"]["Category"] is None and got["p2"]["Description"] is None
    assert got["p3"]["Category"] is None


def test_sections(spark):
    rows = [(1, "Category\n\tPuzzle\nFoo\n\tx\nDownload\n\t5+"),
            (2, "Category\n\tPuzzle\nPrice"), (3, "Price\n\t1\nPrice\n\t2\n")]
    got = apps.parse_sections(spark.createDataFrame(rows, "id int, value string")).collect()
    assert {r["id"]: r["fields"] for r in got} == {
        1: {"Category": "Puzzle", "Installs": "5+"}, 3: {"Price": "2"}}


def test_app_tree(spark, tmp_path):
    def put(package, version, files):
        folder = tmp_path / "tree" / package / version
        folder.mkdir(parents=True)
        for name, value in files.items():
            (folder / f"{name}(eng).txt").write_text(value)

    info = "Category\n\tRole Playing\nDownload\n\t10+\n"
    full = {"Information": info, "Permission": "read\nwrite\n", "Description": "one\ntwo"}
    put("com.a", "1", full)
    put("com.a", "2", {**full, "Description": "later"})
    put("com.b", "1", {k: v for k, v in full.items() if k != "Permission"})
    put("com.c", "1", {**full, "Information": "Category\n\tTools\n"})
    put("com.d e%20", "1", {**full, "Information": info.replace("Role Playing", "Word")})
    opened = spark.sparkContext.accumulator(0)
    got = apps.read_app_tree(spark, str(tmp_path / "tree"), opened=opened).collect()
    got.sort(key=lambda r: r["Package"])
    assert [(r["Package"], r["Category"]) for r in got] == [("com.a", "Role_Playing"), ("com.d e%20", "Word")]
    assert opened.value == 3 + 3 + 1  # of com.c only the information, of com.b and later versions nothing
    row = got[0]
    assert row["Category"] == "Role_Playing" and row["Installs"] == "10+"
    assert row["Permission"] == "read;write" and row["Description"] == "one two"


def test_app_page_rules(spark):
    df = spark.createDataFrame([("a", PAGE)], "Package string, html string")
    found = pages.extract_fields(df).first()["fields"]
    assert found["Name"] == "Fun & Games" and found["Category"] == "Role Playing"
    assert found["Updated"] == "May 1" and found["Age"] == "Teen"
    assert found["Content_Feature"] == "Fear, Blood"
    assert found["Rating_5"] == "120" and found["Rating_4"] == "30"
    assert found["Description"].replace("\n", "") == "Linetwo"
    assert "Size" not in found and "Rating_3" not in found
    links = pages.extract_links(df, "Package", "html", pages.PREVIEW_LINKS).collect()
    assert {r["dst"] for r in links} == {"b", "c"} and len(links) == 2


def test_selectors_follow_the_nesting(spark):
    df = spark.createDataFrame([("a", PAGE, 1), ("n", None, 2), ("e", "", 3)], "Package string, html string, fields int")
    found = {r["Package"]: r["fields"] for r in markup.parse_fields(df).collect()}
    want = {r["Package"]: r["fields"] for r in pages.extract_fields(df.filter("html is not null")).collect()}
    assert found == {**want, "n": None}
    links = markup.parse_links(df, "Package").collect()
    assert sorted((r["src"], r["dst"]) for r in links) == [("a", "b"), ("a", "c")]


def test_pages_that_are_not_well_formed():
    def text(html, *steps, attribute=None):
        return list(markup.Page(html).found(markup.Selector(steps, attribute)))

    step = markup.Step
    assert text("<ul><li>a<li>b<ul><li>c</ul></ul>", step("ul"), step("li", number=2)) == ["bc"]
    assert text("<div>a</b><div>b<div>c</div>d", step("div")) == ["abcd", "bcd", "c"]
    assert text("<p>1<br>2<br/>3<hr></p>4", step("p")) == ["123"]
    assert text("<i>x</i", step("i")) == ["x</i"] and text("a < b <b>c", step("b")) == ["c"]
    assert text("<!-- <b>no</b> --><b>yes</b><!-- <b>no", step("b")) == ["yes"]
    assert text("<a HREF='x&amp;y'>", step("a"), attribute="href") == ["x&y"]
    assert text("<a t=\"1>2\" u>z</a>", step("a", (("u", None), ("t", "1>2")))) == ["z"]
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000, step("div"), step("div", text="deep"))[-1] == "deep"
    assert text("<script>'<b>no</b>'</script><b>yes</b><style><b>", step("b")) == ["yes"]


def test_labels_replace_one_model(spark, tmp_path):
    path = str(tmp_path / "labels")
    one = spark.createDataFrame([(1, 0)], "id long, class_id int")
    two = spark.createDataFrame([(2, 1)], "id long, class_id int")
    datasets.save_labels(one, path, "a")
    datasets.save_labels(one, path, "b")
    datasets.save_labels(two, path, "b")
    got = {(r["id"], r["model"]) for r in datasets.load_labels(spark, path).collect()}
    assert got == {(1, "a"), (2, "b")}
    json_rows = datasets.labels_json(spark.createDataFrame([(1, [0, 1])], "id int, y array<int>"))
    assert json.loads(json_rows.first()["row"]) == [0, 1]


def test_bfs(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "id string")

    def levels(df):
        return {r["id"]: r["depth"] for r in df.collect()}

    everything = {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    assert levels(graph.bfs(edges, seeds)) == everything
    accept = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert levels(graph.bfs(edges, seeds, accept)) == {"a": 0, "b": 1, "c": 2, "d": 3}
    part = graph.bfs(edges, seeds, max_depth=2)
    assert levels(graph.bfs(edges, seeds, resume=(part, 2))) == everything
    star = spark.range(50).select(F.lit("a").alias("src"), F.format_string("x%02d", "id").alias("dst"))
    capped = levels(graph.bfs(star, seeds, frontier_cap=20))
    assert capped == {"a": 0, **{f"x{i:02d}": 1 + i // 20 for i in range(50)}}


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    source, out, log = (str(tmp_path / d) for d in ("in", "out", "log"))
    rows = [("a", PAGE), ("b", "<p>no category</p>"), ("a", PAGE)]
    schema = "Package string, html string"
    first = spark.createDataFrame(rows, schema)
    first.write.parquet(source)

    def run():
        stream = ingest.read_page_stream(spark, source, first.schema, files_per_trigger=1)
        once = ingest.dedup_stream(stream, "Package")
        records = ingest.pages_to_records(once, min_fields=5)
        ingest.ingest_stream(records, out, log).awaitTermination()
        return apps.read_apps(spark, out, header=False).select("Package").collect()

    assert [r["Package"] for r in run()] == ["a"]
    spark.createDataFrame([("a", PAGE), ("c", PAGE)], schema).write.mode("append").parquet(source)
    assert sorted(r["Package"] for r in run()) == ["a", "c"]
    batch = ingest.pages_to_records(spark.read.parquet(source), min_fields=5)
    assert {r["Package"] for r in batch.collect()} == {"a", "c"}


def test_streams_read_tables_that_are_folders(spark, tmp_path, sf_dir):
    """A table of several files in a folder of its own gives the rows that one file gives."""
    for name in ("pages", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for run in (ingest_plans.stream_pages, ingest_plans.stream_dedup):
        one, folder = (sorted(run(spark, d).collect()) for d in (sf_dir, str(tmp_path)))
        assert one and folder == one


def test_pages_of_one_file_are_parsed_by_all_cores(spark, sf_dir):
    """Parts are one small file, their pages are the work of several tasks."""
    for run in (ingest_plans.app_page_fields, ingest_plans.app_page_links):
        assert run(spark, sf_dir).rdd.getNumPartitions() > 1


def test_app_tree_is_listed_in_tasks(spark, tmp_path, monkeypatch):
    """The driver gets no list of the tree's files; an empty first version does not count."""
    rows = [(f"com.p{i}", v, "Category\n\tPuzzle\n", "a\nb\n", f"text {v}") for i in range(100) for v in ("1", "2")]
    tree = spark.createDataFrame(rows, "Package string, version string, information string, permission string, description string")
    assert apps.write_app_tree(tree, str(tmp_path / "tree")) == 600
    (tmp_path / "tree" / "com.p0" / "0").mkdir()
    (tmp_path / "tree" / "com.p1" / ".0").mkdir()
    (tmp_path / "tree" / "com.p1" / ".0" / "x").write_text("x")
    monkeypatch.setattr(apps, "LISTED", 7)
    found = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED()
    before = found.getCount()
    got = {r["Package"]: r["Description"] for r in apps.read_app_tree(spark, str(tmp_path / "tree")).collect()}
    assert found.getCount() - before < 100
    assert got == {f"com.p{i}": "text 1" for i in range(100)}
