"""Queries on sources, sinks, page parsing, graph expansion and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from manylabel.functions.labels import to_matrix
from manylabel.operators import clean, graph
from manylabel.plans.inputs import DOCS, EVENT_TYPES, USER_TYPES, documents, table, user_types
from manylabel.plans.registry import query
from manylabel.session import shuffle_width, staging_root
from manylabel.sources import apps, datasets, markup, pages
from manylabel.streaming import ingest

PAGE_HEADER = ["page_id", "url", "lang", "title", "h1", "article", "note"]


def stream_table(spark, sf_dir: str, name: str):
    """The files of a table as a stream, whether the table is one file or a folder of files."""
    # Written as a pattern, as a stream takes the plain path for a folder.
    return ingest.read_page_stream(spark, f"{sf_dir}/{{{name}.parquet}}", table(spark, sf_dir, name).schema)


def scratch(spark, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


# --- delimited and sectioned text -------------------------------------------


@query("csv_round_trip", """
SELECT CAST(doc_id AS VARCHAR) AS "Package", source AS "Category", text AS "Description"
FROM documents""")
def csv_round_trip(spark, sf_dir):
    """Quoted multi-line texts written as CSV shards and read back."""
    names = ["Package", "Category", "Description"]
    records = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("Package"), F.col("source").alias("Category"),
        F.col("text").alias("Description"),
    )
    path = scratch(spark, "apps")
    apps.write_apps(records, path)
    return apps.read_apps(spark, path, names=names)


@query("parse_sections", """
SELECT p_partkey AS id, trim(p_type) AS "Category", CAST(p_size AS VARCHAR) || '+' AS "Installs",
       p_brand AS "Version", CAST(NULL AS VARCHAR) AS "Price"
FROM part WHERE p_size % 5 <> 0""")
def parse_sections(spark, sf_dir):
    """Parts written as sectioned text; a known key on the last line spoils the file."""
    part = table(spark, sf_dir, "part")
    body = F.concat(
        F.lit("Category\n\t"), "p_type", F.lit(" \nFoo\n\tx\nDownload\n\t"),
        F.col("p_size").cast("string"), F.lit("+\nEdition\n\told\nEdition\n\t"), "p_brand",
        F.when(F.col("p_size") % 5 == 0, "\nPrice").otherwise("\nOther\n\ty\n"),
    )
    files = part.select(F.col("p_partkey").alias("id"), body.alias("value"))
    parsed = apps.parse_sections(files)
    names = ["Category", "Installs", "Version", "Price"]
    return parsed.select(
        "id", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names]
    )


@query("package_tree", """
SELECT concat('com.part', p_partkey) AS "Package", CASE p_size % 3 WHEN 0 THEN 'Role_Playing' ELSE 'Puzzle' END AS "Category",
       concat(p_size, '+') AS "Installs", p_brand AS "Developer", concat(p_type, ';', p_brand) AS "Permission",
       concat(p_name, ' ', p_type) AS "Description"
FROM part WHERE p_size % 3 <> 2 AND p_partkey % 7 <> 0""")
def package_tree(spark, sf_dir):
    """Parts written as package folders of one or two versions and read back; some lack a file, some the category."""
    text = """concat('Category\\n\\t', element_at(array('Role Playing', 'Puzzle', 'Tools'), p_size % 3 + 1),
        '\\nDownload\\n\\t', p_size, '+\\nDeveloper\\n\\t', p_brand, '\\n')"""
    part = table(spark, sf_dir, "part").select(
        F.expr("concat('com.part', p_partkey)").alias("Package"), "p_partkey",
        F.expr(text).alias("information"),
        F.expr("CASE WHEN p_partkey % 7 <> 0 THEN concat(p_type, '\\n', p_brand, '\\n') END").alias("permission"),
        F.expr("concat(p_name, '\\n', p_type)").alias("description"),
    )
    later = part.filter("p_partkey % 4 = 0").withColumn("description", F.lit("later")).withColumn("version", F.lit("2"))
    path = scratch(spark, "tree")
    apps.write_app_tree(part.withColumn("version", F.lit("1")).unionByName(later), path)
    names = ["Package", "Category", "Installs", "Developer", "Permission", "Description"]
    return apps.read_app_tree(spark, path).select(names)


@query("next_line", """
SELECT id, pos, line, lead(line) OVER (PARTITION BY id ORDER BY pos) AS following FROM (
  SELECT doc_id AS id, unnest(range(len(s))) AS pos, unnest(s) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))""")
def next_line(spark, sf_dir):
    lines = documents(spark, sf_dir).select(
        "id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    out = apps.next_line(lines, ["id"])
    return out.withColumn("pos", F.col("pos").cast("bigint"))


# --- pages ------------------------------------------------------------------

_TAGS = "'<[^>]*>', '', 'g'"


def _inner(expr: str) -> str:
    out = f"regexp_replace({expr}, {_TAGS})"
    for entity, char in pages.ENTITIES.items():
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


_FIELDS = "fields AS (SELECT page_id, url,\n" + ",\n".join(
    [r"""regexp_extract(html, '(?is)<html\b[^>]*\blang\s*=\s*["'']([^"'']*)["'']', 1) AS lang"""]
    + [
        f"CASE WHEN regexp_matches(html, '(?is)<{t}\\b[^>]*>(.*?)</{t}\\s*>') THEN "
        + _inner(f"regexp_extract(html, '(?is)<{t}\\b[^>]*>(.*?)</{t}\\s*>', 1)") + f" END AS {t}"
        for t in ("title", "h1", "article")
    ]
) + " FROM pages)"


@query("page_fields", f"WITH {_FIELDS} SELECT page_id, lang, title, h1, article FROM fields")
def page_fields(spark, sf_dir):
    parsed = pages.extract_fields(table(spark, sf_dir, "pages"), pages.WEB_PAGE_RULES)
    names = list(pages.WEB_PAGE_RULES)
    return parsed.select(
        "page_id", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names]
    )


@query("page_links", """
SELECT DISTINCT src, dst FROM (
  SELECT page_id AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst
  FROM pages)""")
def page_links(spark, sf_dir):
    return pages.extract_links(table(spark, sf_dir, "pages"))


#: Values of the fields of a part's page, in SQL that both engines read; null where the page lacks the field.
_PART_FIELDS = {
    "Category": "concat(p_type, ' & ', p_brand)",
    "Name": "p_name",
    "Price": "concat('$', p_size, '.49')",
    "Updated": "concat('May ', p_partkey % 28 + 1)",
    "Size": "CASE WHEN p_size % 5 <> 0 THEN concat(p_size, 'M') END",
    "Installs": "concat(p_partkey % 7 * 100, '+')",
    "Requires_Android": "concat(p_size % 8 + 1, ' and up')",
    "Age": "CASE WHEN p_size % 2 = 0 THEN 'Teen' ELSE 'Everyone' END",
    "Inapp_Products": "CASE WHEN p_size % 2 = 0 THEN concat('<', p_size, '> per item') END",
    "Developer": "p_brand",
    "Description": "concat(p_name, ' of ', p_type, ' by ', p_brand)",
    "Rating": "concat('4.', p_partkey % 10)",
    "Rating_Total": "CAST(p_partkey % 1000 AS STRING)",
    "Content_Feature": "CASE WHEN p_size % 3 <> 0 THEN concat('Blood, ', p_type) END",
    "Version": "concat('1.', p_size)",
    **{f"Rating_{n}": f"CASE WHEN p_partkey % {n + 1} <> 0 THEN CAST({n} * p_size AS STRING) END" for n in (5, 4, 3, 2, 1)},
}


def _part_html() -> str:
    """The page of a part: nested ``div``, unclosed and void tags, comments, scripts, both quotes."""
    def given(name: str, before: str, after: str) -> str:
        value = f"replace(replace(replace({_PART_FIELDS[name]}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
        return f"coalesce(concat('{before}', {value}, '{after}'), '')"

    def labelled(name: str, label: str) -> str:
        return given(name, f"<div class=x><div> {label}</div><span><div><span>", "</span></div></span></div>")

    pieces = [
        "'<!DOCTYPE html><html><body><div><!-- <h1 itemprop=\"name\"><span>no</span></h1> -->'",
        "'<script>if (a < b) x = \"<div><div>Size</div><span><div><span>0</span></div></span></div>\";</script>'",
        given("Name", "<h1 class=\"a>b\" itemprop=\"name\"><span>", "</span></h1></em>"),
        given("Category", "<p>one<p>two<br><a itemprop=genre href=\"/x?a=1&amp;b=2\">", "</a>"),
        given("Price", "<button aria-label=\"Buy\">free</button><button aria-label><span><span>", "</span></span></button>"),
        labelled("Updated", "Updated"), labelled("Size", "Size"), labelled("Installs", "Installs"),
        labelled("Requires_Android", "Requires Android"), labelled("Inapp_Products", "In-app Products"),
        labelled("Developer", "Offered By"), labelled("Version", "Current Version"),
        given("Age", "<DIV><div>Content Rating</div><span><div><span><div>", "</div>"),
        given("Content_Feature", "<div>", "</div>"), "'</span></div></span></DIV>'",
        "concat('<content><div jsname=sngebd>', p_name, '<div> of <div>', p_type, '</div></div> by<img src=x> <b>', p_brand, '</div></content>')",
        given("Rating", "<div class=\"BHMmbe\">", "</div>"), given("Rating_Total", "<span aria-label=\"all\">", "</span>"),
        *[given(f"Rating_{n}", f"<div><span>{n}</span><span style=\"w\"></span><span title=\"", "\">x</span></div>") for n in (5, 4, 3, 2, 1)],
        *[f"concat('<div><span class=preview-overlay-container data-docid=\"p', p_partkey + {n}, '\"></span></div>')" for n in (1, 2, 1)],
    ]
    return "concat(" + ", ".join(pieces) + ")"


def _part_pages(spark, sf_dir):
    """``(p_partkey, html)``, dealt to all cores: pages take far more work than their parts take bytes."""
    parts = table(spark, sf_dir, "part").repartition(shuffle_width(spark), "p_partkey")
    return parts.select("p_partkey", F.expr(_part_html()).alias("html"))


@query("app_page_fields", "SELECT p_partkey, " + ", ".join(f'{v} AS "{k}"' for k, v in _PART_FIELDS.items()) + " FROM part")
def app_page_fields(spark, sf_dir):
    """All twenty fields of the pages of the parts."""
    parsed = markup.parse_fields(_part_pages(spark, sf_dir))
    return parsed.select("p_partkey", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in markup.APP_PAGE])


@query("app_page_links", """
SELECT p_partkey AS src, concat('p', p_partkey + n) AS dst FROM part CROSS JOIN (SELECT unnest([1, 2]) AS n)""")
def app_page_links(spark, sf_dir):
    """Similar items shown on the pages of the parts."""
    return markup.parse_links(_part_pages(spark, sf_dir), "p_partkey")



_RECORDS = _FIELDS + """,
records AS (
  SELECT replace(url, chr(10), ' ') AS "Package", lang, replace(title, chr(10), ' ') AS title,
         replace(h1, chr(10), ' ') AS h1, replace(article, chr(10), ' ') AS article,
         '???' AS note FROM fields WHERE replace(lang, ' ', '_') IN ('en', 'de', 'fr'))"""

_RECORD_STEP = dict(
    rules=pages.WEB_PAGE_RULES, id_col="Package",
    header=["Package", "lang", "title", "h1", "article", "note"], trivial=["note"],
    names=["en", "de", "fr"], category="lang", min_fields=6,
)


def _page_rows(df):
    return df.select(F.col("url").alias("Package"), "html")


@query("conform_pages", f"""WITH {_FIELDS}
SELECT url AS "Package", coalesce(replace(lang, chr(10), ' '), '') AS lang,
       coalesce(replace(title, chr(10), ' '), '') AS title,
       coalesce(replace(h1, chr(10), ' '), '') AS h1, '' AS missing, '???' AS note,
       2 + CAST(lang IS NOT NULL AS INTEGER) + CAST(title IS NOT NULL AS INTEGER)
         + CAST(h1 IS NOT NULL AS INTEGER) + CAST(article IS NOT NULL AS INTEGER) AS n_fields
FROM fields""")
def conform_pages(spark, sf_dir):
    parsed = pages.extract_fields(
        _page_rows(table(spark, sf_dir, "pages")), pages.WEB_PAGE_RULES
    )
    header = ["Package", "lang", "title", "h1", "missing", "note"]
    return clean.conform(parsed, "fields", "Package", header, ["note"])


@query("complete_pages", f"""WITH {_RECORDS}
SELECT * FROM records
WHERE title <> '' AND h1 <> '' AND article <> '' AND lang <> '' AND note <> ''""")
def complete_pages(spark, sf_dir):
    rows = _page_rows(table(spark, sf_dir, "pages"))
    return ingest.pages_to_records(rows, strict=True, **_RECORD_STEP)


# --- streams ----------------------------------------------------------------


@query("stream_pages", f"WITH {_RECORDS} SELECT * FROM records")
def stream_pages(spark, sf_dir):
    """The record step as a stream over the page files, ended when all is read."""
    records = ingest.pages_to_records(_page_rows(stream_table(spark, sf_dir, "pages")), **_RECORD_STEP)
    out, log = scratch(spark, "records"), scratch(spark, "log")
    ingest.ingest_stream(records, out, log, "parquet").awaitTermination()
    return spark.read.schema(records.schema).parquet(out)


@query("stream_dedup", "SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf_dir):
    """Each user once; the state store is the visited set."""
    once = ingest.dedup_stream(stream_table(spark, sf_dir, "events").select("user_id"), "user_id")
    out, log = scratch(spark, "seen"), scratch(spark, "log")
    ingest.ingest_stream(once, out, log, "parquet").awaitTermination()
    return spark.read.schema(once.schema).parquet(out)


# --- datasets, labels, ids --------------------------------------------------


def _split_docs(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "id", "class_id", "text",
        F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"),
    )


@query("dataset_round_trip", f"""WITH {DOCS}
SELECT id, class_id, text, 'train' AS split FROM docs WHERE id % 4 <> 0""")
def dataset_round_trip(spark, sf_dir):
    path = scratch(spark, "dataset")
    datasets.save_dataset(_split_docs(spark, sf_dir), path)
    return datasets.load_dataset(spark, path, "train")


@query("dataset_ids", f"""WITH {DOCS}
SELECT id, CASE WHEN id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM docs""")
def dataset_ids(spark, sf_dir):
    path = scratch(spark, "dataset")
    datasets.save_dataset(_split_docs(spark, sf_dir), path)
    return datasets.load_ids(datasets.load_dataset(spark, path))


@query("concatenated_parts", f"WITH {DOCS} SELECT id, class_id FROM docs")
def concatenated_parts(spark, sf_dir):
    path = scratch(spark, "dataset")
    datasets.save_dataset(_split_docs(spark, sf_dir), path)
    train, test = (datasets.load_dataset(spark, path, s) for s in ("train", "test"))
    return train.unionByName(test).select("id", "class_id")


@query("labels_round_trip", f"""WITH {USER_TYPES}
SELECT id, class_id, 'spysvm' AS model FROM user_types WHERE n % 3 <> 0
UNION ALL SELECT id, class_id, 'nbsvm' FROM user_types WHERE n >= 14""")
def labels_round_trip(spark, sf_dir):
    path = scratch(spark, "labels")
    seen = user_types(spark, sf_dir)
    datasets.save_labels(seen.filter("n >= 14"), path, "nbsvm")
    datasets.save_labels(seen, path, "spysvm")
    datasets.save_labels(seen.filter("n % 3 <> 0"), path, "spysvm")
    return datasets.load_labels(spark, path, ["nbsvm", "spysvm"])


@query("labels_as_json", f"""WITH {USER_TYPES}
SELECT id, '[' || string_agg(CAST(held AS INTEGER), ',' ORDER BY k) || ']' AS row FROM (
  SELECT u.id, k.k, bool_or(u.class_id = k.k) AS held
  FROM user_types u CROSS JOIN (SELECT unnest(range(5)) AS k) k GROUP BY ALL)
GROUP BY id""")
def labels_as_json(spark, sf_dir):
    return datasets.labels_json(to_matrix(user_types(spark, sf_dir), len(EVENT_TYPES)))


@query("report_round_trip", """
SELECT CAST(p_partkey AS VARCHAR) AS "Package", p_type AS "Original_Label", p_name AS "NBSVM"
FROM part""")
def report_round_trip(spark, sf_dir):
    report = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("Package"), F.col("p_type").alias("Original_Label"),
        F.col("p_name").alias("NBSVM"),
    )
    path = scratch(spark, "report")
    datasets.write_report(report, path)
    return spark.read.schema(apps.string_schema(report.columns)).csv(path, header=True, escape='"')


# --- graph ------------------------------------------------------------------

#: Levels unrolled in SQL; those past the last one reached are empty.
DEPTH = 24


def _order_part_edges(spark, sf_dir):
    """Orders and parts linked by order lines, in both directions."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey").alias("src"),
        F.concat(F.lit("p"), "l_partkey").alias("dst"),
    )
    return lines.unionByName(lines.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _accepted(spark, sf_dir):
    """Parts of even size and finished orders: only those are expanded."""
    parts = table(spark, sf_dir, "part").filter(F.col("p_size") % 2 == 0)
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    return parts.select(F.concat(F.lit("p"), "p_partkey").alias("id")).unionByName(
        orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    )


def _bfs_sql() -> str:
    out = """
edges AS MATERIALIZED (
  SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION ALL SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem),
accepted AS (
  SELECT 'p' || p_partkey AS id FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'F'),
l0 AS MATERIALIZED (SELECT 'p' || min(p_partkey) AS id, 0 AS depth FROM part
                    WHERE p_size % 2 = 0)"""
    for d in range(1, DEPTH + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(d))
        out += f""",
l{d} AS MATERIALIZED (
  SELECT DISTINCT dst AS id, {d} AS depth FROM edges
  WHERE src IN (SELECT id FROM l{d - 1} WHERE id IN (SELECT id FROM accepted))
    AND dst NOT IN ({seen}))"""
    return "WITH " + out + " " + " UNION ALL ".join(
        f"SELECT id, depth FROM l{i}" for i in range(DEPTH + 1)
    )


@query("similar_items_bfs", _bfs_sql())
def similar_items_bfs(spark, sf_dir):
    first = table(spark, sf_dir, "part").filter(F.col("p_size") % 2 == 0).agg(
        F.concat(F.lit("p"), F.min("p_partkey")).alias("id")
    )
    return graph.bfs(
        _order_part_edges(spark, sf_dir), first, _accepted(spark, sf_dir)
    )


@query("resumed_bfs", _bfs_sql())
def resumed_bfs(spark, sf_dir):
    """The search stopped after three levels, written, and taken up again from what was written."""
    first = table(spark, sf_dir, "part").filter(F.col("p_size") % 2 == 0).agg(
        F.concat(F.lit("p"), F.min("p_partkey")).alias("id")
    )
    edges, accepted = _order_part_edges(spark, sf_dir), _accepted(spark, sf_dir)
    path = scratch(spark, "visited")
    graph.bfs(edges, first, accepted, max_depth=3).write.parquet(path)
    return graph.bfs(edges, first, accepted, resume=(spark.read.parquet(path), 3))


@query("new_candidates", """
SELECT DISTINCT 'p' || l_partkey AS id FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)""")
def new_candidates(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), "l_partkey").alias("id")
    ).distinct()
    visited = table(spark, sf_dir, "part").filter("p_size < 25").select(
        F.concat(F.lit("p"), "p_partkey").alias("id")
    )
    return graph.new_only(found, visited)


@query("capped_frontier", """
SELECT DISTINCT l_partkey AS id FROM lineitem ORDER BY id LIMIT 150""")
def capped_frontier(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    return graph.cap(found, 150)


@query("visited_union", """
SELECT DISTINCT l_partkey AS id FROM lineitem UNION SELECT p_partkey FROM part""")
def visited_union(spark, sf_dir):
    visited = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    return graph.visit(visited, graph.new_only(found, visited))
