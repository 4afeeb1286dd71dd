"""Queries on cleaning, encoding, sampling, set operations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from manylabel.functions import labels as lb
from manylabel.functions import lists, vectors
from manylabel.functions import text as tx
from manylabel.operators import clean, encode, evaluate, ranks, sample
from manylabel.plans.inputs import (
    CLEAN,
    CLEAN_AND_CUT,
    DOCS,
    EVENT_TYPES,
    SOURCES,
    USER_TYPES,
    cleaned,
    cleaned_and_cut,
    documents,
    table,
    user_types,
)
from manylabel.plans.registry import query
from manylabel.session import stage

PUNCT_SQL = tx.PUNCTUATION.replace("'", "''")

# --- text functions ---------------------------------------------------------


@query("clean_texts", f"WITH {CLEAN_AND_CUT} SELECT id, class_id, text FROM clean")
def clean_texts(spark, sf_dir):
    return cleaned_and_cut(spark, sf_dir).select("id", "class_id", "text")


@query("strip_non_ascii", """
SELECT doc_id AS id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS ascii,
       lower(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS lowered FROM documents""")
def strip_non_ascii(spark, sf_dir):
    ascii_text = tx.strip_non_ascii(F.col("text"))
    return documents(spark, sf_dir).select(
        "id", ascii_text.alias("ascii"), tx.to_lower(ascii_text).alias("lowered")
    )


@query("delete_punctuation", f"""
SELECT doc_id AS id, translate(text, '{PUNCT_SQL}', '') AS plain FROM documents""")
def delete_punctuation(spark, sf_dir):
    return documents(spark, sf_dir).select("id", tx.delete_chars(F.col("text")).alias("plain"))


@query("squeeze_spaces", "SELECT doc_id AS id, regexp_replace(text, ' +', ' ', 'g') AS squeezed "
                         "FROM documents")
def squeeze_spaces(spark, sf_dir):
    return documents(spark, sf_dir).select("id", tx.squeeze_spaces(F.col("text")).alias("squeezed"))


@query("strip_urls", """
SELECT page_id AS id,
       regexp_replace(replace(html, '"', ' '), ' http[^\\n]*? ', ' ', 'g') AS stripped
FROM pages""")
def strip_urls(spark, sf_dir):
    spaced = F.replace("html", F.lit('"'), F.lit(" "))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), tx.strip_urls(spaced).alias("stripped")
    )


@query("truncate_words", """
SELECT doc_id AS id,
       CASE WHEN instr(substr(text, 3001), ' ') = 0 THEN text
            ELSE substr(text, 1, 2999 + instr(substr(text, 3001), ' ')) END AS cut
FROM documents""")
def truncate_words(spark, sf_dir):
    return documents(spark, sf_dir).select("id", tx.truncate_words(F.col("text")).alias("cut"))


@query("count_char", """
SELECT doc_id AS id, length(text) - length(replace(text, ' ', '')) AS blanks,
       length(text) - length(replace(text, chr(10), '')) AS line_ends FROM documents""")
def count_char(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "id",
        tx.count_char(F.col("text"), " ").cast("bigint").alias("blanks"),
        tx.count_char(F.col("text"), "\n").cast("bigint").alias("line_ends"),
    )


@query("parse_count", """
SELECT p_partkey AS id,
       CAST(p_partkey * 1000 + CAST(floor(p_retailprice) AS BIGINT) AS DOUBLE) AS installs,
       0.0::DOUBLE AS unknown FROM part""")
def parse_count(spark, sf_dir):
    number = F.col("p_partkey") * 1000 + F.floor("p_retailprice")
    written = F.concat(F.format_number(number, 0), F.lit("+"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        tx.parse_count(written).alias("installs"),
        tx.parse_count(F.col("p_type")).alias("unknown"),
    )


@query("letters_only", """
SELECT doc_id AS id, regexp_replace(lower(text), '[^\\p{L} ]', '', 'g') AS letters
FROM documents""")
def letters_only(spark, sf_dir):
    return documents(spark, sf_dir).select("id", tx.letters_only(F.col("text")).alias("letters"))


@query("boost_name", """
SELECT d.doc_id AS id, repeat(coalesce(p.p_name, '') || ' ', 5) || d.text AS boosted
FROM documents d LEFT JOIN part p ON p.p_partkey = d.doc_id""")
def boost_name(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    joined = documents(spark, sf_dir).join(names, "id", "left")
    return joined.select("id", tx.boost(F.col("p_name"), F.col("text")).alias("boosted"))


@query("fill_missing", """
SELECT d.doc_id AS id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def fill_missing(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    joined = documents(spark, sf_dir).select("id").join(marks, "id", "left")
    return joined.select("id", tx.fill(F.col("quality").cast("string")).alias("quality"))


@query("normalise_separators", """
SELECT doc_id AS id, replace(replace(text, chr(10), ' '), ' ', '_') AS joined,
       replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ';') AS listed
FROM documents""")
def normalise_separators(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "id",
        tx.underscore(tx.flatten_lines(F.col("text"))).alias("joined"),
        tx.lines_to_list(F.col("text")).alias("listed"),
    )


# --- row filters ------------------------------------------------------------


@query("keep_language", "SELECT doc_id AS id, lang FROM documents WHERE lang = 'en'")
def keep_language(spark, sf_dir):
    return clean.keep_language(documents(spark, sf_dir)).select("id", "lang")


@query("drop_sparse_text", """
SELECT page_id AS id FROM pages
WHERE length(html) - length(replace(html, ' ', '')) <= length(html) // 8
UNION ALL SELECT doc_id + 1000000000 FROM documents
WHERE length(text) - length(replace(text, ' ', '')) <= length(text) // 4""")
def drop_sparse_text(spark, sf_dir):
    pages = clean.drop_sparse_text(table(spark, sf_dir, "pages"), "html", share=8)
    pages = pages.select(F.col("page_id").alias("id"))
    docs = clean.drop_sparse_text(documents(spark, sf_dir))
    return pages.unionByName(docs.select((F.col("id") + 1000000000).alias("id")))


@query("min_length", """
SELECT doc_id AS id, length(text) AS length FROM documents
WHERE length(text) >= 800 OR doc_id IN (3, 11, 42, 77)""")
def min_length(spark, sf_dir):
    kept = clean.min_length(documents(spark, sf_dir), keep_ids=["3", "11", "42 ", "77"])
    return kept.select("id", F.length("text").cast("bigint").alias("length"))


@query("allow_categories", """
SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name FROM part
WHERE replace(p_name, ' ', '_') IN ('red_widget', 'blue_gizmo', 'hot_ring')""")
def allow_categories(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name")
    )
    return clean.allow_categories(parts, "name", ["red_widget", "blue_gizmo", "hot_ring"])


@query("rename_keys", "SELECT p_partkey AS Package, p_type AS Category, p_name AS Name FROM part")
def rename_keys(spark, sf_dir):
    mapping = {"p_partkey": "Package", "p_type": "Category", "p_name": "Name"}
    return clean.rename_keys(table(spark, sf_dir, "part"), mapping)


@query("tolerant_rows", """
SELECT p_partkey AS id, TRY_CAST(substr(p_brand, 7) AS INTEGER) AS brand,
       TRY_CAST(p_name AS INTEGER) AS bad
FROM part WHERE TRY_CAST(substr(p_brand, 7) AS INTEGER) IS NOT NULL""")
def tolerant_rows(spark, sf_dir):
    parsed = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.substring("p_brand", 7, 9).try_cast("int").alias("brand"),
        F.col("p_name").try_cast("int").alias("bad"),
    )
    return parsed.filter(F.col("brand").isNotNull())


@query("dedup_first", """
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
WHERE rn = 1""")
def dedup_first(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return clean.dedup_first(events, "user_id", [F.col("event_id")])


@query("dedup_texts", """
SELECT id, class_id FROM (
  SELECT doc_id AS id, CAST(substr(source, 4) AS INTEGER) AS class_id,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1""")
def dedup_texts(spark, sf_dir):
    keyed = documents(spark, sf_dir).select("id", "class_id", F.sha2("text", 256).alias("key"))
    return clean.dedup_first(keyed, "key", [F.col("id")]).drop("key")


# --- encoding ---------------------------------------------------------------


@query("encode_category", """
SELECT doc_id AS id, CAST(substr(source, 4) AS INTEGER) AS class_id, source AS name
FROM documents""")
def encode_category(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), lists.name_index(F.col("source"), SOURCES).alias("class_id")
    )
    return docs.withColumn("name", lists.index_name(F.col("class_id"), SOURCES))


TYPE_PHRASES = {
    "click": ["Interaction"],
    "purchase": ["Payment", "Interaction"],
    "error": ["Problem"],
    "view": ["Interaction"],
}


def _user_lists(spark, sf_dir, sep):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_set("event_type")), sep).alias("listed")
    )


@query("map_list", """
SELECT id, string_agg(DISTINCT key, ';' ORDER BY key) AS keys FROM (
  SELECT user_id AS id, unnest(CASE event_type
           WHEN 'click' THEN ['Interaction'] WHEN 'view' THEN ['Interaction']
           WHEN 'purchase' THEN ['Payment', 'Interaction'] WHEN 'error' THEN ['Problem']
           ELSE [event_type] END) AS key
  FROM events) GROUP BY id""")
def map_list(spark, sf_dir):
    keys = lists.map_list(F.col("listed"), TYPE_PHRASES)
    return _user_lists(spark, sf_dir, ", ").select(
        "id", F.array_join(F.array_sort(keys), ";").alias("keys")
    )


@query("multi_hot", """
SELECT user_id AS id, CAST(max(event_type = 'click') AS TINYINT) AS click,
       CAST(max(event_type = 'error') AS TINYINT) AS error,
       CAST(max(event_type = 'purchase') AS TINYINT) AS purchase,
       CAST(0 AS TINYINT) AS refund
FROM events GROUP BY user_id""")
def multi_hot(spark, sf_dir):
    items = F.split("listed", ";")
    keys = ["click", "error", "purchase", "refund"]
    return _user_lists(spark, sf_dir, ";").select("id", *lists.multi_hot(items, keys))


PRIORITY_RANKS = {
    "1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "4-NOT SPECIFIED": 0, "5-LOW": 1,
}


@query("ordinal_encode", """
SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3
       WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 0 WHEN '5-LOW' THEN 1 END AS rank
FROM orders""")
def ordinal_encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        lists.ordinal(F.col("o_orderpriority"), PRIORITY_RANKS).alias("rank"),
    )


PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("encode_records", """
SELECT CAST(p_partkey AS VARCHAR) AS Package,
       CAST(list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type)
         - 1 AS BIGINT) AS Category,
       CAST(p_partkey * 1000 AS DOUBLE) AS Installs,
       CAST(p_size % 2 = 0 AS TINYINT) AS Horror, CAST(p_size % 2 = 1 AS TINYINT) AS Alcohol,
       CAST(p_size % 2 = 1 AS TINYINT) AS Tobacco,
       CAST(1 AS TINYINT) AS "record audio", CAST(p_size > 25 AS TINYINT) AS "run at startup",
       repeat(regexp_replace(lower(p_name), '[^\\p{L} ]', '', 'g') || ' ', 5) || p_brand
         AS Description
FROM part""")
def encode_records(spark, sf_dir):
    even = F.col("p_size") % 2 == 0
    records = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("Package"),
        F.col("p_type").alias("Category"),
        F.concat(F.format_number(F.col("p_partkey") * 1000, 0), F.lit("+")).alias("Installs"),
        F.when(even, "Fear, Other").otherwise("Use of Alcohol/Tobacco").alias("Content_Feature"),
        F.when(F.col("p_size") > 25, "record audio;run at startup;record audio")
        .otherwise("record audio;;foo").alias("Permission"),
        F.col("p_name").alias("Name"),
        F.col("p_brand").alias("Description"),
    )
    encoders = encode.default_encoders(
        PART_TYPES, ["Horror", "Alcohol", "Tobacco"], ["record audio", "run at startup"]
    )
    return encode.encode(records, encoders)


@query("binarize_class", """
SELECT doc_id AS id, CAST(source = 'src3' AS INTEGER) AS y FROM documents""")
def binarize_class(spark, sf_dir):
    return encode.binarize(documents(spark, sf_dir).select("id", "class_id"), 3).select("id", "y")


# --- vectors ----------------------------------------------------------------


def _embedding_steps(spark, sf_dir):
    """Every vector next to its successor: an equi-join, no pairs."""
    left = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return left.join(right, "vec_id")


_STEPS = """
steps AS (
  SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


@query("vector_similarity", f"""WITH {_STEPS}
SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine,
       round(exp(-list_distance(a, b) * list_distance(a, b) / 64), 6) AS rbf,
       round(1 / (1 + exp(-list_dot_product(a, b))), 6) AS proba
FROM steps""")
def vector_similarity(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _embedding_steps(spark, sf_dir).select(
        "vec_id",
        F.round(vectors.cosine(a, b), 6).alias("cosine"),
        F.round(vectors.rbf(a, b), 6).alias("rbf"),
        F.round(vectors.proba(vectors.dot(a, b)), 6).alias("proba"),
    )


# --- counts, windows, samples ----------------------------------------------


@query("count_non_null", """
SELECT count(doc_id) AS id, count(text) AS text, count(quality) AS quality, count(toxic) AS toxic
FROM documents LEFT JOIN labels USING (doc_id)""")
def count_non_null(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    joined = documents(spark, sf_dir).select("id", "text").join(marks, "id", "left")
    return clean.count_non_null(joined)


@query("class_sizes", f"WITH {CLEAN} SELECT class_id, count(*) AS n FROM clean GROUP BY class_id")
def class_sizes(spark, sf_dir):
    return clean.class_sizes(cleaned(spark, sf_dir))


@query("balanced_size", f"""WITH {CLEAN}
SELECT min(n) // 10 * 10 AS n_each_class
FROM (SELECT count(*) AS n FROM clean GROUP BY class_id)""")
def balanced_size(spark, sf_dir):
    return sample.balanced_size(cleaned(spark, sf_dir))


@query("balanced_sample", f"""WITH {CLEAN},
each AS (SELECT min(n) // 10 * 10 AS k FROM
         (SELECT count(*) AS n FROM clean GROUP BY class_id)),
ranked AS (
  SELECT id, class_id, n_chars,
         row_number() OVER (PARTITION BY class_id ORDER BY n_chars DESC, id) AS rn FROM clean)
SELECT id, class_id, n_chars FROM ranked
WHERE rn <= (SELECT k FROM each) OR id IN (1, 5, 100, 999)""")
def balanced_sample(spark, sf_dir):
    docs = stage(cleaned(spark, sf_dir).select("id", "class_id", "n_chars"), "clean")
    return sample.balanced_sample(docs, "n_chars", important=["1", "5", "100", "999"])


@query("top_per_class", f"""WITH {DOCS}
SELECT id, class_id, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY n_chars DESC, id) AS rn FROM docs)
WHERE rn <= 7""")
def top_per_class(spark, sf_dir):
    docs = documents(spark, sf_dir).select("id", "class_id", "n_chars")
    return sample.top_per_class(docs, 7, [F.col("n_chars").desc(), F.col("id")])


@query("top_of_large_classes", """
SELECT event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn
  FROM events) WHERE rn <= 1500""")
def top_of_large_classes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    order = [F.col("value").desc(), F.col("event_id")]
    return sample.top_per_class(events, 1500, order, "event_type")


@query("head_split", f"""WITH {CLEAN}
SELECT id, class_id, CASE WHEN rn <= 20 THEN 'test' ELSE 'train' END AS split FROM (
  SELECT id, class_id, row_number() OVER (PARTITION BY class_id ORDER BY id) AS rn FROM clean)""")
def head_split(spark, sf_dir):
    docs = stage(cleaned(spark, sf_dir).select("id", "class_id"), "clean")
    return sample.head_split(docs, [F.col("id")])


@query("contiguous_folds", """
SELECT doc_id AS id,
       CAST(ntile(3) OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS INTEGER) AS fold
FROM documents""")
def contiguous_folds(spark, sf_dir):
    return sample.folds(documents(spark, sf_dir).select("id"), 3)


@query("stratified_folds", f"""WITH {DOCS}
SELECT id, class_id, CAST(ntile(3) OVER (
         PARTITION BY class_id ORDER BY md5('7:' || id), id) - 1 AS INTEGER) AS fold FROM docs""")
def stratified_folds(spark, sf_dir):
    docs = documents(spark, sf_dir).select("id", "class_id")
    return sample.folds(docs, 3, by="class_id")


@query("shuffled_rows", """
SELECT event_id AS id, row_number() OVER (ORDER BY md5('7:' || event_id), event_id) AS pos
FROM events""")
def shuffled_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return ranks.shuffled(events)


@query("order_desc", """
SELECT event_type, event_id,
       row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn
FROM events""")
def order_desc(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    ranked = ranks.with_rank(events, ["event_type"], [F.col("value").desc(), F.col("event_id")])
    return ranked.drop("value")


@query("running_total", """
SELECT event_type, event_id, round(sum(value) OVER (
         PARTITION BY event_type ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING), 4)
         AS total
FROM events""")
def running_total(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_type", "event_id", "value", F.col("value").alias("total")
    )
    order = [F.col("value").desc(), F.col("event_id")]
    out = ranks.running_sum(events, ["event_type"], order, ["total"])
    return out.select("event_type", "event_id", F.round("total", 4).alias("total"))


@query("restore_order", f"""WITH {DOCS}
SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM docs""")
def restore_order(spark, sf_dir):
    mixed = ranks.shuffled(documents(spark, sf_dir).select("id"), seed=3, name="mixed")
    ordered = ranks.with_rank(mixed, [], [F.col("id")], "rn")
    return ordered.select("id", (F.col("rn") - 1).alias("pos"))


@query("spy_sample", f"""WITH {DOCS}
SELECT id, class_id FROM (
  SELECT id, class_id, row_number() OVER (PARTITION BY class_id ORDER BY md5('7:' || id), id)
           AS rn, count(*) OVER (PARTITION BY class_id) AS n FROM docs)
WHERE rn <= floor(n * 0.15::DOUBLE)""")
def spy_sample(spark, sf_dir):
    return sample.sample_spies(documents(spark, sf_dir).select("id", "class_id"))


@query("order_statistic", """
SELECT event_type, value AS threshold FROM (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
         count(*) OVER (PARTITION BY event_type) AS n FROM events)
WHERE rn = floor(n * 0.2::DOUBLE) + 1""")
def order_statistic(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    return ranks.order_statistic(events, "event_type", "value", 0.2)


# --- label sets -------------------------------------------------------------


def _label_sets(spark, sf_dir):
    """Two label sets per user: types seen often, and types seen at all but not rarely."""
    seen = stage(user_types(spark, sf_dir), "types")
    return (
        seen.filter(F.col("n") >= 14).select("id", "class_id"),
        seen.filter(F.col("n") % 3 != 0).select("id", "class_id"),
    )


_SETS = USER_TYPES + """,
a AS (SELECT id, class_id FROM user_types WHERE n >= 14),
b AS (SELECT id, class_id FROM user_types WHERE n % 3 != 0)"""


@query("labels_or", f"WITH {_SETS} SELECT * FROM a UNION SELECT * FROM b")
def labels_or(spark, sf_dir):
    return lb.labels_or(*_label_sets(spark, sf_dir))


@query("labels_and", f"WITH {_SETS} SELECT * FROM a INTERSECT SELECT * FROM b")
def labels_and(spark, sf_dir):
    return lb.labels_and(*_label_sets(spark, sf_dir))


@query("fallback_labels", f"""WITH {_SETS}
SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)""")
def fallback_labels(spark, sf_dir):
    return lb.fallback_labels(*_label_sets(spark, sf_dir))


@query("has_any_label", f"""WITH {_SETS}
SELECT DISTINCT user_id AS id, user_id IN (SELECT id FROM a) AS any_label FROM events""")
def has_any_label(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return lb.has_any(_label_sets(spark, sf_dir)[0], ids)


@query("label_density", f"""WITH {_SETS}
SELECT round((SELECT count(*) FROM a) / (5.0 * (SELECT count(DISTINCT user_id) FROM events)), 6)
         AS density""")
def label_density(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    out = lb.density(_label_sets(spark, sf_dir)[0], None, len(EVENT_TYPES), ids)
    return out.select(F.round("density", 6).alias("density"))


@query("label_matrix", f"""WITH {_SETS}
SELECT u.id, CAST(k.class_id AS INTEGER) AS class_id, CAST(a.id IS NOT NULL AS TINYINT) AS flag
FROM (SELECT DISTINCT user_id AS id FROM events) u
CROSS JOIN (SELECT unnest(range(5)) AS class_id) k
LEFT JOIN a ON a.id = u.id AND a.class_id = k.class_id""")
def label_matrix(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    matrix = lb.to_matrix(_label_sets(spark, sf_dir)[0], len(EVENT_TYPES), ids)
    return matrix.select("id", F.posexplode("y").alias("class_id", "flag"))


@query("label_positives", f"WITH {_SETS} SELECT id, class_id FROM a")
def label_positives(spark, sf_dir):
    matrix = lb.to_matrix(_label_sets(spark, sf_dir)[0], len(EVENT_TYPES))
    return lb.to_positives(matrix)


@query("label_names", f"""WITH {_SETS}
SELECT id, string_agg(['click', 'error', 'purchase', 'signup', 'view'][class_id + 1], ' '
                      ORDER BY class_id) AS labels FROM a GROUP BY id""")
def label_names(spark, sf_dir):
    return lb.label_names(_label_sets(spark, sf_dir)[0], EVENT_TYPES)


# --- id sets ----------------------------------------------------------------


@query("keep_ids", """
SELECT doc_id AS id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def keep_ids(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return clean.keep_ids(documents(spark, sf_dir).select("id", "lang"), marks)


@query("drop_ids", """
SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def drop_ids(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return clean.drop_ids(documents(spark, sf_dir).select("id", "lang"), marks)


# --- reports ----------------------------------------------------------------


def _report_inputs(spark, sf_dir):
    """Users, their most frequent type as the original label, and two label sets."""
    seen = stage(user_types(spark, sf_dir), "types")
    ids = seen.select("id").distinct()
    original = clean.dedup_first(seen, "id", [F.col("n").desc(), F.col("class_id")])
    a = seen.filter(F.col("n") >= 14).select("id", "class_id")
    b = seen.filter(F.col("n") % 3 != 0).select("id", "class_id")
    return ids, original.select("id", "class_id"), {"nbsvm": a, "spysvm": b}


_NAMES = "['click', 'error', 'purchase', 'signup', 'view']"
_REPORT = _SETS + f""",
orig AS (
  SELECT id, class_id FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, class_id) AS rn
    FROM user_types) WHERE rn = 1),
an AS (SELECT id, string_agg({_NAMES}[class_id + 1], ' ' ORDER BY class_id) AS s
       FROM a GROUP BY id),
bn AS (SELECT id, string_agg({_NAMES}[class_id + 1], ' ' ORDER BY class_id) AS s
       FROM b GROUP BY id),
merged AS (
  SELECT o.id AS Package, {_NAMES}[o.class_id + 1] AS Original_Label,
         coalesce(an.s, '') AS NBSVM, coalesce(bn.s, '') AS SPYSVM
  FROM orig o LEFT JOIN an ON an.id = o.id LEFT JOIN bn ON bn.id = o.id)"""


@query("model_report", f"WITH {_REPORT} SELECT Package, Original_Label, NBSVM FROM merged")
def model_report(spark, sf_dir):
    ids, original, models = _report_inputs(spark, sf_dir)
    return evaluate.report(ids, original, models["nbsvm"], EVENT_TYPES, "nbsvm")


@query("merged_report", f"WITH {_REPORT} SELECT * FROM merged")
def merged_report(spark, sf_dir):
    ids, original, models = _report_inputs(spark, sf_dir)
    return evaluate.merged_report(ids, original, models, EVENT_TYPES)


@query("error_report", f"""WITH {_REPORT}
SELECT * FROM merged WHERE Package NOT IN (
  SELECT id FROM (SELECT * FROM a INTERSECT SELECT * FROM b INTERSECT SELECT * FROM orig))""")
def error_report(spark, sf_dir):
    ids, original, models = _report_inputs(spark, sf_dir)
    return evaluate.error_report(ids, original, models, EVENT_TYPES)


@query("label_count_histogram", f"""WITH {_SETS},
tagged AS (SELECT 'nbsvm' AS model, * FROM a UNION ALL SELECT 'spysvm', * FROM b),
per_row AS (SELECT model, id, CAST(count(*) AS INTEGER) AS labels FROM tagged GROUP BY ALL),
hist AS (SELECT model, labels, count(*) AS n FROM per_row GROUP BY ALL),
grid AS (SELECT model, CAST(unnest(range(1, (SELECT max(labels) FROM hist) + 1)) AS INTEGER)
           AS labels FROM (SELECT DISTINCT model FROM tagged))
SELECT model, labels, coalesce(n, 0) AS n FROM grid LEFT JOIN hist USING (model, labels)""")
def label_count_histogram(spark, sf_dir):
    return evaluate.label_counts(_report_inputs(spark, sf_dir)[2])


_PRED = """
pred AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END
           AS y, CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 200000 THEN 1
           ELSE 3 END AS pred FROM orders)"""


def _predictions(spark, sf_dir):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("y"),
        F.when(price < 100000, 0).when(price < 200000, 1).otherwise(3).alias("pred"),
    )


@query("accuracy", f"WITH {_PRED} SELECT round(avg(CAST(y = pred AS DOUBLE)), 6) AS accuracy "
                   "FROM pred")
def accuracy(spark, sf_dir):
    out = evaluate.accuracy(_predictions(spark, sf_dir))
    return out.select(F.round("accuracy", 6).alias("accuracy"))


@query("confusion", f"""WITH {_PRED},
k AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS c)
SELECT a.c AS y, b.c AS pred, count(p.id) AS n
FROM k a CROSS JOIN k b LEFT JOIN pred p ON p.y = a.c AND p.pred = b.c GROUP BY ALL""")
def confusion(spark, sf_dir):
    return evaluate.confusion(_predictions(spark, sf_dir), range(4))


@query("classification_report", f"""WITH {_PRED},
k AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS c)
SELECT a.c AS y, b.c AS pred, count(p.id) AS n,
       (SELECT round(avg(CAST(y = pred AS DOUBLE)), 6) FROM pred) AS accuracy
FROM k a CROSS JOIN k b LEFT JOIN pred p ON p.y = a.c AND p.pred = b.c GROUP BY ALL""")
def classification_report(spark, sf_dir):
    out = evaluate.classification_report(_predictions(spark, sf_dir), range(4))
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("n_classes", f"WITH {DOCS} SELECT max(class_id) + 1 AS q FROM docs")
def n_classes(spark, sf_dir):
    return documents(spark, sf_dir).agg((F.max("class_id") + 1).alias("q"))

