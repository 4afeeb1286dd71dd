"""Hand-derived values of the text and list expressions."""

import pytest
from pyspark.sql import functions as F

from manylabel.functions import fixed, lists
from manylabel.functions import text as tx
from manylabel.operators import clean, encode, features


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expr(F.col("v")).alias("out")).first()["out"]


@pytest.mark.parametrize("fn, value, expected", [
    (tx.clean_characters, "Café — well-known: a_b, 50%", "caf  wellknown ab 50%"),
    (tx.clean_characters, "keep % ; < > ~ only", "keep % ; < > ~ only"),
    (tx.strip_urls, "see httpaa httpbb end", "see httpbb end"),
    (tx.strip_urls, "httpaa end", "httpaa end"),
    (tx.strip_urls, "see httpaa", "see httpaa"),
    (tx.strip_urls, "see http\naa end", "see http\naa end"),
    (tx.squeeze_spaces, "a   b  c", "a b c"),
    (lambda c: tx.truncate_words(c, 3), "aaa bbb ccc", "aaa"),
    (lambda c: tx.truncate_words(c, 3), "aaaaaaa", "aaaaaaa"),
    (lambda c: tx.truncate_words(c, 3), "ab ", "ab "),
    (lambda c: tx.truncate_words(c, 4), "aaa bbb ccc", "aaa bbb"),
    (tx.too_sparse, "a b c d", True),
    (tx.too_sparse, "abcd efg", False),
    (tx.parse_count, "1,000,000+", 1000000.0),
    (tx.parse_count, "Varies", 0.0),
    (tx.parse_count, None, 0.0),
    (tx.letters_only, "Café 中2 x-y!", "café 中 xy"),
    (lambda c: tx.boost(F.lit("ab"), c), "t", "ab ab ab ab ab t"),
    (lambda c: tx.boost(c, F.lit("t")), None, "     t"),
    (tx.lines_to_list, "\tread\nwrite\n", "read;write"),
    (tx.flatten_lines, "a\nb", "a b"),
])
def test_text_expressions(spark, fn, value, expected):
    assert one(spark, value, fn) == expected


def test_clean_chain_keeps_listed_ids(spark):
    long, short = "word " * 200, "too short"
    rows = [("a", "en", long), ("b", "en", short), ("c", "de", long), ("d", None, long),
            ("com.tencent.ig", "en", short), ("e", "en", None), ("f", "en", "x " * 2000)]
    df = spark.createDataFrame(rows, "id string, lang string, text string")
    kept = {r["id"]: r["text"] for r in clean.clean_texts(df, lang="en", max_length=3000, n=800).collect()}
    assert set(kept) == {"a", "com.tencent.ig"}
    assert kept["a"] == long
    assert {r["id"] for r in clean.clean_texts(df).collect()} == {"a", "b", "c", "d", "com.tencent.ig"}


def test_length_border(spark):
    rows = [("a", "x" * 799), ("b", "x" * 800), ("c", "x" * 799)]
    df = spark.createDataFrame(rows, "id string, text string")
    kept = clean.min_length(df, keep_ids=["c "])
    assert {r["id"] for r in kept.collect()} == {"b"}
    kept = clean.min_length(df, keep_ids=["c"])
    assert {r["id"] for r in kept.collect()} == {"b", "c"}


def test_content_and_permission_keys(spark):
    rows = [(1, "Fear, Use of Alcohol/Tobacco", "record audio;;record audio;foo"),
            (2, None, None), (3, "Unknown Thing", "run at startup"),
            (4, "Language, Language", "")]
    df = spark.createDataFrame(rows, "id int, c string, p string")
    content = lists.multi_hot(
        lists.map_list(F.col("c"), fixed.CONTENT_PHRASES), fixed.CONTENT_KEYS
    )
    permission = lists.multi_hot(F.split("p", ";"), fixed.PERMISSION_KEYS)
    found = {
        r["id"]: {k for k, v in r.asDict().items() if k != "id" and v == 1}
        for r in df.select("id", *content, *permission).collect()
    }
    assert found[1] == {"Horror", "Alcohol", "Tobacco", "record audio"}
    assert found[2] == set()
    assert found[3] == {"run at startup"}
    assert found[4] == {"Language"}


def test_fixed_tables():
    assert len(fixed.CATEGORIES) == 17 and len(fixed.APP_HEADER) == 22
    assert len(fixed.CONTENT_KEYS) == 19 and len(fixed.PERMISSION_KEYS) == 28
    assert len(fixed.CONTENT_PHRASES) == 45 and len(fixed.IMPORTANT_IDS) == 43
    assert {k for v in fixed.CONTENT_PHRASES.values() for k in v} == set(fixed.CONTENT_KEYS)


def test_unknown_category_fails(spark):
    df = spark.createDataFrame([("Action",), ("Nonsense",)], "Category string")
    with pytest.raises(Exception, match="unknown class name"):
        encode.encode(df).collect()


def test_encode_defaults(spark):
    df = spark.createDataFrame(
        [("p", "Word", "5+", "Blood", "record audio", "A-b", "text")],
        "Package string, Category string, Installs string, Content_Feature string, "
        "Permission string, Name string, Description string",
    )
    row = encode.encode(df).first().asDict()
    assert row["Category"] == 16 and row["Installs"] == 5.0 and row["Blood"] == 1
    assert row["Description"] == "ab ab ab ab ab text"
    assert len(row) == 3 + 19 + 28 + 1


def test_tokens(spark):
    df = spark.createDataFrame([(1, "is a of The cat_x cat is"), (2, ""), (3, None)],
                               "id int, text string")
    words = [r["term"] for r in features.tokenize(df).orderBy("id", "pos").collect()]
    assert words == ["is", "of", "the", "cat_x", "cat", "is"]
    blank = features.tokenize(df, pattern=fixed.BLANK_WORD_PATTERN).orderBy("pos").collect()
    assert [r["term"] for r in blank] == ["is ", "of "]
    counts = {r["term"]: r["tf"] for r in features.term_counts(df).collect()}
    assert counts == {"is": 2, "of": 1, "the": 1, "cat_x": 1, "cat": 1}
    grams = features.term_counts(df, ngram_range=(2, 2), stop_words=["of"])
    assert {r["term"] for r in grams.collect()} == {"is the", "the cat_x", "cat_x cat", "cat is"}


def test_conform_and_complete(spark):
    six = {k: "v" for k in ["Category", "Name", "Size", "Age", "Price", "Version"]}
    seven = {**six, "Rating": "4\n5"}
    df = spark.createDataFrame([("p", six), ("r", seven)], "Package string, fields map<string,string>")
    rows = clean.conform(df)
    assert {r["Package"]: r["n_fields"] for r in rows.collect()} == {"p": 9, "r": 10}
    kept = clean.complete(rows).collect()
    assert [r["Package"] for r in kept] == ["r"]
    assert kept[0]["Rating"] == "4 5" and kept[0]["Permission"] == "???" and kept[0]["Updated"] == ""
    assert clean.complete(rows, strict=True).count() == 0
