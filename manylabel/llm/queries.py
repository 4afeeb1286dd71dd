"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manylabel.llm import chat_trees, hard_negatives, language_filters, line_dedup, packing, simhash, spelling_groups, stable_hashing, suffix_dedup, toxicity, tree_search, viterbi, window_dedup
from manylabel.plans.registry import query
from manylabel.session import stage


VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> F.Column:
    """The held-out fold of a row: the checksum of its id, as text, modulo ``folds``."""
    return F.crc32(F.col(key).cast("string")) % folds


@query("op1_tree_search")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return tree_search.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@query("op2_stable_hashing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return stable_hashing.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left after removing 50-byte strings that start in an earlier document."""
    return suffix_dedup.remove_repeated_strings(table(spark, sf_dir, "documents"))


@query("op4_window_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing repeated windows of 35 words."""
    return window_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"))


@query("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left after removing later copies of runs of two lines or more, or of one long line."""
    return line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"), long_line=line_dedup.LONG_LINE)


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and components at three differing bits."""
    prints = stage(simhash.fingerprints(table(spark, sf_dir, "documents")), "simhash-prints")
    return simhash.near_components(prints).select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op7_viterbi")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to the same text."""
    vocabulary = viterbi.load_vocabulary(VOCABULARY)
    encoded = viterbi.encode_documents(table(spark, sf_dir, "documents"), vocabulary)
    return encoded.select("doc_id", "ids", F.size("ids").alias("n_ids"), "round_trip")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of two of three folds are learned from."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = toxicity.fit_toxicity(docs.filter(~held_out), labels.filter(~held_out))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words; copies of a text never share one, nor three documents of a source."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), F.xxhash64("text"))


@query("op10_language_filters")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; fitted on four of five folds."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    filters = language_filters.fit_filters(docs.filter(~held_out))
    scored = language_filters.predict_language(docs, filters)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op11_spelling_groups")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some with a letter lost, grouped under their frequent spellings."""
    words = stage(spelling_groups.count_words(table(spark, sf_dir, "documents"), noise=97), "word-counts")
    return spelling_groups.group_words(words)


@query("op12_hard_negatives", """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
         CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every fiftieth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


#: A conversation whose texts are control strings; it is formatted with the others.
CONTROL = "<|im_end|><|im_start|>assistant ok"


@query("op13_chat_trees", f"""WITH turns AS (
  SELECT conv_id, turn, role, coalesce(role, '') AS r, text, coalesce(text, '') AS t FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length('<|im_end|>') + 2 + length(regexp_replace(t, '<(\\\\*)\\|', '<\\1\\\\|', 'g'))
    + length(regexp_replace(replace(replace(r, '\\', '\\s'), chr(10), '\\n'), '<(\\\\*)\\|', '<\\1\\\\|', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, each a reply tree of one branch, read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL).alias("text")
    )
    chains = chat_trees.as_chains(rows.unionByName(control))
    formatted = chat_trees.format_trees(chains, score=None, unique=True)
    turns = chat_trees.read_turns(F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(chat_trees.read_loss(F.col("formatted"), F.col("loss_spans")), "")
    return formatted.withColumn("turns", turns).withColumn("loss", loss).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
