"""Queries on text features, naive Bayes and label enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from manylabel.functions.fixed import BLANK_WORD_PATTERN
from manylabel.functions.labels import to_matrix
from manylabel.operators import bayes, enrich, evaluate, features
from manylabel.operators.algebra import doc_scores, term_sums
from manylabel.operators.sample import head_split
from manylabel.plans.inputs import (
    CLEAN,
    COUNTS,
    Q,
    SOURCES,
    TFIDF,
    Corpus,
    cleaned,
    documents,
    table,
)
from manylabel.plans.registry import query
from manylabel.session import stage, stage_by_key

GAMMA = 6
STOP_WORDS = ["and", "for", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with"]

# --- tokens and counts ------------------------------------------------------


@query("tokens", f"""WITH {CLEAN}
SELECT id, unnest(range(len(t))) AS pos, unnest(t) AS term
FROM (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM clean)""")
def tokens(spark, sf_dir):
    out = features.tokenize(cleaned(spark, sf_dir))
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query("word_counts", """
SELECT id, term, count(*) AS tf FROM (
  SELECT doc_id AS id,
         unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term
  FROM documents) GROUP BY ALL""")
def word_counts(spark, sf_dir):
    return features.term_counts(documents(spark, sf_dir))


@query("blank_word_counts", f"""WITH {CLEAN}
SELECT id, term, count(*) AS tf FROM (
  SELECT id, unnest(regexp_extract_all(lower(text), '\\b[a-z0-9_]{{2}} +\\b')) AS term FROM clean)
GROUP BY ALL""")
def blank_word_counts(spark, sf_dir):
    return features.term_counts(cleaned(spark, sf_dir), pattern=BLANK_WORD_PATTERN)


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("counts_without_stopwords", f"""WITH {COUNTS}
SELECT id, term, tf FROM counts WHERE term NOT IN ({_STOP_SQL})""")
def counts_without_stopwords(spark, sf_dir):
    return features.term_counts(cleaned(spark, sf_dir), stop_words=STOP_WORDS)


@query("bigram_counts", f"""WITH {CLEAN},
tok AS (SELECT id, unnest(range(len(t))) AS pos, unnest(t) AS term FROM (
  SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM clean))
SELECT id, term, count(*) AS tf FROM (
  SELECT id, term FROM tok UNION ALL
  SELECT id, term || ' ' || lead(term) OVER (PARTITION BY id ORDER BY pos) FROM tok)
WHERE term IS NOT NULL GROUP BY ALL""")
def bigram_counts(spark, sf_dir):
    return features.term_counts(cleaned(spark, sf_dir), ngram_range=(1, 2))


@query("document_frequency", f"""WITH {COUNTS}
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY term""")
def document_frequency(spark, sf_dir):
    return features.doc_freq(features.term_counts(cleaned(spark, sf_dir)))


@query("limited_vocabulary", f"""WITH {COUNTS},
v AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY term)
SELECT term, df, n FROM v
WHERE df >= 3 AND df <= 0.5::DOUBLE * (SELECT count(*) FROM clean)
ORDER BY n DESC, term LIMIT 1200""")
def limited_vocabulary(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    return features.vocabulary(
        corpus.counts, corpus.n, min_df=3, max_df=0.5, max_features=1200
    )


@query("count_vectors", f"""WITH {COUNTS},
v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx
      FROM (SELECT DISTINCT term FROM counts))
SELECT id, term, idx, tf FROM counts JOIN v USING (term)""")
def count_vectors(spark, sf_dir):
    return features.count_vectorize(Corpus(spark, sf_dir, with_tfidf=False).counts)


@query("tfidf", f"WITH {TFIDF} SELECT id, term, round(x, 6) AS x FROM tfidf")
def tfidf(spark, sf_dir):
    rows = Corpus(spark, sf_dir).features
    return rows.select("id", "term", F.round("x", 6).alias("x"))


@query("tfidf_options", f"""WITH {COUNTS},
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
raw AS (SELECT id, term, (ln(tf) + 1) *
          (ln((SELECT count(*) FROM clean)::DOUBLE / df) + 1) AS x
        FROM counts JOIN dfs USING (term))
SELECT id, term, round(x / sum(abs(x)) OVER (PARTITION BY id), 6) AS x FROM raw""")
def tfidf_options(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    rows = features.tfidf(
        corpus.counts, corpus.n, norm="l1", smooth_idf=False, sublinear_tf=True
    )
    return rows.select("id", "term", F.round("x", 6).alias("x"))


@query("column_moments", """
SELECT round(avg(l_quantity), 6) AS l_quantity_mean,
       round(stddev_pop(l_quantity), 6) AS l_quantity_std,
       round(avg(l_discount), 6) AS l_discount_mean,
       round(stddev_pop(l_discount), 6) AS l_discount_std FROM lineitem""")
def column_moments(spark, sf_dir):
    out = features.moments(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("scaled_columns", """
WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s, avg(l_tax) AS b,
                  stddev_pop(l_tax) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - a) / (s + 1e-6), 6) AS l_quantity,
       round((l_tax - b) / (t + 1e-6), 6) AS l_tax,
       round(l_discount / (1 + 1e-6), 6) AS l_discount
FROM lineitem, m""")
def scaled_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"
    )
    out = features.scale(lines, ["l_quantity", "l_tax"])
    out = features.scale(out, ["l_discount"], identity=True)
    rounded = {c: F.round(c, 6) for c in ("l_quantity", "l_tax", "l_discount")}
    return out.withColumns(rounded)


@query("feature_union", f"""WITH {COUNTS}
SELECT id, 'word:' || term AS term, CAST(tf AS DOUBLE) AS x FROM counts
UNION ALL SELECT id, 'general:n_chars', CAST(n_chars AS DOUBLE) FROM clean WHERE n_chars <> 0""")
def feature_union(spark, sf_dir):
    docs = stage(cleaned(spark, sf_dir), "clean")
    words = features.term_counts(docs).withColumn("x", F.col("tf").cast("double"))
    return features.union_features(word=words, general=features.numeric_block(docs, ["n_chars"]))


# --- similarity -------------------------------------------------------------


@query("cosine_degree", """
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.id, round(sum(list_cosine_similarity(a.v, b.v)), 5) AS degree
FROM e a CROSS JOIN e b GROUP BY a.id""")
def cosine_degree(spark, sf_dir):
    """Row sums of the cosine matrix, from the sum of all rows instead of all pairs."""
    rows = _unit_embeddings(spark, sf_dir)
    ones = rows.select("id").distinct().withColumn("a", F.array(F.lit(1.0)))
    total = term_sums(rows, ones, 1).withColumnRenamed("s", "w")
    sums = doc_scores(rows, total, 1)
    return sums.select("id", F.round(F.get("s", F.lit(0)), 5).alias("degree"))


def _unit_embeddings(spark, sf_dir):
    """Embeddings as long unit rows ``(id, term, x)``."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "v")
    )
    value = F.col("v").cast("double")
    long = vectors.select("id", F.col("pos").cast("string").alias("term"), value.alias("v"))
    norms = long.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    joined = long.join(norms, "id")
    return stage_by_key(joined.select("id", "term", (F.col("v") / F.col("norm")).alias("x")))


@query("embedding_class_similarity", """
WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.id, CAST(b.label AS INTEGER) AS class_id,
       round(sum(list_cosine_similarity(a.v, b.v)), 5) AS similarity
FROM e a CROSS JOIN e b GROUP BY a.id, b.label""")
def embedding_class_similarity(spark, sf_dir):
    rows = _unit_embeddings(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("int").alias("class_id")
    )
    y = to_matrix(labels, 10).select("id", F.col("y").alias("a"))
    centroids = term_sums(rows, y, 10).withColumnRenamed("s", "w")
    sums = doc_scores(rows, centroids, 10)
    return sums.select("id", F.posexplode("s").alias("class_id", "v")).select(
        "id", "class_id", F.round("v", 5).alias("similarity")
    )


_LINEAR = TFIDF + """,
cent AS (SELECT class_id AS k, term, sum(x) AS c FROM tfidf GROUP BY ALL),
sims AS MATERIALIZED (
  SELECT id, k AS class_id, round(sum(x * c), 6) AS s
  FROM tfidf JOIN cent USING (term) GROUP BY ALL),
linear AS MATERIALIZED (
  SELECT id, class_id FROM clean UNION
  SELECT id, class_id FROM sims WHERE s > 6)"""


@query("class_similarity", f"""WITH {_LINEAR}
SELECT c.id, CAST(k.k AS INTEGER) AS class_id, coalesce(s, 0) AS similarity
FROM clean c CROSS JOIN (SELECT unnest(range(20)) AS k) k
LEFT JOIN sims ON sims.id = c.id AND sims.class_id = k.k""")
def class_similarity(spark, sf_dir):
    corpus = Corpus(spark, sf_dir)
    scores = enrich.class_similarity(corpus.features, corpus.labels, corpus.ids, Q)
    return scores.select("id", F.posexplode("s").alias("class_id", "similarity"))


@query("linear_well", f"WITH {_LINEAR} SELECT id, class_id FROM linear")
def linear_well(spark, sf_dir):
    corpus = Corpus(spark, sf_dir)
    return enrich.linear_well(corpus.features, corpus.labels, corpus.ids, Q, GAMMA)


@query("linear_well_report", f"""WITH {_LINEAR},
named AS (SELECT id, string_agg('src' || class_id, ' ' ORDER BY class_id) AS s
          FROM linear GROUP BY id)
SELECT c.id AS Package, 'src' || c.class_id AS Original_Label, n.s AS LINEAR_WELL
FROM clean c JOIN named n USING (id)""")
def linear_well_report(spark, sf_dir):
    """The flagship chain: clean, count, weigh, enrich, report."""
    corpus = Corpus(spark, sf_dir)
    labels = enrich.linear_well(corpus.features, corpus.labels, corpus.ids, Q, GAMMA)
    return evaluate.report(corpus.ids, corpus.labels, labels, SOURCES, "linear_well")


RATE_GAMMAS = [4.5, 5.5, 6, 6.5]


@query("linear_well_at_rate", f"""WITH {_LINEAR},
g AS (SELECT unnest([4.5, 5.5, 6, 6.5])::DOUBLE AS gamma, unnest([0, 1, 2, 3]) AS i),
rates AS (
  SELECT gamma, i, (SELECT count(*) FROM (
           SELECT id, class_id FROM clean UNION
           SELECT id, class_id FROM sims WHERE s > gamma)) / (20.0::DOUBLE *
           (SELECT count(*) FROM clean)) AS rate FROM g),
best AS (SELECT gamma FROM rates ORDER BY abs(rate - 0.08::DOUBLE), i LIMIT 1)
SELECT id, class_id, (SELECT gamma FROM best) AS gamma FROM (
  SELECT id, class_id FROM clean UNION
  SELECT id, class_id FROM sims WHERE s > (SELECT gamma FROM best))""")
def linear_well_at_rate(spark, sf_dir):
    corpus = Corpus(spark, sf_dir)
    labels, gamma = enrich.linear_well_at_rate(
        corpus.features, corpus.labels, corpus.ids, Q, RATE_GAMMAS
    )
    return labels.withColumn("gamma", F.lit(float(gamma)))


# --- naive Bayes ------------------------------------------------------------


def nb_sql(prefix: str, positives: str, alpha: float = 1.0) -> str:
    """CTE ``<prefix>_m(id, k, m)``: margins of all classes for positives ``(id, k)``."""
    p = prefix
    return f"""
{p}_nk AS (SELECT k, term, sum(tf)::DOUBLE AS c FROM counts JOIN {positives} USING (id)
           GROUP BY ALL),
{p}_n AS (SELECT term, sum(tf)::DOUBLE AS n FROM counts GROUP BY term),
{p}_t AS (SELECT k, sum(c) AS ck FROM {p}_nk GROUP BY k),
{p}_all AS (SELECT sum(n) AS n, count(*) AS v FROM {p}_n),
{p}_d AS (SELECT k, count(*)::DOUBLE AS dk FROM {positives} GROUP BY k),
{p}_w AS (
  SELECT t.k, n.term, ln(coalesce(c, 0) + {alpha}) - ln(n.n - coalesce(c, 0) + {alpha})
         - ln(t.ck + {alpha} * a.v) + ln(a.n - t.ck + {alpha} * a.v) AS w
  FROM {p}_n n CROSS JOIN {p}_t t CROSS JOIN {p}_all a
  LEFT JOIN {p}_nk nk ON nk.k = t.k AND nk.term = n.term),
{p}_s AS (SELECT id, k, sum(tf * w) AS s FROM counts JOIN {p}_w USING (term) GROUP BY ALL),
{p}_m AS MATERIALIZED (
  SELECT c.id, d.k, round(coalesce(s, 0) + ln(dk) - ln((SELECT count(*) FROM clean) - dk), 6)
         AS m
  FROM clean c CROSS JOIN {p}_d d LEFT JOIN {p}_s s ON s.id = c.id AND s.k = d.k)"""


_Y = "y AS MATERIALIZED (SELECT id, class_id AS k FROM clean)"
_NB = f"{COUNTS}, {_Y}, {nb_sql('nb', 'y')}"


@query("nb_term_counts", f"""WITH {COUNTS}
SELECT term, class_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY ALL""")
def nb_term_counts(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    stats = bayes.nb_stats(corpus.counts, corpus.targets(), Q)
    long = stats.select("term", F.posexplode("nk").alias("class_id", "n"))
    return long.filter(F.col("n") > 0).select("term", "class_id", F.col("n").cast("bigint"))


@query("nb_margins", f"""WITH {_NB}
SELECT id, k AS class_id, m AS margin FROM nb_m""")
def nb_margins(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    y = stage(corpus.targets(), "targets")
    margins = enrich.nb_margins(corpus.counts, y, corpus.ids, Q)
    return margins.select("id", F.posexplode("m").alias("class_id", "margin"))


_MULTI = COUNTS + """,
nk AS (SELECT class_id AS k, term, sum(tf)::DOUBLE AS c FROM counts GROUP BY ALL),
v AS (SELECT count(DISTINCT term) AS v FROM counts),
tk AS (SELECT k, sum(c) AS ck FROM nk GROUP BY k),
pk AS (SELECT class_id AS k, ln(count(*)) - ln((SELECT count(*) FROM clean)) AS p
       FROM clean GROUP BY class_id),
w AS (SELECT t.k, n.term, ln(coalesce(c, 0) + 1.0) - ln(ck + v) AS w
      FROM (SELECT DISTINCT term FROM counts) n CROSS JOIN tk t CROSS JOIN v
      LEFT JOIN nk ON nk.k = t.k AND nk.term = n.term),
jll AS (SELECT c.id, p.k, round(coalesce(s, 0) + p.p, 6) AS m
        FROM clean c CROSS JOIN pk p
        LEFT JOIN (SELECT id, k, sum(tf * w) AS s FROM counts JOIN w USING (term) GROUP BY ALL) s
        ON s.id = c.id AND s.k = p.k)"""


@query("nb_multiclass", f"""WITH {_MULTI}
SELECT id, arg_max(k, (m, -k)) AS pred FROM jll GROUP BY id""")
def nb_multiclass(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    y = stage(corpus.targets(), "targets")
    model = bayes.fit_multiclass(corpus.counts, y, Q)
    scored = bayes.score(model, corpus.counts, corpus.ids)
    return scored.select("id", bayes.best_class("m").alias("pred"))


_SPLIT = CLEAN + """,
parts AS MATERIALIZED (
  SELECT id, class_id, text, row_number() OVER (PARTITION BY class_id ORDER BY id) > 20 AS train
  FROM clean),
bcounts AS MATERIALIZED (
  SELECT id, class_id, train, term, count(*) AS tf FROM (
    SELECT id, class_id, train,
           unnest(regexp_extract_all(lower(text), '\\b[a-z0-9_]{2} +\\b')) AS term FROM parts)
  GROUP BY ALL),
bnk AS (SELECT class_id AS k, term, sum(tf)::DOUBLE AS c FROM bcounts WHERE train GROUP BY ALL),
bn AS (SELECT term, sum(c) AS n FROM bnk GROUP BY term),
ball AS (SELECT sum(n) AS n, count(*) AS v FROM bn),
bd AS (SELECT class_id AS k, count(*)::DOUBLE AS dk FROM parts WHERE train GROUP BY class_id),
btot AS (SELECT bd.k, coalesce(sum(c), 0) AS ck FROM bd LEFT JOIN bnk USING (k) GROUP BY bd.k),
bw AS (SELECT t.k, bn.term, ln(coalesce(c, 0) + 1) - ln(bn.n - coalesce(c, 0) + 1)
              - ln(ck + v) + ln(ball.n - ck + v) AS w
       FROM bn CROSS JOIN btot t CROSS JOIN ball
       LEFT JOIN bnk ON bnk.k = t.k AND bnk.term = bn.term),
bs AS (SELECT id, k, sum(tf * w) AS s FROM bcounts JOIN bw USING (term)
       WHERE NOT train GROUP BY ALL),
bp AS MATERIALIZED (
  SELECT p.id, bd.k, CAST(p.class_id = bd.k AS INTEGER) AS y,
         CAST(round(coalesce(s, 0) + ln(dk) - ln((SELECT count(*) FROM parts WHERE train) - dk),
                    6) > 0 AS INTEGER) AS pred
  FROM (SELECT * FROM parts WHERE NOT train) p CROSS JOIN bd
  LEFT JOIN bs ON bs.id = p.id AND bs.k = bd.k)"""


@query("binary_report", f"""WITH {_SPLIT},
g AS (SELECT CAST(k AS INTEGER) AS class_id, y, pred FROM
      (SELECT unnest(range(20)) AS k), (SELECT unnest([0, 1]) AS y), (SELECT unnest([0, 1]) AS pred))
SELECT g.class_id, g.y, g.pred, count(b.id) AS n,
       round(any_value(a.accuracy), 6) AS accuracy
FROM g LEFT JOIN bp b ON b.k = g.class_id AND b.y = g.y AND b.pred = g.pred
JOIN (SELECT k, avg(CAST(y = pred AS DOUBLE)) AS accuracy FROM bp GROUP BY k) a
  ON a.k = g.class_id
GROUP BY g.class_id, g.y, g.pred""")
def binary_report(spark, sf_dir):
    """One-vs-rest naive Bayes on a hold-out: confusion cells and accuracy per class."""
    docs = stage(cleaned(spark, sf_dir), "clean")
    parts = stage(
        head_split(docs.select("id", "class_id"), [F.col("id")]), "parts"
    )
    counts = stage_by_key(
        features.term_counts(docs, pattern=BLANK_WORD_PATTERN), "id", "counts", placed=True
    )
    return enrich.binary_report(counts, parts, Q)


# --- enrichment with naive Bayes -------------------------------------------


@query("naive_well_nb", f"""WITH {_NB}
SELECT id, class_id FROM clean UNION SELECT id, CAST(k AS INTEGER) FROM nb_m WHERE m > 0""")
def naive_well_nb(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    return enrich.naive_well_nb(corpus.counts, corpus.labels, corpus.ids, Q)


def _kfold_sql(step: int, y: str) -> str:
    """One round of out-of-fold prediction from positives ``y``."""
    p = f"r{step}"
    return f"""
{p}_nk AS (SELECT fold, k, term, sum(tf)::DOUBLE AS c
           FROM counts JOIN {y} USING (id) JOIN folds USING (id) GROUP BY ALL),
{p}_ck AS (SELECT f.fold, nk.k, nk.term, sum(c) AS c FROM {p}_nk nk
           JOIN (SELECT DISTINCT fold FROM folds) f ON f.fold <> nk.fold GROUP BY ALL),
{p}_cn AS (SELECT f.fold, term, sum(tf)::DOUBLE AS n FROM counts JOIN folds o USING (id)
           JOIN (SELECT DISTINCT fold FROM folds) f ON f.fold <> o.fold GROUP BY ALL),
{p}_tk AS (SELECT fold, k, sum(c) AS ck FROM {p}_ck GROUP BY ALL),
{p}_t AS (SELECT fold, sum(n) AS n FROM {p}_cn GROUP BY fold),
{p}_d AS (SELECT f.fold, k, count(*)::DOUBLE AS dk FROM {y} JOIN folds o USING (id)
          JOIN (SELECT DISTINCT fold FROM folds) f ON f.fold <> o.fold GROUP BY ALL),
{p}_dn AS (SELECT f.fold, count(*)::DOUBLE AS d FROM folds o
           JOIN (SELECT DISTINCT fold FROM folds) f ON f.fold <> o.fold GROUP BY ALL),
{p}_u AS (SELECT DISTINCT fold, term FROM counts JOIN folds USING (id)),
{p}_w AS (
  SELECT u.fold, u.term, tk.k, ln(coalesce(c, 0) + 1)
         - ln(coalesce(cn.n, 0) - coalesce(c, 0) + 1) - ln(ck + v) + ln(t.n - ck + v) AS w
  FROM {p}_u u JOIN {p}_tk tk USING (fold) JOIN {p}_t t USING (fold)
  CROSS JOIN (SELECT count(DISTINCT term) AS v FROM counts)
  LEFT JOIN {p}_ck k ON k.fold = u.fold AND k.term = u.term AND k.k = tk.k
  LEFT JOIN {p}_cn cn ON cn.fold = u.fold AND cn.term = u.term),
{p}_s AS (SELECT id, k, sum(tf * w) AS s FROM counts JOIN folds USING (id)
          JOIN {p}_w USING (fold, term) GROUP BY ALL),
{p}_y AS MATERIALIZED (
  SELECT id, k FROM {y} UNION
  SELECT f.id, d.k FROM folds f JOIN {p}_d d USING (fold) JOIN {p}_dn USING (fold)
  LEFT JOIN {p}_s s ON s.id = f.id AND s.k = d.k
  WHERE round(coalesce(s, 0) + ln(dk) - ln(d - dk), 6) > 0)"""


_FOLDS = """
folds AS MATERIALIZED (
  SELECT id, ntile(3) OVER (ORDER BY md5('7:' || id), id) - 1 AS fold FROM clean)"""


@query("kfold_well_nb", f"""WITH {COUNTS}, {_Y}, {_FOLDS}, {_kfold_sql(1, 'y')},
{_kfold_sql(2, 'r1_y')}
SELECT id, CAST(k AS INTEGER) AS class_id FROM r2_y""")
def kfold_well_nb(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    return enrich.kfold_well_nb(corpus.counts, corpus.labels, corpus.ids, Q, max_iters=2)


# --- positive-unlabeled learning, first stage -------------------------------


@query("nb_reliable_negatives", f"""WITH {_NB}
SELECT id, CAST(k AS INTEGER) AS class_id FROM nb_m
WHERE m <= 0 AND (id, k) NOT IN (SELECT id, k FROM y)""")
def nb_reliable_negatives(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    return enrich.reliable_negatives(corpus.counts, corpus.labels, corpus.ids, Q)


_SPIES = """
spies AS MATERIALIZED (
  SELECT id, k FROM (
    SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY md5('7:' || id), id) AS rn,
           count(*) OVER (PARTITION BY k) AS n FROM y)
  WHERE rn <= floor(n * 0.15::DOUBLE)),
y0 AS MATERIALIZED (SELECT id, k FROM y EXCEPT SELECT id, k FROM spies)"""


def _threshold_sql(margins: str, noise: float) -> str:
    return f"""
limits AS (
  SELECT k, m AS threshold FROM (
    SELECT k, m, row_number() OVER (PARTITION BY k ORDER BY m) AS rn,
           count(*) OVER (PARTITION BY k) AS n FROM {margins} JOIN spies USING (id, k))
  WHERE rn = floor(n * {noise}::DOUBLE) + 1),
rn AS MATERIALIZED (
  SELECT id, k FROM {margins} JOIN limits USING (k)
  WHERE m < threshold AND (id, k) NOT IN (SELECT id, k FROM y))"""


_SPY = f"{COUNTS}, {_Y}, {_SPIES}, {nb_sql('nb', 'y0')}, {_threshold_sql('nb_m', 0.2)}"


@query("spy_reliable_negatives",
       f"WITH {_SPY} SELECT id, CAST(k AS INTEGER) AS class_id FROM rn")
def spy_reliable_negatives(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    return enrich.spy_negatives(corpus.counts, corpus.labels, corpus.ids, Q)


@query("pu_diagnostics", f"""WITH {_SPY},
p AS (SELECT k, count(*) AS n FROM y GROUP BY k), r AS (SELECT k, count(*) AS n FROM rn GROUP BY k)
SELECT CAST(p.k AS INTEGER) AS class_id, p.n AS positives, coalesce(r.n, 0) AS negatives,
       p.n + coalesce(r.n, 0) AS total, CAST(0 AS BIGINT) AS overlap
FROM p LEFT JOIN r USING (k)""")
def pu_diagnostics(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    negatives = enrich.spy_negatives(corpus.counts, corpus.labels, corpus.ids, Q)
    return enrich.pu_diagnostics(corpus.labels, negatives)


@query("pu_training_set", f"""WITH {_SPY}
SELECT id, CAST(k AS INTEGER) AS class_id, 1 AS target FROM y
UNION ALL SELECT id, CAST(k AS INTEGER), 0 FROM rn""")
def pu_training_set(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    negatives = enrich.spy_negatives(corpus.counts, corpus.labels, corpus.ids, Q)
    return enrich.pu_training_set(corpus.labels, negatives)


def _iterate_sql(steps: int) -> str:
    """``steps`` refits on predicted labels with per-class stopping."""
    out = nb_sql("i0", "y0")
    out += """,
i0_f AS MATERIALIZED (SELECT id, k, m, true AS live FROM i0_m)"""
    for s in range(1, steps + 1):
        prev, p = f"i{s - 1}", f"i{s}"
        out += f""",
{p}_y AS MATERIALIZED (
  SELECT id, k FROM {prev}_f WHERE live AND m > 0 AND k IN (
    SELECT k FROM {prev}_f GROUP BY k
    HAVING bool_or(m > 0) AND bool_or(m <= 0))),
{nb_sql(p, f'{p}_y')},
{p}_delta AS (
  SELECT k, max(abs(1 / (1 + exp(-n.m)) - 1 / (1 + exp(-o.m)))) AS d
  FROM {p}_m n JOIN {prev}_f o USING (id, k) GROUP BY k),
{p}_f AS MATERIALIZED (
  SELECT o.id, o.k, coalesce(n.m, o.m) AS m, coalesce(d.d > 0.1, false) AS live
  FROM {prev}_f o LEFT JOIN {p}_m n USING (id, k) LEFT JOIN {p}_delta d USING (k))"""
    return out


#: Refits unrolled in SQL; settled classes stay as they are, so more change nothing.
ITERATIONS = 12
_ITER = f"{COUNTS}, {_Y}, {_SPIES}, {_iterate_sql(ITERATIONS)}"


@query("iterated_bayes", f"""WITH {_ITER}
SELECT id, CAST(k AS INTEGER) AS class_id, m AS margin FROM i{ITERATIONS}_f""")
def iterated_bayes(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    spies = stage(enrich.sample_spies(corpus.labels), "spies")
    margins, _ = enrich.iterate_bayes(
        corpus.counts, enrich._without_spies(corpus.labels, spies), corpus.ids, Q
    )
    return margins.select("id", F.posexplode("m").alias("class_id", "margin"))


@query("iter_spy_reliable_negatives", f"""WITH {_ITER},
{_threshold_sql(f'i{ITERATIONS}_f', 0.5)}
SELECT id, CAST(k AS INTEGER) AS class_id FROM rn""")
def iter_spy_reliable_negatives(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    return enrich.iter_spy_negatives(corpus.counts, corpus.labels, corpus.ids, Q)


@query("max_margin_change", f"""WITH {_ITER}
SELECT CAST(k AS INTEGER) AS class_id, round(max(abs(a.m - b.m)), 4) AS delta
FROM i0_f a JOIN i{ITERATIONS}_f b USING (id, k) GROUP BY k""")
def max_margin_change(spark, sf_dir):
    """How far the iteration moved the margins of each class."""
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    spies = stage(enrich.sample_spies(corpus.labels), "spies")
    hidden = enrich._without_spies(corpus.labels, spies)
    y = stage(to_matrix(hidden, Q, corpus.ids), "targets")
    first = stage(enrich.nb_margins(corpus.counts, y, corpus.ids, Q), "margins")
    last, _ = enrich.iterate_bayes(corpus.counts, hidden, corpus.ids, Q, first=first)
    deltas = enrich.margin_changes(first, last)
    return deltas.select("class_id", F.round("delta", 4).alias("delta"))


@query("quality_reliable_negatives", f"""WITH {COUNTS},
y AS MATERIALIZED (SELECT doc_id AS id, 0 AS k FROM labels
                   WHERE quality = 1 AND doc_id IN (SELECT id FROM clean)),
{nb_sql('nb', 'y')}
SELECT id, CAST(0 AS INTEGER) AS class_id FROM nb_m
WHERE m <= 0 AND id NOT IN (SELECT id FROM y)""")
def quality_reliable_negatives(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    return enrich.reliable_negatives(corpus.counts, corpus.quality(), corpus.ids, 1)

