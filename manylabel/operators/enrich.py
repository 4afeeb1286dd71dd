"""Label enrichment: turn one weak label per row into several.

Labels come in and go out as positives ``(id, class_id)``; inside, the 0/1 values of all
classes sit in one array per document, so every class is served by the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manylabel.functions.labels import labels_or, to_matrix, to_positives
from manylabel.functions.vectors import proba
from manylabel.operators import bayes
from manylabel.operators.algebra import (
    SIZE_COLUMNS,
    TermSize,
    array_sums,
    doc_scores,
    join_terms,
    literal_array,
    pack,
    term_sums,
)
from manylabel.operators.ranks import order_statistic
from manylabel.operators.sample import folds, hash_folds, sample_spies
from manylabel.session import at_ids, block_of, drop_staged, placed_by_block, stage, staging

DIGITS = bayes.DIGITS


# --- linear similarity ------------------------------------------------------


def class_similarity(
    features: DataFrame, labels: DataFrame, ids: DataFrame, q: int
) -> DataFrame:
    """``(id, s)``: sum of cosines of a row to all positives of each class.

    With unit rows the sum equals the product with the sum of the positive rows, so no
    pair of rows is ever formed. Terms that ``features`` marks as ``lone``, of a single row, only
    bring that row to itself.
    """
    y = to_matrix(labels, q).select("id", F.col("y").alias("a"))
    split = "lone" in features.columns
    several = features.filter(~F.col("lone")) if split else features
    centroids = term_sums(several, y, q).withColumnRenamed("s", "w")
    sums = doc_scores(several, centroids, q)
    zeros = F.array_repeat(F.lit(0.0), q)
    scores = ids.select("id").join(sums, "id", "left").withColumn("s", F.coalesce("s", zeros))
    if split:
        block = block_of(features.columns)
        inside = [block] if block else []
        own = features.filter("lone").groupBy(*inside, "id").agg(F.sum(F.col("x") * F.col("x")).alias("own"))
        scores = scores.join(own.select("id", "own").join(y, "id"), "id", "left").withColumn(
            "s", F.when(F.col("own").isNull(), F.col("s")).otherwise(
                F.zip_with("s", "a", lambda s, a: s + F.col("own") * a))
        )
    return scores.select("id", F.transform("s", lambda v: F.round(v, DIGITS)).alias("s"))


def above(scores: DataFrame, gamma: float) -> DataFrame:
    return (
        scores.select("id", F.posexplode("s").alias("class_id", "v"))
        .filter(F.col("v") > gamma)
        .select("id", "class_id")
    )


def linear_well(
    features: DataFrame, labels: DataFrame, ids: DataFrame, q: int, gamma: float = 10
) -> DataFrame:
    """A class is added when its summed similarity exceeds ``gamma``; positives stay.

    This is the closed form of the per-class linear program, which separates by row.
    """
    scores = class_similarity(features, labels, ids, q)
    return labels_or(labels, above(scores, gamma))


def nearest_rate(
    densities: Sequence[tuple[float, float]], target: float, floor: float = 0.0
) -> float:
    """First candidate whose density is closest to ``target`` and not below ``floor``."""
    allowed = [(abs(d - target), i) for i, (_, d) in enumerate(densities) if d >= floor]
    if not allowed:
        raise ValueError(f"no candidate reaches density {floor}: {list(densities)}")
    return densities[min(allowed)[1]][0]


def gamma_densities(
    scores: DataFrame, labels: DataFrame, q: int, gammas: Sequence[float]
) -> list[tuple[float, float]]:
    """Label density per candidate, all from one pass over the scores."""
    joined = scores.join(to_matrix(labels, q), "id", "left")
    held = F.coalesce("y", F.array_repeat(F.lit(0), q).cast("array<tinyint>"))

    def ones(gamma: float):
        flags = F.zip_with("s", held, lambda v, y: ((v > gamma) | (y == 1)).cast("int"))
        return F.sum(F.aggregate(flags, F.lit(0), lambda a, v: a + v))

    row = joined.agg(
        F.count(F.lit(1)).alias("n"), *[ones(g).alias(f"g{i}") for i, g in enumerate(gammas)]
    ).first()
    return [(g, (row[f"g{i}"] or 0) / max(row["n"] * q, 1)) for i, g in enumerate(gammas)]


def linear_well_at_rate(
    features: DataFrame, labels: DataFrame, ids: DataFrame, q: int,
    gammas: Sequence[float] = (120, 140, 150, 160), target: float = 0.08,
) -> tuple[DataFrame, float]:
    """Linear enrichment at the candidate whose density comes closest to ``target``."""
    scores = stage(class_similarity(features, labels, ids, q), "similarity")
    gamma = nearest_rate(gamma_densities(scores, labels, q, gammas), target)
    return labels_or(labels, above(scores, gamma)), gamma


# --- positive-unlabeled learning, first stage -------------------------------


def nb_margins(
    counts: DataFrame, y: DataFrame, ids: DataFrame, q: int, alpha: float = 1.0,
    totals: tuple[int, list[float]] | None = None, tiles: bayes.CountTiles | None = None,
) -> DataFrame:
    """``(id, m)`` margins of one-vs-rest naive Bayes fitted and scored on the same rows.

    With the counts in ``tiles``, which pays where they are fitted again, ``totals`` have to be given.
    """
    if tiles is not None:
        return tiles.margins(y, q, totals)
    return bayes.score(bayes.fit_binary(counts, y, q, alpha, totals=totals), counts, ids)


def reliable_negatives(
    counts: DataFrame, labels: DataFrame, ids: DataFrame, q: int, alpha: float = 1.0
) -> DataFrame:
    """Unlabeled rows that naive Bayes predicts negative: ``(id, class_id)``."""
    y = stage(to_matrix(labels, q, ids), "targets")
    scored = nb_margins(counts, y, ids, q, alpha).join(y, "id")
    flags = F.zip_with("m", "y", lambda m, t: ((m <= 0) & (t == 0)).cast("tinyint"))
    return to_positives(scored.select("id", flags.alias("y")))


def _without_spies(labels: DataFrame, spies: DataFrame) -> DataFrame:
    return labels.select("id", "class_id").join(spies, ["id", "class_id"], "left_anti")


def _below_threshold(
    margins: DataFrame, labels: DataFrame, ids: DataFrame, spies: DataFrame, noise: float, q: int
) -> DataFrame:
    """Non-positives strictly below the spy threshold of their class.

    Only scores of spies become rows; the thresholds, one for each class, are literals, and
    margins are compared inside their arrays.
    """
    spy_scores = margins.join(spies.select("id", "class_id"), "id").select(
        "id", "class_id", F.get("m", F.col("class_id")).alias("m")
    )
    found = order_statistic(spy_scores, "class_id", "m", noise).collect()
    limits = {r["class_id"]: r["threshold"] for r in found}
    bars = F.array(*[F.lit(limits.get(k)).cast("double") for k in range(q)])
    scored = margins.join(to_matrix(labels, q, ids), "id").withColumn(
        "_v", F.arrays_zip(F.col("m"), F.col("y"), bars.alias("bar"))
    )
    flags = F.transform("_v", lambda v: ((v["m"] < v["bar"]) & (v["y"] == 0)).cast("tinyint"))
    return to_positives(scored.select("id", flags.alias("y")))


def spy_negatives(
    counts: DataFrame, labels: DataFrame, ids: DataFrame, q: int, alpha: float = 1.0,
    share: float = 0.15, noise: float = 0.2, seed: int = 7,
) -> DataFrame:
    """Reliable negatives: rows scoring below hidden positives ("spies").

    A class too small to give a spy has no reliable negatives.
    """
    spies = stage(sample_spies(labels, share, seed), "spies")
    y = to_matrix(_without_spies(labels, spies), q, ids)
    margins = stage(nb_margins(counts, stage(y, "targets"), ids, q, alpha), "margins")
    return _below_threshold(margins, labels, ids, spies, noise, q)


def iterate_bayes(
    counts: DataFrame, labels: DataFrame, ids: DataFrame, q: int, alpha: float = 1.0,
    eps: float = 0.1, max_iter: int = 50, first: DataFrame | None = None,
) -> tuple[DataFrame, list[int]]:
    """Refit naive Bayes on its own predictions until probabilities settle.

    Every class stops by itself once no probability moves by more than ``eps``; its margins
    are then kept. A class whose predictions become all equal cannot be refitted and keeps
    the last margins too. Classes that have stopped take no part in later passes. ``first`` are the
    staged margins of the first fit, if the caller has them. Returns margins and the number of
    refits per class.
    """
    if first is None:
        y = stage(to_matrix(labels, q, ids), "targets")
        first = stage(nb_margins(counts, y, ids, q, alpha), "margins")
    state = first
    still = F.array_repeat(F.lit(0.0), q)
    n, ones, _ = _progress(state.withColumn("delta", still), q)
    refits, active = [0] * q, [True] * q
    tiles, used_up = None, []
    for _ in range(max_iter):
        active = [a and 0 < c < n for a, c in zip(active, ones)]
        if not any(active):
            break
        # A class's margins depend on no other class, so only those that still move are refitted.
        live = [k for k, a in enumerate(active) if a]
        if tiles is None:
            with staging() as used_up:
                tiles = bayes.CountTiles(counts, ids, q, alpha)
        own = F.array(*[F.get("m", F.lit(k)) for k in live])
        y = state.select("id", F.transform(own, lambda m: (m > 0).cast("tinyint")).alias("y"))
        fresh = nb_margins(counts, y, ids, len(live), alpha, (n, [ones[k] for k in live]), tiles)
        step = fresh.withColumnRenamed("m", "m1").join(state.select("id", "m"), "id")
        at = {k: i for i, k in enumerate(live)}
        new = [F.get("m1", F.lit(at[k])) if k in at else F.get("m", F.lit(k)) for k in range(q)]
        step = step.withColumn("_m", F.arrays_zip(F.array(*new).alias("m1"), F.col("m")))
        merged = F.transform("_m", lambda v: v["m1"])
        moved = F.transform("_m", lambda v: F.abs(proba(v["m1"]) - proba(v["m"])))
        state = stage(step.select("id", merged.alias("m"), moved.alias("delta")), "margins")
        n, ones, deltas = _progress(state, q)
        refits = [r + 1 if a else r for r, a in zip(refits, active)]
        active = [a and d > eps for a, d in zip(active, deltas)]
    else:
        if any(active):
            raise RuntimeError(f"classes not settled after {max_iter} refits: "
                               f"{[k for k, a in enumerate(active) if a]}")
    drop_staged(counts.sparkSession, used_up)
    return state.select("id", "m"), refits


def _progress(state: DataFrame, q: int) -> tuple[int, list[float], list[float]]:
    """Rows, positive margins per class and largest change per class, from one pass."""
    row = state.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"count_if(get(m, {k}) > 0) AS p{k}") for k in range(q)],
        *[F.expr(f"max(get(delta, {k})) AS d{k}") for k in range(q)],
    ).first()
    ones = [float(row[f"p{k}"]) for k in range(q)]
    return row["n"], ones, [row[f"d{k}"] or 0.0 for k in range(q)]


def margin_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(class_id, delta)``: largest change of any margin of a class."""
    moved = before.select("id", F.col("m").alias("a")).join(
        after.select("id", F.col("m").alias("b")), "id"
    )
    change = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    return moved.select(F.posexplode(change).alias("class_id", "d")).groupBy("class_id").agg(
        F.max("d").alias("delta")
    )


def iter_spy_negatives(
    counts: DataFrame, labels: DataFrame, ids: DataFrame, q: int, alpha: float = 1.0,
    share: float = 0.15, noise: float = 0.5, eps: float = 0.1, max_iter: int = 50,
    seed: int = 7,
) -> DataFrame:
    """Spy negatives after iterating naive Bayes to a stable labelling."""
    spies = stage(sample_spies(labels, share, seed), "spies")
    margins, _ = iterate_bayes(
        counts, _without_spies(labels, spies), ids, q, alpha, eps, max_iter
    )
    return _below_threshold(margins, labels, ids, spies, noise, q)


def pu_diagnostics(labels: DataFrame, negatives: DataFrame) -> DataFrame:
    """Per class: sizes of P and RN, their sum and overlap."""
    both = labels.select("id", "class_id", F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(
        negatives.select("id", "class_id", F.lit(0).alias("p"), F.lit(1).alias("r"))
    )
    merged = both.groupBy("id", "class_id").agg(F.max("p").alias("p"), F.max("r").alias("r"))
    return merged.groupBy("class_id").agg(
        F.sum("p").alias("positives"),
        F.sum("r").alias("negatives"),
        F.sum(F.col("p") + F.col("r")).alias("total"),
        F.sum(F.col("p") * F.col("r")).alias("overlap"),
    )


def pu_training_set(labels: DataFrame, negatives: DataFrame) -> DataFrame:
    """``(id, class_id, target)``: positives with 1, reliable negatives with 0."""
    return labels.select("id", "class_id", F.lit(1).alias("target")).unionByName(
        negatives.select("id", "class_id", F.lit(0).alias("target"))
    )


# --- supervised one-vs-rest report -------------------------------------------


def binary_report(
    counts: DataFrame, parts: DataFrame, q: int, alpha: float = 1.0
) -> DataFrame:
    """``(class_id, y, pred, n, accuracy)`` of one-vs-rest naive Bayes on a hold-out.

    ``parts`` is ``(id, class_id, split)``. The vocabulary comes from the training rows;
    unknown terms of test rows carry no weight.
    """
    train = parts.filter(F.col("split") == "train")
    test = parts.filter(F.col("split") == "test")
    y = stage(to_matrix(train, q), "targets")
    model = bayes.fit_binary(counts, y, q, alpha)
    tested = counts.join(*at_ids(counts, test.select("id")), "left_semi")
    margins = bayes.score(model, tested, test)
    long = margins.select("id", F.posexplode("m").alias("k", "m")).join(
        test.select("id", F.col("class_id").alias("truth")), "id"
    )
    cells = long.groupBy("k").agg(*[
        F.count_if(
            ((F.col("truth") == F.col("k")) == F.lit(bool(t)))
            & ((F.col("m") > 0) == F.lit(bool(p)))
        ).alias(f"n{t}{p}")
        for t in (0, 1) for p in (0, 1)
    ])
    total = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    entries = F.array(*[
        F.struct(F.lit(t).alias("y"), F.lit(p).alias("pred"), F.col(f"n{t}{p}").alias("n"))
        for t in (0, 1) for p in (0, 1)
    ])
    return cells.select(
        F.col("k").alias("class_id"),
        F.round((F.col("n00") + F.col("n11")) / total, DIGITS).alias("accuracy"),
        F.inline(entries),
    )


# --- naive and k-fold enrichment with naive Bayes ---------------------------


def naive_well_nb(
    counts: DataFrame, labels: DataFrame, ids: DataFrame, q: int, alpha: float = 1.0
) -> DataFrame:
    """Fit and predict on the same rows; predictions are added to the labels."""
    y = stage(to_matrix(labels, q, ids), "targets")
    margins = nb_margins(counts, y, ids, q, alpha)
    predicted = to_positives(margins.select("id", bayes.positive("m").alias("y")))
    return labels_or(labels, predicted)


def assign_folds(ids: DataFrame, k: int, mode: str = "exact", seed: int = 7) -> DataFrame:
    """``(id, fold)``: equal contiguous folds of a seeded shuffle, or folds by hash."""
    rows = ids.select("id")
    return folds(rows, k, seed=seed) if mode == "exact" else hash_folds(rows, k, seed=seed)


def fold_margins_nb(
    counts: DataFrame, y: DataFrame, q: int, k: int, alpha: float = 1.0
) -> DataFrame:
    """``(id, m)``: every document scored by a fit on the other folds.

    ``y`` is ``(id, y, fold)``. One aggregate by term holds the counts of all folds side by
    side; training counts of a fold are the totals minus its own.
    """
    width = q + 1  # occurrences overall, then per class
    own = F.concat(F.array(F.lit(1).cast("tinyint")), F.col("y"))
    none = F.array_repeat(F.lit(0).cast("tinyint"), width)
    spread = F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda f: F.when(f == F.col("fold"), own).otherwise(none),
    ))
    docs = stage(y.select("id", "y", "fold", spread.alias("a")), "foldtargets")
    with placed_by_block(counts.sparkSession):
        stats = stage(term_sums(counts, docs.select("id", "a"), k * width, "tf"), "foldstats")
    cells = range(k * width)
    row = stats.agg(
        *map(F.expr, SIZE_COLUMNS), *array_sums("1.0D", "s", k * width),
    ).first()
    sizes = docs.agg(*array_sums("1.0D", "a", k * width)).first()

    def outside(values) -> list[list[float]]:
        """Sums over all folds but one, for each fold."""
        parts = [values[f"_s{c}"] or 0.0 for c in cells]
        every = [sum(parts[f * width + j] for f in range(k)) for j in range(width)]
        return [[every[j] - parts[f * width + j] for j in range(width)] for f in range(k)]

    v = row["v"]
    priors, shifts = [], []
    for (n, *ones), (tokens, *per_class) in zip(outside(sizes), outside(row)):
        priors.append([
            bayes._log(p) - bayes._log(n - p) if 0 < p < n
            else float("inf") if p else float("-inf")
            for p in ones
        ])
        shifts.append([
            bayes._log(c + alpha * v) - bayes._log(tokens - c + alpha * v) for c in per_class
        ])

    def table(rows: list[list[float]]) -> Column:
        return F.array(*[literal_array(r) for r in rows])

    every = F.transform(
        F.sequence(F.lit(0), F.lit(q)),
        lambda j: F.aggregate(
            F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0),
            lambda acc, f: acc + F.get("s", f * width + j),
        ),
    )
    sums = stats.select("term", "df", "s", F.explode(F.array(every)).alias("t"))

    def weights_of(f: Column, shift: Column) -> Column:
        tokens = F.get("t", F.lit(0)) - F.get("s", f * width)
        return F.transform(shift, lambda c, j: (
            F.log(F.get("t", j + 1) - F.get("s", f * width + j + 1) + alpha)
            - F.log(
                tokens - F.get("t", j + 1) + F.get("s", f * width + j + 1) + alpha
            ) - c
        ))

    weights = sums.select(
        "term", "df", F.transform(table(shifts), lambda c, f: weights_of(f, c)).alias("w")
    )
    block = block_of(counts.columns)
    joined = join_terms(
        counts.join(*at_ids(counts, docs.select("id", "fold"))), weights, tasks=k * q,
        size=TermSize(v, row["pairs"], row["key_bytes"]),
    ).withColumn("w", F.get("w", F.col("fold")))
    scores = joined.groupBy(*([block] if block else []), "id").agg(*array_sums("CAST(tf AS DOUBLE)", "w", q))
    with placed_by_block(counts.sparkSession):
        scores = stage(scores, "scores")
    prior = F.get(table(priors), F.col("fold"))
    zeros = F.array_repeat(F.lit(0.0), q)
    return docs.select("id", "fold").join(scores.select("id", pack(q, "s")), "id", "left").select(
        "id",
        F.zip_with(
            F.coalesce("s", zeros), prior, lambda s, p: F.round(s + p, DIGITS)
        ).alias("m"),
    )


def kfold_well_nb(
    counts: DataFrame, labels: DataFrame, ids: DataFrame, q: int, k: int = 3,
    max_iters: int = 20, alpha: float = 1.0, fold_mode: str = "exact", seed: int = 7,
) -> DataFrame:
    """Out-of-fold predictions are added to the labels, repeatedly; labels only grow.

    Stops early at the fixpoint. Folds are drawn once, before the loop.
    """
    fold_of = stage(assign_folds(ids, k, fold_mode, seed), "folds")
    y = stage(to_matrix(labels, q, ids).join(fold_of, "id"), "targets")
    ones = sum(bayes.class_totals(y, q)[1])
    for _ in range(max_iters):
        margins = fold_margins_nb(counts, y, q, k, alpha)
        grown = F.zip_with("y", "m", lambda t, m: F.greatest(t, (m > 0).cast("tinyint")))
        y = stage(y.join(margins, "id").select("id", grown.alias("y"), "fold"), "targets")
        now = sum(bayes.class_totals(y, q)[1])
        if now == ones:
            break
        ones = now
    return to_positives(y)
