"""Balanced sampling, hold-out split, folds and spies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manylabel.functions.fixed import HOLD_OUT, IMPORTANT_IDS
from manylabel.operators.clean import class_sizes
from manylabel.operators.ranks import GROUP_LIMIT, hash_order, head_per_group, with_rank


def balanced_size(df: DataFrame, by: str = "class_id", step: int = 10) -> DataFrame:
    """Size of the smallest class rounded down to a multiple of ``step``."""
    smallest = F.min("n")
    return class_sizes(df, by).agg((F.floor(smallest / step) * step).alias("n_each_class"))


def top_per_class(
    df: DataFrame, n: int, order: Sequence[Column], by: str = "class_id"
) -> DataFrame:
    return head_per_group(df, n, [by], order, "_rn").drop("_rn")


def balanced_sample(
    df: DataFrame, rank_by: str, n: int = 0, by: str = "class_id", id_col: str = "id",
    important: Sequence[str] = IMPORTANT_IDS, step: int = 10,
) -> DataFrame:
    """The ``n`` highest-ranked rows of every class plus every important id.

    ``n=0`` takes the balanced size, one number read back from the class counts. Sample and
    important rows come from one filter, so no union and no second distinct are needed.
    """
    order = [F.col(rank_by).desc(), F.col(id_col)]
    if n == 0:
        n = balanced_size(df, by, step).first()["n_each_class"] or 0
    is_important = (
        F.trim(F.col(id_col).cast("string")).isin(*sorted(set(important)))
        if important else F.lit(False)
    )
    if n > GROUP_LIMIT:
        ranked = with_rank(df, [by], order, "_rn")
        return ranked.filter((F.col("_rn") <= n) | is_important).drop("_rn")
    top = head_per_group(df, n, [by], order, "_rn").drop("_rn") if n else df.filter(F.lit(False))
    if not important:
        return top
    return top.filter(~is_important).unionByName(df.filter(is_important))


def head_split(
    df: DataFrame, order: Sequence[Column], n_test: int = HOLD_OUT, by: str = "class_id",
    id_col: str = "id",
) -> DataFrame:
    """Mark the first ``n_test`` rows of every class ``test`` and the rest ``train``.

    Only the hold-out ids (``n_test`` per class) are ranked; everything else is matched
    against them, so no class is sorted as a whole.
    """
    head = head_per_group(df.select(id_col, by, *_order_columns(df, order, id_col, by)),
                          n_test, [by], order)
    held = head.select(id_col, F.lit("test").alias("split"))
    return df.join(held, id_col, "left").withColumn(
        "split", F.coalesce("split", F.lit("train"))
    )


def _order_columns(df: DataFrame, order: Sequence[Column], *skip: str) -> list[str]:
    """Columns of ``df`` that the sort keys read; unknown keys keep every column."""
    text = " ".join(str(o) for o in order)
    return [c for c in df.columns if c not in skip and c in text]


def folds(
    df: DataFrame, k: int, order: Sequence[Column] | None = None, id_col: str = "id",
    by: str | None = None, seed: int = 7,
) -> DataFrame:
    """``k`` contiguous folds of near-equal size over ``order``; ``by`` stratifies them.

    The first ``n mod k`` folds hold one row more, as ``ntile`` would give, but the rank
    behind it is distributed.
    """
    groups = [by] if by else []
    order = order if order is not None else hash_order(id_col, seed)
    ranked = with_rank(df, groups, order, "_rn", size="_size")
    small = F.floor(F.col("_size") / k)
    extra = F.col("_size") % k
    border = extra * (small + 1)
    row = F.col("_rn") - 1
    fold = F.when(row < border, F.floor(row / (small + 1))).otherwise(
        extra + F.floor((row - border) / F.greatest(small, F.lit(1)))
    )
    return ranked.withColumn("fold", fold.cast("int")).drop("_rn", "_size")


def hash_folds(df: DataFrame, k: int, id_col: str = "id", seed: int = 7) -> DataFrame:
    """Folds by hash: near-equal sizes, no shuffle at all."""
    key = F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))
    return df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(k)).cast("int"))


def sample_spies(
    positives: DataFrame, share: float = 0.15, seed: int = 7, by: str = "class_id"
) -> DataFrame:
    """``int(n * share)`` positives per class, without replacement."""
    ranked = with_rank(positives.select("id", by), [by], hash_order("id", seed), size="_size")
    wanted = F.floor(F.col("_size") * F.lit(float(share)))
    return ranked.filter(F.col("rn") <= wanted).select("id", by)
