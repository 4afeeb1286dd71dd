"""Breadth-first expansion over a graph of similar items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manylabel.operators.ranks import with_rank
from manylabel.session import stage, stage_by_key


# Levels after which the visited set is rewritten as one table.
COMPACT_EVERY = 16


def new_only(candidates: DataFrame, visited: DataFrame, key: str = "id") -> DataFrame:
    return candidates.join(visited.select(key), key, "left_anti")


def cap(frontier: DataFrame, n: int, key: str = "id") -> DataFrame:
    """At most ``n`` waiting items, lowest ids first. Counting decides if any work is due."""
    if frontier.count() <= n:
        return frontier
    return with_rank(frontier, [], [F.col(key)], "_rn").filter(F.col("_rn") <= n).drop("_rn")


def visit(visited: DataFrame, frontier: DataFrame) -> DataFrame:
    """Visited items are disjoint from a frontier by construction, so no distinct is needed."""
    return visited.unionByName(frontier)


def bfs(
    edges: DataFrame, seeds: DataFrame, accept: DataFrame | None = None,
    frontier_cap: int | None = None, max_depth: int | None = None,
    resume: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """``(id, depth)`` of everything reached from ``seeds`` over ``edges(src, dst)``.

    Nothing is visited twice; only ids in ``accept`` (if given) are expanded; the loop ends
    when a level brings nothing new. Every level is written before the next one starts, so
    plans stay short and a run can go on from ``resume = (visited, last_depth)``. Edges and
    accepted ids are placed by id once; only levels move. With ``frontier_cap`` a level takes
    the lowest ids and the rest waits for the next one, so the result is complete either way.
    """
    edges = stage_by_key(edges.select("src", "dst"), "src", "edges")
    if accept is not None:
        accept = stage_by_key(accept.select("id").distinct(), "id", "accept")
    if resume is None:
        depth = 0
        level = stage(
            seeds.select("id").distinct().select("id", F.lit(0).alias("depth")), "level"
        )
        visited = level
    else:
        visited, depth = resume
        level = visited.filter(F.col("depth") == depth)
    waiting = None
    while max_depth is None or depth < max_depth:
        source = level if accept is None else level.join(accept, "id", "left_semi")
        reached = edges.join(source.select(F.col("id").alias("src")), "src", "left_semi")
        fresh = reached.select(F.col("dst").alias("id"))
        if waiting is not None:
            fresh = fresh.unionByName(waiting.select("id"))
        fresh = stage(new_only(fresh.distinct(), visited), "fresh")
        depth += 1
        level = fresh if frontier_cap is None else cap(fresh, frontier_cap)
        level = stage(level.withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        if frontier_cap is not None:
            waiting = new_only(fresh, level)
        visited = visit(visited, level)
        if depth % COMPACT_EVERY == 0:
            visited = stage(visited, "visited")
    return visited
