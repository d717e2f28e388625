"""Connected components by contraction: no task holds a component, and lineage is cut every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sessions import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, either direction, repeats and loops allowed) to (node, component): the smallest node of
    each component, for every node of an edge that isn't a loop. No edges: no rows. Null ends are left out.

    In each round every node hooks onto the smallest of itself and its neighbours, and the edges are redrawn between
    the nodes hooked onto. Smallest goes by id in even rounds, which folds a star onto its smallest node at once, and
    by a hash in odd ones, which shortens chains however they are numbered. Hooks go through partial sums (min), and
    both sides of each join are tables read anew, so AQE can split a node with very many neighbours.
    """
    spark = edges.sparkSession
    e = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    e, e_path = cut(e.where(F.col("a") < F.col("b")).distinct(), "edges")
    hooks: list[DataFrame] = []
    hook_paths: list[str] = []
    while not e.isEmpty():
        turn = len(hooks)
        rank = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c, t=turn: F.xxhash64(F.lit(t), c))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("id"))
        hook, path = cut(best.select(F.col("a").alias("node"), F.least("m", own)["id"].alias("to")), "hooks")
        hooks.append(hook)
        hook_paths.append(path)
        ha, hb = hook.toDF("a", "ta"), hook.toDF("b", "tb")
        redrawn = e.join(ha, "a").join(hb, "b").where(F.col("ta") != F.col("tb")).select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        following, following_path = cut(redrawn, "edges")
        discard(spark, e_path)
        e, e_path = following, following_path
    if not hooks:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = hooks[-1].toDF("node", "root")
    for hook in reversed(hooks[:-1]):
        higher = roots.toDF("to", "root")
        roots = hook.join(higher, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    roots, _ = cut(roots, "roots")
    for path in [*hook_paths, e_path]:
        discard(spark, path)
    smallest, _ = cut(roots.groupBy("root").agg(F.min("node").alias("component")), "smallest")
    return roots.join(smallest, "root").select("node", "component")
