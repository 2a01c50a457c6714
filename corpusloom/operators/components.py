"""Connected components by iterative minimum-label propagation (CL1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize, release


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node reachable from node. Nodes without edges do not occur.

    Each round every node takes the smallest label among its neighbours, labels of labels are followed (pointer jumping),
    and edges are contracted to labels, with edges inside a component dropped. A round at least halves the number of
    components that still have edges, so rounds grow with the logarithm of the nodes, chains included: 60 rounds are enough for
    2^60 nodes, and edges left after ``max_rounds`` are an error. Each round is a written table, so a lost executor costs no
    earlier round. Nulls, self-loops and repeated edges are ignored."""
    e = edges.toDF("a", "b").where("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = None
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        for _ in range(6):
            up = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            new = materialize(to.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")))
            moved = not new.where("moved").isEmpty()
            release(to)
            to = new
            if not moved:
                break
        to_ = to.select("node", "root")
        a, b = to_.toDF("a", "ra"), to_.toDF("b", "rb")
        smaller = e.join(a, "a").join(b, "b").where("ra <> rb")
        smaller = materialize(smaller.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if known is None:
            got = materialize(to_)
        else:
            moved_on = to_.toDF("root", "next")
            got = materialize(known.join(moved_on, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            release(known)
        release(e)
        release(to)
        known, e = got, smaller
    else:
        if not e.isEmpty():
            raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    if known is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    # roots are minima of their own component already, as labels only ever fall to smaller nodes of it
    return known
