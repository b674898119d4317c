"""Connected components of a graph that stays distributed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.storage import dropped, written


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every end of `edges` (src, dst, both long); a component is named by one of its nodes.

    Distributed union-find by contraction: in each round every root hooks onto the
    neighbour of least random priority, edges are redrawn between the new roots, and
    loops fall away. Fresh priorities halve the roots about each round whatever the
    shape of the graph, so the number of rounds follows the logarithm of the nodes.
    Nothing but one flag per round reaches the driver. Null ends are ignored. The tables of a round go with it.
    """
    live = edges.select("src", "dst").where("src <> dst").distinct()
    live = written(live, f"{name}-edges")
    labels = written(live.selectExpr("src as node").union(live.selectExpr("dst")).distinct()
                     .withColumn("component", F.col("node")), f"{name}-labels")
    turn = 0
    while live.take(1):
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("priority"), F.col(c).alias("id"))
        both = live.union(live.select("dst", "src"))
        parent = (both.groupBy("src").agg(F.min(order("dst")).alias("best"))
                  .select(F.col("src").alias("child"), F.least(F.col("best"), order("src")).getField("id").alias("root")))
        parent = written(parent, f"{name}-roots")
        old = labels, live
        labels = written(labels.join(parent, labels.component == parent.child, "left")
                         .select("node", F.coalesce("root", "component").alias("component")), f"{name}-labels")
        a, b = parent.toDF("src", "a"), parent.toDF("dst", "b")
        live = written(live.join(a, "src").join(b, "dst").where("a <> b")
                       .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(),
                       f"{name}-edges")
        dropped(parent, *old)
    dropped(live)
    return labels
