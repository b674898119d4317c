"""Linking the members of buckets without writing all pairs of a bucket.

Buckets come from a filter that never separates two members that link. First every
member is compared with one hub of its bucket, which costs one pair per member.
Most groups of copies are then one component. What is left are the strays of a bucket, members
outside the component of its hub: only those are compared with what is in other components, so no link that
could join two components is lost, and pairs inside a component are not made at all.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.components import connected_components
from tablescope.llm.storage import dropped, written


def repeated(postings: DataFrame) -> DataFrame:
    """The postings of buckets that hold more than one. They are read and shuffled once."""
    times = F.count(F.lit(1)).over(Window.partitionBy("bucket"))
    return postings.withColumn("times", times).where("times > 1").drop("times")


def link_buckets(postings: DataFrame, verify: Callable[[DataFrame], DataFrame], possible: str, name: str,
                 first: str = "node", details: DataFrame | None = None, likely: str = "true") -> DataFrame:
    """(node, component) of all nodes that have a link.

    `postings`: bucket, node (both long, no pair twice) and columns that `possible` uses: SQL on two
    postings `a` and `b` of a bucket that holds at least once for each pair that links.
    `verify`: takes pairs (src, dst), returns a written table of those that link. `first`: numeric expression, least in the hub.
    `likely`: SQL on two postings, with the columns that `details` has of their nodes, that holds for the pairs that
    `verify` would not drop by these columns. Where a bucket is compared member by member, no other pair is made.
    """
    other = [c for c in postings.columns if c not in ("bucket", "node")]
    hub = F.min(F.struct(F.expr(first).alias("first"), "node", *other)).over(Window.partitionBy("bucket"))
    shared = written(repeated(postings).withColumn("hub", hub), f"{name}-shared")
    met = shared.select(F.col("hub").alias("a"), F.struct("node", *other).alias("b")).where("a.node <> b.node").where(possible)
    star = written(_ends(met).distinct(), f"{name}-star")
    links = verify(star)
    parts = connected_components(links, name)

    own, of_hub = parts.toDF("node", "own"), parts.toDF("hub_node", "of_hub")
    known = shared.withColumn("hub_node", F.col("hub.node")).drop("hub").join(own, "node", "left").join(of_hub, "hub_node", "left") \
        .withColumn("part", F.coalesce("own", "node")).withColumn("stray", F.col("part") != F.coalesce("of_hub", "hub_node"))
    mixed = known.select("bucket", "node", *other, "part", "stray", F.max("stray").over(Window.partitionBy("bucket")).alias("mixed"))
    rest = written(mixed.where("mixed").drop("mixed"), f"{name}-rest")
    dropped(shared)
    told = rest if details is None else rest.join(details, "node")
    a, b = told.where("stray").alias("a"), told.alias("b")
    met = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.part") != F.col("b.part"))
                 & (~F.col("b.stray") | (F.col("a.node") < F.col("b.node"))) & F.expr(possible) & F.expr(likely))
    more = written(_ends(met).distinct().join(star, ["src", "dst"], "left_anti"), f"{name}-more")
    dropped(rest)
    late = verify(more)
    if late.take(1):
        known, parts = parts, connected_components(links.union(late), name)
        dropped(known)
    dropped(star, links, more, late)
    return parts


def _ends(met: DataFrame) -> DataFrame:
    """(src, dst) of pairs of postings `a` and `b`, src < dst."""
    return met.select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst"))
