"""Connected components of a table of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): the smallest node that is
    reachable. Each turn, every component takes the smallest neighbouring
    component as its parent and parents are followed three times, so a turn
    shortens chains eightfold; turns end when no link joins two components.
    Tables are written between turns; none is collected."""
    spark = links.sparkSession
    both = written(spark, links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    comp = written(spark, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"), "components")
    while True:
        cross = (both.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
                 .join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb"))
        parents = written(spark, cross.groupBy("ca").agg(F.min("cb").alias("p")).where("p < ca").withColumnRenamed("ca", "c"), "parents")
        if parents.isEmpty():
            return comp
        for _ in range(3):
            up = parents.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            parents = parents.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("p"))
        comp = written(spark, comp.join(parents.withColumnRenamed("c", "comp"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "components")
