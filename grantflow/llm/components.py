"""Connected components of a link table by hooking and pointer jumping.

Every node starts as its own parent.  A round lets each link offer the
grandparent of one end to the other end and to that end's parent, and every
node moves to its grandparent; a node takes the smallest offer.  The number
of rounds grows with the logarithm of the longest chain.  Offers are combined
by partial aggregates and a popular parent only occurs on the large side of a
join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from grantflow.llm.store import staged


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): the smallest node each node reaches.

    Nodes without a link have no row; null ends are ignored.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .distinct(), "cc-links")
    parents = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("p")),
                     "cc-parents")
    while True:
        up = parents.select(F.col("node").alias("p"), F.col("p").alias("gp"))
        known = staged(parents.join(up, "p").select("node", "p", "gp"), "cc-known")
        offers = (both.alias("l").join(known.alias("x"), F.col("l.a") == F.col("x.node"))
                  .select("l.b", "x.gp").alias("o")
                  .join(known.alias("y"), F.col("o.b") == F.col("y.node"))
                  .select(F.explode(F.array(F.struct(F.col("y.node").alias("node"), F.col("o.gp").alias("p")),
                                            F.struct(F.col("y.p").alias("node"), F.col("o.gp").alias("p")))).alias("m"))
                  .select("m.node", "m.p", F.lit(None).cast("long").alias("was")))
        own = known.select("node", F.col("gp").alias("p"), F.col("p").alias("was"))
        new = staged(offers.union(own).groupBy("node").agg(F.min("p").alias("p"), F.max("was").alias("was")),
                     "cc-round")
        parents = new.select("node", "p")
        if new.where("p <> was").isEmpty():
            return parents.select("node", F.col("p").alias("root"))
