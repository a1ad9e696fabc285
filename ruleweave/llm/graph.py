"""Connected components of an undirected graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ruleweave.llm.common import cut


#: A key with more than one of so many rows is dealt out in so many parts.
SHARE, PARTS = 500, 64


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row for each ``key``), keys with very many rows dealt out.

    Those that hold more than one of ``SHARE`` rows are fewer than ``SHARE`` keys, whatever the data; they
    are counted and broadcast, their rows dealt at random and their one row of ``table`` repeated.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    hot = cut(counts.filter(F.col("n_rows") * SHARE > rows.count()).select(key, F.lit(True).alias("is_hot")))
    if hot.isEmpty():
        return rows.join(table, key, "left")
    hot = F.broadcast(hot)
    dealt = rows.join(hot, key, "left").withColumn("part", F.when(F.col("is_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS))).otherwise(0).cast("int"))
    every = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    copies = table.join(hot, key, "left").withColumn("part", F.explode(every)).drop("is_hot")
    return dealt.drop("is_hot").join(copies, [key, "part"], "left").drop("part")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst long); component is its smallest node.

    Each round hangs a node below its smallest neighbour, doubles the paths to the roots until none
    moves, and renames the ends of the remaining edges by their roots. A node that is smaller than
    its neighbours but drew none of them joins in the next round, so two rounds at least halve every
    component; rounds and doublings grow with the logarithm of its size, long chains included. Minima are
    partial aggregates, the joins are equi-joins that AQE can split, and the names of a component that
    holds a large part of all nodes are dealt out, so a hub costs no more than its edges. Rounds end in a reliable checkpoint;
    only their emptiness is looked at by the driver. Edges with a null end, repeated edges and loops
    do no harm; an empty table gives an empty table.
    """
    links = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst").distinct()
    links = cut(links)
    names = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    names = names.withColumn("component", F.col("node"))
    while not links.isEmpty():
        both = links.union(links.select("dst", "src"))
        parent = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("up"))
        parent = parent.select("node", F.least("node", "up").alias("up"))
        moving = True
        while moving:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = cut(parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            moving = not jumped.filter("moved").isEmpty()
            parent = jumped.select("node", "up")
        source, target = parent.toDF("src", "s"), parent.toDF("dst", "d")
        links = cut(links.join(source, "src").join(target, "dst").filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct())
        names = looked_up(names, parent.toDF("component", "up"), "component")
        names = cut(names.select("node", F.coalesce("up", "component").alias("component")))
    return names
