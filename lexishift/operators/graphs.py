"""Reachability over written tables, and the depth-first order of includes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexishift.sources.shared import settled


def closure(edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """L4: (src, dst) for every node that src reaches. Paths end at the nodes of ``stop`` (dst).

    Only pairs found in the last round take part as first halves, and of them only those exactly half as far apart as the round reaches: every longer pair has
    such a node on its way. So a pair is made about as often as it has middles, however many rounds there are, and the number of rounds is the logarithm of the longest path,
    with or without cycles. Each round is a written table; earlier ones are not written again.
    """
    end = None if stop is None else stop.select("dst").distinct()
    last = settled(edges.select("src", "dst").distinct().withColumn("far", F.lit(1)))
    tables, reach = [last], 1
    while True:
        found = reduce(DataFrame.unionByName, tables)
        half = last.filter(F.col("far") == reach)
        half = half if end is None else half.join(end, "dst", "left_anti")
        on = half.select("src", F.col("dst").alias("_via")).join(found.select(F.col("src").alias("_via"), "dst", "far"), "_via").groupBy("src", "dst").agg((F.min("far") + reach).alias("far"))
        last = settled(on.join(found.select("src", "dst"), ["src", "dst"], "left_anti"))
        if last.isEmpty():
            return found.select("src", "dst")
        tables, reach = [*tables, last], 2 * reach


def include_order(roots: DataFrame, includes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, tbl, path), (source, path)): the tables that a source's search visits, and the places where it comes back to a table it is still in.

    ``roots`` (source, tbl) begins; ``includes`` (tbl, ord, inc) follow a table in the order of ``ord``. Paths (arrays of places) sort as the depth-first search
    goes. A table that the search has been in before, on another way, has no answer left to give and is not entered again.
    """
    step = includes.groupBy("tbl", "ord").agg(F.min("inc").alias("inc"))
    level = settled(roots.groupBy("source", "tbl").agg(F.lit(0)).select("source", "tbl", F.array(F.lit(0)).alias("path"), F.array("tbl").alias("within")))
    visits, loops, first = [level], [], level.groupBy("source", "tbl").agg(F.min("path").alias("best"))
    while True:
        onward = settled(level.join(step, "tbl").select("source", F.col("inc").alias("tbl"), F.concat("path", F.array(F.col("ord").cast("int"))).alias("path"), "within"))
        loops.append(onward.filter(F.array_contains("within", F.col("tbl"))).select("source", "path"))
        fresh = onward.filter(~F.array_contains("within", F.col("tbl"))).groupBy("source", "tbl").agg(F.min_by(F.struct("path", "within"), "path").alias("x")).select("source", "tbl", "x.path", F.concat("x.within", F.array("tbl")).alias("within"))
        level = settled(fresh.join(first, ["source", "tbl"], "left").filter(F.col("best").isNull() | (F.col("path") < F.col("best"))).drop("best"))
        if level.isEmpty():
            every = reduce(DataFrame.unionByName, visits).groupBy("source", "tbl").agg(F.min("path").alias("path"))
            return every, reduce(DataFrame.unionByName, loops)
        visits.append(level)
        first = settled(first.unionByName(level.select("source", "tbl", F.col("path").alias("best"))).groupBy("source", "tbl").agg(F.min("best").alias("best")))
