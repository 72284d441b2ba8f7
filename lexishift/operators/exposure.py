"""Objects of many databases' catalogs whose stored state rests on the library's text rules.

Catalog snapshots are tables with a ``db`` column, so one job answers for all databases:

* ``databases`` (db, provider, datcollate, datctype) and ``collations`` (db, oid, label, provider, collcollate, collctype);
* ``keys`` (db, obj, colloid, ...): the key columns of an object; a ``colloid`` of 0 is no collation;
* ``reads`` (db, obj, colloid): the collations of columns that an object's expression reads, and those it names.

Every answer is (db, obj, rank, labels): found through a collation (rank 1), or only through the database's LC_CTYPE (rank 2).
Rows meet by (db, oid) or by db; databases and collations are few against objects, and Spark broadcasts them by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN = ("C", "POSIX")


def library_collations(collations: DataFrame, databases: DataFrame) -> DataFrame:
    """(db, oid, label, is_default, sorts, chars) of the collations that take rules from the library: whether their order does, and whether
    their characters do. The default is the library's only where its database is, and has its database's halves."""
    own = databases.select("db", F.col("provider").alias("_p"), F.col("datcollate").alias("_s"), F.col("datctype").alias("_c"))
    default = F.col("provider") == "d"
    half = lambda base, mine: ~F.coalesce(F.when(default, F.col(base)).otherwise(F.col(mine)), F.lit("")).isin(*PLAIN)
    met = collations.join(own, "db").filter((F.col("provider") == "c") | (default & (F.col("_p") == "c")))
    return met.select("db", "oid", "label", default.alias("is_default"), half("_s", "collcollate").alias("sorts"), half("_c", "collctype").alias("chars"))


def _through(rows: DataFrame, library: DataFrame, which: Column) -> DataFrame:
    """Hits of rank 1: ``rows`` (db, obj, colloid, ...) whose collation is the library's, where ``which`` holds."""
    return rows.join(library.withColumnRenamed("oid", "colloid"), ["db", "colloid"]).filter(which).select("db", "obj", F.lit(1).alias("rank"), "label")


def _by_default(rows: DataFrame, library: DataFrame) -> DataFrame:
    """Hits of rank 1: ``rows`` (db, obj) that are ordered by their database's default collation."""
    return rows.join(library.filter("is_default and sorts").select("db", "label"), "db").select("db", "obj", F.lit(1).alias("rank"), "label")


def _by_ctype(rows: DataFrame, databases: DataFrame) -> DataFrame:
    """Hits of rank 2: ``rows`` (db, obj) in databases whose LC_CTYPE is the library's."""
    own = databases.filter(~F.col("datctype").isin(*PLAIN)).select("db", F.concat(F.lit("database LC_CTYPE "), "datctype").alias("label"))
    return rows.select("db", "obj").join(own, "db").select("db", "obj", F.lit(2).alias("rank"), "label")


def best(*hits: DataFrame) -> DataFrame:
    """Of each object the hits of its best rank, their labels joined. Labels combine before the shuffle; few are left an object."""
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    per = every.groupBy("db", "obj", "rank").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
    return per.groupBy("db", "obj").agg(F.min(F.struct("rank", "labels")).alias("_b")).select("db", "obj", "_b.rank", "_b.labels")


def exposed_indexes(indexes: DataFrame, keys: DataFrame, reads: DataFrame, library: DataFrame, databases: DataFrame) -> DataFrame:
    """Indexes by order, by characters, by jsonb keys in a btree, or by the database's LC_CTYPE.

    ``indexes``: (db, obj, method, computes), computes where it has a predicate or an expression. ``keys``: (db, obj, colloid, extension,
    json, tsvector) with extension for an operator class that came with an extension and tsvector for a computed search key.
    A hash index over plain keys hashes bytes, so the order leaves it alone.
    """
    told = keys.groupBy("db", "obj").agg(F.bool_or(F.col("extension") & (F.col("colloid") != 0)).alias("extension"), F.bool_or("json").alias("json"), F.bool_or("tsvector").alias("tsvector"))
    idx = indexes.join(told, ["db", "obj"], "left").select("db", "obj", "method", "computes", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("extension", "json", "tsvector")])
    refs = keys.filter("colloid <> 0").select("db", "obj", "colloid").unionByName(reads.filter("colloid <> 0").select("db", "obj", "colloid").join(indexes.filter("computes").select("db", "obj").distinct(), ["db", "obj"], "left_semi")).distinct()
    met = refs.join(idx, ["db", "obj"])
    order = _through(met, library, F.expr("sorts and (method <> 'hash' or computes)"))
    characters = _through(met, library, F.expr("chars and (computes or extension)"))
    text = idx.join(refs.select("db", "obj").distinct().withColumn("_text", F.lit(True)), ["db", "obj"], "left").filter(F.expr("extension or tsvector or (computes and _text)"))
    return best(order, characters, _by_ctype(text, databases), _by_default(idx.filter("method = 'btree' and json"), library))


def exposed_checks(reads: DataFrame, library: DataFrame, databases: DataFrame) -> DataFrame:
    """CHECKs whose expression consults a collation: ``reads`` has only those. An expression computes, so both halves count."""
    text = reads.filter("colloid <> 0")
    return best(_through(text, library, F.expr("sorts or chars")), _by_ctype(text.select("db", "obj").distinct(), databases))


def exposed_partitions(keys: DataFrame, reads: DataFrame, children: DataFrame, library: DataFrame, databases: DataFrame) -> DataFrame:
    """Partitioned tables by their keys, with how many partitions they have.

    ``keys``: (db, obj, strategy, expression, colloid, extension, json), strategy r, l or h. ``reads``: collations that expressions in
    a key are computed with. ``children``: (db, obj), a row a partition.
    """
    plain = _through(keys, library, F.expr("strategy = 'r' and not expression and sorts"))
    extension = _through(keys, library, F.expr("extension and chars"))
    json = _by_default(keys.filter("strategy = 'r' and json").select("db", "obj").distinct(), library)
    computed = reads.filter("colloid <> 0").select("db", "obj", "colloid").unionByName(keys.filter("expression and colloid <> 0").select("db", "obj", "colloid")).distinct()
    expressions = _through(computed, library, F.expr("sorts or chars"))
    ctype = computed.select("db", "obj").unionByName(keys.filter("extension and colloid <> 0").select("db", "obj")).distinct()
    found = best(plain, extension, json, expressions, _by_ctype(ctype, databases))
    return found.join(children.groupBy("db", "obj").agg(F.count("*").alias("partitions")), ["db", "obj"], "left").withColumn("partitions", F.coalesce("partitions", F.lit(0)))


def exposed_generated(reads: DataFrame, search: DataFrame, library: DataFrame, databases: DataFrame) -> DataFrame:
    """Stored generated columns that read text, and those that are search vectors (``search``: db, obj), whatever they read.

    ``reads`` holds both shapes in which a server records what a column is computed from.
    """
    text = reads.filter("colloid <> 0")
    every = text.select("db", "obj").unionByName(search.select("db", "obj")).distinct()
    return best(_through(text, library, F.expr("sorts or chars")), _by_ctype(every, databases))


def exposed_matviews(reads: DataFrame, search: DataFrame, library: DataFrame, databases: DataFrame) -> DataFrame:
    """Materialized views with what they read. ``reads`` and ``search`` name the relation a view reads in ``source``; a view
    listed through a collation tells the sources of those collations only."""
    text = reads.filter("colloid <> 0")
    found = exposed_generated(text.select("db", "obj", "colloid"), search, library, databases)
    used = text.join(library.filter("sorts or chars").select("db", F.col("oid").alias("colloid")), ["db", "colloid"]).select("db", "obj", F.lit(1).alias("rank"), "source")
    used = used.unionByName(text.select("db", "obj", F.lit(2).alias("rank"), "source")).unionByName(search.select("db", "obj", F.lit(2).alias("rank"), "source"))
    sources = used.filter("source is not null").groupBy("db", "obj", "rank").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("reads_from"))
    return found.join(sources, ["db", "obj", "rank"], "left").select("db", "obj", "rank", "labels", F.coalesce("reads_from", F.lit("")).alias("reads_from"))
