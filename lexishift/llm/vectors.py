"""Near duplicates among embeddings: all rows are compared, in tiles, by their leading principal components first.

Equal vectors are one class. Classes of one dimension are turned into the principal axes of a bounded sample (any rotation keeps
cosines, so the sample decides about speed alone), laid into the cells of a small tree over the leading axes, and written as
blocks of about ``BLOCK`` vectors, a file each. A block meets every other unless the boxes of the two, on the leading axes,
already lie too far apart. Within a tile the leading axes are multiplied first; what the rest can add is at most the product
of the two suffix norms, which stands as one more column of the same product. Pairs whose bound falls below the
similarity are dropped, the others go on with more axes, and what is left is judged by the cosine in double precision.

A tile returns, of each vector with links, how many there are and the least vector of its component within the tile, never its pairs.
Blocks are read from the shared folder by the tasks that compare them, so no vector is shuffled twice, and a lost task starts again from files.

Defined results: a vector that is null or empty, holds a null or a component that is not finite, or is zero links with nothing (0 links, itself
as component, kept), as do vectors of different dimensions with each other; a row whose ``vec_id`` is null takes no part: no links, a null component, kept; rows that share one ``vec_id``
are vectors of their own that share that id; equal rows link with each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexishift.llm.minhash import components
from lexishift.llm.storage import materialise, task_fs, workspace

SIMILARITY = 0.9
#: Vectors of a block, rows of the sample that axes and cells are fitted on, vectors of it in a cell, leading axes that boxes are kept of, blocks a task's unit of work meets.
BLOCK, SAMPLE, LEAF, BOX, UNIT = 2048, 4096, 128, 8, 16
#: Slack of the bounds, for 32-bit products; pairs within it of the similarity are judged in double precision.
SLACK = 1e-4
DENSE = 1 / 16  # share of a tile's pairs from which the next axes are multiplied for all of it


def usable(v: Column) -> Column:
    """Is there a direction: not null, not empty, all components finite, one of them not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


class Axes:
    """Principal axes of unit vectors and the cells of a tree over them, fitted on a sample; without a sample, the axes as they are."""

    def __init__(self, sample: np.ndarray | None, dim: int):
        self.dim, self.turn, self.cuts = dim, None, []
        if sample is not None and len(sample):
            _, vectors = np.linalg.eigh(sample.T @ sample)
            self.turn = np.ascontiguousarray(vectors[:, ::-1])
            self._split(sample @ self.turn, 1)

    def _split(self, rows: np.ndarray, node: int) -> None:
        if len(rows) < 2 * LEAF or node >= 1 << 40:
            return
        axis = int(rows[:, :BOX].var(0).argmax())
        at = float(np.median(rows[:, axis]))
        low = rows[:, axis] < at
        if low.any() and not low.all():
            self.cuts.append((node, axis, at))
            self._split(rows[low], 2 * node), self._split(rows[~low], 2 * node + 1)

    def turned(self, unit: np.ndarray) -> np.ndarray:
        return unit if self.turn is None else unit @ self.turn

    def cells(self, turned: np.ndarray) -> np.ndarray:
        node = np.ones(len(turned), np.int64)
        for at, axis, value in sorted(self.cuts):  # parents before their children
            here = node == at
            node[here] = 2 * at + (turned[here, axis] >= value)
        return node


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of length one, in double precision, whatever their size."""
    x = flat.reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def steps_of(dim: int) -> list[int]:
    """How many leading axes are multiplied before each bound."""
    return sorted({max(1, dim // 4), max(1, 3 * dim // 8), max(1, dim // 2), max(1, 3 * dim // 4)} - {dim}) if dim > 1 else []


class Block:
    """A block as a tile needs it: unit vectors, the same turned, their suffix norms before each step."""

    def __init__(self, rep: np.ndarray, members: np.ndarray, unit: np.ndarray, axes: Axes):
        self.rep, self.members, self.unit = rep, members, unit
        turned = axes.turned(unit)
        self.turned = turned.astype(np.float32)
        tail = np.sqrt(np.maximum((turned * turned)[:, ::-1].cumsum(1)[:, ::-1], 0))
        self.suffix = {k: tail[:, k].astype(np.float32) for k in steps_of(unit.shape[1])}

    def leading(self, k: int) -> np.ndarray:
        return np.concatenate([self.turned[:, :k], self.suffix[k][:, None]], 1)


def linked(a: Block, b: Block, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` that reach the similarity: leading axes first, and no more of a pair that cannot reach it."""
    least, i, j = np.float32(similarity - SLACK), None, None
    done, sums = 0, None
    dim = a.unit.shape[1]
    for k in steps_of(dim):
        if i is None:  # the tile as a whole
            bound = a.leading(k) @ b.leading(k).T
            flat = np.flatnonzero(bound.ravel() >= least)
            if len(flat) > DENSE * bound.size:
                continue
            i, j = np.divmod(flat, len(b.rep))
            sums = bound[i, j] - a.suffix[k][i] * b.suffix[k][j]
        else:
            sums = sums + np.einsum("ij,ij->i", a.turned[i, done:k], b.turned[j, done:k])
            stay = sums + a.suffix[k][i] * b.suffix[k][j] >= least
            i, j, sums = i[stay], j[stay], sums[stay]
        done = k
        if not len(i):
            return i, j
    if i is None:
        i, j = np.nonzero(a.turned @ b.turned.T >= least)
    good = np.concatenate([np.einsum("ij,ij->i", a.unit[i[s : s + 65536]], b.unit[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)]) >= similarity
    return i[good], j[good]


def least_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1, the least node that links (u, v) lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low), np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


LINKS = "rep long, links long, root long"


def tile(a: Block, b: Block, similarity: float, same: bool) -> pa.RecordBatch:
    """(rep, links, root) of the vectors with links in a tile; ``links`` counts members of the linked classes."""
    i, j = linked(a, b, similarity)
    if same:
        i, j = i[i < j], j[i < j]
    na, nb = (np.bincount(x, weights=w, minlength=n).astype(np.int64) for x, w, n in ((i, b.members[j], len(a.rep)), (j, a.members[i], len(b.rep))))
    rep, links = (a.rep, na + nb) if same else (np.concatenate([a.rep, b.rep]), np.concatenate([na, nb]))
    order = np.argsort(rep, kind="stable")  # so the least node is the least number
    place = np.empty(len(rep), np.int64)
    place[order] = np.arange(len(rep))
    root = rep[order][least_of(len(rep), place[i], place[j if same else j + len(a.rep)])[place]]
    held = links > 0
    return pa.RecordBatch.from_arrays([pa.array(rep[held]), pa.array(links[held]), pa.array(root[held])], names=["rep", "links", "root"])


BLOCKS = "dim int, block string, file string, n long, low array<double>, high array<double>"


def _block_writer(folder: str, axes: Axes):
    """One file a block under a name of its own; the row that names it decides what counts."""

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        dim = table["dim"][0].as_py()
        unit = unit_rows(_flat(table["vector"].combine_chunks()), dim)
        lead = (axes.turned(unit) if dim == axes.dim else unit)[:, :BOX]
        fs, base = task_fs(folder)
        fs.create_dir(base, recursive=True)
        name, out = f"{uuid.uuid4().hex}.npz", io.BytesIO()
        np.savez(out, rep=table["rep"].to_numpy(), members=table["members"].to_numpy(), unit=unit)
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(out.getvalue())
        row = {"dim": dim, "block": table["block"][0].as_py(), "file": name, "n": len(unit), "low": lead.min(0).tolist(), "high": lead.max(0).tolist()}
        kinds = [("dim", pa.int32()), ("block", pa.string()), ("file", pa.string()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]
        return pa.Table.from_pylist([row], schema=pa.schema(kinds))

    return write


def _units(meta: str, similarity: float):
    """For each block the blocks from it on, in the order of their names, that its box lets it meet, ``UNIT`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        fs, base = task_fs(meta)
        every = ds.dataset(base, filesystem=fs, format="parquet").to_table(columns=["dim", "block", "file", "low", "high"]).sort_by([("dim", "ascending"), ("block", "ascending")])
        dims, names, files = every["dim"].to_numpy(), every["block"].to_numpy(zero_copy_only=False), every["file"].to_numpy(zero_copy_only=False)
        far = 2 - 2 * similarity + SLACK  # the squared distance of unit vectors at the similarity
        for batch in batches:
            for row in batch.to_pylist():
                a, b = np.searchsorted(dims, row["dim"]), np.searchsorted(dims, row["dim"], "right")
                later = slice(a, b)
                low, high = (np.stack(every[c].slice(a, b - a).to_numpy(zero_copy_only=False)) for c in ("low", "high"))
                gap = np.maximum(0, np.maximum(low - np.array(row["high"]), np.array(row["low"]) - high))
                met = files[later][(names[later] >= row["block"]) & ((gap * gap).sum(1) <= far)]
                groups = [met[s : s + UNIT].tolist() for s in range(0, len(met), UNIT)]
                yield pa.RecordBatch.from_pydict({"dim": pa.array([row["dim"]] * len(groups), pa.int32()), "file": [row["file"]] * len(groups), "others": pa.array(groups, pa.list_(pa.string()))})

    return run


def _compare(folder: str, axes: Axes, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = task_fs(folder)

        def read(name: str, dim: int) -> Block:
            with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                x = np.load(io.BytesIO(f.read()))
            return Block(x["rep"], x["members"], x["unit"], axes if dim == axes.dim else Axes(None, dim))

        for batch in batches:
            for row in batch.to_pylist():
                a = read(row["file"], row["dim"])
                for other in row["others"]:
                    same = other == row["file"]
                    yield tile(a, a if same else read(other, row["dim"]), similarity, same)

    return run


def near_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table``; links reach the cosine ``similarity``, which is above 0."""
    if not 0 < similarity <= 1:
        raise ValueError(f"a similarity is above 0 and at most 1, not {similarity}")
    spark: SparkSession = table.sparkSession
    root = workspace(spark, "vectors")
    plain = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    plain = plain.withColumn("v", F.when(F.col("vec_id").isNotNull() & usable(F.col("v")), F.transform("v", lambda x: x + F.lit(0.0))))  # -0 is 0
    rows = plain.withColumn("a", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))).withColumn("b", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(2), "v")))
    classes = rows.filter("v is not null").groupBy("a", "b").agg(F.min("vec_id").alias("own"), F.count("*").alias("members"), F.first("v").alias("vector"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("rep"), "a", "b", "own", "members", F.size("vector").alias("dim"), "vector"), f"{root}/classes")

    common = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = common["dim"] if common else 0
    sample = [r["vector"] for r in classes.filter(F.col("dim") == dim).orderBy("a", "b").limit(SAMPLE).select("vector").collect()]
    axes = Axes(unit_rows(np.array(sample), dim) if sample else None, dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int64)
            mine = dims == axes.dim
            if mine.any():
                cell[mine] = axes.cells(axes.turned(unit_rows(_flat(batch.column(2).filter(pa.array(mine))), axes.dim)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell)], names=["rep", "cell"])

    celled = classes.select("rep", "dim", "vector").mapInArrow(place, "rep long, cell long")
    celled = materialise(classes.select("rep", "dim", "members", "vector").join(celled, "rep"), f"{root}/cells")
    sizes = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    number = F.pmod(F.xxhash64("rep"), F.col("k"))
    blocks = celled.join(sizes, ["dim", "cell"]).withColumn("block", F.concat_ws("-", F.lpad(F.col("cell").cast("string"), 12, "0"), F.lpad(number.cast("string"), 12, "0")))
    folder = f"{root}/blocks"
    meta = materialise(blocks.groupBy("dim", "block").applyInArrow(_block_writer(folder, axes), BLOCKS), f"{root}/meta")
    units = materialise(meta.select("dim", "block", "file", "low", "high").mapInArrow(_units(f"{root}/meta", similarity), "dim int, file string, others array<string>"), f"{root}/units")
    width = max(1, min(units.count(), 8 * spark.sparkContext.defaultParallelism, 4096))
    found = materialise(units.repartition(width).mapInArrow(_compare(folder, axes, similarity), LINKS), f"{root}/links")

    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.filter("rep <> root").select(F.col("root").alias("u"), F.col("rep").alias("v")).distinct(), f"{root}/cc")
    comp = materialise(comp.unionByName(comp.select(F.col("comp").alias("node"), "comp").distinct()), f"{root}/comp")  # the least of a component has no row of its own
    named = classes.select("rep", "a", "b", "own", "members").join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    least = named.filter("comp is not null").groupBy("comp").agg(F.min("own").alias("least"))
    label = named.join(least, "comp", "left").select("a", "b", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"), F.coalesce("least", "own").alias("least"))
    out = rows.select("vec_id", "a", "b").join(label, ["a", "b"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


ORACLE_OP11 = """
with recursive v as (select vec_id, row_number() over (order by vec_id) as r, embedding::double[] as e from embeddings),
ok as (select * from v where len(e) > 0 and len([x for x in e if x is null or not isfinite(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
link as (select a.r as u, b.r as v from ok a join ok b on a.r <> b.r and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select r as u, r as v from v union select reach.u, link.v from reach join link on link.u = reach.v),
comp as (select reach.u, min(v.vec_id) as c from reach join v on v.r = reach.v group by 1),
n as (select u, count(*) as n from link group by 1)
select v.vec_id, coalesce(n.n, 0) as n_links, comp.c as component_id, v.vec_id = comp.c as kept from v join comp on comp.u = v.r left join n on n.u = v.r
"""


def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
