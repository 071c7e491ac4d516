"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one vector kept of each group.

Equal vectors are one class. Each class has a home, the cell of the centroid nearest to it, and visits further
cells near whose border it lies. Inside a cell blocks of rows are multiplied with each other. Of a pair with
homes a and b, the distances of its vectors to the border between a and b add up to their own distance at
most, sqrt(2 - 2t) at cosine t, so one of the two lies within half of that: it visits the other's home, and
the pair meets there. So no link is lost, whatever the centroids are. They are fitted on a bounded sample.
Products in single precision find candidates, which double precision confirms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .neardup import connected_components

#: Products that differ from the limit by less than this are worked out again from the vectors as given.
CLOSE = 1e-9
ITERATIONS = 8
STRIP = 1_024
PAIRS = 1 << 16


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length, as rows of doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows; no component is rounded."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fitted(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of spherical k-means over the unit vectors ``x``; an emptied cell keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(ITERATIONS):
        home = np.concatenate([(x[lo : lo + STRIP] @ c.T).argmax(1) for lo in range(0, len(x), STRIP)])
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        length = np.sqrt((sums * sums).sum(1))
        c[length > 0] = sums[length > 0] / length[length > 0, None]
    return c


def visited(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's home, and the cells (rows x cells) within ``margin`` of whose border with it the row lies."""
    s = x @ c.T
    home = s.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 0))
    near = s.max(1)[:, None] - s <= margin * apart + 1e-9
    near[np.arange(len(x)), home] = False
    return home, near


def placed(classes: DataFrame, model: dict[int, np.ndarray], first_cell: dict[int, int], margin: float) -> DataFrame:
    """``cell, cls, n, home, vec, visits``: each class at home, with the cells it visits, and in each of these."""
    out = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("cls", T.LongType()), T.StructField("n", T.LongType()), T.StructField("home", T.IntegerType()), classes.schema["vec"], T.StructField("visits", T.ArrayType(T.IntegerType()))])
    shared = classes.sparkSession.sparkContext.broadcast((model, first_cell))

    def run(batches):
        centroids, first = shared.value
        for b in batches:
            lengths = np.asarray(b.column("vec").value_lengths())
            for dim in np.unique(lengths):
                part = b.take(pa.array(np.flatnonzero(lengths == dim)))
                for at in range(0, part.num_rows, STRIP):
                    p = part.slice(at, STRIP)
                    home, near = np.zeros(p.num_rows, int), np.zeros((p.num_rows, 1), bool)
                    if dim in centroids:
                        home, near = visited(unit(matrix(p.column("vec"))), centroids[dim], margin)
                    row, cell = np.nonzero(near)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=p.num_rows))])
                    visits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell + first[dim], pa.int32()))
                    where = pa.array(np.concatenate([np.arange(p.num_rows), row]))
                    none = pa.nulls(len(row), visits.type)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([home, cell]) + first[dim], pa.int32()), p.column("cls").take(where), p.column("n").take(where), pa.array(home + first[dim], pa.int32()).take(where), p.column("vec").take(where), pa.concat_arrays([visits, none])],
                        out.fieldNames(),
                    )

    return classes.select("cls", "n", "vec").mapInArrow(run, out)


def joined(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``root`` (of each row, the smallest row known to be linked with it) after the links ``p`` to ``q``."""
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up := root[root]).sum() != root.sum():
            root = up


def compare(least: float):
    """The function that compares rows of one cell: two blocks of its homes, or one with itself and a block of visitors.

    It gives ``cls, links, root``: how many vectors (copies counted) a class is linked with here, and a class
    that links lead to. A pair of two cells that meets in both counts in the cell of the smaller number.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cell, low, high, visit = (k.as_py() for k in key)
        table = table.sort_by("cls").combine_chunks()
        raw = scaled(matrix(table.column("vec").combine_chunks()))
        x = unit(raw)
        small = x.astype(np.float32)
        # Products in single precision find candidates; their error stays below this.
        slack = np.float32((x.shape[1] + 8) * 1.2e-7)
        cls, n, home, own = (np.asarray(table.column(c)) for c in ("cls", "n", "home", "own"))
        at_home = home == cell
        # The pairs of a home and a cell that it visits, as numbers in order.
        visits = table.column("visits").combine_chunks()
        lengths = np.asarray(visits.value_lengths().fill_null(0))
        span = np.int64(1) << 32
        mutual = np.sort(np.repeat(np.arange(len(cls)), lengths) * span + np.asarray(visits.flatten()))
        left = np.flatnonzero(at_home & (own == low))
        right = np.flatnonzero(at_home & (own == high)) if low != high else np.flatnonzero(~at_home | (visit == 0))
        total, root = np.zeros(len(cls), np.int64), np.arange(len(cls))
        for at in range(0, len(left), STRIP):
            a = left[at : at + STRIP]
            i, j = np.nonzero(small[a] @ small[right].T >= np.float32(least) - slack)
            i, j = a[i], right[j]
            # Two homes of one block meet twice here, and count once.
            one = (i < j) | ~at_home[j] | (low != high)
            i, j = i[one], j[one]
            for lo in range(0, len(i), PAIRS):
                p, q = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
                s = np.einsum("ij,ij->i", x[p], x[q])
                close = np.flatnonzero(np.abs(s - least) < CLOSE)
                for k in close:
                    u, v = raw[p[k]], raw[q[k]]
                    s[k] = u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v))
                hit = s >= least
                foreign = hit & ~at_home[q] & (home[q] < cell)
                want = p[foreign] * span + home[q[foreign]]
                found = np.searchsorted(mutual, want)
                hit[np.flatnonzero(foreign)[(found < len(mutual)) & (mutual[np.minimum(found, len(mutual) - 1)] == want if len(mutual) else False)]] = False
                p, q = p[hit], q[hit]
                np.add.at(total, p, n[q])
                np.add.at(total, q, n[p])
                root = joined(root, p, q)
        some = np.flatnonzero(total)
        return pa.table({"cls": cls[some], "links": total[some], "root": cls[root[some]]})

    return run


def dealt(rows: DataFrame, *, block_rows: int, visit_rows: int) -> DataFrame:
    """``rows`` with ``own`` and ``low, high, visit``: each row once for every group that it is compared in.

    Homes of a cell make blocks, and visitors others. Every two blocks of homes are a group, and every block of
    homes with every block of visitors. As a rule a cell has one block of each, and is one group.
    """
    at_home = F.col("home") == F.col("cell")
    blocks = lambda n, most: F.greatest(F.ceil(n / most), F.lit(1)).cast("int")
    # One row per cell, no more than there are centroids and lengths.
    sizes = rows.groupBy("cell").agg(blocks(F.count_if(at_home), block_rows).alias("homes"), blocks(F.count_if(~at_home), visit_rows).alias("visitors"))
    own = F.pmod(F.xxhash64("cls"), F.when(at_home, F.col("homes")).otherwise(F.col("visitors"))).cast("int")
    out = rows.join(F.broadcast(sizes), "cell").withColumn("own", own)
    group = lambda low, high, visit: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), visit.cast("int").alias("visit"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of_home = F.concat(
        F.transform(F.filter(upto("homes"), lambda j: j != F.col("own")), lambda j: group(F.least("own", j), F.greatest("own", j), F.lit(0))),
        F.transform(upto("visitors"), lambda v: group(F.col("own"), F.col("own"), v)),
    )
    of_visitor = F.transform(upto("homes"), lambda i: group(i, i, F.col("own")))
    return out.withColumn("g", F.explode(F.when(at_home, of_home).otherwise(of_visitor))).drop("homes", "visitors").select("*", "g.*").drop("g")


def near_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.95,
    cell_rows: int = 4_096,
    block_rows: int = 4_096,
    sample_bytes: int = 32 << 20,
    model_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept`` (``vec_id = component_id``).

    Vectors are linked when their cosine, in double precision, is ``least`` or more; ``n_links`` counts all
    other rows that a row is linked with, equal ones included. Vectors that are null, empty or zero, or that
    hold a null or non-finite component, are linked with nothing, nor are vectors of different lengths. A null id
    takes the smallest id of its group, if any, and isn't kept. Rows of one id are rows like others: they are
    linked only by their vectors; repeated rows give repeated results. Ties can't arise: the smallest id stands for a
    group. An empty table gives no rows; other columns, of any name, are not looked at.

    Centroids are fitted per length of vector, on ``sample_bytes`` of classes that a hash picks; there are as many as
    give cells of ``cell_rows`` on average, at most ``model_bytes`` of them (that much is broadcast). Larger
    cells are compared in pairs of blocks of ``block_rows``, each pair of blocks a group of its own. Vectors without any
    structure visit a good part of all cells, so that work grows nearly as all pairs do; clustered ones visit few.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    classes = src.filter(good).groupBy("vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    # One row for each length of vector. Only lengths of which there is more than a cell get centroids.
    model, first_cell, cells = {}, {}, 0
    for dim, many in sorted(classes.groupBy(F.size("vec")).count().collect()):
        first_cell[dim] = cells
        k = min(-(-many // cell_rows), max(1, model_bytes // (8 * dim)))
        if k > 1:
            share = min(1.0, min(sample_bytes // (8 * dim), 64 * k) / many)
            picked = F.pmod(F.xxhash64("cls"), F.lit(1 << 32)) < int(share * (1 << 32))
            sample = classes.filter((F.size("vec") == dim) & picked).select("cls", "vec").toArrow().sort_by("cls")
            if sample.num_rows:
                x = unit(matrix(sample.column("vec").combine_chunks()))
                model[dim] = fitted(x, min(k, len(x)))
        cells += len(model.get(dim, [0]))

    margin = np.sqrt((1 - least) / 2)
    rows = stored(placed(classes, model, first_cell, float(margin)), "placed")
    groups = dealt(rows, block_rows=block_rows, visit_rows=4 * block_rows).groupBy("cell", "low", "high", "visit")
    met = stored(groups.applyInArrow(compare(least), "cls long, links long, root long"), "met")

    labels = connected_components(met.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.select("cls", "first_id", "n").join(links, "cls", "left").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    ids = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("first_id").alias("smallest"))
    of_class = named.join(ids, "component", "left").select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "first_id").alias("component_id"))
    result = classes.select("vec", "cls").join(of_class, "cls").drop("cls")
    linked = src.filter(good).join(result, "vec").select("vec_id", "n_links", "component_id")
    alone = src.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
