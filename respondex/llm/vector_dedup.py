"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

Two unit vectors with a cosine of t are sqrt(2 - 2 t) apart. So a vector's partner in
another cell lies no farther than that beyond the plane between the two cells' centres, and
each vector also visits the cells whose planes are that near: no link is lost to a border.
Every vector counts its links in its own cell, where all its partners are at home or visit.
Cells are cut into blocks, and pairs of blocks are the unit of work, so a large cell is many
tasks. A pair of blocks gives sums and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondex.llm.components import components
from respondex.llm.shared import written

THRESHOLD = 0.93
CELL_ROWS = 1024
BLOCK = 1024
#: Vectors on which the cells' centres are fitted, in the driver.
FIT_ROWS = 8192
FIT_ROUNDS = 10
_SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit_cells(vectors: np.ndarray, cells: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Unit centres by spherical k-means; the first centres are spread over the rows."""
    cells = max(1, min(cells, len(vectors)))
    centres = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        lengths = np.linalg.norm(sums, axis=1)
        alive = lengths > 0
        centres[alive] = sums[alive] / lengths[alive, None]
    return centres


def visits(vectors: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's own cell, and which cells it is in, its own included."""
    products = vectors @ centres.T
    own = np.argmax(products, axis=1)
    gap = products[np.arange(len(vectors)), own][:, None] - products
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[own]
    return own, gap <= np.sqrt(2 - 2 * threshold) * apart + _SLACK


def _usable(label: Column, vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(
        label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _placed(contents: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """node, kind (label and width), n, vector (unit), own, cells."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(3)])
            for width in np.unique(sizes):
                part = batch.filter(pa.array(sizes == width))
                vectors = unit(_matrix(part.column(3), int(width)))
                own = np.zeros(len(vectors), np.int64)
                within = np.ones((len(vectors), 1), bool)
                if width in centres:
                    own, within = visits(vectors, centres[int(width)], threshold)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        pa.array(list(vectors), pa.list_(pa.float64())),
                        pa.array(own, pa.int32()),
                        pa.array([np.flatnonzero(x) for x in within], pa.list_(pa.int32())),
                    ],
                    names=["node", "kind", "n", "vector", "own", "cells"],
                )

    return contents.select("node", "kind", "n", "vector").mapInArrow(
        task, "node binary, kind string, n bigint, vector array<double>, own int, cells array<int>"
    )


def _forest(n_rows: int, n_columns: int, at: np.ndarray, to: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For rows, then columns: the index whose rank is the smallest that links reach."""
    label = rank.copy()
    to = to + n_rows
    while True:
        before = label.copy()
        low = np.minimum(label[at], label[to])
        np.minimum.at(label, at, low)
        np.minimum.at(label, to, low)
        if (label == before).all():
            return label


def _block_links(threshold: float):
    names = ["node", "n_links", "root"]

    def links(table: pa.Table) -> pa.Table:
        """Links of the members at home (``core``) of one block with those of another."""
        core = np.array(table["core"].to_pylist(), bool)
        nodes = table["node"].to_pylist()
        vectors = _matrix(table["vector"].combine_chunks(), len(table["vector"][0]))
        weight = table["n"].to_numpy()
        rows, columns = np.flatnonzero(core), np.flatnonzero(~core)
        order = {x: k for k, x in enumerate(sorted(set(nodes)))}
        rank = np.array([order[x] for x in nodes])
        counts = np.zeros(len(rows), np.int64)
        at, to = [], []
        for k in range(0, len(rows), 256):
            chunk = rows[k : k + 256]
            hit = vectors[chunk] @ vectors[columns].T >= threshold
            hit &= rank[chunk][:, None] != rank[columns][None, :]
            counts[k : k + 256] = hit @ weight[columns]
            i, j = np.nonzero(hit)
            at.append(i + k)
            to.append(j)
        ends = np.concatenate([rows, columns])
        roots = _forest(
            len(rows),
            len(columns),
            np.concatenate(at) if at else np.zeros(0, np.int64),
            np.concatenate(to) if to else np.zeros(0, np.int64),
            rank[ends],
        )
        known = sorted(order)
        all_counts = np.append(counts, np.zeros(len(columns), np.int64))
        said = (all_counts > 0) | (roots != rank[ends])
        keep = np.flatnonzero(said)
        return pa.table(
            [
                pa.array([nodes[ends[k]] for k in keep], pa.binary()),
                pa.array(all_counts[keep]),
                pa.array([known[roots[k]] for k in keep], pa.binary()),
            ],
            names=names,
        )

    return links


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    cell_rows: int = CELL_ROWS,
    block: int = BLOCK,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per input row.

    Rows link if their labels are equal and their cosine is ``threshold`` or more.
    A vector that is null, empty, zero, or has a null or non-finite number, or a null label, links
    with nothing; so do vectors of different lengths. Rows that repeat a vector are linked
    with each other, whatever their ids; they are compared once. ``component_id`` is the
    smallest id that links reach, null if none of these rows has an id. Other columns are
    not looked at. An empty table gives an empty result. The centres are fitted on at most
    ``fit_rows`` vectors, chosen by digest; they only decide where vectors meet.
    """
    spark = vectors.sparkSession
    value = F.col("vector")
    base = vectors.select(
        F.col(f"`{vec_id}`").alias("vec_id"),
        F.col(f"`{label}`").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    )
    kind = F.concat_ws("/", F.col("label").cast("string"), F.size("vector").cast("string"))
    rows = base.select(
        "vec_id",
        "vector",
        kind.alias("kind"),
        F.when(
            _usable(F.col("label"), value),
            F.unhex(F.md5(F.concat_ws("|", kind, value.cast("string")))),
        ).alias("node"),
    )
    contents = written(
        rows.where("node is not null")
        .groupBy("node")
        .agg(
            F.first("kind").alias("kind"),
            F.count("*").alias("n"),
            F.first("vector").alias("vector"),
            F.min("vec_id").alias("least_id"),
        ),
        "vector-contents",
    )
    largest = contents.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    cells = -(-largest // cell_rows)
    sample: dict[int, list] = {}
    if cells > 1:
        for row in contents.orderBy("node").limit(fit_rows).select("vector").collect():
            sample.setdefault(len(row[0]), []).append(row[0])
    centres = {w: fit_cells(unit(np.array(x, float)), cells) for w, x in sample.items()}
    placed = written(_placed(contents, centres, threshold), "vector-cells")

    seen = placed.select(
        "node", "kind", "n", "vector", F.explode("cells").alias("cell"), "own"
    )
    # How many blocks a cell's own vectors and all its vectors make.
    parts = written(
        seen.groupBy("kind", "cell")
        .agg(
            F.ceil(F.count(F.when(F.col("cell") == F.col("own"), 1)) / block).alias("i_parts"),
            F.ceil(F.count("*") / block).alias("j_parts"),
        )
        .where("i_parts > 0"),
        "vector-parts",
    )
    spread = seen.join(parts, ["kind", "cell"])

    def place(parts: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")

    def every(parts: str) -> Column:
        return F.sequence(F.lit(0), (F.col(parts) - 1).cast("int"))

    home = spread.where("cell = own").select(
        "kind", "cell", place("i_parts").alias("i"), F.explode(every("j_parts")).alias("j"),
        "node", "n", "vector", F.lit(True).alias("core"),
    )
    guests = spread.select(
        "kind", "cell", F.explode(every("i_parts")).alias("i"), place("j_parts").alias("j"),
        "node", "n", "vector", F.lit(False).alias("core"),
    )
    found = written(
        home.union(guests)
        .groupBy("kind", "cell", "i", "j")
        .applyInArrow(_block_links(threshold), "node binary, n_links bigint, root binary"),
        "vector-links",
    )
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    edges = found.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))
    labels = components(edges)
    known = (
        contents.select("node", "n", "least_id")
        .join(counts, "node", "left")
        .join(labels, "node", "left")
        .select(
            "node",
            (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("label", "node").alias("group"),
            "least_id",
        )
    )
    least = known.groupBy("group").agg(F.min("least_id").alias("component_id"))
    results = known.join(least, "group").select("node", "n_links", "component_id")
    component = F.when(F.col("node").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return (
        rows.select("vec_id", "node")
        .join(results, "node", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.col("vec_id").eqNullSafe(component).alias("kept"),
        )
    )
