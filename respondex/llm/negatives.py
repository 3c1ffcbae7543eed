"""Hard negatives by exact integer scores from a residue number system.

Vectors become integers. A score is an inner product of two of them, at most the longest
squared length in size (Cauchy-Schwarz), so a few primes whose product is over twice that
determine it. Component matrices are multiplied modulo each prime in float32: residues are
centred and columns taken in slices, so every sum stays below 2^24 and is exact whatever the
order of additions. Chinese remaindering by mixed digits gives the signed score back.

Anchors and rows are dealt to blocks, and pairs of blocks are the tasks. The first pass
finds each anchor's positives within its label, the second the other labels' rows whose
score lies in the window below each positive. A task returns the best few of each anchor,
and ranking in windows keeps the best of those.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respondex.llm.shared import passing, written

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this many hundredths of the positive's, and at most all.
LOW_PERCENT = 80
ROW_BLOCK = 8192
ANCHOR_BLOCK = 1024
#: Anchors whose scores a task holds at once.
_CHUNK = 128
#: Longest squared length of a vector of integers; 100 times a score then fits into 64 bits.
MOST = 1 << 56
_COLUMNS = 64
#: Half the largest prime, squared, times ``_COLUMNS`` is below 2^24.
_LARGEST = 1023


def primes_for(bound: int) -> list[int]:
    """The largest primes whose product is over ``2 * bound``, so that signs can be told."""
    found: list[int] = []
    product, p = 1, _LARGEST
    while product <= 2 * bound:
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
        p -= 1
    return found


def residues(matrix: np.ndarray, p: int) -> np.ndarray:
    """Residues between -p/2 and p/2."""
    rest = matrix % p
    return (rest - p * (rest > p // 2)).astype(np.float32)


def signed(rests: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The numbers nearest to zero that have these remainders."""
    digits: list[np.ndarray] = []
    for rest, p in zip(rests, primes):
        value, weight = rest.astype(np.int64), 1
        for digit, q in zip(digits, primes):
            value = value - digit % p * weight
            weight = weight * q % p
        digits.append(value % p * pow(weight, -1, p) % p)
    total, weight = np.zeros_like(digits[0]), 1
    for digit, p in zip(digits, primes):
        total += digit * weight
        weight *= p
    return np.where(total > weight // 2, total - weight, total)


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of both sides, given as residues for each prime."""
    rests = []
    for a, b, p in zip(left, right, primes):
        rest = np.zeros((len(a), len(b)), np.int64)
        for k in range(0, a.shape[1], _COLUMNS):
            product = a[:, k : k + _COLUMNS] @ b[:, k : k + _COLUMNS].T
            rest += product.astype(np.int64)
        rests.append(rest % p)
    return signed(rests, primes)


def _firsts(group: np.ndarray, score: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first ``most`` of each group: higher scores, then smaller places."""
    order = np.lexsort((place, -score, group))
    ordered = group[order]
    rank = np.arange(len(order)) - np.searchsorted(ordered, ordered)
    return order[rank < most]


class _Block:
    """Rows and anchors of one pair of blocks."""

    def __init__(self, table: pa.Table, primes: list[int]):
        is_anchor = table["is_anchor"].to_numpy(zero_copy_only=False).astype(bool)
        ids = table["vec_id"]
        known = ids.is_valid().to_numpy(zero_copy_only=False).astype(bool)
        number = ids.fill_null(0).to_numpy()
        rows = np.flatnonzero(~is_anchor)
        # Ties go to the smaller id; rows without one come last.
        self.rows = rows[np.lexsort((table["uid"].to_numpy()[rows], number[rows], ~known[rows]))]
        self.anchors = np.flatnonzero(is_anchor)
        self.uid = table["uid"].to_numpy()
        self.label = table["label"].to_numpy()
        self.ids = ids.combine_chunks()
        width = len(table["vector"][0])
        flat = table["vector"].combine_chunks().flatten().to_numpy().astype(np.int64)
        matrix = flat.reshape(-1, width) if width else np.zeros((table.num_rows, 0), np.int64)
        self.primes = primes
        self.right = [residues(matrix[self.rows], p) for p in primes]
        self.matrix = matrix

    def chunks(self):
        for k in range(0, len(self.anchors), _CHUNK):
            part = self.anchors[k : k + _CHUNK]
            left = [residues(self.matrix[part], p) for p in self.primes]
            yield part, scores(left, self.right, self.primes)


def _best_positives(primes: list[int], most: int) -> Callable[[pa.Table], pa.Table]:
    names = ["anchor", "positive", "positive_id", "positive_score"]

    def task(table: pa.Table) -> pa.Table:
        block = _Block(table, primes)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for part, found in block.chunks():
            others = block.uid[part][:, None] != block.uid[block.rows][None, :]
            if found.shape[1] > most + 1:
                # The anchor itself may be among the rows, so one more is looked at.
                last = np.partition(found, -most - 1, axis=1)[:, -most - 1]
                others &= found >= last[:, None]
            at, row = np.nonzero(others)
            score = found[at, row]
            keep = _firsts(at, score, row, most)
            out[0].append(block.uid[part[at[keep]]])
            out[1].append(block.uid[block.rows[row[keep]]])
            out[2].append(block.rows[row[keep]])
            out[3].append(score[keep])
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        ids = block.ids.take(pa.array(columns[2], pa.int64()))
        return pa.table([pa.array(columns[0]), pa.array(columns[1]), ids, pa.array(columns[3])], names=names)

    return task


def _best_negatives(primes: list[int], most: int, low: int) -> Callable[[pa.Table], pa.Table]:
    names = ["anchor", "positive", "negative_id", "negative_score", "negative"]

    def task(table: pa.Table) -> pa.Table:
        block = _Block(table, primes)
        given = table["positives"].to_pylist()
        row_label = block.label[block.rows]
        out: list[list[np.ndarray]] = [[], [], [], []]
        for part, found in block.chunks():
            of, positive, top = [], [], []
            for k, a in enumerate(part):
                for p in given[a] or []:
                    of.append(k)
                    positive.append(p["positive"])
                    top.append(p["positive_score"])
            of, positive, top = (np.array(x, np.int64) for x in (of, positive, top))
            bottom = -((-low * top) // 100)
            if not len(of):
                continue
            highest = np.full(len(part), np.iinfo(np.int64).min)
            lowest = np.full(len(part), np.iinfo(np.int64).max)
            np.maximum.at(highest, of, top)
            np.minimum.at(lowest, of, bottom)
            fits = (found <= highest[:, None]) & (found >= lowest[:, None])
            fits &= block.label[part][:, None] != row_label[None, :]
            at, row = np.nonzero(fits)
            score = found[at, row]
            # Of each anchor's candidates, best first, each of its positives takes a slice.
            order = np.lexsort((row, -score, at))
            at, row, score = at[order], row[order], score[order]
            starts, ends = np.searchsorted(at, of), np.searchsorted(at, of, side="right")
            for a, pos, hi, lo, s, e in zip(of, positive, top, bottom, starts, ends):
                first = s + np.searchsorted(-score[s:e], -hi)
                last = s + np.searchsorted(-score[s:e], -lo, side="right")
                taken = slice(first, min(last, first + most))
                n = max(0, taken.stop - taken.start)
                if n:
                    out[0].append(np.full(n, block.uid[part[a]]))
                    out[1].append(np.full(n, pos))
                    out[2].append(block.rows[row[taken]])
                    out[3].append(score[taken])
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        ids = block.ids.take(pa.array(columns[2], pa.int64()))
        return pa.table(
            [pa.array(columns[0]), pa.array(columns[1]), ids, pa.array(columns[3]), pa.array(block.uid[columns[2]])],
            names=names,
        )

    return task


def _pairs(rows: DataFrame, anchors: DataFrame, kind: list[str], sizes: DataFrame) -> DataFrame:
    """Rows and anchors, each sent to all pairs of blocks that it belongs to."""

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))

    columns = ["uid", "vec_id", "label", "vector", "positives", "is_anchor"]
    place = [c for c in kind if c != "label"]
    right = rows.join(sizes, kind).select(
        *place, block("n_rows").alias("i"), F.explode(every("n_anchors")).alias("j"), *columns
    )
    left = anchors.join(sizes, kind).select(
        *place, F.explode(every("n_rows")).alias("i"), block("n_anchors").alias("j"), *columns
    )
    return right.unionByName(left)


def usable_rows(
    vectors: DataFrame, vec_id: str, vector: str, label: Column, scale: int = SCALE
) -> DataFrame:
    """vec_id, label, vector of integers, for the rows that take part."""
    value = F.col("_vector")
    clean = F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= float(MOST) ** 0.5 / scale)
    )
    whole = F.transform("_vector", lambda x: F.floor(x * scale))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x.cast("double"))
    return (
        vectors.select(
            F.col(f"`{vec_id}`").alias("vec_id"),
            label.alias("label"),
            F.col(f"`{vector}`").cast("array<double>").alias("_vector"),
        )
        .where(F.col("label").isNotNull() & value.isNotNull() & F.coalesce(clean, F.lit(False)))
        .select("vec_id", "label", whole.cast("array<int>").alias("vector"))
        .where(length <= float(MOST))
    )


def mine(
    vectors: DataFrame,
    anchor: Column,
    label: Column | None = None,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    row_block: int = ROW_BLOCK,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` chooses the anchors and may use ``vec_id``, ``label`` and ``vector``; ``label``
    is an integer on the columns of ``vectors``, its column ``label`` by default. Scores are
    integer inner products of vectors times 256, rounded down. Of an anchor's other rows of
    its label the first few are its positives, higher scores first, ties by smaller id, rows
    without an id last. Each positive gets the first few rows of other labels that score no
    more than it does and at least ``low_percent`` hundredths of it, so a positive with a
    negative score gets none. Without fitting rows nothing is returned for it.

    Rows with a null label or vector, or a null or non-finite component, take no part, nor do
    vectors so long that a score might not fit into a long (integers of 2^28, or a squared
    length of 2^56). Only vectors of one length are compared. Rows that repeat an id are rows
    of their own. Other columns are not looked at. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    label = F.col("`label`") if label is None else label
    with passing(spark):
        rows = written(
            usable_rows(vectors, vec_id, vector, label.cast("long"))
            .select(
                F.monotonically_increasing_id().alias("uid"),
                F.size("vector").alias("width"),
                "*",
                F.coalesce(anchor, F.lit(False)).alias("chosen"),
            ),
            "negatives-rows",
        )
        squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x.cast("double"))
        longest = rows.agg(F.max(squares)).first()[0]
        primes = primes_for(int(longest or 0) + 1)
        ends = "anchor bigint, positive bigint"
        plain = rows.select("*", F.lit(None).cast("array<struct<positive:bigint,positive_score:bigint>>").alias("positives"))
        right = plain.select("*", F.lit(False).alias("is_anchor"))
        left = plain.where("chosen").select("*", F.lit(True).alias("is_anchor"))

        def sizes(kind: list[str]) -> DataFrame:
            counted = rows.groupBy(*kind).agg(
                F.count("*").alias("n_rows"), F.count_if("chosen").alias("n_anchors")
            )
            blocks = [F.ceil(F.col("n_rows") / row_block), F.ceil(F.col("n_anchors") / anchor_block)]
            return counted.where("n_anchors > 0").select(
                *kind, blocks[0].alias("n_rows"), blocks[1].alias("n_anchors")
            )

        by_score = [F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last(), "positive"]
        near = written(
            _pairs(right, left, ["width", "label"], sizes(["width", "label"]))
            .groupBy("width", "label", "i", "j")
            .applyInArrow(
                _best_positives(primes, positives),
                f"{ends}, positive_id bigint, positive_score bigint",
            )
            .select("*", F.row_number().over(Window.partitionBy("anchor").orderBy(*by_score)).alias("_n"))
            .where(F.col("_n") <= positives)
            .drop("_n"),
            "negatives-positives",
        )
        # At most ``positives`` of each anchor, so the list is short.
        listed = near.groupBy("anchor").agg(
            F.collect_list(F.struct("positive", "positive_score")).alias("positives")
        )
        asking = left.drop("positives").join(
            listed.withColumnRenamed("anchor", "uid"), "uid"
        )
        order = [F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), "negative"]
        far = (
            _pairs(right, asking, ["width"], sizes(["width"]))
            .groupBy("width", "i", "j")
            .applyInArrow(
                _best_negatives(primes, negatives, low_percent),
                f"{ends}, negative_id bigint, negative_score bigint, negative bigint",
            )
            .select(
                "*",
                F.row_number()
                .over(Window.partitionBy("anchor", "positive").orderBy(*order))
                .alias("rank"),
            )
            .where(F.col("rank") <= negatives)
        )
        anchors = left.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        return written(
            far.join(near, ["anchor", "positive"])
            .join(anchors, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"),
            "negatives",
            keep=True,
        )
