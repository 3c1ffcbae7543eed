"""Near-duplicate documents by BagMinHash, banding and exact verification.

A document is the bag of its shingles of five words. Every shingle has independent Poisson
processes over the weights [0, 1), [1, 2), [2, 4), [4, 8) ...: points with a time, a weight
and a register. A bag of weight w sees the points below w, and each register keeps the
earliest time, so two bags agree in a register with the probability of their weighted
Jaccard similarity. Processes above the weight are never begun, and none is followed beyond
the time at which all registers are likely to be full.

Signatures are cut into bands; bags that agree in a band share a bucket. Equal bags are one
node, so copies cost nothing. Each bucket's members are compared first with the one that
meets most others, such as the text that others were copied from. Only members that this
leaves in different groups are compared with each other, and of these only pairs that can
be similar: 1024 parities of a bag's items bound from below how many items differ. So the
groups are those of all pairs, without making all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respondex.llm.components import components
from respondex.llm.hashing import mix, offsets_of, slices, words_of
from respondex.llm.shared import written

SHINGLE = 5
BANDS = 32
ROWS = 4
THRESHOLD = 0.8
#: 64-bit numbers of item parities of a bag.
PARITIES = 16


def shingles_of(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle; a text of fewer words is one shingle."""
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(bounds[1:], counts)
    here = np.arange(len(words))
    out = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            n = max(len(words) - k, 0)
            inside = here[:n] + k < end[:n]
            out[:n] += np.where(inside, mix(words[k:], 10 + k), np.uint64(0))
    whole = (here + size <= end) | (here == np.repeat(bounds[:-1], counts))
    return text[whole], mix(out[whole], 3)


def bags_of(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle and weight, each pair once, in order of text and shingle."""
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(first)
    return text[at], shingle[at], np.diff(np.append(at, len(text)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(
    n_texts: int, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, registers: int
) -> np.ndarray:
    """Times in the registers of each text; infinite for texts without shingles."""
    out = np.full((n_texts, registers), np.inf)
    totals = np.bincount(text, weights=weight, minlength=n_texts)
    slack = 6.0
    todo = totals > 0
    while todo.any():
        # All registers of a text are full by this time but once in e^slack times.
        until = np.where(todo, registers * (np.log(registers) + slack) / np.maximum(totals, 1), 0)
        chosen = todo[text]
        t, s, w = text[chosen], shingle[chosen], weight[chosen]
        level = 0
        while len(t):
            low, high = (0, 1) if level == 0 else (1 << (level - 1), 1 << level)
            _follow(out, t, mix(s, 100 + level), w, low, high, until)
            above = w > high
            t, s, w = t[above], s[above], w[above]
            level += 1
        todo &= ~np.isfinite(out).all(axis=1)
        slack *= 2
    return out


def _follow(out, text, seed, weight, low, high, until) -> None:
    """Points of the processes over [low, high), each up to its text's time."""
    registers = np.uint64(out.shape[1])
    time = np.zeros(len(text))
    limit = until[text]
    partial = bool((weight < high).any())
    step = 0
    while len(text):
        time = time - np.log(_uniform(mix(seed, 1000 + 3 * step))) / (high - low)
        on = time <= limit
        text, seed, time, limit, weight = text[on], seed[on], time[on], limit[on], weight[on]
        register = (mix(seed, 1001 + 3 * step) % registers).astype(np.int64)
        if partial:
            seen = low + (high - low) * _uniform(mix(seed, 1002 + 3 * step)) < weight
            np.minimum.at(out, (text[seen], register[seen]), time[seen])
        else:
            np.minimum.at(out, (text, register), time)
        step += 1


def _keys(n_texts: int, text, shingle, weight) -> list[bytes]:
    """128 bits for each bag, whatever the order of its shingles."""
    sums = np.zeros((n_texts, 2), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(2):
            np.add.at(sums[:, k], text, mix(shingle, 20 + k) * mix(weight.astype(np.uint64), 30 + k))
    return [x.tobytes() for x in sums]


def _items(shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A hash for each occurrence: the first, second ... of a shingle are different items."""
    at = np.cumsum(weight) - weight
    number = (np.arange(int(weight.sum())) - np.repeat(at, weight)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(np.repeat(shingle, weight) + mix(number, 6), 7)


def _read(batch: pa.RecordBatch, column: int, size: int):
    words, bounds = words_of(*offsets_of(batch.column(column)))
    return bags_of(*shingles_of(words, bounds, size))


def _signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, hash (of the text), row, key, n, buckets, parities of each document.

    The last two are null for a bag that has been met before in its slice of the input.
    """
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("hash", T.LongType()),
            T.StructField("row", T.LongType()),
            T.StructField("key", T.BinaryType()),
            T.StructField("n", T.LongType()),
            T.StructField("buckets", T.ArrayType(T.LongType())),
            T.StructField("parities", T.ArrayType(T.LongType())),
        ]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                n = part.num_rows
                text, shingles, weight = _read(part, 3, shingle)
                keys = _keys(n, text, shingles, weight)
                totals = np.bincount(text, weights=weight, minlength=n).astype(np.int64)
                first = np.zeros(n, bool)
                first[list({k: i for i, k in reversed(list(enumerate(keys)))}.values())] = True
                first &= totals > 0
                own = first[text]
                times = signatures(n, text[own], shingles[own], weight[own], bands * rows)
                bits = mix(times.view(np.uint64).reshape(n, bands, rows), 4)
                folded = np.zeros((n, bands), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(rows):
                        folded = mix(folded + bits[:, :, k], 40 + k)
                    folded = mix(folded + np.arange(bands, dtype=np.uint64), 5)
                parities = np.zeros((n, PARITIES), np.uint64)
                items = _items(shingles[own], weight[own])
                bit = mix(items, 8)
                number = ((bit >> np.uint64(6)) % np.uint64(PARITIES)).astype(np.int64)
                place = (np.repeat(text[own], weight[own]), number)
                np.bitwise_xor.at(parities, place, np.uint64(1) << (bit & np.uint64(63)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(2),
                        pa.array(keys, pa.binary()),
                        pa.array(totals),
                        *[
                            pa.array(
                                [x if f else None for x, f in zip(table.view(np.int64), first)],
                                pa.list_(pa.int64()),
                            )
                            for table in (folded, parities)
                        ],
                    ],
                    names=schema.names,
                )

    return docs.mapInArrow(task, schema)


def _bags(docs: DataFrame, shingle: int) -> DataFrame:
    """key, bag: the numbered occurrences of shingles as hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                n = part.num_rows
                text, shingles, weight = _read(part, 0, shingle)
                keys = _keys(n, text, shingles, weight)
                items = _items(shingles, weight)
                sizes = np.bincount(text, weights=weight, minlength=n).astype(np.int64)
                bounds = np.append(0, np.cumsum(sizes)).astype(np.int32)
                bags = pa.ListArray.from_arrays(pa.array(bounds), pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), bags], names=["key", "bag"]
                )

    return docs.select("text").mapInArrow(task, "key binary, bag array<bigint>")


def _verified(
    docs: DataFrame, signed: DataFrame, pairs: DataFrame, shingle: int, threshold: float
) -> DataFrame:
    """The pairs (a, b) whose bags have the similarity, checked in full."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = (
        signed.where("buckets is not null")
        .join(wanted, "key")
        .groupBy("key")
        .agg(F.min(F.struct("doc_id", "hash")).alias("row"))
        .select("row.doc_id", "row.hash")
    )
    same = docs["doc_id"].eqNullSafe(ids["doc_id"]) & (docs["hash"] == ids["hash"])
    # Rows that repeat an id and a text give a bag each; one of them is enough.
    found = _bags(docs.join(ids, same, "left_semi"), shingle)
    bags = written(found.groupBy("key").agg(F.first("bag").alias("bag")), "near-bags")
    left = bags.select(F.col("key").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("key").alias("b"), F.col("bag").alias("bag_b"))
    common = F.size(F.array_intersect("bag_a", "bag_b"))
    either = F.size("bag_a") + F.size("bag_b") - common
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(common >= F.lit(threshold) * either)
        .select("a", "b")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    threshold: float = THRESHOLD,
    single: bool = False,
    row: str | None = None,
) -> DataFrame:
    """doc_id, hash, row, n_shingles, class_id, kept; one row per input row.

    ``class_id`` is the smallest id of the documents that links reach; a link is a multiset
    Jaccard similarity of ``threshold`` or more between two texts that share a bucket. With
    32 bands of 4 rows a pair at 0.8 is missed once in ten million times. ``kept`` holds for
    the rows with the class's id. Null and empty texts, and texts of blanks, have no shingle
    and link with nothing; a text of fewer than five words is one shingle. A row without id
    is kept if its class has no id at all. Rows that repeat an id and a text are one
    document. With ``single`` exactly one row of each class is kept, whatever the ids are:
    that with the smallest id (null last), then with the smallest number. Numbers are those
    of column ``row``, which must be unique, or given once to the rows as they are read;
    they are in the result. Other columns are not looked at. An empty table gives an empty
    result. ``hash`` is xxhash64 of the text.
    """
    source = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("hash"),
        (F.col(f"`{row}`") if row else F.monotonically_increasing_id()).alias("row"),
        F.col(f"`{text}`").alias("text"),
    )
    signed = written(_signed(source, shingle, bands, rows), "near-signed")
    posts = signed.where("buckets is not null").select(
        F.explode("buckets").alias("bucket"), "key", "n"
    )
    shared = (
        posts.groupBy("bucket")
        .agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("m"))
        .where("least <> most")
    )
    members = written(
        posts.join(shared, "bucket").select("bucket", "key", "n", "m").distinct(), "near-members"
    )
    degrees = members.groupBy("key").agg(F.sum("m").alias("degree"))
    leaders = (
        members.join(degrees, "key")
        .groupBy("bucket")
        .agg(F.max(F.struct("degree", "key")).alias("top"))
        .select("bucket", F.col("top.key").alias("leader"))
    )
    stars = written(
        members.join(leaders, "bucket")
        .where("leader <> key")
        .select(F.least("leader", "key").alias("a"), F.greatest("leader", "key").alias("b"))
        .distinct(),
        "near-stars",
    )
    links = written(_verified(source, signed, stars, shingle, threshold), "near-links")
    labels = components(links)
    # Buckets whose members aren't one group yet, beyond pairs with the leader.
    grouped = members.join(labels, F.col("key") == F.col("node"), "left").select(
        "bucket", "key", "n", F.coalesce("label", "key").alias("group")
    )
    split = (
        grouped.groupBy("bucket")
        .agg(F.min("group").alias("least"), F.max("group").alias("most"), F.count("*").alias("m"))
        .where("least <> most and m > 2")
        .select("bucket")
    )
    parities = signed.where("parities is not null").groupBy("key").agg(
        F.first("parities").alias("parities")
    )
    rest = grouped.join(split, "bucket").join(parities, "key")
    x, y = rest.alias("x"), rest.alias("y")
    differ = sum(
        (
            F.bit_count(F.col("x.parities")[k].bitwiseXOR(F.col("y.parities")[k]))
            for k in range(PARITIES)
        ),
        F.lit(0),
    )
    total = F.col("x.n") + F.col("y.n")
    apart = (
        x.join(
            y,
            (F.col("x.bucket") == F.col("y.bucket"))
            & (F.col("x.key") < F.col("y.key"))
            & (F.col("x.group") != F.col("y.group"))
            & (F.least("x.n", "y.n") >= F.lit(threshold) * F.greatest("x.n", "y.n"))
            # Of similar bags at most this share of all items is in one only.
            & (differ <= F.lit((1 - threshold) / (1 + threshold) + 1e-9) * total),
        )
        .select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
        .distinct()
    )
    open_pairs = written(apart.join(stars, ["a", "b"], "left_anti"), "near-open")
    if not open_pairs.isEmpty():
        more = written(_verified(source, signed, open_pairs, shingle, threshold), "near-links")
        labels = components(links.union(more))
    placed = signed.join(labels, F.col("key") == F.col("node"), "left").select(
        "doc_id",
        "hash",
        "row",
        "n",
        F.when(F.col("n") > 0, F.coalesce("label", "key")).alias("group"),
    )
    classes = (
        placed.where("group is not null")
        .groupBy("group")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row")).alias("head"))
        .select("group", F.col("head.doc_id").alias("class_id"), F.col("head.row").alias("head"))
    )
    first = F.col("row") == F.col("head") if single else F.col("doc_id").eqNullSafe(F.col("class_id"))
    return placed.join(classes, "group", "left").select(
        "doc_id",
        "hash",
        "row",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n") > 0, first).otherwise(True).alias("kept"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever their names."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns]
    key, body = F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`")
    if options.get("single"):
        # Numbered once, as every later look has to find the same numbers.
        rows = written(
            docs.select(own, key, body.alias("_text"), F.monotonically_increasing_id().alias("_n")),
            "near-rows",
        )
        gone = near_duplicates(rows, "_id", "_text", row="_n", **options).where("not kept")
        return rows.join(gone.select(F.col("row").alias("_n")), "_n", "left_anti").select(*columns)
    gone = near_duplicates(docs, doc_id, text, **options).where("not kept")
    gone = gone.select("doc_id", "hash").distinct()
    rows = docs.select(own, key, F.xxhash64(F.coalesce(body, F.lit(""))).alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("hash"))
    return rows.join(gone, same, "left_anti").select(*columns)
