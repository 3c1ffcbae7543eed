"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source has a weight and a limit, so many times its own size; the budget is shared by
weight, and what a limit turns away is shared again. The budget is a number of equal
blocks, which go to the sources, and then to the shards of each source, by highest
quotients weight / (2 k - 1). A shard holds about ``shard_rows`` documents in seeded order;
its quota is laid out from a seeded block onwards, round the shard, again and again. Which
words a document gives follows from sums, so blocks never become rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respondex.llm.shared import word_count, written

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
REPEATS = 2
BLOCK = 128
#: Blocks that the target of any source has at least; blocks are smaller if need be.
SOURCE_BLOCKS = 8
SHARD_ROWS = 1024
SEED = 20_24


def targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    repeats: int = REPEATS,
) -> DataFrame:
    """source, source_size, rows, target for (source, source_size, rows).

    Filling up by ``limit / weight``, the level after the sources that reach their limit is
    the largest of all levels so reached; a target is the smaller of limit and
    weight * level. The window has one row per source.
    """
    everyone = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    known = sizes.select(
        "*",
        F.element_at(
            F.array(*[F.lit(w) for w in weights]),
            ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"),
        ).alias("weight"),
        (repeats * F.col("source_size")).alias("most"),
        (F.sum("source_size").over(everyone) * (budget_percent / 100)).alias("budget"),
    )
    filling = Window.orderBy(
        F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("most").over(filling), F.lit(0))) / (
        F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(filling), F.lit(0))
    )
    return known.select("*", level.alias("level")).select(
        "source",
        "source_size",
        "rows",
        F.least(
            F.col("most").cast("double"), F.col("weight") * F.max("level").over(everyone)
        ).alias("target"),
    )


def apportion(rows: DataFrame, group: list[str], key: list[str], weight: str, seats: str) -> DataFrame:
    """``rows`` with ``quota``: Sainte-Lague seats, ``seats`` in each group, ties by ``key``.

    Rounded shares are at most so many seats off as all of the group are together, so only
    that many seats about each share are ranked by quotient.
    """
    in_group = Window.partitionBy(*group)
    all_weights = F.sum(weight).over(in_group)
    share = F.floor(F.try_divide(F.col(seats) * F.col(weight), all_weights) + 0.5)
    near = (
        rows.select("*", F.coalesce(share, F.lit(0)).alias("_share"))
        .select("*", F.abs(F.col(seats) - F.sum("_share").over(in_group)).alias("_off"))
        .select("*", F.greatest(F.col("_share") - F.col("_off"), F.lit(0)).alias("_sure"))
        .select("*", (F.col(seats) - F.sum("_sure").over(in_group)).alias("_left"))
    )
    open_seats = near.where("_off > 0").select(
        *group,
        *key,
        "_left",
        F.col(weight).alias("_weight"),
        F.explode(F.sequence(F.col("_sure") + 1, F.col("_share") + F.col("_off"))).alias("_seat"),
    )
    by_quotient = Window.partitionBy(*group).orderBy(
        (F.col("_weight") / (2 * F.col("_seat") - 1)).desc(), *[F.col(k).asc_nulls_last() for k in key]
    )
    won = (
        open_seats.select("*", F.row_number().over(by_quotient).alias("_rank"))
        .where("_rank <= _left")
        .groupBy(*group, *key)
        .agg(F.count("*").alias("_won"))
    )
    same = [F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in [*group, *key]]
    return (
        near.alias("_a")
        .join(won.alias("_b"), reduce(lambda x, y: x & y, same), "left")
        .select(
            *[F.col(f"_a.{c}") for c in rows.columns],
            (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota"),
        )
    )


def _common(start: Column, end: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(end, high) - F.greatest(start, low), F.lit(0))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    carry: bool = False,
    weights: tuple[int, ...] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    repeats: int = REPEATS,
    block: int = BLOCK,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, whole, cut_at, cut, again; one row per row.

    ``taken`` words are ``whole`` times the document, then ``cut`` words from word
    ``cut_at`` on, then its first ``again`` words. With ``carry``, ``_row`` has all columns
    of ``docs``. Null and empty texts have size 0 and give nothing; a null source is a
    source of its own, the last. Rows that repeat an id count each; between rows alike in id
    and size it is open which of them gives how much. An empty table gives an empty
    result. Reruns agree, whatever the partitions of ``docs``.
    """
    narrow = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []),
    )
    # Narrow sizes are kept, so texts are read once; with whole rows they are read twice.
    sized = narrow if carry else written(narrow, "mix-sizes")
    by_source = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("rows")
    )
    shared = written(targets(by_source, weights, budget_percent, repeats), "mix-targets")
    # Blocks are equal for all sources, so the smallest target says how small they must be.
    smallest = shared.where("target > 0").agg(F.min("target")).first()[0]
    if smallest is not None:
        block = max(1, min(block, int(smallest) // SOURCE_BLOCKS))
    seats = shared.select(
        "*",
        F.lit(0).alias("all"),
        F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5).alias("seats"),
    )
    quotas = written(
        apportion(seats, ["all"], ["source"], "target", "seats").select(
            F.col("source").alias("_source"),
            "source_size",
            "target",
            F.ceil(F.col("rows") / shard_rows).alias("shards"),
            F.col("quota").alias("source_quota"),
        ),
        "mix-quotas",
    )
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    dealt = sized.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).select(
        *[c for c in sized.columns],
        "source_size",
        "target",
        "shards",
        "source_quota",
        F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), "shards").alias("shard"),
    )
    shards = (
        dealt.groupBy("source", "shard")
        .agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
        .where("shard_size > 0")
    )
    shard_quotas = written(
        apportion(shards, ["source"], ["shard"], "shard_size", "source_quota").select(
            F.col("source").alias("_s"),
            F.col("shard").alias("_n"),
            "shard_size",
            F.least(F.col("quota") * block, repeats * F.col("shard_size")).alias("words"),
        ),
        "mix-shards",
    )
    place = Window.partitionBy("source", "shard").orderBy(order, "doc_id", "size")
    placed = dealt.select(
        "*",
        F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)).alias("_end"),
    ).join(
        shard_quotas,
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_n")),
        "left",
    )
    rest = F.col("words") % F.col("shard_size")
    first = block * F.pmod(
        F.xxhash64(F.lit(seed + 2), "source", "shard"),
        F.ceil(F.col("shard_size") / block),
    )
    start = F.col("_end") - F.col("size")
    laid = placed.select(
        *[c for c in sized.columns],
        "source_size",
        "target",
        F.coalesce(F.floor(F.col("words") / F.col("shard_size")), F.lit(0)).alias("whole"),
        F.greatest(first - start, F.lit(0)).alias("cut_at"),
        F.coalesce(_common(start, F.col("_end"), first, first + rest), F.lit(0)).alias("cut"),
        F.coalesce(
            _common(start, F.col("_end"), F.lit(0), first + rest - F.col("shard_size")), F.lit(0)
        ).alias("again"),
    )
    return laid.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("cut") + F.col("again")).alias("taken"),
        "whole",
        "cut_at",
        "cut",
        "again",
        *(["_row"] if carry else []),
    )


def mixed_documents(
    docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options
) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    A document taken twice is two rows. At the border of a quota a row has a part of the
    words, with the white space after them. ``n_chars`` follows the text where it is there.
    """
    laid = mix(docs, text=text, carry=True, **options)
    body = F.col("_row").getField(text)
    whole = F.col("cut") == F.col("size")
    word = F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
    words = F.regexp_extract_all(F.coalesce(body, F.lit("")), word, F.lit(0))

    def part(at: Column, n: Column) -> Column:
        return F.array_join(F.slice(words, (at + 1).cast("int"), n.cast("int")), "")

    times = F.col("whole") + F.when(whole & (F.col("size") > 0), 1).otherwise(0)
    copies = F.concat(
        F.array_repeat(body, times.cast("int")),
        F.when((F.col("cut") > 0) & ~whole, F.array(part(F.col("cut_at"), F.col("cut")))).otherwise(
            F.array().cast("array<string>")
        ),
        F.when(F.col("again") > 0, F.array(part(F.lit(0), F.col("again")))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    rows = laid.select("_row", F.explode(copies).alias("_text"))
    values = {text: F.col("_text"), n_chars: F.length("_text").cast("long")}
    return rows.select(
        *[values.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns]
    )
