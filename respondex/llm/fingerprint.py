"""Document fingerprints by consistent weighted sampling, in columns only.

A document is the bag of its words, a word's weight is how often it occurs. For each sample
and word, independent numbers r and c ~ Gamma(2, 1) and b ~ Uniform(0, 1) are drawn from
hashes of the word. With t = floor(ln(weight) / r + b), the word's value is
ln c - r (t - b + 1), and the sample is the word with the least value, with its t. The same
word and t give the same value in any document, so comparing values compares samples, and
two documents agree in a sample with the probability of their generalised Jaccard
similarity. A sample is kept as 16 bits of its value's hash.

Texts are shuffled once, by ranges of ids, and everything else stays within those ranges:
the next document, word counts, minima over words and the comparison with the next
document's fingerprint need no other exchange of texts or words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respondex.llm.shared import passing, text_or_empty, written

#: Rounds of samples, and samples a round; each round is a row for each word.
ROUNDS = 4
WIDTH = 8
#: Documents in a range of ids, and the most ranges.
RANGE_ROWS = 256
MOST_RANGES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
_HEX = 4


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """A number between 0 and 1 from ``width`` bits of a hash, never 0 or 1."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + 0.5) / float(1 << width)


def draws(word: Column, sample: int) -> tuple[Column, Column, Column]:
    """ln c, r and b of a word (a 64-bit hash) in a sample."""
    one, two = (F.xxhash64(word, F.lit(2 * sample + k)) for k in (0, 1))
    c = -F.ln(_uniform(one, 32, 32) * _uniform(one, 0, 32))
    r = -F.ln(_uniform(two, 43, 21) * _uniform(two, 22, 21))
    return F.ln(c), r, _uniform(two, 0, 22)


def value(log_weight: Column, drawn: tuple[Column, Column, Column]) -> Column:
    """A word's value in a sample; null if its weight is null."""
    log_c, r, b = drawn
    return log_c - r * (F.floor(log_weight / r + b) - b + 1)


def _slot(least: Column) -> Column:
    """16 bits of a sample; those of a text without words are zero."""
    bits = F.coalesce(F.xxhash64(least).bitwiseAND(F.lit(0xFFFF)), F.lit(0))
    return F.when(least.isNull(), F.lit("0" * _HEX)).otherwise(F.lpad(F.lower(F.hex(bits)), _HEX, "0"))


def likeness(a: Column, b: Column, samples: int = ROUNDS * WIDTH) -> Column:
    """Share of samples in which two fingerprints agree; null if one is null."""
    same = F.size(
        F.filter(
            F.sequence(F.lit(0), F.lit(samples - 1)),
            lambda k: F.substring(a, k * _HEX + 1, F.lit(_HEX))
            == F.substring(b, k * _HEX + 1, F.lit(_HEX)),
        )
    )
    return F.when(a.isNotNull() & b.isNotNull(), same / samples)


def samples_of(
    words: DataFrame, keys: list[str], weights: list[str], rounds: int = ROUNDS, width: int = WIDTH
) -> DataFrame:
    """(keys, word bigint, weights) to keys and one fingerprint for each weight column.

    Where rows lie together by some of ``keys``, no shuffle is needed.
    """
    logs = [F.when(F.col(w) > 0, F.ln(w)).alias(f"_log{i}") for i, w in enumerate(weights)]
    numbered = words.select(*keys, "word", *logs, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_round"))
    mixed = numbered.select(
        *keys, "_round", F.xxhash64("word", "_round").alias("_w"), *[f"_log{i}" for i in range(len(weights))]
    )
    least = []
    for k in range(width):
        drawn = draws(F.col("_w"), k)
        for i in range(len(weights)):
            least.append(F.min(value(F.col(f"_log{i}"), drawn)).alias(f"_m{i}_{k}"))
    minima = mixed.groupBy(*keys, "_round").agg(*least)
    parts = minima.select(
        *keys,
        "_round",
        *[F.concat(*[_slot(F.col(f"_m{i}_{k}")) for k in range(width)]).alias(f"_p{i}") for i in range(len(weights))],
    )
    def joined(name: str) -> Column:
        in_order = F.array_sort(F.collect_list(F.struct("_round", F.col(name).alias("part"))))
        return F.array_join(F.transform(in_order, lambda x: x["part"]), "")

    prints = [joined(f"_p{i}").alias(f"fingerprint_{i}") for i in range(len(weights))]
    return parts.groupBy(*keys).agg(*prints)


def _range_of(key: Column, tie: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds are at most (key, tie), by halving; null keys have 0."""
    if not bounds:
        return F.lit(0)
    keys, ties = (F.lit([b[i] for b in bounds]) for i in (0, 1))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def halve(found: Column, step: Column) -> Column:
        bound, bound_tie = F.get(keys, found + step - 1), F.get(ties, found + step - 1)
        reached = (key > bound) | ((key == bound) & (tie >= bound_tie))
        return F.when(reached, found + step).otherwise(found)

    return F.aggregate(F.lit(steps), F.lit(0), halve)


def _ranges(keys: DataFrame, range_rows: int) -> tuple[list[tuple[int, int]], int]:
    """Bounds of ranges of (id, tie), and how many ranges there are at most.

    The bounds are distinct keys chosen by hash, about one in ``range_rows``, and fewer where
    they would be more than ``MOST_RANGES``.
    """
    n = keys.count()
    share = max(range_rows, -(-n // MOST_RANGES))
    chosen = keys.where(F.pmod(F.xxhash64("id", "tie"), F.lit(share)) == 0)
    bounds = chosen.where("id is not null").distinct().orderBy("id", "tie").collect()
    return [(b[0], b[1]) for b in bounds], len(bounds) + 1


def _with_next(docs: DataFrame, range_rows: int) -> DataFrame:
    """(id, text) to range, place, id, text, next: by descending id, round to the first.

    The last row of a range is a copy of the next range's first row, with a null ``next``.
    """
    rows = docs.select("id", F.xxhash64("text").alias("tie"), "text")
    keys = written(rows.select("id", "tie"), "fingerprint-keys")
    bounds, n_ranges = _ranges(keys, range_rows)
    at = _range_of(F.col("id"), F.col("tie"), bounds).alias("range")
    # One row for each range, so the windows here are as small as the bounds.
    heads = written(
        keys.select(at, "id", "tie")
        .groupBy("range")
        .agg(F.max(F.struct("id", "tie")).alias("head")),
        "fingerprint-heads",
    )
    upwards = Window.orderBy("range")
    everyone = upwards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select(
        F.col("range").alias("of"),
        F.coalesce(F.lag("range").over(upwards), F.max("range").over(everyone)).alias("range"),
    )
    wanted = heads.select("range", F.col("head.id").alias("_id"), F.col("head.tie").alias("_tie"))
    first = (
        rows.join(F.broadcast(wanted), F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
        .groupBy("range", "id", "tie")
        .agg(F.first("text").alias("text"))
    )
    ends = written(
        first.join(after, "range").select(
            F.col("of").alias("range"), "id", "tie", "text", F.lit(True).alias("end")
        ),
        "fingerprint-ends",
    )
    everything = rows.select(at, "*", F.lit(False).alias("end")).unionByName(ends)
    order = Window.partitionBy("range").orderBy(
        "end", F.col("id").desc_nulls_last(), F.col("tie").desc()
    )
    return everything.repartition(-(-n_ranges // 2), "range").select(
        "range",
        F.row_number().over(order).alias("place"),
        "id",
        "text",
        F.lead("text").over(order).alias("next"),
    )


def edited_text(text: Column, following: Column) -> Column:
    """The last third of a text (rounded down) gives way to the start of the following one."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.left(text, n - third), F.left(following, third))


def compare_neighbours(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rounds: int = ROUNDS,
    width: int = WIDTH,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    One row per row. The next document is that with the next smaller id, after the last one
    the first. Rows that repeat an id come in the order of a hash of their texts; null ids
    come last. A lone document is its own next one. Null texts are empty. A text without
    words has a fingerprint of its own, like that of other such texts and of none else. Other
    columns are not looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), text_or_empty(f"`{text}`").alias("text"))
    with passing(spark):
        placed = _with_next(base, range_rows).select(
            "*", edited_text(F.col("text"), F.col("next")).alias("edited")
        )
        bodies = placed.select(
            "range", "place", F.posexplode(F.array("text", "edited")).alias("which", "body")
        )
        words = bodies.select(
            "range", "place", "which", F.explode_outer(F.regexp_extract_all("body", F.lit(WORD), F.lit(0))).alias("word")
        ).select(
            "range",
            "place",
            F.xxhash64("word").alias("word"),
            F.when(F.col("word").isNotNull() & (F.col("which") == 0), 1).otherwise(0).alias("a"),
            F.when(F.col("word").isNotNull() & (F.col("which") == 1), 1).otherwise(0).alias("b"),
        )
        counted = words.groupBy("range", "place", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        prints = samples_of(counted, ["range", "place"], ["a", "b"], rounds, width)
        following = Window.partitionBy("range").orderBy("place")
        compared = prints.select("*", F.lead("fingerprint_0").over(following).alias("_next"))
        known = placed.where("next is not null").select(
            "range",
            "place",
            F.col("id").alias("doc_id"),
            F.char_length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
        )
        n = rounds * width
        return written(
            known.join(compared, ["range", "place"]).select(
                "doc_id",
                "n_chars",
                "edited_sha256",
                F.col("fingerprint_0").alias("fingerprint"),
                F.col("fingerprint_1").alias("edited_fingerprint"),
                likeness(F.col("fingerprint_0"), F.col("fingerprint_1"), n).alias("near_edited"),
                likeness(F.col("fingerprint_0"), F.col("_next"), n).alias("near_next"),
            ),
            "fingerprints",
            keep=True,
        )
