"""Line dedup: an exact set-similarity join of lines, of which later matches are removed.

A line is the set of its words. Words are ordered by rarity, so two lines of enough common
words share a word in a short prefix of each; prefixes are met by word, and positional and
length filters, and a bound from the parity of 128 word groups, leave few pairs. Their whole
sets are compared. A line goes if an earlier line, kept or not, is as similar as that.

Equal sets are one node. Rarity comes from exact counts of all words in a table of fixed
size: words that share an entry count as equally frequent, which costs time and no match, and
a word whose entry is 1 is in one line only, so it can find nothing. Only documents that hold
a set of some pair are hashed again for the comparison in full.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondex.llm.hashing import lines_of, mix, offsets_of, order_of, slices, words_by_eights
from respondex.llm.shared import passing, written

THRESHOLD = 0.8
#: Entries of the table of counts are 2 ** COUNT_BITS; it is broadcast with a byte for each.
COUNT_BITS = 24
#: Most entries of the filters of sets and documents, 2 ** FILTER_BITS; a bit each is broadcast.
#: Up to there eight for each key; with more keys the filters pass more and a join does the rest.
FILTER_BITS = 24
#: Partners that a line offers for each of its words before it is asked for the rest.
OFFERS = 3
#: Bytes of text that are hashed at once; their arrays stay in the CPU caches.
SLICE = 1 << 18
#: Words that are sorted before they are counted.
COUNTED_AT_ONCE = 1 << 20
#: Rows over which comparisons are run at once.
STRETCH = 1 << 17
#: Sets that one task compares for a word; a word of more sets is dealt to more tasks.
WORD_SETS = 1 << 16
_BLOCK_BITS = 16
#: 64 parities each.
_BITS = [f"bits{k}" for k in range(2)]


def _code(counts: np.ndarray) -> np.ndarray:
    """One byte for each count: counts to 63, then eight steps for each doubling."""
    steps = 64 + np.floor(8 * np.log2(np.maximum(counts, 64) / 64))
    return np.where(counts < 64, counts, np.minimum(steps, 255)).astype(np.uint8)


def _table(parts: DataFrame, bits: int) -> np.ndarray:
    """Sum of (block, at, count) tables: ``at`` and ``count`` are packed numbers of a block.

    The blocks are summed by as many tasks as there are shuffle partitions, each of which
    holds its blocks only, and come to the driver with one byte an entry.
    """
    size = 1 << _BLOCK_BITS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, count in zip(*(c.to_pylist() for c in batch.columns)):
                own = sums.setdefault(block, np.zeros(size, np.uint32))
                places = np.frombuffer(at, np.uint16)
                # Above the largest code it doesn't matter how much.
                more = own[places].astype(np.uint64) + np.frombuffer(count, np.uint32)
                own[places] = np.minimum(more, 1 << 31)
        for block, own in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([block], pa.int32()), "codes": [_code(own).tobytes()]}
            )

    out = np.zeros(1 << bits, np.uint8)
    dealt = parts.repartition("block").mapInArrow(task, "block int, codes binary")
    for row in dealt.collect():
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(row.codes, np.uint8)
    return out


def _packed(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The filled entries of a table, as rows for ``_table``."""
    filled = np.flatnonzero(counts)
    block = filled >> _BLOCK_BITS
    edges = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(filled))):
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([block[a]], pa.int32()),
                "at": [(filled[a:b] & ((1 << _BLOCK_BITS) - 1)).astype(np.uint16).tobytes()],
                "count": [counts[filled[a:b]].astype(np.uint32).tobytes()],
            }
        )


def _key_filter(keys: DataFrame, column: str, each: int = 8) -> tuple[int, Broadcast]:
    """One bit for each entry that a key of the written table falls on, packed.

    Of other keys one in ``each`` passes, or less, up to the largest size.
    """
    wanted = (each * keys.count()).bit_length()
    bits = min(max(wanted, _BLOCK_BITS), FILTER_BITS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            seen[(key >> np.uint64(64 - bits)).astype(np.int64)] = True
        yield from _packed(seen.view(np.uint8))

    parts = keys.select(column).mapInArrow(task, "block int, at binary, count binary")
    packed = np.packbits(_table(parts, bits) > 0).tobytes()
    return bits, keys.sparkSession.sparkContext.broadcast(packed)


def _passed(rows: DataFrame, column: str, bits: int, packed: Broadcast) -> DataFrame:
    """Rows whose key passes the filter, by columns only: nothing else goes to the tasks' Python."""
    longs = np.packbits(np.unpackbits(np.frombuffer(packed.value, np.uint8)), bitorder="little")
    held = rows.sparkSession.createDataFrame([(longs.view(np.int64).tolist(),)], "_held array<bigint>")
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    bit = F.getbit(F.get("_held", F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int"))
    return rows.join(F.broadcast(held), bit == 1, "left_semi")


def _in_filter(bits: int, packed: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = (key >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


class _Sets:
    """The lines of a batch's texts as sets of words, one after the other.

    ``line`` and ``words`` have an entry for each distinct word of a line, ordered by line,
    then by the value that ``rank`` gives a word; ``held`` are the lines with words, ``begins``
    where they begin and ``sizes`` how many words they have. ``ranks`` are those values. ``texts`` and ``number`` say for
    each line which text it is in and its place there.
    """

    def __init__(self, part: pa.RecordBatch, text: int, rank: Callable[[np.ndarray], np.ndarray]):
        offsets, data = offsets_of(part.column(text))
        edges, bounds = lines_of(offsets, data)
        words, at = words_by_eights(edges, data)
        counts = np.diff(at)
        line = np.repeat(np.arange(len(counts)), counts)
        ranks = rank(words)
        order = order_of(line, len(counts), ranks)
        line, words = line[order], words[order]
        first = np.ones(len(line), bool)
        first[1:] = (line[1:] != line[:-1]) | (words[1:] != words[:-1])
        self.line, self.words, self.ranks = line[first], words[first], ranks[order][first]
        sizes = np.bincount(self.line, minlength=len(counts))
        self.held = np.flatnonzero(sizes > 0)
        self.sizes = sizes[self.held]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.texts = np.repeat(np.arange(part.num_rows), np.diff(bounds))
        self.number = np.arange(len(counts)) - bounds[:-1][self.texts]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each held line's set."""
        with np.errstate(over="ignore"):
            return tuple(
                mix(np.add.reduceat(words, self.begins), 60 + k)
                for k, words in enumerate((mix(self.words, 50), self.words))
            )


def _add(counts: np.ndarray, at: np.ndarray) -> None:
    """Add 1 for each of ``at``; in order, so that the table is not walked at random."""
    at = np.sort(at)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    counts[at[first]] += np.diff(np.append(first, len(at))).astype(np.uint32)


def _counted(docs: DataFrame) -> np.ndarray:
    """How often each word occurs, at least once for each line that has it, by entry."""
    size = 1 << COUNT_BITS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                words, _ = words_by_eights(*offsets_of(part.column(0)))
                held.append((words >> np.uint64(64 - COUNT_BITS)).astype(np.uint32))
                if sum(map(len, held)) >= COUNTED_AT_ONCE:
                    _add(counts, np.concatenate(held))
                    held = []
        if held:
            _add(counts, np.concatenate(held))
        yield from _packed(counts)

    parts = docs.select("text").mapInArrow(task, "block int, at binary, count binary")
    return _table(parts, COUNT_BITS)


def _pieces(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values``, one piece for each of ``ends``."""
    offsets = (np.append(0, ends) * values.itemsize).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(ends), buffers)


def _values(pieces: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ``pieces``, and how many each has."""
    offsets, data = offsets_of(pieces)
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def _posts(sets: DataFrame, asked: tuple[int, Broadcast] | None = None) -> DataFrame:
    """word, id, line, k1, size, parities: a row for each word that a set shows.

    With a filter of words, those that pass it.
    """
    kind = sets.schema["first"].dataType["id"].dataType
    schema = f"word bigint, id {kind.simpleString()}, line int, k1 bigint, size bigint" + "".join(
        f", {b} bigint" for b in _BITS
    )
    heads = len(_BITS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown, counts = _values(batch.column("words"), np.uint64)
            skipped, _ = _values(batch.column("skipped"), np.uint32)
            begins = np.cumsum(counts) - counts
            counts = counts - heads
            row = np.repeat(np.arange(len(counts)), counts)
            index = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            word = shown[begins[row] + heads + index]
            place = skipped + index
            if asked is not None:
                keep = _in_filter(asked[0], np.frombuffer(asked[1].value, np.uint8), word)
                row, word, place = row[keep], word[keep], place[keep]
            rows = pa.array(row)
            # The set's size and the word's place in it, as one number.
            size = (batch.column("n").to_numpy().astype(np.int64)[row] << 32) + place
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(word.view(np.int64)),
                    *[batch.column(c).take(rows) for c in ("id", "line", "k1")],
                    pa.array(size),
                    *[pa.array(shown[begins + k].view(np.int64)[row]) for k in range(heads)],
                ],
                names=["word", "id", "line", "k1", "size", *_BITS],
            )

    showing = sets.where(F.length("words") > 8 * heads)
    return showing.select("first.id", "first.line", "k1", "n", "words", "skipped").mapInArrow(task, schema)


def _prefixed(docs: DataFrame, threshold: float) -> DataFrame:
    """id, hash, line, k1, k2, n, often, words, skipped: one row per line with a word.

    ``words`` holds the parities, then the words of the prefix that more than one line has, 8
    bytes each; ``skipped`` how many words of the prefix were left out before each of them, 4
    bytes each. Spark moves and compares such columns as they are, arrays number by number.
    ``often`` says that one of the words may be in the prefixes of more than ``WORD_SETS``
    sets. For a set that its slice has shown before, words and skipped are empty.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_counted(docs).tobytes())
    kind = docs.schema["id"].dataType
    schema = (
        f"id {kind.simpleString()}, hash bigint, line int, k1 bigint, k2 bigint, n int, often boolean, "
        "words binary, skipped binary"
    )
    many = _code(np.array([WORD_SETS]))[0]
    groups = np.uint64(len(_BITS) - 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer(shared.value, np.uint8)

        def rank(words: np.ndarray) -> np.ndarray:
            # Rarity stands above the first 56 bits of the word, which is a hash already.
            rarity = codes[(words >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
            return (rarity.astype(np.uint64) << np.uint64(56)) | (words >> np.uint64(8))

        for batch in batches:
            for part in slices(batch, 2, SLICE):
                found = _Sets(part, 2, rank)
                words, sizes, begins, held = found.words, found.sizes, found.begins, found.held
                if not len(held):
                    continue
                k1, k2 = found.keys()
                _, first = np.unique(k1, return_index=True)
                fresh = np.zeros(len(held), bool)
                fresh[first] = True
                one = np.uint64(1) << (words & np.uint64(63))
                part_of = words >> np.uint64(6) & groups
                parity = [
                    np.bitwise_xor.reduceat(np.where(part_of == k, one, 0), begins)[fresh]
                    for k in range(len(_BITS))
                ]
                place = np.arange(len(words)) - np.repeat(begins, sizes)
                most = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
                code = found.ranks >> np.uint64(56)
                posted = (place < np.repeat(np.where(fresh, most, 0), sizes)) & (code > 1)
                per_line = np.add.reduceat(posted, begins, dtype=np.int64)
                often = np.logical_or.reduceat(posted & (code >= many), begins)
                ends = np.cumsum(per_line)
                index = np.arange(ends[-1]) - np.repeat(ends - per_line, per_line)
                head = np.cumsum(np.where(fresh, per_line + len(_BITS), 0))
                shown = np.zeros(head[-1], np.uint64)
                own = np.ones(len(shown), bool)
                for k, bits in enumerate(parity):
                    at = (head - per_line - len(_BITS))[fresh] + k
                    shown[at], own[at] = bits, False
                shown[own] = words[posted]
                skipped = (place[posted] - index).astype(np.uint32)
                texts = pa.array(found.texts[held])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(texts),
                        part.column(1).take(texts),
                        pa.array(found.number[held], pa.int32()),
                        pa.array(k1.view(np.int64)),
                        pa.array(k2.view(np.int64)),
                        pa.array(sizes, pa.int32()),
                        pa.array(often),
                        _pieces(shown, head),
                        _pieces(skipped, ends),
                    ],
                    names=["id", "hash", "line", "k1", "k2", "n", "often", "words", "skipped"],
                )

    return docs.select("id", "hash", "text").mapInArrow(task, schema)


def _offers(posts: DataFrame, many: DataFrame, threshold: float, most: int | None) -> DataFrame:
    """later, earlier, more: pairs that pass all filters.

    ``posts`` has word, id, line, k1, size, parities, asks. Rows of a word lie together and in
    order; each that asks is held against those before it, the nearest first, until it has
    ``most`` partners (``more`` then says that others may be left). Comparisons run over all
    words of a stretch at once, one distance after the other. A word with many sets (``many``
    has hot, halves) deals them to halves, and each pair of halves is compared by itself.
    """
    if many.isEmpty():
        half, alone, group = F.lit(0).cast("bigint"), F.lit(2), F.col("word")
        dealt = posts
    else:
        half = F.coalesce(F.pmod(F.xxhash64("k1"), "halves"), F.lit(0))
        others = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("halves"), F.lit(1)) - 1)
        dealt = posts.join(many, F.col("word") == F.col("hot"), "left").select(
            *posts.columns, half.alias("half"), F.explode(others).alias("other")
        )
        half = F.col("half")
        alone = F.when(half == F.col("other"), 2).otherwise(0)
        # The larger half and the smaller one name their meeting.
        group = F.xxhash64("word", F.least("half", "other"), F.greatest("half", "other"))
    dealt = dealt.select(
        group.alias("group"),
        "id",
        "k1",
        "size",
        *_BITS,
        # The line and the flags, as one number.
        (
            F.shiftleft(F.col("line").cast("long"), 32)
            + 4 * half
            + alone
            + F.when(F.col("asks"), 1).otherwise(0)
        ).alias("spot"),
    )
    # By one number Spark sorts fastest; each stretch is put in order below.
    grouped = dealt.repartition("group").sortWithinPartitions("group")
    by = [(c, "ascending") for c in ("group", "id", "line", "k1")]

    def pairs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        groups = rows.column("group").to_numpy()
        same = groups[1:] == groups[:-1]
        # A set alone with its word meets nothing.
        rows = rows.filter(pa.array(np.append(same, False) | np.append(False, same)))
        if not rows.num_rows:
            return
        spot = rows.column("spot").to_numpy()
        rows = rows.append_column("line", pa.array(spot >> 32))
        order = pc.sort_indices(rows, sort_keys=by, null_placement="at_start")
        rows = rows.select(["group", "k1", "size", *_BITS]).take(order)
        flags = spot[order.to_numpy()] & ((1 << 32) - 1)
        group, key, size, *bits = (c.to_numpy(zero_copy_only=False) for c in rows.columns)
        yield from offered(group, key, size, flags, *bits)

    def offered(word, key, size, flags, *bits) -> Iterator[pa.RecordBatch]:
        n, place = size >> 32, size & ((1 << 32) - 1)
        asks, alone, half = flags & 1 > 0, flags & 2 > 0, flags >> 2
        dealt = not alone.all()
        rest = n - place
        begins = np.flatnonzero(np.diff(word, prepend=~word[0]))
        index = np.arange(len(word)) - np.repeat(begins, np.diff(np.append(begins, len(word))))
        found = np.zeros(len(word), np.int32)
        live = np.flatnonzero((index > 0) & asks)
        gap = 1
        while len(live):
            x, y = live, live - gap
            total = n[x] + n[y]
            need = np.ceil(threshold / (1 + threshold) * total - 1e-9)
            # This bounds the sizes too: the words left are no more than the smaller set has.
            near = np.flatnonzero(np.minimum(rest[x], rest[y]) >= need)
            a, b = x[near], y[near]
            other = key[a] != key[b]
            if dealt:
                other &= alone[a] | (half[a] != half[b])
            near = near[other]
            a, b = x[near], y[near]
            differ = sum(np.bitwise_count((c[a] ^ c[b]).view(np.uint64)).astype(np.int64) for c in bits)
            hit = total[near] - differ >= 2 * need[near]
            a, b = a[hit], b[hit]
            found[a] += 1
            full = np.zeros(len(a), bool) if most is None else found[a] >= most
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[a]), pa.array(key[b]), pa.array(full & (index[a] > gap))],
                    names=["later", "earlier", "more"],
                )
            gap += 1
            keep = index[live] >= gap
            if most is not None:
                keep &= found[live] < most
            live = live[keep]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < STRETCH:
                continue
            whole = pa.concat_batches(held)
            # The last word may go on in the next batch.
            groups = whole.column("group").to_numpy()
            cut = int(np.searchsorted(groups, groups[-1], side="left"))
            if cut:
                yield from pairs(whole.slice(0, cut))
            held = [whole.slice(cut)]
        if sum(x.num_rows for x in held):
            yield from pairs(pa.concat_batches(held))

    return grouped.mapInArrow(task, "later bigint, earlier bigint, more boolean")


def _token_sets(docs: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """k1, k2, items of the sets that pass the filter of ``keys`` (k1), and a few others.

    Texts in which none of these sets comes first are not looked at.
    """
    homes = sets.join(keys, "k1", "left_semi").select(F.col("first.hash").alias("hash"))
    text_bits, text_filter = _key_filter(written(homes, "line-homes"), "hash")
    key_bits, key_filter = _key_filter(keys, "k1")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(key_filter.value, np.uint8)
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                found = _Sets(part, 0, lambda words: words)
                if not len(found.held):
                    continue
                k1, k2 = found.keys()
                _, first = np.unique(k1, return_index=True)
                wanted = np.zeros(len(k1), bool)
                wanted[first] = True
                wanted &= _in_filter(key_bits, bits, k1)
                bounds = np.append(0, np.cumsum(found.sizes[wanted]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k1[wanted].view(np.int64)),
                        pa.array(k2[wanted].view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(bounds, pa.int32()),
                            pa.array(found.words[np.repeat(wanted, found.sizes)].view(np.int64)),
                        ),
                    ],
                    names=["k1", "k2", "items"],
                )

    schema = "k1 bigint, k2 bigint, items array<bigint>"
    return _passed(docs, "hash", text_bits, text_filter).select("text").mapInArrow(task, schema)


def _matched(docs: DataFrame, sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """k1, k2 of the later sets of ``pairs`` that are similar to the earlier one, in full."""
    pairs = written(pairs.select("later", "earlier").distinct(), "line-pairs")
    keys = pairs.select(F.explode(F.array("later", "earlier")).alias("k1")).distinct()
    keys = written(keys, "line-keys")
    full = (
        _token_sets(docs, sets, keys)
        .join(keys, "k1", "left_semi")
        .groupBy("k1", "k2")
        .agg(F.first("items").alias("items"))
    )
    full = written(full, "line-items")
    later = full.select(
        F.col("k1").alias("later"), F.col("k2").alias("later_2"), F.col("items").alias("x")
    )
    earlier = full.select(F.col("k1").alias("earlier"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(later, "later")
        .join(earlier, "earlier")
        .where(common >= F.lit(threshold) * (F.size("x") + F.size("y") - common) - 1e-9)
        .select(F.col("later").alias("k1"), F.col("later_2").alias("k2"))
        .distinct()
    )


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, hash, lines: which lines of which documents (id, hash, text) match an earlier one."""
    first = F.struct("id", "line", "k1", "hash")
    with passing(docs.sparkSession):
        wide = written(_prefixed(docs, threshold), "lines-wide")
        sets = written(
            wide.groupBy("k1", "k2").agg(
                F.min(first).alias("first"),
                F.first("n").alias("n"),
                F.max("often").alias("often"),
                (F.count(F.lit(1)) > 1).alias("repeated"),
                # Empty, or the same in all rows of a set.
                F.max("words").alias("words"),
                F.max("skipped").alias("skipped"),
            ),
            "line-sets",
            keep=True,
        )
        lines = written(wide.select("id", "hash", "line", "k1", "k2"), "lines", keep=True)
    # Of two different sets the smaller one has at most n / (n + 1) of all their words.
    if threshold >= 1:
        smallest = 1 << 30
    else:
        smallest = math.ceil(threshold / (1 - threshold) - 1e-9)

    large = sets.where(F.col("n") >= smallest)
    posts = _posts(large)
    many = written(
        _posts(large.where("often"))
        .groupBy("word")
        .count()
        .where(F.col("count") > WORD_SETS)
        .select(F.col("word").alias("hot"), F.ceil(F.col("count") / (WORD_SETS // 2)).alias("halves")),
        "line-words",
    )
    offers = written(_offers(posts.withColumn("asks", F.lit(True)), many, threshold, OFFERS), "line-offers")
    matched = written(_matched(docs, sets, offers, threshold), "line-matches")
    # Lines with more partners than were tried, and no match among those.
    open_sets = written(
        offers.where("more")
        .select(F.col("later").alias("k1"))
        .distinct()
        .join(matched, "k1", "left_anti"),
        "line-open",
    )
    if not open_sets.isEmpty():
        asked = _posts(large.join(open_sets, "k1", "left_semi")).select("word").distinct()
        asked = written(asked, "line-asked")
        asking = (
            _posts(large, _key_filter(asked, "word", 128))
            .join(asked, "word", "left_semi")
            .join(open_sets.withColumn("asks", F.lit(True)), "k1", "left")
        )
        asking = asking.withColumn("asks", F.coalesce("asks", F.lit(False)))
        rest = _offers(asking, many, threshold, None)
        rest = rest.join(offers.select("later", "earlier").distinct(), ["later", "earlier"], "left_anti")
        matched = matched.union(written(_matched(docs, sets, rest, threshold), "line-matches"))
    # Only lines of these sets may go; of a set with one line it goes if the set has a match.
    heads = (
        sets.where("repeated")
        .select("k1", "k2", "first")
        .join(matched.distinct().withColumn("hit", F.lit(True)), ["k1", "k2"], "full")
    )
    gone = lines.join(heads, ["k1", "k2"]).where(
        F.col("hit").isNotNull() | ~first.eqNullSafe(F.col("first"))
    )
    return gone.groupBy("id", "hash").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """_row (all columns of ``docs``), text, n_lines, n_removed; one row per input row.

    Lines are what line feeds part. Of each line with words all but the first occurrence of
    its set of words go, in the order of document id and line number, and so do all lines
    whose set has a Jaccard similarity of ``threshold`` or more with that of an earlier line.
    Lines without words stay. The other lines stay as they are, with one line feed between.
    A null text stays null. Rows that repeat an id and a text are one document seen twice:
    the same lines go from each; where only the id repeats, it is open, but settled by the
    words, which of two lines of one number is the first. A null id comes first. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.xxhash64(body).alias("hash"), body.alias("text")
    )
    with passing(spark):
        gone = written(repeated_lines(source, threshold), "lines-gone", keep=True)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{doc_id}`").alias("_id"),
        F.xxhash64(body).alias("_hash"),
    )
    joined = rows.join(
        gone, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")), "left"
    )
    value = F.col("_row").getField(text)
    parts = F.split(value, "\n", -1)

    def left(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lines"))
        return F.transform(places, lambda i: F.get(lines, i))

    # Line feeds are counted without building the lines.
    n_lines = F.octet_length(value) - F.octet_length(F.replace(value, F.lit("\n"), F.lit(""))) + 1
    # As the only element of an array the lines are split once, and not for every place.
    kept = F.transform(F.array(parts), left)[0]
    return joined.select(
        "_row",
        F.when(F.col("lines").isNull(), value).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(value.isNotNull(), n_lines).otherwise(0).cast("long").alias("n_lines"),
        F.when(F.col("lines").isNotNull(), F.size("lines")).otherwise(0).cast("long").alias("n_removed"),
    )


def deduplicated(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """``docs`` with the shorter texts; documents of which no word is left are left out.

    Documents that had no word before stay. ``n_chars`` follows the text where it is there.
    """
    done = dedup_lines(docs, text=text, **options)
    some = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = done.where((F.col("n_removed") == 0) | some)
    values = {text: F.col("text"), n_chars: F.length("text").cast("long")}
    own = {c: F.col("_row").getField(c) for c in docs.columns}
    changed = F.col("n_removed") > 0
    return rows.select(
        *[
            (F.when(changed, values[c]).otherwise(own[c]) if c in values else own[c]).alias(c)
            for c in docs.columns
        ]
    )
