"""Packing token sequences by vector bin packing.

An example is a vector: tokens, segments (one), loss-bearing tokens. A sequence is a bin
with a limit on each. Bins are filled one at a time: of the examples at hand the one whose
vector has the largest dot product with what the bin has left, each measured by its limit,
goes in. If none fits, one is cut to fill the bin. So only the last bin of a task has room
left; its content is dealt to bins of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respondex.llm.hashing import slices

TOKENS = 4096
SEGMENTS = 128
#: Examples that a task chooses from.
WINDOW = 512
#: Bytes of text that a task encodes at once.
SLICE = 8 << 20
END_ID = 2
TOKENIZER = "word_bpe_49k.json"

#: Words of these characters alone take the short way; the library encodes all others.
_PLAIN = re.compile("[!-~¡-¬®-±´-¸º»¿-įı-ňŊ-ž‐-‧€]+")
_PIECES = re.compile(r"\x01|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s\x01]|_)+")


class WordEncoder:
    """Token ids of many texts, each distinct word of a batch encoded once.

    The vocabulary splits at white space and looks at no neighbour, so a text's ids are
    those of its words. Plain words go through the same merges in another library, which
    takes a byte after each piece for the end of a word; both give equal ids. With
    ``added_tokens`` literal added tokens, also inside a word, have their own id, as in
    ``Tokenizer.encode(text, add_special_tokens=False)``; words that hold one go to the
    library. Without, they are text as any other.
    """

    def __init__(self, path: str, added_tokens: bool = False) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = not added_tokens
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        added = [x["content"] for x in described["added_tokens"]] if added_tokens else []
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        shown = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        rest = [b for b in range(256) if b not in shown]
        shown |= {b: chr(256 + k) for k, b in enumerate(rest)}
        byte = {c: bytes([b]) for b, c in shown.items()}

        def raw(piece: str) -> bytes:
            body = piece.removesuffix("</w>")
            return b"".join(byte[c] for c in body) + (b"\0" if body != piece else b"")

        ranks = {bytes([b]) + b"\0": b for b in range(256)}
        for b in range(256):
            ranks.setdefault(bytes([b]), len(ranks))
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(raw(a) + raw(b), len(ranks))
        ids = {raw(k): v for k, v in model["vocab"].items()}
        self.ids = np.array([ids.get(k, 0) for k in ranks], np.uint32)
        self.mark = ranks[b"\1\0"]
        self.plain = tiktoken.Encoding(
            "words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}
        )

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's begin, and the end."""
        n = len(words)
        plain = np.fromiter((bool(_PLAIN.fullmatch(w)) for w in words), bool, n)
        if self.added:
            plain &= ~np.fromiter((bool(self.added.search(w)) for w in words), bool, n)
        counts = np.zeros(n, np.int64)
        first = [w for w, p in zip(words, plain) if p]
        short = np.zeros(0, np.uint32)
        if first:
            line = "\1".join(first).lower() + "\1"
            coded = self.plain.encode_to_numpy("\0".join(_PIECES.findall(line)) + "\0")
            at = np.flatnonzero(coded == self.mark)
            counts[plain] = np.diff(at, prepend=-1) - 1
            short = self.ids[coded[coded != self.mark]]
        odd = [w for w, p in zip(words, plain) if not p]
        coded = self.full.encode_batch(odd, add_special_tokens=False) if odd else []
        long = [np.array(x.ids, np.uint32) for x in coded]
        counts[~plain] = [len(x) for x in long]
        begins = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(begins[-1], np.uint32)
        inside = np.repeat(plain, counts)
        out[inside] = short
        if long:
            out[~inside] = np.concatenate(long)
        return out, begins

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (nulls are empty) and the bounds of each text's."""
        filled = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset :][: len(filled) + 1]
        low, body = offsets[0], filled.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
        data = data[low : offsets[-1]]
        offsets = offsets - low
        solid = (data != 32) & ((data < 9) | (data > 13))
        starts = solid.copy()
        starts[1:] &= ~solid[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        starts[heads] = solid[heads]
        at = np.flatnonzero(starts)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(filled) + 1, np.int64)
        bounds = np.append(at, len(data))
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)]
        ).dictionary_encode()
        codes = pieces.indices.to_numpy()
        known = [x.decode("utf-8").strip(" \t\n\v\f\r") for x in pieces.dictionary.to_pylist()]
        ids, begins = self.words(known)
        counts = np.diff(begins)[codes]
        ends = np.cumsum(counts)
        shift = np.repeat(begins[codes] - (ends - counts), counts)
        out = ids[np.arange(len(shift)) + shift]
        words = np.searchsorted(at, offsets)
        return out, np.append(0, ends)[words]


class _Packer:
    """Bins of one task. Rows are (example, start, length, bin, offset)."""

    def __init__(self, first_bin: int, limits: tuple[int, int, int]) -> None:
        self.limits = np.array(limits, np.int64)
        self.bin, self.rows = first_bin, []
        self.examples: list[int] = []
        self.spans = np.zeros((0, 3), np.int64)  # start, end, first token that bears loss
        self.open()

    def open(self) -> None:
        self.left, self.content = self.limits.copy(), []

    def vectors(self) -> np.ndarray:
        start, end, loss = self.spans.T
        out = np.ones((len(self.spans), 3), np.int64)
        out[:, 0] = end - start
        out[:, 2] = np.maximum(end - np.maximum(start, loss), 0)
        return out

    def put(self, k: int, n: int) -> None:
        """The first ``n`` tokens of example ``k`` go into the open bin."""
        start, end, loss = self.spans[k]
        self.content.append((self.examples[k], int(start), n))
        self.left -= (n, 1, max(int(start) + n - max(int(start), int(loss)), 0))
        if start + n == end:
            self.examples.pop(k)
            self.spans = np.delete(self.spans, k, axis=0)
        else:
            self.spans[k, 0] += n

    def close(self) -> None:
        at = 0
        for example, start, n in self.content:
            self.rows.append((example, start, n, self.bin, at))
            at += n
        self.bin += 1
        self.open()

    def fill(self, least: int) -> None:
        """Close bins while more than ``least`` examples wait."""
        while len(self.examples) > least:
            vectors = self.vectors()
            fits = np.flatnonzero((vectors <= self.left).all(axis=1))
            gain = (vectors / self.limits) @ (self.left / self.limits)
            if len(fits):
                k = int(fits[np.argmax(gain[fits])])
                self.put(k, int(vectors[k, 0]))
            elif self.left[:2].min() > 0:
                # As much of the largest as tokens and loss allow; none if loss allows none.
                start, _, loss = self.spans[:, 0], None, self.spans[:, 2]
                room = np.minimum(self.left[0], np.maximum(loss - start, 0) + self.left[2])
                room = np.minimum(room, vectors[:, 0])
                if room.max() <= 0:
                    self.close()
                    continue
                k = int(np.argmax(np.where(room == room.max(), gain, -1)))
                self.put(k, int(room[k]))
            if self.left[:2].min() <= 0:
                self.close()

    def finish(self) -> None:
        """The rest goes to bins whose sizes are powers of two, the largest first."""
        self.fill(0)
        content, total = self.content, sum(x[2] for x in self.content)
        self.open()
        sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        for size in sizes:
            while size:
                example, start, n = content.pop(0)
                cut = min(n, size)
                self.content.append((example, start, cut))
                size -= cut
                if cut < n:
                    content.insert(0, (example, start + cut, n - cut))
            self.close()


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    prompt_tokens: str | None = None,
    tokens: int = TOKENS,
    segments: int = SEGMENTS,
    loss_tokens: int = TOKENS,
    window: int = WINDOW,
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A sequence has at most ``tokens`` tokens, ``segments`` pieces and ``loss_tokens`` tokens
    that bear loss, which are a document's from its ``prompt_tokens``-th on (all, without
    that column; null counts 0). Each document's ids end with 2 and lie in exactly one piece
    each; a null or empty text is this one id. Rows that repeat an id are packed each. Other
    columns are not looked at. An empty table gives no sequence. Sequences are made in the
    tasks that read the texts: nothing is shuffled, and a task holds ``window`` documents
    beside the batch that it reads. With ``with_ids`` a piece has its ids too.
    """
    if min(tokens, segments, loss_tokens, window) < 1:
        raise ValueError("limits must be 1 or more")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    prompt = F.coalesce(F.col(f"`{prompt_tokens}`"), F.lit(0)) if prompt_tokens else F.lit(0)
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
        prompt.cast("long").alias("prompt"),
    )
    fields = [T.StructField(x, T.LongType()) for x in names]
    fields[0] = rows.schema["doc_id"]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    limits = (tokens, segments, loss_tokens)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        encoder = WordEncoder(tokenizer or public_tokenizers.path(TOKENIZER), added_tokens=True)
        packer = _Packer(TaskContext.get().partitionId() << 40, limits)
        held: dict[int, np.ndarray] = {}
        keys: dict[int, object] = {}
        count = 0

        def taken() -> pa.RecordBatch:
            done, packer.rows = packer.rows, []
            parts = [held[k][at : at + n] for k, at, n, _, _ in done]
            out = [
                pa.array([keys[x[0]] for x in done], kind),
                *[pa.array([x[i] for x in done], pa.int64()) for i in (1, 2)],
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()),
                pa.array([len(held[x[0]]) for x in done], pa.int64()),
                *[pa.array([x[i] for x in done], pa.int64()) for i in (3, 4)],
            ]
            if with_ids:
                out.append(pa.array([x.tolist() for x in parts], pa.list_(pa.int64())))
            alive = {*packer.examples, *[x[0] for x in packer.content]}
            for k in [k for k in held if k not in alive]:
                del held[k], keys[k]
            return pa.RecordBatch.from_arrays(out, names=names + ["ids"] * with_ids)

        for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
            kind = batch.column(0).type
            ids, bounds = encoder.texts(batch.column(1))
            loss = batch.column(2).to_numpy(zero_copy_only=False)
            added = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                held[count] = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(END_ID))
                keys[count] = key
                added.append((count, len(held[count]), int(loss[i])))
                count += 1
                if len(added) >= window or i + 1 == batch.num_rows:
                    packer.examples += [x[0] for x in added]
                    packer.spans = np.vstack(
                        [packer.spans, np.array([(0, n, f) for _, n, f in added], np.int64)]
                    )
                    added = []
                    packer.fill(window)
                    if packer.rows:
                        yield taken()
        packer.finish()
        if packer.rows:
            yield taken()

    return rows.mapInArrow(task, T.StructType(fields))
