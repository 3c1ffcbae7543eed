"""Hashes of all words of a batch of texts at once, for code that runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well mixing bijection of 64-bit numbers; another one for each salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.where(_SPACE, np.uint64(0), mix(np.arange(256, dtype=np.uint64), 1) | np.uint64(1))


def _solid(data: np.ndarray) -> np.ndarray:
    """Which bytes are not white space; compared and not looked up, many bytes at once."""
    return (data - np.uint8(9) > 4) & (data != 32)


def slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``most`` bytes of text; a row is never cut."""
    sizes = np.diff(offsets_of(batch.column(text))[0])
    part = np.cumsum(sizes) // most if len(sizes) else sizes
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def offsets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (from 0) and bytes of the texts; nulls are empty."""
    filled = texts.fill_null("").cast(pa.large_binary())
    if not len(filled):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset :][: len(filled) + 1]
    body = filled.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def words_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the bounds of each text's words.

    A word's hash sums random numbers of its bytes, each times a power that its place gives.
    """
    solid = _solid(data)
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    starts[heads] = solid[heads]
    at = np.flatnonzero(starts)
    bounds = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), bounds
    lengths = np.diff(np.append(at, len(data)))
    place = np.arange(at[0], len(data)) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _MULTIPLIER))
        terms = _BYTES[data[at[0] :]] * powers[place]
        return mix(np.add.reduceat(terms, at - at[0]), 2), bounds


#: Words of more bytes are hashed byte by byte.
_SHORT = 64
_SIZES = mix(np.arange(_SHORT + 2, dtype=np.uint64), 3)
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def words_by_eights(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``words_of``, with other hashes: eight bytes of each word are mixed at once."""
    solid = _solid(data)
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    starts[heads] = solid[heads]
    inner = heads[heads > 0]
    ends[inner - 1] = solid[inner - 1]
    at = np.flatnonzero(starts)
    bounds = np.searchsorted(at, offsets)
    sizes = np.flatnonzero(ends) + 1 - at
    padded = np.append(data, np.zeros(8, np.uint8))
    # Entry k has the bytes k to k + 7.
    eights = np.ndarray((len(data) + 1,), np.uint64, padded, strides=(1,))
    sized = _SIZES[np.minimum(sizes, _SHORT + 1)]
    # The first eight bytes of all words, then the next ones of those that have more.
    out = mix(sized ^ (eights[at] & _FIRST[np.minimum(sizes, 8)]), 4)
    done = 8
    short = np.flatnonzero((sizes > done) & (sizes <= _SHORT))
    while len(short):
        left = np.minimum(sizes[short] - done, 8)
        out[short] = mix(out[short] ^ (eights[at[short] + done] & _FIRST[left]), 4)
        done += 8
        short = short[sizes[short] > done]
    for k in np.flatnonzero(sizes > _SHORT):
        own = data[at[k] : at[k] + sizes[k]]
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(len(own), _MULTIPLIER))
            size = mix(sizes[k : k + 1].astype(np.uint64), 3)
            out[k] = mix(size ^ (_BYTES[own] * powers).sum(dtype=np.uint64), 5)[0]
    return out, bounds


def order_of(group: np.ndarray, n_groups: int, value: np.ndarray) -> np.ndarray:
    """The order by group, then value, from one sort of their leading bits."""
    bits = np.uint64(max(1, (n_groups - 1).bit_length()))
    key = (group.astype(np.uint64) << (np.uint64(64) - bits)) | (value >> bits)
    order = np.argsort(key)
    key, value_there = key[order], value[order]
    if ((key[1:] == key[:-1]) & (value_there[1:] < value_there[:-1])).any():
        return np.lexsort((value, group))
    return order


def lines_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all lines, and the bounds of each text's lines.

    A line takes its line feed along. Each text has one line at least.
    """
    breaks = np.flatnonzero(data == 10) + 1
    texts = np.searchsorted(offsets, breaks - 1, side="right") - 1
    counts = np.bincount(texts, minlength=len(offsets) - 1) + 1
    bounds = np.append(0, np.cumsum(counts))
    edges = np.zeros(bounds[-1] + 1, np.int64)
    # Before a break lie the other breaks and the ends of earlier texts.
    edges[1 + np.arange(len(breaks)) + texts] = breaks
    edges[bounds[1:]] = offsets[1:]
    return edges, bounds
