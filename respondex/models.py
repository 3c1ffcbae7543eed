"""Embedding models: what a name stands for, and the offline stand-in."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

# One call embeds a list of texts, as a list of vectors or as the rows of a matrix. A text
# it cannot embed may come back as None.
BatchFunction = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]

# Fixed value: the instruction that goes before a question (never before an answer).
RETRIEVAL_PREFIX = "Represent this sentence for searching relevant passages: "


@dataclass(frozen=True)
class Model:
    """How texts and questions of one model become vectors.

    ``load`` runs once per task and returns the batch function, so a heavy model is read
    once and not per text. It must be picklable. ``source`` is where the model's answer
    vectors can be had, on any path Spark reads.
    """

    name: str
    dim: int
    normalize: bool = False
    query_prefix: str = ""
    load: Callable[[], BatchFunction] | None = None
    batch_size: int = 256
    source: str | None = None

    def using(
        self, load: Callable[[], BatchFunction] | None = None, source: str | None = None
    ) -> Model:
        """The same model with an embedding function, a source of vectors, or both."""
        return replace(self, load=load or self.load, source=source or self.source)


# Names, widths and prefixes. "mxbai" is the pair of plain vectors and
# plain questions, "mxbai_norm" the pair in which both have length one.
MODELS = {
    "mxbai": Model("mxbai", 1024, normalize=False, query_prefix=RETRIEVAL_PREFIX),
    "mxbai_norm": Model("mxbai_norm", 1024, normalize=True, query_prefix=RETRIEVAL_PREFIX),
    "openai": Model("openai", 1536),
}


def model(name: str) -> Model:
    """Look a model up; an unknown name is an error, not a silent default."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(MODELS))}")
    return MODELS[name]


# Distinct words whose buckets a task remembers at once.
_KNOWN_WORDS = 1 << 20


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    import regex

    # Surrogates are no characters of any text; here blanks stand for them.
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    points[0xD800:0xE000] = ord(" ")
    out = np.zeros(len(points), bool)
    for found in regex.finditer(r"\p{L}+", points.tobytes().decode("utf-32-le")):
        out[found.start() : found.end()] = True
    return out


def _words(texts: Sequence[str], letters: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Which text each word is in, and the words: all runs of letters.

    Borders are found in arrays of all characters. Runs of letters and what lies between
    them are then alternating slices of the texts' bytes.
    """
    line = "\0".join(texts) + "\0"
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters[points]
    changes = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    sizes = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.cumsum(sizes, dtype=np.int64)
    edges = np.concatenate([[0], ends[changes - 1], ends[-1:]])
    data = pa.py_buffer(line.encode("utf-8", "surrogatepass"))
    runs = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), data)
    first = 0 if letter[0] else 1
    starts = np.concatenate([[0], changes])[first::2]
    ended = np.cumsum([len(t) + 1 for t in texts]) - 1
    return np.searchsorted(ended, starts), runs[first::2].dictionary_encode()


def _count_words(dim: int) -> BatchFunction:
    known: dict[str, int] = {}
    letters = _letters()

    def bucket(word: str) -> int:
        found = known.get(word)
        if found is None:
            if len(known) >= _KNOWN_WORDS:
                known.clear()
            found = int(hashlib.md5(word.lower().encode()).hexdigest()[:8], 16) % dim
            known[word] = found
        return found

    def embed(texts: Sequence[str]) -> np.ndarray:
        """All texts at once; each distinct word is hashed once."""
        if not len(texts):
            return np.zeros((0, dim))
        row, words = _words(texts, letters)
        buckets = np.array([bucket(w) for w in words.dictionary.to_numpy(zero_copy_only=False)], np.int64)
        at = row * dim + (buckets[words.indices.to_numpy()] if len(row) else row)
        counts = np.bincount(at, minlength=len(texts) * dim)
        return counts.reshape(len(texts), dim).astype(np.float64)

    return embed


def word_count_model(dim: int, name: str = "words", **options) -> Model:
    """The offline stand-in: words hashed to ``dim`` buckets and counted.

    It finds shared words, not shared meaning.
    """

    def load() -> BatchFunction:
        return _count_words(dim)

    return Model(name, dim, load=load, **options)
