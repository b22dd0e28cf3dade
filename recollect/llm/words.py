"""Words of Arrow string columns, without a Python object for each word.

A run of texts is split in Arrow, its words become codes into a dictionary of the distinct ones, and whatever is costly for a
word (a hash, token ids) is worked out once for each distinct word of the run. Nothing is remembered from one run to the next, so
the memory of a worker follows the run, or the one text that is longer than a run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
RUN = 4_000_000


def runs(texts: pa.Array, most: int = RUN) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive slices of about `most` bytes; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, upto
        at = upto


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between white space (space, \\t, \\n, \\v, \\f, \\r): text i has codes[offsets[i]:offsets[i + 1]], which count into the
    dictionary of distinct words. A null text has none. lower: A-Z in lower case."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if blank >= 0:  # before leading and after trailing white space
        real = codes != blank
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return offsets, codes, coded.dictionary


def hash_each(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    import xxhash

    at, data = _buffers(words)
    digest = xxhash.xxh3_64_intdigest
    ends = at.tolist()
    return np.fromiter((digest(data[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)), np.uint64, len(words))


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    """The same hash of each word of a list."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text, and the hashes of all their words."""
    offsets, codes, words = split_words(texts, lower)
    return offsets, hash_each(words)[codes]


def _buffers(strings: pa.Array) -> tuple[np.ndarray, memoryview]:
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    _, ends, data = strings.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    return at.astype(np.int64), memoryview(data) if data is not None else memoryview(b"")


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of strings without nulls."""
    at, data = _buffers(strings)
    return at, np.frombuffer(data, np.uint8)


def pick_lists(values: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists values[offsets[c]:offsets[c + 1]] of all codes one after the other, and where each begins (and the last ends)."""
    size = (offsets[1:] - offsets[:-1])[codes]
    at = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(at[-1])
    index += np.repeat(offsets[codes] - at[:-1], size)
    return values[index], at
