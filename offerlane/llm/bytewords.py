"""Words of texts by byte classes, as numpy arrays over Arrow buffers.

All classes are of ASCII bytes, and bytes of other characters are from 0x80 on, so
bytes can be looked at one by one. Memory is about 30 times the bytes that are
looked at together: slices() cuts batches, and only a single text longer than
STEP is more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together.
STEP = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(inside) -> np.ndarray:
    """A lookup table: which bytes are in the class."""
    found = np.zeros(256, bool)
    found[list(inside)] = True
    return found


def slices(batch: pa.RecordBatch, text: str = "text"):
    """The batch in slices of about STEP bytes of text, a row at least."""
    ends, at = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
        yield batch.slice(at, end - at)
        at = end


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, A-Z in lower case, and the places where texts begin and end."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return LOWER[raw], at - at[0]


def word_places(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the runs of bytes inside start and stop, none over the end of a text, and
    the number of the first word of each text, and of all."""
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    cut = at[(at > 0) & (at < len(inside))]
    before[cut] = False
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, at)


def word_strings(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The words as strings."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (FNV-1a)."""
    sizes = stops - starts
    found = np.full(len(starts), 0xCBF29CE484222325, np.uint64)
    own, k = np.arange(len(starts)), 0
    while len(own):
        found[own] = (found[own] ^ data[starts[own] + k]) * np.uint64(0x100000001B3)
        k += 1
        own = own[sizes[own] > k]
    return found


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width words, never 0."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    found = np.full(n, width, np.uint64)
    for k in range(width):
        found = (found ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    found[found == 0] = 1
    return found


def planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte by byte of their size: high bytes are mostly equal and compress to nothing."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def packed(*blobs: bytes) -> bytes:
    """Some bytes as one compressed blob."""
    import zstandard

    head = np.array([len(blobs), *map(len, blobs)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(blobs))


def unpacked(blob: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<i8", n, 8)) + 8 * (n + 1)
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist())]
