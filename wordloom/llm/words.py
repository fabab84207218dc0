"""Word boundaries and word hashes of whole texts, as numpy arrays.

A batch of texts becomes one byte buffer; words are found by comparing bytes
with the separators, and every word gets a 64-bit hash of its bytes: a
polynomial in an odd base modulo 2**64, read off prefix sums, then mixed.
Equal words have equal hashes in every task.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BLOCK = 1 << 20            # bytes hashed at a time; a longer word extends its block

# bytes that are no letter, digit or part of a multi-byte character become a blank
LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[size] = tuple(
                np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, b, np.uint64)))) for b in (_BASE, inverse))
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of a splitmix generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash_block(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(a))
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)])))
        return mix((total[ends] - total[starts]) * inverse[starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text.

    Returns (hash of each word, index of each text's first word with the word
    count appended, the joined buffer, start and end of each word in it).
    """
    data = b"\n".join(texts)
    a = np.frombuffer(data, np.uint8)
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        base = starts[done]
        upto = max(int(np.searchsorted(ends, base + _BLOCK, "right")), done + 1)
        hashes[done:upto] = _hash_block(a[base: ends[upto - 1]], starts[done:upto] - base, ends[done:upto] - base)
        done = upto
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    first = np.searchsorted(starts, begins)
    first[-1] = len(starts)
    return hashes, first, data, starts, ends


def batches(texts: list, most: int = 4 << 20):
    """Slices (from, to) of a list of strings with about ``most`` characters each, one text at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def column_slices(column, most: int = 1 << 20):
    """(from, to, texts) of slices of an Arrow string column with about ``most`` bytes each, one text at least.

    Only one slice at a time is held as Python strings.
    """
    import pyarrow.compute as pc
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        upto = max(int(np.searchsorted(ends, before + most, "right")), at + 1)
        yield at, upto, column.slice(at, upto - at).to_pylist()
        at = upto


def word_blocks(data: bytes, size: int = 4 << 20):
    """Lists of the words of one text, so many bytes of it at a time; no word is cut."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            tail = data[end:end + 4096]
            while end + len(tail) < len(data) and not tail.split(None, 1)[1:] and not tail[:1].isspace():
                tail = data[end:end + 2 * len(tail)]  # a very long word
            cut = next((i for i, b in enumerate(tail) if b == 32 or 9 <= b <= 13), len(tail))
            end += cut
        yield data[at:end].split()
        at = end
