"""Terms of whole texts as packed machine words.

A term is a maximal run of bytes of a class; ASCII capitals are lowered.  Every
class used here takes all bytes from 0x80 on, so a run of bytes is a run of
characters.  No term has a zero byte, so up to eight bytes, padded with zeros
behind, are one ``uint64`` whose order is the order of the bytes.
"""

from __future__ import annotations

import numpy as np

PAD = 16    # zero bytes behind a buffer, so that every term can be read as two words

_MASK = np.array([0] + [((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(1, 9)], np.uint64)


def byte_class(digits: bool) -> np.ndarray:
    """A table byte -> lowered byte, zero for bytes that are in no term."""
    low = np.zeros(256, np.uint8)
    low[0x41:0x5B] = low[0x61:0x7B] = np.arange(0x61, 0x7B)
    low[0x80:] = np.arange(0x80, 0x100)
    if digits:
        low[0x30:0x3A] = np.arange(0x30, 0x3A)
    return low


LETTERS = byte_class(digits=False)
LETTERS_AND_DIGITS = byte_class(digits=True)


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null is an empty text."""
    import pyarrow as pa
    column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 4 << 20):
    """(first, last + 1) of runs of texts with about ``most`` bytes each, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = max(int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1, at + 1)
        yield at, upto
        at = upto


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(lowered bytes with PAD zeros behind, start and end of every term, text of every term)."""
    low = np.zeros(len(data) + PAD, np.uint8)
    np.take(table, data, out=low[: len(data)])
    inside = low[: len(data)] != 0
    if not inside.any():
        none = np.empty(0, np.int64)
        return low, none, none, none
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    some = offsets[1:] > offsets[:-1]                   # a term ends where its text ends
    first, last = offsets[:-1][some], offsets[1:][some] - 1
    begins[first] = inside[first]
    stops[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return low, starts, ends, text


def packed(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: int = 0) -> np.ndarray:
    """Bytes ``at`` to ``at + 8`` of the terms as ``uint64``; what lies behind a term's end is zero."""
    window = np.ndarray((len(low) - 7,), ">u8", low.data, strides=(1,))
    return window[starts + at].astype(np.uint64) & _MASK[np.clip(lengths - at, 0, 8)]


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order by ``words`` (least significant first), sixteen bits at a time."""
    order = None
    for word in words:
        for shift in range(0, 8 * word.dtype.itemsize, 16):
            digit = (word if order is None else word[order]) >> word.dtype.type(shift)
            digit = digit.astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                step = np.argsort(digit, kind="stable")     # numpy sorts 16-bit numbers by radix
                order = step if order is None else order[step]
    return np.arange(len(words[0])) if order is None else order


def fresh(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before it in any of the columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def unpacked(words: list[np.ndarray]) -> np.ndarray:
    """The bytes of packed terms, as numpy byte strings."""
    wide = np.empty((len(words[0]), len(words)), ">u8")
    for i, w in enumerate(words):
        wide[:, i] = w
    return wide.view(f"S{8 * len(words)}").ravel()
