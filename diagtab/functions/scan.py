"""Words of texts and parts of names, found in whole columns at once.

A column of texts is one array of bytes; numpy marks where words begin and end. The results are those of the expressions
``lower_words``, ``sentences`` and ``split_identifier`` in ``text.py``, for code that runs on Arrow batches inside tasks.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value

from .text import SPACE_CHARACTERS

# scanning travels with the job, so executors need no copy of the package
register_pickle_by_value(sys.modules[__name__])

_DIGIT, _SMALL, _CAPITAL = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[ord("0"):ord("9") + 1], _KIND[ord("a"):ord("z") + 1], _KIND[ord("A"):ord("Z") + 1] = _DIGIT, _SMALL, _CAPITAL
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_ENDS_SENTENCE = np.isin(np.arange(256), [ord(c) for c in ".!?"])
# the first three bytes of a space character, as many as it has
_SPACES = [tuple(c.encode()) for c in SPACE_CHARACTERS]
_SPACE_1 = np.isin(np.arange(256), [s[0] for s in _SPACES if len(s) == 1])
_SPACE_2 = np.array([s[0] << 8 | s[1] for s in _SPACES if len(s) == 2])
_SPACE_3 = np.array([s[0] << 16 | s[1] << 8 | s[2] for s in _SPACES if len(s) == 3])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of some texts, and where each text begins, with the end of the last; null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _found(data: np.ndarray, begins: np.ndarray, camel: bool, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """Runs of ASCII letters and digits from their first letter on, and the byte each begins at; ``camel`` splits them at capitals."""
    kind = _KIND[data]
    inside = kind > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = begins[(begins > 0) & (begins < len(data))]  # a run ends with its text
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    if camel:  # a capital behind a small letter or a digit
        hump = np.flatnonzero((kind[1:] == _CAPITAL) & ((kind[:-1] == _SMALL) | (kind[:-1] == _DIGIT))) + 1
        first[hump] = last[hump - 1] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    digit = np.flatnonzero(kind[start] == _DIGIT)
    if len(digit):
        letters = np.append(np.flatnonzero(kind >= _SMALL), len(data))
        start[digit] = np.minimum(letters[np.searchsorted(letters, start[digit])], end[digit])
        kept = start < end
        inside = np.cumsum(np.bincount(start, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1))[:-1] > 0
        start, end = start[kept], end[kept]
    ends = np.append(0, np.cumsum(end - start))
    letters = data[inside]
    values = pa.py_buffer((_LOWER[letters] if lower else letters).tobytes())
    large = ends[-1] >= 1 << 31
    offsets = pa.py_buffer(ends.astype(np.int64 if large else np.int32).tobytes())
    return (pa.LargeStringArray if large else pa.StringArray).from_buffers(len(start), offsets, values), start


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ASCII words of some texts in order, the place of each one's text, and the number of its sentence."""
    data, begins = _bytes(texts)
    words, start = _found(data, begins, False, lower)
    text = np.searchsorted(begins, start, "right") - 1
    # a sentence ends behind a mark that a space follows in the same text
    gap = np.flatnonzero(_ENDS_SENTENCE[data]) + 1
    gap = gap[gap < begins[np.searchsorted(begins, gap - 1, "right")]] if len(gap) else gap
    after = [np.append(data, np.zeros(3, np.uint8))[gap + k].astype(np.int64) for k in range(3)]
    two = after[0] << 8 | after[1]
    gap = gap[_SPACE_1[after[0]] | np.isin(two, _SPACE_2) | np.isin(two << 8 | after[2], _SPACE_3)]
    sentence = np.searchsorted(gap, start) - np.searchsorted(gap, begins[text])
    return words, text, sentence


def parts_of(names: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case parts of some names in order, and the place of each one's name."""
    data, begins = _bytes(names)
    parts, start = _found(data, begins, True, True)
    return parts, np.searchsorted(begins, start, "right") - 1
