"""Hashes of all words of an Arrow batch of texts, computed on the bytes with numpy.

A word's hash is a polynomial in its bytes modulo 2**64, taken as a difference of running sums and then
mixed, so no Python object exists per word. Texts are worked off in slices of a few MB.
"""

from __future__ import annotations

import numpy as np

SLICE_BYTES = 2 << 20
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def blanks() -> np.ndarray:
    """Separators of the plain word rule: the six ASCII blanks."""
    mask = np.zeros(256, bool)
    mask[[0x20, *range(0x09, 0x0E)]] = True
    return mask


def non_letters() -> np.ndarray:
    """Separators that leave runs of ASCII letters and of characters beyond ASCII."""
    mask = np.ones(256, bool)
    mask[0x41:0x5B] = mask[0x61:0x7B] = mask[0x80:] = False
    return mask


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    return _POWERS[base][:n]


def slices(texts):
    """(first row, bytes, offsets) for runs of rows of about SLICE_BYTES. ``texts``: an Arrow string array; null is empty."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    blob = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        last = min(last, len(texts))
        yield row, blob[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row]
        row = last


def _words(blob: np.ndarray, offsets: np.ndarray, separators: np.ndarray, fold: bool):
    """(folded bytes, starts, ends, row) of the words of a blob that is not empty."""
    n, rows = len(blob), len(offsets) - 1
    if fold:
        blob = np.where((blob >= 0x41) & (blob <= 0x5A), blob + 32, blob).astype(np.uint8)
    gap = separators[blob]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return blob, starts, ends, np.minimum(np.searchsorted(offsets[1:], starts, "right"), rows - 1)


def _hasher(blob: np.ndarray):
    """A function from starts and ends to the hashes of the bytes between them."""
    n = len(blob)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * _powers(_STEP, n), out=sums[1:])

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (sums[ends] - sums[starts]) * _powers(_BACK, n)[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    return hashes


def word_hashes(blob: np.ndarray, offsets: np.ndarray, separators: np.ndarray, fold: bool = True):
    """(hash of each word, row of each word) in text order; ``fold`` lower-cases A-Z."""
    if not len(blob):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blob, starts, ends, row = _words(blob, offsets, separators, fold)
    return _hasher(blob)(starts, ends), row


def word_and_prefix_hashes(blob: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lengths):
    """(hash of each word, its row), and for each of ``lengths`` (hash, row) of the first so many characters of the words that have them."""
    if not len(blob):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return none, [none] * len(lengths)
    blob, starts, ends, row = _words(blob, offsets, separators, True)
    hashes = _hasher(blob)
    leads = (blob & 0xC0) != 0x80  # the first byte of each character
    number = np.cumsum(leads)[starts] - 1
    leads = np.flatnonzero(leads)
    leads = np.append(leads, len(blob))
    prefixes = []
    for k in lengths:
        upto = leads[np.minimum(number + k, len(leads) - 1)]
        whole = (number + k < len(leads)) & (upto <= ends)
        prefixes.append((hashes(starts[whole], upto[whole]), row[whole]))
    return (hashes(starts, ends), row), prefixes


def shingle_hashes(words: np.ndarray, row: np.ndarray, rows: int, width: int):
    """(hash, row) of every run of ``width`` words; a row with fewer words, but some, gives one for all of them."""
    step, odd = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
    counts = np.bincount(row, minlength=rows)
    m = len(words)
    full = np.zeros(0, np.uint64)
    full_row = np.zeros(0, np.int64)
    if m >= width:
        acc = words[:m - width + 1].copy()
        for k in range(1, width):
            acc = mix(acc * step + words[k:m - width + 1 + k])
        same = row[:m - width + 1] == row[width - 1:]
        full, full_row = acc[same], row[:m - width + 1][same]
    short = np.flatnonzero((counts > 0) & (counts < width))
    first = np.searchsorted(row, short)
    acc = words[first] * odd if len(first) else np.zeros(0, np.uint64)
    for k in range(1, width - 1):
        more = counts[short] > k
        acc[more] = mix(acc[more] * step + words[first[more] + k])
    acc = mix(acc + counts[short].astype(np.uint64) * odd)
    return np.concatenate([full, acc]), np.concatenate([full_row, short])


def distinct_sorted(values: np.ndarray, row: np.ndarray, rows: int):
    """(values, bounds): row r's distinct values, ascending, are values[bounds[r]:bounds[r + 1]]."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(rows + 1))
