"""Words of whole texts as NumPy arrays over an Arrow string column.

All word classes of this package are classes of single ASCII bytes, so words
are found on the UTF-8 bytes themselves.  A word's hash takes its bytes in blocks
of eight, each mixed in before the next (no sums that patterns of a word could
cancel); words are equal when their 64-bit hashes are (about n**2 / 2**65 expected
collisions for n distinct words; none among words of one length up to 8 bytes).  Texts are handled in chunks of about ``CHUNK`` bytes (a
longer text is a chunk of its own), so memory does not follow the batch.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21
PIECE = 1 << 20
SEED = 0xD6E8FEB86659FD93
LONG = 256
U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
#: words `[^\x20\x09-\x0D]+`
NOT_SPACE = SPACES
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text
LETTER_DIGIT = np.zeros(256, bool)
LETTER_DIGIT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_pow = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for i, b in enumerate((BASE, BASE_INV)):
            steps = np.full(n, b, U)
            steps[0] = 1
            _pow[i] = np.multiply.accumulate(steps)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h = h ^ (h >> U(27))
    h = h * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of bytes; spans ascend and do not overlap.

    A span is taken in blocks of 8 bytes, each mixed into the hash before the next; a span of more than
    ``LONG`` bytes by a cryptographic hash.
    """
    length = ends - starts
    out = mix(length.astype(U) * U(SEED))
    if not len(out):
        return out
    a, b = int(starts[0]), int(ends[-1])
    part = LOWER[buf[a:b]] if lower else buf[a:b]
    words = np.zeros((b - a) // 8 + 2, "<u8")
    words.view(np.uint8)[: b - a] = part
    starts = starts - a
    at = np.flatnonzero((length > 0) & (length <= LONG))
    pos, left = starts[at], length[at]
    while len(at):
        q, r = pos >> 3, ((pos & 7) << 3).astype(U)
        block = (words[q] >> r) | ((words[q + 1] << (U(63) - r)) << U(1))
        short = np.minimum(left, 8).astype(U) << U(3)
        block &= ~U(0) >> (U(64) - short)
        out[at] = mix(out[at] ^ block)
        more = left > 8
        at, pos, left = at[more], pos[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG).tolist():
        data = np.ascontiguousarray(part[int(starts[i]): int(starts[i] + length[i])])
        out[i] = int.from_bytes(blake2b(data, digest_size=8).digest(), "little")
    return out


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0]: offs[-1]], offs - offs[0]


def chunks(column, size: int = CHUNK):
    """Yield (first row, end row, bytes, offsets) over whole texts of about ``size`` bytes."""
    buf, offs = text_buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j, buf[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
    """(starts, ends, first word of each text + total) of the words; no word crosses texts."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = is_word[buf]
    change = np.empty(len(buf) + 1, bool)
    change[0], change[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    cuts = offs[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(buf))])
    joined = cuts[inside[cuts] & inside[cuts - 1]]
    edges = np.flatnonzero(change)
    if len(joined):  # a word that runs over the end of a text is two words
        edges = np.sort(np.concatenate([edges, joined, joined]))
    starts, ends = edges[0::2], edges[1::2]
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf, offs, is_word, lower: bool = True):
    """(hashes, starts, ends, first word of each text + total)."""
    starts, ends, first = word_spans(buf, offs, is_word)
    return span_hashes(buf, starts, ends, lower), starts, ends, first


_GRAM = [U(int(x) | 1) for x in _rng.integers(1, 2**63, 64, dtype=np.uint64)]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (``len(h) - k + 1`` values)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n] * _GRAM[0]
    for j in range(1, k):
        out += h[j: j + n] * _GRAM[j % 64] + U(j)
    return mix(out)


def row_of(first: np.ndarray) -> np.ndarray:
    """Text index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
