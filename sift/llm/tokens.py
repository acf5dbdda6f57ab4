"""Token ids of whole texts by a public byte-level BPE, each distinct piece encoded once.

The tokenizer splits a text into pieces by a fixed pattern and encodes each
piece by itself.  Texts of Latin letters without an apostrophe are split here,
with NumPy, by the same rule; a piece (told by a 64-bit hash) is handed to the
tokenizers library the first time a worker meets it.  Any other text goes to the
library whole.  The ids are those of ``Tokenizer.encode`` with
add_special_tokens=False, special tokens' strings being ordinary text.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from sift.llm.bytewords import U, chunks, span_hashes

SIMPLE = 0x250  # code points below are split here
MEMO_WORDS = 3 << 20
TABLE = 1 << 22
JOINED = 500
CHUNK = 1 << 22

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def _classes() -> np.ndarray:
    out = np.zeros(SIMPLE, np.uint8)
    for c in range(SIMPLE):
        kind = unicodedata.category(chr(c))[0]
        if c in (0x20, 0x85, 0xA0) or 0x09 <= c <= 0x0D:
            out[c] = SPACE
        elif kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    return out


CLASS = _classes()


def piece_starts(codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the pieces of concatenated texts (offsets in code points, all below SIMPLE, no apostrophe).

    A run of letters, of numbers or of other signs is a piece, with one blank before it if there is one.
    Of a run of white space before a piece all but the last sign are a piece; the last is a piece of its
    own unless it is a blank.  White space at the end of a text is one piece.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    cls = CLASS[codes]
    edge = np.ones(n, bool)
    edge[1:] = cls[1:] != cls[:-1]
    text_start = np.zeros(n + 1, bool)
    text_start[offs] = True
    edge |= text_start[:n]
    runs = np.flatnonzero(edge)
    ends = np.append(runs[1:], n)
    space = cls[runs] == SPACE
    before_piece = space & ~text_start[ends]  # white space that another run of the text follows
    last_blank = codes[ends - 1] == 0x20
    mark = np.zeros(n + 1, bool)
    mark[runs[space]] = True
    mark[ends[before_piece] - 1] = True
    # a piece starts at its run, or at the blank before it
    mark[ends[before_piece & ~last_blank]] = True
    piece = ~space
    follows_space = np.zeros(len(runs), bool)
    follows_space[1:] = before_piece[:-1]
    mark[runs[piece & ~follows_space]] = True
    return np.flatnonzero(mark[:n])


class Memo:
    """Ids of the pieces met so far: an arena of ids and a hash table of piece hashes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 0xFFFF:
            raise ValueError("ids must fit in 16 bits")
        self.reset()

    def reset(self):
        self.n = self.used = 0
        self.keys = np.zeros(1 << 16, U)
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.arena = np.zeros(1 << 18, np.uint16)
        #: slot + 1 of the piece whose hash ends in these bits, if it was the last to come here
        self.at = np.zeros(TABLE, np.int32)
        self.rest: dict[int, int] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, texts: list[str], joint: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each) of pieces that stay pieces when they are joined: fewer, longer calls."""
        if not texts:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        step = 2 if joint else 1
        groups = [texts[i: i + JOINED] for i in range(0, len(texts), JOINED)]
        ids, counts = [], []
        for group, e in zip(groups, self.tokenizer.encode_batch([joint.join(g) + joint for g in groups], add_special_tokens=False)):
            word = np.array(e.word_ids, np.int64)
            count = np.bincount(word, minlength=len(group) * step)
            if len(count) != len(group) * step or not count.all():
                raise RuntimeError("the tokenizer split joined pieces in another way")
            got = np.array(e.ids, np.uint16)
            ids.append(got[word % 2 == 0] if joint else got)
            counts.append(count[::step])
        return np.concatenate(ids), np.concatenate(counts)

    def _single(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.encode(texts)
        return np.concatenate([np.zeros(0, np.uint16), *got]), np.array([len(x) for x in got], np.int64)

    def add(self, keys: np.ndarray, texts: list[str], kind: np.ndarray) -> np.ndarray:
        """Slots of new pieces; kind 0: a blank before other signs, 1: no white space, 2: only that."""
        parts, length = [], np.empty(len(texts), np.int64)
        order = np.argsort(kind, kind="stable")
        for k, run in ((0, lambda x: self._joined(x, "")), (1, lambda x: self._joined(x, "\n")), (2, self._single)):
            at = np.flatnonzero(kind == k)
            ids, length[at] = run([texts[i] for i in at.tolist()])
            parts.append(ids)
        n, used = self.n + len(texts), self.used + int(length.sum())
        while n > len(self.keys):
            self.keys, self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.start, self.length))
        while used > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        self.arena[self.used: used] = np.concatenate(parts)
        slot = np.arange(self.n, n)
        self.keys[slot], self.length[slot] = keys, length
        # the arena has the pieces by kind
        self.start[slot[order]] = self.used + np.cumsum(length[order]) - length[order]
        low = (keys & U(TABLE - 1)).astype(np.int64)
        free = self.at[low] == 0
        self.at[low[free]] = slot[free] + 1
        rest = self.at[low] != slot + 1  # another piece has the place
        self.rest.update(zip(keys[rest].tolist(), slot[rest].tolist()))
        self.n, self.used = n, used
        return slot

    def slots(self, h: np.ndarray, text: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of the pieces [start, end) of ``text`` with the hashes ``h``."""
        if self.n > MEMO_WORDS:
            self.reset()
        slot = self.at[(h & U(TABLE - 1)).astype(np.int64)].astype(np.int64) - 1
        away = np.flatnonzero((slot < 0) | (self.keys[slot] != h))
        if len(away):
            keys, first, back = np.unique(h[away], return_index=True, return_inverse=True)
            found = np.array([self.rest.get(k, -1) for k in keys.tolist()], np.int64)
            new = np.flatnonzero(found < 0)
            if len(new):
                at = away[first[new]]
                kind = np.where(CLASS[codes[ends[at] - 1]] == SPACE, 2, np.where(codes[starts[at]] == 0x20, 0, 1))
                found[new] = self.add(keys[new], [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())], kind)
            slot[away] = found[back]
        return slot


_memos: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    if path not in _memos:
        _memos[path] = Memo(path)
    return _memos[path]


def _simple_ids(m: Memo, text: str, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each text) of concatenated simple texts."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = piece_starts(codes, offs)
    if not len(starts):
        return np.zeros(0, np.uint16), np.zeros(len(offs) - 1, np.int64)
    ends = np.append(starts[1:], len(codes))
    # code points below SIMPLE are two bytes each
    h = span_hashes(codes.astype("<u2").view(np.uint8), 2 * starts, 2 * ends, lower=False)
    slot = m.slots(h, text, codes, starts, ends)
    length = m.length[slot]
    stop = np.cumsum(length)
    ids = m.arena[np.repeat(m.start[slot] - (stop - length), length) + np.arange(int(stop[-1]))]
    total = np.append(0, stop)
    return ids, np.diff(total[np.searchsorted(starts, offs)])


def encode_column(path: str, column, end_id: int):
    """Yield (ids, count of each text) of a string column, the end id after each text; null is the empty text."""
    m = memo(path)
    for _, _, buf, offs in chunks(column, CHUNK):
        inner = np.flatnonzero((buf & 0xC0) == 0x80)  # bytes inside a code point
        # a code point of SIMPLE or more starts with a byte of 0xC9 or more: 0xC9 0x90 is 0x250
        hard = (buf >= 0xCA) | (buf == 0x27)
        if len(buf):
            at = np.flatnonzero(buf[:-1] == 0xC9)
            hard[at[buf[at + 1] >= 0x90]] = True
        simple = np.diff(np.searchsorted(np.flatnonzero(hard), offs)) == 0
        n_codes = offs - np.searchsorted(inner, offs)
        rows = len(offs) - 1
        if simple.all():
            ids, count = _simple_ids(m, buf.tobytes().decode(), n_codes)
        else:
            keep = np.flatnonzero(simple)
            text = b"".join(buf[offs[r]: offs[r + 1]].tobytes() for r in keep.tolist()).decode()
            easy, easy_count = _simple_ids(m, text, np.append(0, np.cumsum(np.diff(n_codes)[keep])))
            whole = m.encode([buf[offs[r]: offs[r + 1]].tobytes().decode() for r in np.flatnonzero(~simple).tolist()])
            count = np.zeros(rows, np.int64)
            count[keep] = easy_count
            count[~simple] = [len(x) for x in whole]
            parts = np.split(easy, np.cumsum(easy_count)[:-1]) if len(keep) else []
            parts, whole = iter(parts), iter(whole)
            ids = np.concatenate([next(parts) if s else next(whole) for s in simple.tolist()])
        stop = np.cumsum(count + 1) - 1
        out = np.empty(len(ids) + rows, np.uint16)
        inside = np.ones(len(out), bool)
        inside[stop] = False
        out[inside] = ids
        out[stop] = end_id
        yield out, count + 1
