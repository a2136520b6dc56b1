"""Simple-8b: ids packed into 64-bit words, each with a selector in its top four bits.

A selector tells how many ids the word holds and how wide each is; the widest runs are taken
greedily from the left.  Selector 0 is the escape: the next word holds one id of more than 60
bits as it is.  Ids are coded in frames of FRAME ids that share no word, and the word at which
each frame starts is kept, so frames are coded and decoded side by side in numpy.
"""

from __future__ import annotations

import numpy as np

FRAME = 512
#: (ids in a word, bits of an id) by selector.
SELECTORS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([n for n, _ in SELECTORS])
ESCAPE = 0
_LIMITS = np.array([1 << b for b in range(64)], np.uint64)


def _over(values: np.ndarray, shift: int) -> np.ndarray:
    """The larger of each value and the one `shift` further on in its row."""
    out = values.copy()
    np.maximum(values[:, :-shift], values[:, shift:], out=out[:, :-shift])
    return out


def _bits(ids: np.ndarray) -> np.ndarray:
    if ids.size and int(ids.max()) >= 1 << 24:
        return np.searchsorted(_LIMITS, ids, "right").astype(np.uint8)
    return np.frexp(ids.astype(np.float32))[1].astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words (uint64), and the number of the word at which each frame starts."""
    total = len(ids)
    frames, most = -(-total // FRAME), int(COUNTS.max())
    padded = np.zeros((frames, FRAME + most), np.uint64)
    padded[:, :FRAME].flat[:total] = ids
    bits = _bits(padded)
    # top[k]: most bits of the 2**k ids from here on
    top = [bits]
    while 2 << len(top) - 1 <= most:
        top.append(_over(top[-1], 1 << len(top) - 1))
    # Where a selector fits, all later ones fit, as they hold fewer and wider ids: the first one
    # that fits follows from how many do.
    fitting = np.zeros(bits.shape, np.uint8)
    for n, width in SELECTORS[1:]:
        k = n.bit_length() - 1
        rest = n - (1 << k)
        fitting += (_over(top[k], rest) if rest else top[k]) <= width
    best = np.where(fitting, len(SELECTORS) - fitting, ESCAPE).astype(np.uint8)
    # walk all frames together
    end = np.full(frames, FRAME)
    if frames:
        end[-1] = total - (frames - 1) * FRAME
    at, rows, flat, steps = np.zeros(frames, np.int64), np.arange(frames), best.reshape(-1), []
    base = rows * bits.shape[1] if frames else rows
    while len(rows):
        now = np.full(frames, -1)
        now[rows] = at
        steps.append(now)
        at = at + COUNTS[flat[base + at]]
        going = at < end
        if not going.all():
            at, rows, base, end = at[going], rows[going], base[going], end[going]
    if not steps:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    walked = np.stack(steps, axis=1)
    row, step = np.nonzero(walked >= 0)
    pos = walked[row, step]
    sel = flat[row * bits.shape[1] + pos]
    slots = 1 + (sel == ESCAPE)
    place = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), np.uint64)
    ids_of, cell = padded.reshape(-1), row * padded.shape[1] + pos
    for s, (n, width) in enumerate(SELECTORS):
        own = np.flatnonzero(sel == s)
        if not len(own):
            continue
        if s == ESCAPE:
            words[place[own] + 1] = ids_of[cell[own]]
            continue
        word, at = np.full(len(own), s << 60, np.uint64), cell[own]
        for j in range(n if width else 0):
            word |= ids_of[at + j] << np.uint64(width * j)
        words[place[own]] = word
    starts = place[np.searchsorted(row, np.arange(frames))]
    return words, starts


def decode(words: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """The ids (uint64) of `total` ids coded by encode()."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True
    at = np.flatnonzero(~raw)
    sel = sel[at]
    frame = np.searchsorted(starts, at, "right") - 1
    before = np.cumsum(COUNTS[sel]) - COUNTS[sel]
    first = before[np.searchsorted(at, starts)] if len(starts) else before
    pos = before - first[frame]
    out = np.zeros((len(starts), FRAME + int(COUNTS.max())), np.uint64)
    flat = out.reshape(-1)
    for s, (n, width) in enumerate(SELECTORS):
        own = np.flatnonzero(sel == s)
        if not len(own):
            continue
        if s == ESCAPE:
            flat[frame[own] * out.shape[1] + pos[own]] = words[at[own] + 1]
            continue
        mask, own_words, cell = np.uint64((1 << width) - 1), words[at[own]], frame[own] * out.shape[1] + pos[own]
        for j in range(n if width else 0):
            flat[cell + j] = (own_words >> np.uint64(width * j)) & mask
    return out[:, :FRAME].reshape(-1)[:total]
