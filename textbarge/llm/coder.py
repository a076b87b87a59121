"""Context-mixing range coder for token ids under 65,536, in blocks that are coded side by side.

Every block starts from a fresh model and is coded on its own; numpy works on the same place
of all blocks of a file at once. For each id three orders predict:

* order 2 and order 1: the id that last followed the two ids before, or the one before
  (hashed tables), each with a confidence; the more confident one's id is the candidate;
* order 0: a table of the ids seen so far with their confidence.

The confidences of orders 2 and 1 choose one weight, that of order 0 another; their sum in
the logistic domain is the probability of the candidate, and both weights learn from the
error. If the id is not the candidate, an adaptive share says whether it is in the order-0
table (then its place there is coded) or not (then the id itself). All of it is one interval
of 2^28 for a range coder with 16-bit words. Only integers are used, so that any machine
decodes what another has coded.
"""

from __future__ import annotations

import numpy as np

#: Entries of the order-2 and order-1 tables and of the order-0 table, as powers of two.
CONTEXT_BITS, SEEN_BITS = 9, 9
#: Bits of the whole interval, of the coder's window and of an output word.
TOTAL, WINDOW, WORD = 28, 48, 16
_LOW, _LEAST_SPAN = WINDOW - WORD, 1 << (WINDOW - WORD)
_WINDOW = (1 << WINDOW) - 1
_LEAST, _MOST = 32, 4032
#: Probabilities (of 4096) for weights -2047..2047, in steps of 1/256: a fixed table made by this rule.
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256.0))), _LEAST, _MOST).astype(np.int32)
#: What is added to an entry whose confidence is c: at c if its id did not come, at c + 8 if it did; and whether it is replaced then.
_CHANGE = np.array([*(-((c + 1) >> 1) for c in range(8)), *(int(c < 7) for c in range(8))], np.int32)
_REPLACED = np.array([1, 1, *[0] * 14], np.int32)


def _either(mask: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """``first`` where the mask is 1, ``second`` where it is 0, by arithmetic: masks are as good as random, which makes np.where slow."""
    out = first - second
    out *= mask
    out += second
    return out


class Model:
    """The state of ``lanes`` blocks."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.context, self.seen_at = lane << CONTEXT_BITS, lane << SEEN_BITS
        self.mix_at, self.order0_at = lane << 7, lane << 4
        self.two, self.one = np.zeros(lanes << CONTEXT_BITS, np.int32), np.zeros(lanes << CONTEXT_BITS, np.int32)
        self.seen = np.zeros(lanes << SEEN_BITS, np.int32)
        start = np.arange(128)
        self.mix = np.tile((((start >> 4) + ((start >> 1) & 7)) * 48 - 500).astype(np.int32), lanes)
        self.order0 = np.zeros(lanes << 4, np.int32)
        self.share = np.full(lanes, 2048, np.int32)
        self.last = np.zeros(lanes, np.uint32)
        self.before = np.zeros(lanes, np.uint32)

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Where an id is kept in the order-0 table."""
        return (ids.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - SEEN_BITS)

    def keep(self, n: int) -> None:
        """Goes on with the first ``n`` blocks."""
        for name in ("context", "seen_at", "mix_at", "order0_at", "share", "last", "before"):
            setattr(self, name, getattr(self, name)[:n])

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(candidate, size of its interval, size of a place's, size of an id's)."""
        mixed = self.last * np.uint32(0x85EBCA6B)
        self.i1 = (mixed >> np.uint32(32 - CONTEXT_BITS)) + self.context
        mixed += self.before * np.uint32(0xC2B2AE35)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x27D4EB2F)
        self.i2 = (mixed >> np.uint32(32 - CONTEXT_BITS)) + self.context
        self.e1, self.e2 = self.one.take(self.i1, mode="clip"), self.two.take(self.i2, mode="clip")
        self.c1, self.c2 = self.e1 & 7, self.e2 & 7
        candidate = _either((self.c2 >= self.c1).astype(np.int32), self.e2, self.e1)
        candidate >>= 3
        self.im = (self.c2 << 4) + (self.c1 << 1) + ((self.e1 ^ self.e2) < 8) + self.mix_at
        kept = self.seen.take(self.place(candidate) + self.seen_at, mode="clip")
        self.i0 = ((kept & 7) + 8) * ((kept >> 3) == candidate) + self.order0_at
        self.wm, self.w0 = self.mix.take(self.im, mode="clip"), self.order0.take(self.i0, mode="clip")
        self.p = SQUASH.take(self.wm + self.w0 + 2047, mode="clip")
        size = self.p << (TOTAL - 12)
        rest = (1 << TOTAL) - size
        self.inside = (rest >> 12) * self.share
        return candidate, size, self.inside >> SEEN_BITS, (rest - self.inside) >> 16

    def update(self, ids: np.ndarray, hit: np.ndarray, place: np.ndarray, kept: np.ndarray, known: np.ndarray) -> None:
        """After coding ``ids``: ``hit`` the candidate was right; ``kept`` is the order-0 entry at ``place``, ``known`` that it is the id's (both 0 or 1)."""
        error = (hit << 12) - self.p
        error >>= 4
        self.mix[self.im] = self.wm + error
        self.order0[self.i0] = self.w0 + (error >> 1)
        move = known * np.int32(4032 - 64)
        move += np.int32(64)
        move -= self.share
        move >>= 5
        move *= hit ^ 1
        self.share += move
        fresh = (ids << 3) + 1
        for table, at, e, c in ((self.one, self.i1, self.e1, self.c1), (self.two, self.i2, self.e2, self.c2)):
            case = ((e >> 3) == ids).astype(np.int32)
            case <<= 3
            case += c
            changed = _CHANGE.take(case, mode="clip")
            changed += e
            table[at] = _either(_REPLACED.take(case, mode="clip"), fresh, changed)
        self.seen[place] = _either(known, kept + ((kept & 7) < 7), fresh)
        self.before, self.last = self.last, ids.view(np.uint32)


def _running(sizes: np.ndarray, steps: int) -> list[int]:
    """How many blocks still run at each step (sizes do not increase)."""
    return np.searchsorted(-sizes, -np.arange(steps), "left").tolist()


def encode(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Codes each row of ``ids`` (blocks x steps), of which the first ``sizes`` count; sizes must not increase."""
    lanes, steps = ids.shape
    columns, model, width = np.ascontiguousarray(ids.T, np.int32), Model(lanes), 2 * steps + 8
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << WINDOW, np.int64)
    words, at = np.zeros(lanes * width, np.uint16), np.arange(lanes) * width
    done = at.copy()
    for step, n in enumerate(_running(sizes, steps)):
        if n < len(low):
            done[n:len(low)] = _finish(words, at[n:], low[n:])
            model.keep(n)
            low, span, at = low[:n], span[:n], at[:n]
        x = columns[step, :n]
        candidate, size, by_place, by_id = model.predict()
        hit = (candidate == x).astype(np.int32)
        place = model.place(x)
        seen_at = place + model.seen_at
        kept = model.seen.take(seen_at, mode="clip")
        known = ((kept >> 3) == x).astype(np.int32)
        freq = _either(hit, size, _either(known, by_place, by_id))
        cum = _either(known, place.view(np.int32) * by_place, model.inside + x * by_id)
        cum += size
        cum *= hit ^ 1
        model.update(x, hit, seen_at, kept, known)
        span >>= TOTAL
        low += span * cum
        span *= freq
        over = np.flatnonzero(low >> WINDOW)
        if len(over):
            low[over] -= 1 << WINDOW
            back = at[over] - 1
            while len(back):
                words[back] += 1
                back = back[words[back] == 0] - 1
        # Up to two words are due; those written without being due are overwritten by the next.
        due = (span < _LEAST_SPAN).view(np.int8) + (span < _LEAST_SPAN >> WORD)
        words[at] = (low >> _LOW).astype(np.uint16)
        words[at + 1] = (low >> (_LOW - WORD)).astype(np.uint16)
        shift = due.astype(np.int64) * WORD
        low = (low << shift) & _WINDOW
        span <<= shift
        at = at + due
    done[:len(low)] = _finish(words, at, low)
    return [words[i * width:e].astype("<u2").tobytes() for i, e in enumerate(done.tolist())]


def _finish(words: np.ndarray, at: np.ndarray, low: np.ndarray) -> np.ndarray:
    for k in range(WINDOW // WORD):
        words[at + k] = low >> (_LOW - k * WORD)
    return at + WINDOW // WORD


def decode(codes: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ids (blocks x steps) that ``encode`` coded; places beyond a block's size are 0."""
    lanes, steps = len(codes), int(sizes.max(initial=0))
    width = max(map(len, codes), default=0) // 2 + 4
    words = np.zeros((lanes, width), np.uint16)
    for i, c in enumerate(codes):
        words[i, :len(c) // 2] = np.frombuffer(c, "<u2")
    code = np.zeros(lanes, np.int64)
    for k in range(WINDOW // WORD):
        code = (code << WORD) | words[:, k]
    at = np.arange(lanes) * width + WINDOW // WORD
    words = words.ravel().astype(np.int64) << WORD      # each word and the one after it
    words[:-1] |= words[1:] >> WORD
    span, out, model = np.full(lanes, 1 << WINDOW, np.int64), np.zeros((steps, lanes), np.int32), Model(lanes)
    for step, n in enumerate(_running(sizes, steps)):
        if n < len(code):
            model.keep(n)
            code, span, at = code[:n], span[:n], at[:n]
        candidate, size, by_place, by_id = model.predict()
        span >>= TOTAL
        # Exact: the quotient is further from the next integer than a double's rounding.
        target = (code / span).astype(np.int32)
        hit = (target < size).astype(np.int32)
        target -= size
        within = (target < model.inside).astype(np.int32)
        target -= model.inside * (within ^ 1)
        value = (target / _either(within, by_place, by_id)).astype(np.int32)
        x = _either(hit, candidate, _either(within, model.seen.take(value + model.seen_at, mode="clip") >> 3, value))
        out[step, :n] = x
        place = model.place(x)
        seen_at = place + model.seen_at
        kept = model.seen.take(seen_at, mode="clip")
        known = ((kept >> 3) == x).astype(np.int32)
        freq = _either(hit, size, _either(known, by_place, by_id))
        cum = _either(known, place.view(np.int32) * by_place, model.inside + x * by_id)
        cum += size
        cum *= hit ^ 1
        model.update(x, hit, seen_at, kept, known)
        code -= span * cum
        span *= freq
        due = (span < _LEAST_SPAN).view(np.int8) + (span < _LEAST_SPAN >> WORD)
        shift = due.astype(np.int64) * WORD
        code = (code << shift) | (words.take(at, mode="clip") >> (2 * WORD - shift))
        span <<= shift
        at = at + due
    return out.T
