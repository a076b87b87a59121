"""Token ids of whole texts by a public tokenizer file, with a bounded cache of pieces.

A text is cut only where the tokenizer's own splitting must cut: before white space that
follows something else, after a single line feed, or between a word and the marks after it.
Each piece is encoded by the tokenizers library once and its ids are
kept, up to twice ``KEPT`` pieces a worker; joining the pieces' ids gives the ids of the
whole text (tests compare with whole-text encoding).
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import starts_of

#: Pieces whose ids a worker keeps in each of two generations.
KEPT = 300_000
#: Longer pieces (characters) are not kept.
LONG = 200
#: Pieces sent to the tokenizer as one text.
GROUP = 500
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = re.compile(r"\s")
#: Marks that end words, and the last of the letters (Latin ones) before which they are split off.
_TAIL, _LAST_LETTER = ".,;:!?%$&*#", "\u024f"
#: The letter that stands for each byte in byte-level vocabularies, for bytes that do not stand for themselves (a fixed table).
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate([*range(0x21), *range(0x7f, 0xa1), 0xad])}
#: Words that show whether a tokenizer's steps before its model leave words as they are.
_PROBES = ["a", "the", "zqxjv", "ma\u00f1ana", "\u00fcber", "stra\u00dfe", "na\u00efve", "\u00e0\u00e1\u00e2", "\u0142\u00f3d\u017a", "\u0219i", "\u00aa\u00b5\u00ba"]
#: White space other than a space and a line feed (fixed values).
_RARE_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class _Kept(dict):
    """Ids by piece, in two generations: when the younger is full it becomes the older, and what is used again moves back.

    A look-up of an unknown piece gives an empty array, which ``learn`` fills: from two known
    pieces if ``split`` gives them, or else from the tokenizer."""

    def __init__(self, encode, split):
        super().__init__()
        self.encode, self.split, self.older, self.noted, self.composed = encode, split, {}, [], []

    def __missing__(self, piece: str) -> bytes | bytearray:
        ids = self.older.get(piece)
        if ids is None:
            ids = bytearray()
            parts = self.split(piece) if piece[-1:] in _TAIL else None
            if parts is None:
                self.noted.append((piece, ids))
            else:
                self.composed.append((piece, ids, self[parts[0]], self[parts[1]]))
        self[piece] = ids
        return ids

    def learn(self) -> None:
        for (piece, blank), ids in zip(self.noted, self.encode([piece for piece, _ in self.noted])):
            blank.extend(ids)
            self[piece] = ids       # later texts join plain bytes, which is faster
        for piece, ids, first, second in self.composed:
            ids.extend(first)
            ids.extend(second)
            self[piece] = bytes(ids)
        self.noted, self.composed = [], []
        if len(self) > KEPT:
            self.older = {k: v for k, v in self.items() if len(k) <= LONG}
            self.clear()


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class _Encoder:
    kind = "<u2"

    def __init__(self, path: str):
        self.path, self.tokenizer = path, _tokenizer(path)
        #: Their strings in a text are their ids: such a text is encoded whole.
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def _alone(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _cut_up(self, tokenizer, groups: list[str], begins: np.ndarray, skip: int) -> list[bytes]:
        """Ids of the pieces in texts of many; each begins ``skip`` bytes after an id of ``begins``."""
        out: list[bytes] = []
        for e in tokenizer.encode_batch_fast(groups, add_special_tokens=False):
            ids = np.array(e.ids, self.kind)
            raw, cuts = ids.tobytes(), (2 * np.flatnonzero(begins[ids])).tolist()
            out += [raw[x + skip:y] for x, y in zip(cuts, [*cuts[1:], len(raw)])]
        return out

    def _together(self, strings: list[str], between: str, begins: np.ndarray, skip: int) -> list[bytes]:
        """Ids of strings that are encoded GROUP at a time as one text; each begins after ``between``, at an id of ``begins``."""
        out: list[bytes] = []
        for a in range(0, len(strings), 64 * GROUP):
            groups = [strings[b:b + GROUP] for b in range(a, min(a + 64 * GROUP, len(strings)), GROUP)]
            out += self._cut_up(self.tokenizer, [between + between.join(g) for g in groups], begins, skip)
        return out


class Pieces(_Encoder):
    """Word-level: pieces are what stands between spaces and line feeds."""

    def __init__(self, path: str):
        super().__init__(path)
        self.kept = _Kept(self._encode, self._parts)
        # What tells pieces apart that are encoded together: a character of a single id between them.
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.mark, between = next((c, e) for c in "\u00a7\u00a4\u00b6\u2020#" if len(e := self.tokenizer.encode(f"a {c} b", add_special_tokens=False).ids[1:-1]) == 1)
        self.begins[between] = True
        # What is done to a text before the model leaves words of small letters as they are.
        self.model = self.tokenizer.model
        self.direct = [self._word(w) for w in _PROBES] == self._alone(_PROBES)

    def _word(self, word: str) -> bytes:
        """The ids that the tokenizer's model gives to a word, without the steps before it."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(word)]
        return pack(f"<{len(ids)}H", *ids)

    def _encode(self, strings: list[str]) -> list[bytes]:
        plain, odd, words = [], [], []
        for i, x in enumerate(strings):
            if self.direct and x.isalpha() and (x.isascii() or max(x) <= _LAST_LETTER) and x.lower() == x:
                words.append(i)
            elif x and not _SPACE.search(x) and self.mark not in x:
                plain.append(i)
            else:
                odd.append(i)
        out = [b""] * len(strings)
        for i in words:
            out[i] = self._word(strings[i])
        for at, ids in ((plain, self._together([strings[i] for i in plain], f" {self.mark} ", self.begins, 2)),
                        (odd, self._alone([strings[i] for i in odd]))):
            for i, x in zip(at, ids):
                out[i] = x
        return out

    def _parts(self, piece: str) -> tuple[str, str] | None:
        """A word and the marks after it: the tokenizer splits between letters and these."""
        word = piece.rstrip(_TAIL)
        if len(word) == len(piece) or not word:
            return None
        # Also in lower case: that of U+0130 has a combining mark, which goes with the marks.
        if not word.isalpha() or not word.isascii() and (not word.lower().isalpha() or max(word) > _LAST_LETTER):
            return None
        return word, piece[len(word):]

    def _cut(self, text: str) -> list[str] | None:
        """Pieces of the text; nothing where it must be encoded whole."""
        lowered = text.encode().lower().decode()     # ASCII letters only
        if any(x in lowered for x in self.special):
            return None
        return lowered.replace("\n", " ").split(" ")

    def rest(self) -> None:
        """Gives back the older pieces: between tasks a worker keeps one generation."""
        self.kept.older = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned integers."""
        get, whole = self.kept.__getitem__, []
        found = []
        for i, t in enumerate(texts):
            pieces = self._cut(t)
            if pieces is None:
                whole.append(i)
            found.append([] if pieces is None else list(map(get, pieces)))
        self.kept.learn()
        out = [b"".join(f) for f in found]
        for i, ids in zip(whole, self._alone([texts[i] for i in whole])):
            out[i] = ids
        return out


#: Kinds of bytes, and of each byte value the kinds (fixed tables).
_BLANK, _FEED, _MARK, _LETTER, _LEAD, _RARE = 1, 2, 4, 8, 16, 32
_KINDS = np.zeros(256, np.uint8)
for _values, _kind in ((b" \n", _BLANK), (b"\n", _FEED), (_TAIL.encode(), _MARK), (bytes([*range(65, 91), *range(97, 123)]), _LETTER),
                       (bytes(range(0xc3, 0xc9)), _LEAD), (b"\t\v\f\r\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3", _RARE)):
    _KINDS[list(_values)] |= _kind
#: Code points of the letters that stand for bytes.
_BYTE_POINTS = np.array([ord(_BYTE_LETTERS.get(b, chr(b))) for b in range(256)], "<u4")


def _letters(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which bytes end a letter that is in ASCII or among the Latin ones of two bytes up to U+023F (all of C4..C8, C3 but for two signs)."""
    out = kinds & _LETTER != 0
    led = np.flatnonzero(kinds & _LEAD) + 1
    out[led[(data[led - 1] != 0xc3) | (data[led] & 0xdf != 0x97)]] = True
    return out


def _contents(values: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all values, where each begins and the end)."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset:][:len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]], at - at[0]


class BytePieces(_Encoder):
    """Byte-level: pieces are the text's own bytes, with the space before them."""

    direct = False

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, pre_tokenizers
        # Kept pieces, the chunk that last had them, their ids one after the other and numbers of ids.
        self.chunk, self.kept, self.used = 0, pa.array([], pa.large_binary()), np.empty(0, np.int64)
        self.flat, self.counts = np.empty(0, self.kind), np.empty(0, np.int64)
        # Only the first id of a piece begins with its space.
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for x, i in vocabulary.items() if x.startswith("\u0120")]] = True
        self.feeds = np.zeros(len(self.begins), bool)
        self.feeds[self.tokenizer.encode("a\nb", add_special_tokens=False).ids[1]] = True
        # The tokenizer's model on pieces that its splitting leaves whole.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")

    def _cuts(self, texts: list[str], raw: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(the texts' bytes, where pieces begin and the end, the first piece of each text and the number of all)."""
        whole, starts = b"".join(raw), starts_of([len(x) for x in raw])
        data = np.frombuffer(whole, np.uint8)
        kinds = _KINDS[data]
        blank = kinds & _BLANK != 0
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = blank[1:] & ~blank[:-1] | (kinds[1:] & _MARK != 0) & _letters(data, kinds)[:-1]
        cut[starts] = True
        feeds = np.flatnonzero(kinds & _FEED)
        feeds = feeds[feeds + 1 < len(data)]
        cut[feeds[cut[feeds] & ~blank[feeds + 1]] + 1] = True
        # Next to other white space runs of it are longer than they look: there only single spaces are cut at.
        maybe = np.unique(np.searchsorted(starts, np.flatnonzero(kinds & _RARE), "right") - 1)
        for i in maybe.tolist():
            if _RARE_SPACE.search(texts[i]):
                a, b = int(starts[i]), int(starts[i + 1])
                cut[a + 1:b] = False
                lengths = np.array([len(x.encode()) + 1 for x in _CUT.split(texts[i])])
                cut[a - 1 + np.cumsum(lengths[:-1])] = True
        begins = np.flatnonzero(cut)
        return whole, begins, np.searchsorted(begins, starts)

    def _modelled(self, pieces: pa.LargeBinaryArray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each piece's) by the model alone; pieces without a space before them are told apart by line feeds between."""
        data, at = _contents(pieces)
        between = [32] if spaced else [32, _BYTE_POINTS[10], 32]
        points = np.insert(_BYTE_POINTS[data], np.repeat(at[:-1], len(between)), np.tile(between, len(pieces)))
        text, cuts = points.astype("<u4").tobytes().decode("utf-32-le"), (at + len(between) * np.arange(len(at)))[::GROUP].tolist()
        groups, ids = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)]) if a < b], [np.empty(0, self.kind)]
        for a in range(0, len(groups), 64):
            ids += [np.array(e.ids, self.kind) for e in self.model.encode_batch_fast(groups[a:a + 64], add_special_tokens=False)]
        flat = np.concatenate(ids)
        begin = (self.begins if spaced else self.feeds)[flat]
        counts = np.diff(np.flatnonzero(begin), append=len(flat))
        return (flat, counts) if spaced else (flat[~begin], counts - 1)

    def _others(self, pieces: list[str]) -> list[bytes]:
        """Ids by the tokenizer as it is, many pieces at a time if there is no more white space in them than a space before."""
        kinds: list[list[int]] = [[], [], []]
        for i, x in enumerate(pieces):
            spaced = x[:1] == " "
            kinds[2 if len(x) == spaced or _SPACE.search(x, spaced) else 0 if spaced else 1].append(i)
        out = [b""] * len(pieces)
        for at, ids in zip(kinds, (self._together([pieces[i] for i in kinds[0]], "", self.begins, 0),
                                   self._together([pieces[i] for i in kinds[1]], "\n", self.feeds, 2),
                                   self._alone([pieces[i] for i in kinds[2]]))):
            for i, x in zip(at, ids, strict=True):
                out[i] = x
        return out

    def _look_up(self, distinct: pa.LargeBinaryArray) -> np.ndarray:
        """The place of each piece among the kept ones, where it is put if need be."""
        place = pc.fill_null(pc.index_in(distinct, value_set=self.kept), -1).to_numpy().astype(np.int64)
        self.chunk += 1
        new = np.flatnonzero(place < 0)
        pieces = distinct.take(pa.array(new))
        data, at = _contents(pieces)
        kinds = _KINDS[data]
        spaced = data[at[:-1]] == 32
        # Plain pieces are letters or marks alone, with or without a space before: bytes that are not are counted up to each place.
        letters = _letters(data, kinds)
        letters[:-1] |= letters[1:] & (kinds[:-1] & _LEAD != 0)
        plain = np.zeros(len(new), bool)
        for fits in (letters, kinds & _MARK != 0):
            others = starts_of(~fits)
            plain |= others[at[:-1] + spaced] == others[at[1:]]
        plain &= at[:-1] + spaced < at[1:]
        parts = [np.flatnonzero(x) for x in (plain & spaced, plain & ~spaced, ~plain)]
        order = np.concatenate(parts)
        place[new[order]] = len(self.kept) + np.arange(len(order))
        self.kept = pa.concat_arrays([self.kept, pieces.take(pa.array(order))])
        odd = self._others([x.decode() for x in pieces.take(pa.array(parts[2])).to_pylist()])
        modelled = [self._modelled(pieces.take(pa.array(x)), k) for x, k in zip(parts, (True, False))]
        self.flat = np.concatenate([self.flat, *[x for x, _ in modelled], np.frombuffer(b"".join(odd), self.kind)])
        self.counts = np.concatenate([self.counts, *[x for _, x in modelled], np.array([len(x) // 2 for x in odd], np.int64)])
        if len(self.counts) != len(self.kept) or self.counts.sum() != len(self.flat):
            raise ValueError("pieces that were encoded together did not come apart")
        self.used = np.concatenate([self.used, np.empty(len(order), np.int64)])
        self.used[place] = self.chunk
        return place

    def rest(self) -> None:
        """Keeps the ``KEPT`` pieces that were used last, and no long ones."""
        stays = pc.binary_length(self.kept).to_numpy() <= LONG
        if stays.sum() > KEPT:
            stays &= self.used >= np.partition(self.used[stays], -KEPT)[-KEPT]
            stays[np.flatnonzero(stays)[:-KEPT]] = False
        self.kept = self.kept.filter(pa.array(stays))
        self.flat, self.counts, self.used = self.flat[np.repeat(stays, self.counts)], self.counts[stays], self.used[stays]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned integers."""
        whole = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        raw = [t.encode() for t in texts]
        for i in whole:
            raw[i] = b""
        if not any(raw):
            return self._alone(texts)
        data, begins, firsts = self._cuts(texts, raw)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(data)]).dictionary_encode()
        places = self._look_up(pieces.dictionary)[pieces.indices.to_numpy()]
        lengths = self.counts[places]
        ends = starts_of(lengths)
        at = np.repeat(starts_of(self.counts)[places] - ends[:-1], lengths)
        at += np.arange(len(at))
        ids, cuts = self.flat[at].tobytes(), (2 * ends[firsts]).tolist()
        if len(self.kept) > 2 * KEPT:
            self.rest()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for i, ids in zip(whole, self._alone([texts[i] for i in whole])):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def pieces(name: str) -> Pieces | BytePieces:
    """The encoder for a file of ``public_tokenizers`` (or a path to such a file), once a worker."""
    import public_tokenizers
    path = name if os.path.sep in name else public_tokenizers.path(name)
    return Pieces(path) if os.path.basename(path).startswith("word_") else BytePieces(path)
