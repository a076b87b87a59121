import random
import zlib

import numpy as np
import pytest

from textbarge.llm import tokenfiles, tokens
from textbarge.llm.coder import decode, encode
from textbarge.session import fresh_dir

from .helpers import awkward, documents, prose
from .test_packing import whole


def expected(docs):
    out, at = [], 0
    rows = sorted(((d, [*x, 0]) for (d, _), x in zip(docs, whole(tokenfiles.TOKENIZER, [t for _, t in docs]))), key=lambda r: (r[0] is not None, r[0] or 0))
    for d, x in rows:
        out.append((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    return out


def test_round_trip(spark):
    docs = [r for r in awkward() if r[0] is not None] + [(None, prose(2, 20))] + [(100 - i, prose(i, i)) for i in range(80)]
    for block, file_ids in ((1024, 4_000_000), (16, 300)):
        path = fresh_dir(spark, "test-tokens")
        written = tokenfiles.write_tokens(documents(spark, docs), path, block=block, file_ids=file_ids).collect()
        rows = sorted(tokenfiles.read_tokens(spark, path).collect(), key=lambda r: r["start"])
        assert sum(r["n_ids"] for r in written) == sum(r["n_tokens"] for r in rows)
        at = 0
        for r in rows:
            assert r["start"] == at and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"]
            at += r["n_tokens"]
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
        got = [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows]
        assert [g[0] for g in got] == [e[0] for e in expected(docs)]
        assert sorted(got, key=key) == sorted(expected(docs), key=key)


def test_empty(spark):
    path = fresh_dir(spark, "test-tokens")
    assert tokenfiles.write_tokens(documents(spark, []), path).count() == 0
    assert tokenfiles.read_tokens(spark, path).count() == 0


def test_coder_round_trips():
    rng = np.random.default_rng(5)
    for lanes, steps in ((1, 1), (3, 50), (30, 400)):
        for ids in (rng.integers(0, 65536, (lanes, steps)), rng.zipf(1.3, (lanes, steps)) % 50257, np.full((lanes, steps), 65535), np.zeros((lanes, steps), int), np.tile(np.arange(steps) % 3, (lanes, 1))):
            sizes = np.full(lanes, steps)
            sizes[-1] = max(1, steps // 3)
            codes = encode(ids, sizes)
            back = decode(codes, sizes)
            assert all((back[i, :n] == ids[i, :n]).all() for i, n in enumerate(sizes))
            # A block is coded on its own: others beside it change nothing.
            assert encode(ids[:1], sizes[:1])[0] == codes[0]
    repeated = encode(np.tile(np.arange(400) % 5, (1, 1)), np.array([400]))
    assert len(repeated[0]) < 160


def test_damage_is_noticed():
    ids = [np.arange(3000, dtype=np.uint16), np.zeros(5, np.uint16)]
    data = tokenfiles.pack_file([1, None], ids, 7, 256)
    docs, lengths, back, before = tokenfiles.unpack_file(data)
    assert docs == [1, None] and lengths.tolist() == [3000, 5] and before == 7 and back.tolist() == np.concatenate(ids).tolist()
    for at in (3, 12, 30, len(data) // 2, len(data) - 400):
        broken = bytearray(data)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            tokenfiles.unpack_file(bytes(broken))
    with pytest.raises(ValueError):
        tokenfiles.unpack_file(data[:-1])


def test_new_words_go_to_the_model_alone():
    encoder, texts = tokens.BytePieces(tokens.pieces(tokenfiles.TOKENIZER).path), [prose(8, 300) + ".\nThe naïve ȿ über: water, light!! stone\nend.", "", "One"]
    want = whole(tokenfiles.TOKENIZER, texts)
    given = []

    class Watched:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, strings, **options):
            given.extend(strings)
            return self.tokenizer.encode_batch_fast(strings, **options)

    encoder.tokenizer = Watched(encoder.tokenizer)
    for _ in range(2):      # the tokenizer's splitting sees the line feed, once, and no word
        assert [np.frombuffer(b, "<u2").tolist() for b in encoder.ids(texts)] == want
        assert given == ["\n"]


def test_white_space_marks_and_dropped_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 60)
    encoder, rng = tokens.BytePieces(tokens.pieces(tokenfiles.TOKENIZER).path), random.Random(3)
    encoder.rest()
    some = [" ", "  ", "\n", "\n\n", "a", "Word", "don't", "é", "×", "÷", "ȿ", "ɀ", "İ", "日本", "42", ".", ",", "%%%", "'s", "-", "\u0301", "\x00", "\x01", "ª", "ñ", "😀", "Ġ", "Ċ", "x" * 300]
    rare = [*some, "\t", "\r\n", "\xa0", "\u2009", "\u3000", "\x1c", "\x85", "<|endoftext|>"]
    for parts in (some, rare) * 4:
        texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(150)]
        assert [np.frombuffer(b, "<u2").tolist() for b in encoder.ids(texts)] == whole(tokenfiles.TOKENIZER, texts)
    encoder.rest()
    assert len(encoder.kept) == len(encoder.counts) == len(encoder.used) == 60 and encoder.counts.sum() == len(encoder.flat)
    assert not any(len(x) > tokens.LONG for x in encoder.kept.to_pylist())


def test_files_of_before_can_be_read():
    ids = (np.arange(6000, dtype=np.int64) ** 2 % 977 * 61 % 50257).astype(np.int32).reshape(6, 1000)
    assert [zlib.crc32(c) for c in encode(ids, np.array([1000, 1000, 1000, 1000, 1000, 9]))] == [1588085492, 1767213594, 2260185037, 1222872983, 137943151, 2811556070]
