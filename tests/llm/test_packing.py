import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from textbarge.llm import packing
from textbarge.llm.tokens import pieces

from .helpers import awkward, documents, prose


def whole(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, docs, length):
    ids = defaultdict(list)
    for (d, _), x in zip(docs, whole(packing.TOKENIZER, [t for _, t in docs])):
        ids[d].append(np.array([*x, packing.END_ID], "<u4"))
    sequences, covered = defaultdict(list), defaultdict(int)
    for r in rows:
        some = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
        assert some and r["length"] > 0
        covered[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: n for d, n in covered.items()} == {d: sum(map(len, x)) for d, x in ids.items()}
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    assert sum(sum(n for _, n in s) < length for s in sequences.values()) <= 1
    assert sorted(sequences) == list(range(len(sequences)))


def test_every_id_in_one_piece(spark, monkeypatch):
    docs = awkward() + [(300 + i, prose(i, 5 + i * 7 % 90)) for i in range(200)] + [(900 + i, prose(1, 50)) for i in range(60)]
    for length, unit in ((4096, packing.UNIT), (64, 500)):
        monkeypatch.setattr(packing, "UNIT", unit)
        check(packing.pack(documents(spark, docs), length=length).collect(), docs, length)


def test_empty(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def test_hilbert_visits_all_cells_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_pieces_equal_whole_text_encoding():
    odd = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "I'm  he's 's", "\x1c a \x1f b", "é ́a", "<|endoftext|> x<|endoftext|>", "<|ENDOFTEXT|> <|startoftext|>a <|endoftext|>, b", "EV\u0130. G\u0130! \u0130, \u01C5. \u1E9E? stra\u00DFe.",
           "A\tB C\r\nD  ", "日本 語", "ΑΣ ΣΑΣ İ", "​ a ᠎ b", "x" * 3000 + " y", prose(1, 3000), " ́x ́"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        for texts in (odd, odd[::-1], [t + " " + u for t in odd for u in odd]):
            assert [np.frombuffer(b, "<u2").tolist() for b in pieces(name).ids(texts)] == whole(name, texts)


def test_words_go_to_the_model_alone():
    import random

    from textbarge.llm.tokens import pieces
    encoder, rng = pieces("word_bpe_49k.json"), random.Random(4)
    assert encoder.direct and not pieces("byte_bpe_50k.json").direct
    letters = [c for c in map(chr, range(0x61, 0x250)) if c.isalpha()]
    words = ["".join(rng.choice(letters if i % 2 else letters[:26]) for _ in range(rng.randrange(1, 14))) for i in range(4000)]
    words += ["\u0130", "\u01c5a", "a\u0301", "\u212a", "\ufb01x", "\u03c2", "\u017fo", "\u0149", "x" * 5000]
    assert encoder._encode(words) == encoder._alone(words)
    # Once a worker has seen them, pieces are plain bytes, and texts are as in whole-text encoding.
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", "!?", ".%"]) for _ in range(50)) for _ in range(40)]
    assert encoder.ids(texts) == encoder.ids(texts) == encoder._alone(texts)
    assert all(type(ids) is bytes for ids in encoder.kept.values())
