import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from huntframe.llm import op10_best_fit_packing as op10, op12_bpe_codec as op12

PATH = public_tokenizers.path("word_bpe_49k.json")


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(texts, library, ours, codec):
    ids, bounds = ours.encode(*block(texts), 0)
    rows, begins = codec.stretches(*block(texts))
    for i, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*want, 0], ascii(t)
        assert [x for r in rows[begins[i] : begins[i + 1]] for x in codec.ids[r]] == want, ascii(t)


def test_letters_do_not_go_through_the_whole_tokeniser(library, monkeypatch):
    ours = op10.ChunkTokenizer(PATH)
    monkeypatch.setattr(ours, "_ids", None)  # not even one text
    texts = ["Der Größte ÉTÉ naïve Ýÿ", "ßß þing", "the cat's".replace("'", " "), ""]
    ids, bounds = ours.encode(*block(texts), 0)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_letters_of_latin_1_part_from_punctuation():
    texts = "Été, été; ÉTÉ. été"
    data, starts, ends, _ = op10.stretches(*block([texts]))
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert words == ["été", ",", "été", ";", "été", ".", "été"]


@pytest.mark.parametrize("marked", ["H̱", "T̈a", "W̊", "Y̊", "J̌", "aH̱b", "Ḥ̱", "İ", "Ẹ́x", "Ǖ", "≠"])
def test_letters_with_marks_are_composed_before_they_are_lower_cased(marked, library):
    check([marked, f"x {marked} y", marked.lower()], library, op10.ChunkTokenizer(PATH), op12.StretchCodec(PATH))


def test_ids_of_odd_texts(library):
    rng = random.Random(31)
    pools = [list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] * 6 + [[chr(i) for i in range(0xA0, 0x100)]] * 3
    pools += [list("̸̧̱̣̌̊̈́"), list("ΣςİıǅẖﬁŉЖй가각日½²٣가\x1c\x00\x85 "), [chr(i) for i in range(0x21, 0x7F)], list(" \t\n'"), list("0123456789")]
    ours, codec = op10.ChunkTokenizer(PATH), op12.StretchCodec(PATH)
    for _ in range(150):
        check(["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 50))) for _ in range(8)], library, ours, codec)
    check(["É<|endoftext|>Été, x", "ÀH̱ <|"], library, ours, codec)


def test_letters_only():
    words = ["abc", "été", "÷", "×a", "a÷", "É", "ł", "a1", "ÿ", "µ", "a"]
    assert op10.letters_only(np.frombuffer(" ".join(words).encode(), np.uint8)).tolist() == [True, True, False, False, False, False, False, False, True, False, True]
    broken = [b"\xc3", b"a\xc3", b"\xa9a", b"\xc3\xc3\xa9", b"\xc3\xa9\xa9", b"a"]  # no UTF-8
    assert op10.letters_only(np.frombuffer(b" ".join(broken), np.uint8)).tolist() == [False] * 5 + [True]


def test_forgotten_stretches_are_learnt_anew(library):
    ours = op10.ChunkTokenizer(PATH)
    ours.limit = 3
    for text in ("Ein großer Wald, 10 Bäume", "l'été à Paris", "Ein großer Wald, 10 Bäume"):
        ids, _ = ours.encode(*block([text]), 0)
        assert zlib.crc32(ids) == zlib.crc32(np.array([*library.encode(text, add_special_tokens=False).ids, 0], np.uint32))
