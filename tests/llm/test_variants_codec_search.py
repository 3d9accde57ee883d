"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeats, empty tables and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from huntframe.llm import op11_spelling_variants as op11
from huntframe.llm import op12_bpe_codec as op12
from huntframe.llm import op13_ranked_search as op13

LOWER = {c: c + 32 for c in range(65, 91)}
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, item long, rank string, node string"  # names that are used inside


def rows_of(texts):
    return [(i, t, "en", 1, "x", "y") for i, t in texts]


# Operator 11


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            for c in letters:
                yield word[:i] + c + word[i + 1 :]


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    letters = sorted({c for w in n for c in w})
    near = {w: {x for x in edits(w, letters) if x in n and x != w} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def variant_texts():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    words = base + [w[:i] + rng.choice("abcéx") + w[i + rng.randint(0, 1) :] for w in base for i in (0, 2, len(w) // 2, len(w))]
    long = "".join(rng.choice("abcdefgh") for _ in range(90))
    words += [long, long[:10] + "z" + long[10:], long[:80] + long[81:], long[:-1], "z" + long, long[:44] + "zz" + long[46:], long + "a", "aaaaaaa" * 9, "aaaaaaa" * 9 + "a", "aaaaaa", "aaaaaaa", "aaaaab"]
    words += ["chain" * 8, "chain" * 8 + "x", "chainy" + "chain" * 7]  # as long as those that walk, and a little longer
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))) for i in range(90)]
    texts += [(12, "kettleab " * 7 + "kettlebb " * 45 + "kettlbbb " * 260), (None, " ".join(words[:40] * 30)), (7, "ABCABC " * 400 + "abcabé÷×" * 60), (7, None), (8, ""), (9, "日本語 abc 12"), (10, "chain" * 8 + " "), (11, ("abccba " + "chain" * 8 + " ") * 300), (-3, "straßenbahn " * 50 + "strassenbahn " * 9 + "straßenbahm " * 6)]
    return texts


def test_variants_match_brute_force(spark):
    texts = variant_texts()
    got = op11.variants(op11.word_counts(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3))).collect()
    want = brute_variants(texts)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r["root"] != r["form"] and r["form"] for r in got) and any(len(r["word"]) > op11.WALKED and r["n_near"] for r in got)


def test_variants_by_shuffle_and_by_stride_agree(spark, monkeypatch):
    counts = op11.word_counts(spark.createDataFrame(rows_of(variant_texts()), SCHEMA))
    want = sorted(op11.variants(counts).collect(), key=str)
    monkeypatch.setattr(op11, "FEW_ROWS", 0)
    assert sorted(op11.variants(counts).collect(), key=str) == want


def test_variants_of_nothing(spark):
    assert op11.variants(op11.word_counts(spark.createDataFrame([], SCHEMA))).collect() == []
    assert op11.variants(op11.word_counts(spark.createDataFrame(rows_of([(1, None), (2, "short of it")]), SCHEMA))).collect() == []
    with pytest.raises(ValueError):
        op11.variants(spark.createDataFrame([("abcdef", 5)], "word string, n long"), ratio=1)


def test_runs_are_counted_across_a_full_memo(spark, monkeypatch):
    texts = variant_texts()
    want = sorted(op11.word_counts(spark.createDataFrame(rows_of(texts), SCHEMA)).collect())
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)

    class Small(op11.RunCounter):
        limit = 5

    monkeypatch.setattr(op11, "RunCounter", Small)
    assert sorted(op11.word_counts(docs).collect()) == want


# Operator 12


def codec_texts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzaeiouthinerANDé'’ -12.,ß́İſ日本\x1c\x00 😀  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    texts += [None, "", " ", "aaaaaaaaaaaaa", "<|endoftext|>hi<|startoftext|> <|endoftext", "a<|endoftext|>b", "<|ENDOFTEXT|> <| |>", "x" * 4000, "don't WE'LL they'Re '", "é ≮ 1́", "the cat " * 30_000]
    return texts + texts[:20]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_codec_is_the_library(spark, library):
    texts = list(enumerate(codec_texts())) + [(None, "one"), (0, "two")]
    got = op12.round_trip(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3), VOCABULARY).collect()
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want


def test_encode_then_decode(spark, library):
    texts = list(enumerate(codec_texts()[:200])) + [(None, None)]
    encoded = op12.encode(spark.createDataFrame(rows_of(texts), SCHEMA), VOCABULARY)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert ids == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts}
    assert {r["doc_id"]: r["text"] for r in op12.decode(encoded, VOCABULARY).collect()} == {i: library.decode(x, skip_special_tokens=False) for i, x in ids.items()}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [320, 999_999, 49407])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in op12.decode(odd, VOCABULARY).collect()} == {1: None, 2: "", 3: library.decode([320, 49407], skip_special_tokens=False)}
    assert op12.round_trip(spark.createDataFrame([], SCHEMA), VOCABULARY).collect() == []


def test_every_prefix_has_one_last_token(library):
    bpe = op12.Bpe(VOCABULARY)
    for word in ("internationalisation", "aaaaaaaaaaaa", "thththethe", "xqzjjkw"):
        for n in range(1, len(word) + 1):
            assert next(bpe.encode_words([word[:n]])) == library.encode(word[:n], add_special_tokens=False).ids


def test_codec_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        op12.Bpe(public_tokenizers.path("byte_bpe_50k.json"))


# Operator 13


def brute_search(docs, items, k=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    terms = [(i, find((t or "").translate(LOWER))) for i, t in docs]
    terms = [(i, Counter(t), len(t)) for i, t in terms if t]
    total, length = len(terms), sum(n for *_, n in terms)
    df = Counter(x for _, c, _ in terms for x in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c, n in terms:
            m, s = 25 + 75 * n * total // length, 0
            for x in find((text or "").translate(LOWER)):
                if c[x]:
                    s += math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (1_000_000_000 * c[x] // (1000 * c[x] + 8 * m))
            if s > 0:
                scores.append((-s, doc_id is None, doc_id))
        out += [(item_id, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


def search_tables():
    rng = random.Random(9)
    words = ["the", "of", "and"] * 8 + [f"w{i}" for i in range(60)] + ["ÉTÉ", "été", "Zoo"] + [f"rare{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for i in range(700)]
    docs += [(1000 + i, "the zoo of w1 and w2 rare1") for i in range(40)] + [(None, "the zoo of w1 and w2 rare1"), (5, docs[5][1]), (6, None), (7, ""), (8, "!? -"), (9, "the " * 50_000 + "rare1 zoo"), (-4, "the zoo of w1 and w2 rare1")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(25)]
    items += [(30, "the zoo of w1 and w2 rare1"), (30, "zoo zoo zoo"), (None, "Zoo! été"), (31, None), (32, "..."), (33, "nowhere at all"), (34, " ".join(words)), (35, "THE")]
    return docs, items


@pytest.mark.parametrize(("shard", "cells", "leaf"), [(16_384, 1 << 22, 16), (64, 1 << 22, 1), (200, 900, 0)])
def test_search_matches_brute_force(spark, monkeypatch, shard, cells, leaf):
    docs, items = search_tables()
    for name, value in (("SHARD", shard), ("CELLS", cells), ("LEAF", leaf)):
        monkeypatch.setattr(op13, name, value)
    got = op13.search(spark.createDataFrame(rows_of(docs), SCHEMA).repartition(3), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int"))
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items)


def test_search_in_blocks_of_items(spark, monkeypatch):
    docs, items = search_tables()
    monkeypatch.setattr(op13, "BLOCK_ITEMS", 15)
    got = op13.search(spark.createDataFrame(rows_of(docs), SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame(rows_of([(1, "a b"), (2, None)]), SCHEMA), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert op13.search(docs.limit(0), items).collect() == [] == op13.search(docs, items.limit(0)).collect()
    assert op13.search(docs.filter("doc_id = 2"), items).collect() == []


def test_bounds_leave_out_most_of_a_tree():
    rng = np.random.default_rng(2)
    counts = (rng.random((4000, 12)) < np.linspace(0.01, 0.6, 12)).astype(np.int32) * rng.integers(1, 4, (4000, 12), np.int32)
    counts = counts[counts.any(axis=1)]
    m, ids = rng.integers(30, 300, len(counts)), np.arange(len(counts))
    weight, best = np.linspace(6000, 500, 12).astype(np.int64), op13.Best(10)
    scored = op13.FpTree(counts, m, ids, np.zeros(len(ids), bool)).search(weight, best)
    score = op13.parts_of_score(weight, counts, m).sum(axis=1)
    order = np.lexsort((ids, -score))[:10]
    assert best.doc_id.tolist() == ids[order].tolist() and best.score.tolist() == score[order].tolist()
    assert scored < len(ids) / 3
