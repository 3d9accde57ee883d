"""Passages matched by anchors and their positions."""

import random

from huntframe.llm import op8_document_fingerprints as op8


def test_a_repeated_passage_is_found_where_it_stands(spark):
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = prose(400)
    texts = {i: prose(rng.randint(300, 900)) for i in range(30)}
    at = {}
    for i in (3, 7, 8, 20):
        at[i] = rng.randint(0, 200)
        texts[i] = texts[i][: at[i]] + passage + texts[i][at[i] :]
    rows = [(i, t) for i, t in texts.items()] + [(None, passage), (50, None), (51, ""), (52, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in op8.shared_spans(docs).collect()}
    assert set(got) == {7, 8, 20}
    for i, r in got.items():
        assert (r.other, r.offset) == (3, at[i] - at[3])
        assert at[i] - 16 <= r["first"] <= at[i] + 30 and at[i] + 350 <= r["last"] <= at[i] + 400
    assert op8.shared_spans(docs.limit(0)).count() == 0


def test_every_shared_run_is_met_with_its_owner(spark):
    """200 texts against brute force: recall 1, also where a smaller document holds bits of a passage; nulls, repeats and ties do no harm."""
    rng = random.Random(21)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [prose(rng.randint(40, 300)) for _ in range(25)]
    texts = {}
    for i in range(200):
        bits = [prose(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            bits += [p[a : rng.randint(a, len(p))] if rng.random() < 0.5 else p, prose(rng.randint(0, 60))]
        texts[i] = "".join(bits)
    texts[200], texts[201], texts[202] = texts[0], "ab" * 300, "ab" * 200  # a copy, and periods
    least = 6
    rows = [*texts.items(), (5, texts[5]), (None, passages[0]), (300, None), (301, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, position int").repartition(3)
    spans = op8.shared_spans(docs, least).collect()
    covered, runs, first = {}, {}, {}
    for i, t in texts.items():
        at, value = op8.anchors(t)
        runs[i] = [(tuple(value[j : j + least].tolist()), int(at[j]), int(at[j + least - 1])) for j in range(len(at) - least + 1)]
        for key, place, _ in runs[i]:
            first.setdefault(key, (i, place))
    for r in spans:
        covered.setdefault((r.doc_id, r.other, r.offset), []).append((r["first"], r["last"]))
        assert r.anchors >= least and r.other < r.doc_id
        inside = [key for key, a, b in runs[r.doc_id] if r["first"] <= a and b <= r["last"]]
        assert len(inside) == r.anchors - least + 1 and all(first[key][0] == r.other for key in inside)
    met = 0
    for i, own in runs.items():
        for key, a, b in own:
            owner, place = first[key]
            if owner < i:
                met += 1
                assert any(x <= a and b <= y for x, y in covered[i, owner, a - place])
    assert met > 2000 and len(spans) == len({tuple(r) for r in spans})
