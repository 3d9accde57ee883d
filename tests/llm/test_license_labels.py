"""Which licence a text names: variants of a family, changed words, shared parts and phrases of one word."""

import numpy as np
import pytest

from huntframe.llm import op2_license_scans as op2

VARIANTS = {"cc-by": ("", ""), "cc-by-sa": ("-SA", "-ShareAlike"), "cc-by-nd": ("-ND", "-NoDerivatives"), "cc-by-nc": ("-NC", "-NonCommercial"), "cc-by-nc-sa": ("-NC-SA", "-NonCommercial-ShareAlike"), "cc-by-nc-nd": ("-NC-ND", "-NonCommercial-NoDerivatives")}


def scan(text, phrases=op2.BASE_PHRASES, templates=op2.TEMPLATES):
    scanner = op2.Scanner(dict(phrases), templates)
    words = op2.words_of(text)
    return scanner.scan(scanner.word_ids(op2.hash_words(words)) if words else np.zeros(0, np.int64))


@pytest.mark.parametrize("label", VARIANTS)
@pytest.mark.parametrize("form", ["Licensed under CC BY{0} 4.0", "some prose. This work is licensed under a Creative Commons Attribution{1} 4.0 International License, it says"])
def test_variants_are_told_apart(label, form):
    spans = scan(form.format(*VARIANTS[label])).spans
    assert {s[0] for s in spans} == {label} and max(s[3] for s in spans) == 1.0


@pytest.mark.parametrize("template", range(len(op2.TEMPLATES)))
def test_one_changed_word_leaves_the_label(template):
    label, text = op2.TEMPLATES[template]
    words = text.split()
    if len(words) < 20:
        return
    words[len(words) // 2] = "zzz"
    spans = scan(" ".join(words)).spans
    assert {s[0] for s in spans} == {label} and 0.9 < max(s for s in spans if s[1] == 0)[3] < 1 or label == "apache"


def test_a_telling_word_is_not_jumped():
    spans = scan("This work is licensed under a Creative Commons Attribution-Something 4.0 International License").spans
    assert all(s[0] == "cc-by" for s in spans)
    text = "This work is licensed under a Creative Commons Attribution-NonCommercial-Something 4.0 International License"
    assert {s[0] for s in scan(text).spans} <= {"cc-by-nc"}


def test_a_template_that_shares_part_of_a_longer_one():
    templates = (("a", "one two three four five six"), ("b", "zero one two three four x y"))
    spans = scan("zero one two three four five six", {}, templates).spans
    assert ("a", 1, 6, 1.0) in spans  # although the longest stretch up to `four` is b's


def test_phrases_of_one_word():
    assert scan("a gpl b mit gpl", {"gpl": "gpl", "mit": "mit"}, ()).places == [(1, "gpl"), (3, "mit"), (4, "gpl")]
    assert scan("nothing here", {"gpl": "gpl"}, ()).places == [] and scan("", {"gpl": "gpl"}, ()).places == []
