"""The signatures and other patterns mean to the JVM what they mean to Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from huntframe.functions.patterns import FOLDED, java_pattern
from huntframe.operators.signatures import NEEDS, SIGNATURES, _folded, pattern_hits
from huntframe.sources.lines import parse_logs

#: White space, letters and digits beyond ASCII that Python's classes hold, or do not hold, where the JVM's own would differ.
ODD = "\u00a0\u3000\u2003\u2009\u202f\u1680\x1c\x1f\x0b\u200b\u017f\u0130\u0131\u212a\u00e9\u00c9\u00df\u0661\uff13\u00b2\u0301_ \x85\r"
EVASIONS = [
    ("onload\u00a0=x", "xss_attempt"),
    ("alert\u3000(1)", "xss_attempt"),
    ("waitfor' waitfor\u00a0delay", "sql_injection"),
    ("<\u017fcript>", "xss_attempt"),
    ("(\u2009)\u00a0{ :;}; echo", "shellshock"),
    (";\u3000cat", "command_injection"),
    ("jnd\u0131:ldap://x", "log4shell"),
    ("jndi:\u00e9\u0661://", "log4shell"),
    ("scp a \u0661\u0662.0.0.\u0663", "data_exfiltration_hint"),
    ("wp-adm\u0130n", None),
    ("authenticat\u0131on failure", "multiple_auth_failure"),
    ("account loc\u212aed", "account_lockout"),
]


def test_white_space_digits_and_case_beyond_ascii_hide_nothing(spark):
    lines = [t for t, _ in EVASIONS] + ["; cate", "; cat\u00e9", "; cat\u0301", ";cat_", ";cat\u0661", "quiet"]
    log = parse_logs(spark.createDataFrame(list(enumerate(lines)), "seq long, value string"), "generic")
    got = {(r.seq, r.finding_type) for r in pattern_hits(log).collect()}
    rows = log.select("seq", *{f for s in SIGNATURES for f in s.fields}).collect()
    assert got == {(r.seq, s.name) for r in rows for s in SIGNATURES if any(r[f] and re.search(s.pattern, r[f]) for f in s.fields)}
    assert all((i, name) in got for i, (_, name) in enumerate(EVASIONS) if name)


def test_signatures_agree_with_python_on_odd_text(spark):
    from huntframe.fixtures import ATTACKS

    rng = random.Random(8)
    pool = [*ATTACKS, "x'--select", "waitfor  delay", "on click=", "onkey =", "() {a;b;bash", "jndi:ab://", "su: x success", "scp a 10.0.0.1", "nc -l 1.2.3.4 4444", "base64 -decode >", "; nc", "| sh", "curl/7"]
    texts = []
    for _ in range(1500):
        text = list(" ".join(rng.choice(pool) for _ in range(rng.randint(1, 3))))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(ODD)
        texts.append("".join(c.upper() if rng.random() < 0.2 else c for c in text))
    log = spark.createDataFrame([(i, t, None if i % 2 else "x", None, None) for i, t in enumerate(texts)], "seq long, message string, raw string, http_path string, user_agent string")
    got = {(r.seq, r.finding_type) for r in pattern_hits(log).collect()}
    assert got == {(i, s.name) for i, t in enumerate(texts) for s in SIGNATURES if "message" in s.fields and re.search(s.pattern, t)}


@pytest.mark.parametrize("pattern", [r"a\sb", r"\Sx\S", r"\w+\d", r"\bid\b", r"x\B", r"[\s,]+q", r"[^\w]z", r"(?i)kiss", r"(?i)[a-k]s", r"a.b", r"[]x]y", r"[^]x]y", r"a$", r"[a&&b[]c"])
def test_patterns_one_by_one(spark, pattern):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abidxyzqKSkis ,&[]\n" + ODD) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(java_pattern(pattern)).alias("hit"))
    wrong = [r.t for r in df.collect() if r.hit != bool(re.search(pattern, r.t))]
    assert not wrong, wrong[:5]


def test_the_gate_folds_case_as_the_patterns_do(spark):
    odd = [c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and re.fullmatch("(?i)[a-z]", c)]
    assert sorted(odd) == sorted(FOLDED)
    texts = ["".join(odd), "abc\u00c9", "NUL", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(_folded("t")).collect()
    assert [r[0] for r in rows] == ["".join(FOLDED[c] for c in odd), "abc\u00e9", "nul", ""]
    assert set(NEEDS) == {s.name for s in SIGNATURES}


def test_opposites_inside_brackets_are_refused():
    with pytest.raises(ValueError):
        java_pattern(r"[\S,]")


def test_words_are_looked_for_in_one_reading(spark):
    """Every text that a signature needs is found wherever it begins, also inside of another; the plan reads the text once, not once a word."""
    from huntframe.operators.signatures import _any_of, searched

    words = sorted({w for texts in NEEDS.values() for w in texts})
    texts = [f"x{a}{b}y" for a in words for b in words[::7]] + [a[:-1] + b for a in words for b in words if a[-1] == b[0]]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(_any_of(words)), F.lit(1)).alias("f"))
    for r in found.collect():
        assert {w for w in words if w in r.t} == {w for w in words if any(f.startswith(w) for f in r.f)}, r.t
    log = spark.createDataFrame([(1, "/a", "m", "u", "r")], "seq long, http_path string, message string, user_agent string, raw string")
    plan = searched(log)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") < len(words) / 10


def test_ascii_patterns(spark):
    """On ASCII text a signature's short form means what its full form means."""
    from huntframe.functions.patterns import ascii_pattern

    texts = ["; CAT x", "x;sh_", "() {\x1f:;}; sh", "waitfor\x1cdelay '", "$(\tID-1", "scp 1.2.3.4", "Failed x ROOT ssh", "sudo\nroot"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for s in SIGNATURES:
        assert df.filter(F.col("t").rlike(java_pattern(s.pattern)) != F.col("t").rlike(ascii_pattern(s.pattern))).isEmpty(), s.name
    assert ascii_pattern("(?i)ſ") == java_pattern("(?i)ſ") and ascii_pattern(r"ſ") == java_pattern(r"ſ")
