"""Patterns with Python's meaning for the JVM's engine."""

from __future__ import annotations

import re

#: White space, digits and word characters as Python has them in text; the JVM's own classes are ASCII's, or differ in
#: the separators U+001C to U+001F and in combining marks.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"
_CLASSES = {"s": SPACE, "d": DIGIT, "w": WORD}
#: What of them is there in ASCII text.
_ASCII_CLASSES = {"s": r"\t-\r\x1c-\x20", "d": "0-9", "w": "A-Za-z0-9_"}


def _edge(word: str) -> str:
    return f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"


def _no_edge(word: str) -> str:
    return f"(?:(?<=[{word}])(?=[{word}])|(?<![{word}])(?![{word}]))"


#: Characters beyond ASCII that match an ASCII letter where case does not count, and that letter.
FOLDED = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def ascii_pattern(pattern: str) -> str:
    """The same for text that is ASCII only, where it is matched many times faster. A pattern that may hold other characters itself is as for any text."""
    return java_pattern(pattern) if not pattern.isascii() or re.search(r"\\[uUxN0-9]", pattern) else _java(pattern, _ASCII_CLASSES, "(?id)")


def java_pattern(pattern: str) -> str:
    """A pattern as Python reads it, written for the JVM: Unicode classes, word edges and case, and lines that end at line feeds only.

    A flag (?i) counts where it stands in front. Inside brackets, classes may be named (`[\\s,]`), but not their
    opposites. Everything else goes through as it is.
    """
    return _java(pattern, _CLASSES, "(?iud)")


def _java(pattern: str, classes: dict[str, str], folding: str) -> str:
    folds = pattern.startswith("(?i)")
    rest, out, inside, at = pattern[4:] if folds else pattern, [], False, 0
    while at < len(rest):
        c = rest[at]
        if c == "\\":
            kind, at = rest[at + 1 : at + 2], at + 2
            if kind in classes:
                out.append(classes[kind] if inside else f"[{classes[kind]}]")
            elif kind and kind in "SDW":
                if inside:
                    raise ValueError(f"\\{kind} inside brackets: {pattern}")
                out.append(f"[^{classes[kind.lower()]}]")
            elif kind and kind in "bB" and not inside:
                out.append((_edge if kind == "b" else _no_edge)(classes["w"]))
            else:
                out.append("\\" + kind)
            continue
        if c == "[" and not inside:
            inside = True
            after = at + 2 if rest[at + 1 : at + 2] == "^" else at + 1
            if rest[after : after + 1] == "]":  # a bracket that stands first is an ordinary one
                out.append(rest[at:after] + "\\]")
                at = after + 1
                continue
        elif c == "[":
            c = "\\["
        elif c == "&" and inside:
            c = "\\&"
        elif c == "]":
            inside = False
        out.append(c)
        at += 1
    return (folding if folds else "(?d)") + "".join(out)
