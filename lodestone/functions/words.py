"""Tokens of one text in plain Python, for queries, snippet lines and table functions.

No Spark objects here: functions of this module are sent to Python workers.
"""

from __future__ import annotations

import regex

from .stem import norm_word

# Fixed values.
URL = r"https?://\S+"
EMAIL = r"[A-Za-z0-9_.+-]+@([a-zA-Z0-9_-]+[.])+[A-Za-z]+"
RAW = r"[A-Za-z]+|[0-9]+|\p{L}[A-Za-z]*|\p{N}[0-9]*|[^\p{P}\p{S}\p{Z}\s\x{85}\x{FEFF}]"
STOP = ["the", "on", "in", "as"]

_RAW = regex.compile(RAW.replace(r"\x{85}", r"\x85").replace(r"\x{FEFF}", "\ufeff"))
_URL, _EMAIL, _SPACE = regex.compile(URL), regex.compile(EMAIL), regex.compile(r"[\s\x85\p{Z}]+")
_LETTERS, _UPPER, _LOWER, _PARTS = (regex.compile(p) for p in (r"\p{L}+", r"\p{Lu}", r"\p{Ll}", r"\p{Lu}[^\p{Lu}]*|^[^\p{Lu}]+"))


def tokens_of(text: str, norm_word=norm_word) -> set[str]:
    """The tokens of one text (queries and snippet lines), on the driver or inside a pandas function."""
    out: set[str] = set()
    for block in _SPACE.split(_EMAIL.sub("", _URL.sub(" ", text))):
        before = None
        for word in _RAW.findall(block):
            norm = norm_word(word)
            if _LETTERS.fullmatch(word) and _UPPER.search(word) and _LOWER.search(word):
                parts = [norm_word(p) for p in _PARTS.findall(word)]
                out.update(p for p in parts if p not in STOP)
                out.update(a + b for a, b in zip(parts, parts[1:], strict=False))
            if norm not in STOP:
                out.add(norm)
            if before is not None and before.isascii() == norm.isascii():
                out.add(before + "-" + norm if norm.isascii() else before + norm)
            before = norm
    return out
