"""The stem of a term where its postings are made: `text.stem` in Python, word for word the same.

Postings are grouped outside the JVM, where each different word of a block is stemmed once. The rules and their lists
are those of `text.stem`.
"""

from __future__ import annotations

import re
from functools import lru_cache

from inkwell.functions import text

_RULED = re.compile(text.RULED_END)
_OVER_0, _OVER_1, _IS_1 = map(re.compile, (text.MEASURE_OVER_0, text.MEASURE_OVER_1, text.MEASURE_IS_1))
_VOWEL, _SHORT, _DOUBLE = map(re.compile, (text.HAS_VOWEL, text.SHORT_END, text.DOUBLE_END))
_SSES, _PAST = re.compile("(?:..sses|.ies)$"), re.compile("(?:eed|ed|ing)$")
_STEP2, _STEP3, _STEP4 = (re.compile(f"(?:{'|'.join(s)})$") for s in (text.STEP2, text.STEP3, text.STEP4))
# Words met lately; no word is longer than 64 bytes.
RECENT = 100_000


def porter(term: str) -> str:
    size = len(term) if term.isascii() else len(term.encode())
    return term if size < 3 or size > 64 or not _RULED.search(term) else _stem(term)


def _repaired(b: str) -> str:
    if re.search(".(?:at|bl|iz)$", b):
        return b + "e"
    if _DOUBLE.search(b):
        return b[:-1]
    return b + "e" if _IS_1.search(b) and _SHORT.search(b) else b


def _past(w: str) -> str:
    found = _PAST.search(w)
    if not found:
        return w
    b, s = w[: found.start()], found[0]
    if w == "eed":
        return "e"
    if s == "eed":
        return b + "ee" if _OVER_0.search(b) else w
    return _repaired(b) if _VOWEL.search(b) else w


@lru_cache(RECENT)
def _stem(term: str) -> str:
    w = "Y" + term[1:] if term[0] == "y" else term
    if _SSES.search(w):
        w = w[:-2]
    elif w.endswith("s") and w[-2:-1] not in ("s", ""):
        w = w[:-1]
    w = _past(w)
    if w.endswith("y") and _VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    for pattern, table in ((_STEP2, text.STEP2), (_STEP3, text.STEP3)):
        if (found := pattern.search(w)) and _OVER_0.search(b := w[: found.start()]):
            w = b + table[found[0]]
    if (found := _STEP4.search(w)) and _OVER_1.search(b := w[: found.start()]) and (found[0] != "ion" or b[-1:] in ("s", "t")):
        w = b
    if w.endswith("e") and (_OVER_1.search(b := w[:-1]) or (_IS_1.search(b) and not _SHORT.search(b))):
        w = b
    if w.endswith("ll") and _OVER_1.search(w):
        w = w[:-1]
    return "y" + w[1:] if w[:1] == "Y" else w
