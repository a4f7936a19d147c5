"""Text analysis as native expressions: folding, term extraction and Porter stems."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.session import build_once

# The combining marks the index tokenizer drops inside a word.
DROPPED_MARKS = (
    "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311"
    "\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
)
# Letters with a plain twin that lower-casing alone does not give.
LETTER_TWINS = {
    "\u00b5": "\u03bc", "\u017f": "s", "\u1e9b": "s", "\u03c2": "\u03c3", "\u03d0": "\u03b2",
    "\u03d1": "\u03b8", "\u03d5": "\u03c6", "\u03d6": "\u03c0", "\u03f0": "\u03ba",
    "\u03f1": "\u03c1", "\u03f5": "\u03b5",
}
# What JavaScript's \s covers (Java's and RE2's \s are ASCII only).
JS_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Symbols that the index tokenizer's Unicode version does not know yet; it keeps them as letters.
LATE_SYMBOLS = (
    (0x20BA, 0x20C0), (0x23F4, 0x23FF), (0x2700, 0x2700), (0x2B4D, 0x2B4F), (0x2B5A, 0x2B73), (0x2B76, 0x2B95),
    (0x2B97, 0x2BFF), (0x1F02C, 0x1F02F), (0x1F094, 0x1F09F), (0x1F0AF, 0x1F0B0), (0x1F0BF, 0x1F0C0),
    (0x1F0D0, 0x1F0D0), (0x1F0E0, 0x1F0FF), (0x1F10D, 0x1F10F), (0x1F12F, 0x1F12F), (0x1F16C, 0x1F16F),
    (0x1F19B, 0x1F1E5), (0x1F203, 0x1F20F), (0x1F23B, 0x1F23F), (0x1F249, 0x1F24F), (0x1F252, 0x1F2FF),
    (0x1F321, 0x1F32F), (0x1F336, 0x1F336), (0x1F37D, 0x1F37F), (0x1F394, 0x1F39F), (0x1F3C5, 0x1F3C5),
    (0x1F3CB, 0x1F3DF), (0x1F3F1, 0x1F3FF), (0x1F43F, 0x1F43F), (0x1F441, 0x1F441), (0x1F4F8, 0x1F4F8),
    (0x1F4FD, 0x1F4FF), (0x1F53E, 0x1F53F), (0x1F544, 0x1F54F), (0x1F568, 0x1F5FA), (0x1F641, 0x1F644),
    (0x1F650, 0x1F67F), (0x1F6C6, 0x1F6FF), (0x1F774, 0x1FAFF),
)
LETTER = r"\p{L}\p{N}\p{Co}" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATE_SYMBOLS)
TERM_PATTERN = f"[{LETTER}]+"
# A word in unfolded text: marks may follow its first letter.
WORD_PATTERN = f"[{LETTER}][{LETTER}{DROPPED_MARKS}]*"


def _quick(members: str) -> str:
    """The same class with ASCII told apart first: Java tries the many members of a class one after the other."""
    return f"[a-zA-Z0-9[\\x{{80}}-\\x{{10FFFF}}&&[{members}]]]"


# For Java's regular expressions alone: the same matches in a part of the time.
QUICK_TERM = f"{_quick(LETTER)}+"
QUICK_WORD = f"{_quick(LETTER)}{_quick(LETTER + DROPPED_MARKS)}*"


def _accent_table() -> tuple[str, str]:
    """Lower-case letters made of one ASCII letter and one dropped mark, and that letter."""
    plain = dict(LETTER_TWINS)
    for code in range(0xC0, 0x2000):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) == 2 and parts[0].isascii() and parts[1] in DROPPED_MARKS and letter.lower() == letter:
            plain[letter] = parts[0]
    return "".join(plain), "".join(plain.values())


ACCENTED, UNACCENTED = _accent_table()


def is_ascii(text: Column) -> Column:
    return F.char_length(text) == F.octet_length(text)


def fold(text: Column) -> Column:
    """Lower-case without accents. Capital sigma goes first: Java lower-cases it by context."""
    lowered = F.lower(F.translate(text, "Σ", "σ"))
    # translate drops what has no counterpart: here the combining marks.
    plain = F.translate(lowered, ACCENTED + DROPPED_MARKS, UNACCENTED)
    return F.when(is_ascii(text), F.lower(text)).otherwise(plain)


def terms(text: Column) -> Column:
    """The folded terms of a text in order."""
    return F.when(
        is_ascii(text), F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    ).otherwise(F.regexp_extract_all(fold(text), F.lit(QUICK_TERM), F.lit(0)))


def count_terms(text: Column) -> Column:
    """How many terms a text has, without building them."""
    return F.when(is_ascii(text), F.regexp_count(text, F.lit("[A-Za-z0-9]+"))).otherwise(
        F.regexp_count(text, F.lit(QUICK_WORD))
    )


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(text, f"[{JS_SPACE}]+", " "), "^ | $", ""
    )


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")


# --- Porter stemmer ---------------------------------------------------------------------
# The suffix lists of the published algorithm (Porter 1980), with logi -> log.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
# Consonant and vowel runs. A leading y is written Y, so that it counts as a consonant.
C_RUN = "[^aeiou][^aeiouy]*"
V_RUN = "[aeiouy][aeiou]*"
MEASURE_OVER_0 = f"^(?:{C_RUN})?{V_RUN}{C_RUN}"
MEASURE_OVER_1 = f"^(?:{C_RUN})?{V_RUN}{C_RUN}{V_RUN}{C_RUN}"
MEASURE_IS_1 = f"^(?:{C_RUN})?{V_RUN}{C_RUN}(?:{V_RUN})?$"
HAS_VOWEL = f"^(?:{C_RUN})?[aeiouy]"
# Consonant, vowel, consonant at the end; the last one is a single byte other than w, x, y.
SHORT_END = "^[^aeiou][^aeiouy]*[aeiouy][b-df-hj-np-tvz0-9]$"
# The last letters of all endings that a rule looks for; a word that ends otherwise is its own stem.
RULED_END = "[cdegilmnrstuy]$"
DOUBLE_END = "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|00|11|22|33|44|55|66|77|88|99)$"


def _bind(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _base(word: Column, suffix: Column) -> Column:
    return F.substring(word, F.lit(1), F.char_length(word) - F.char_length(suffix))


def _cut_suffix(word: Column, suffixes, rule) -> Column:
    """Apply rule(word, base, suffix) to the longest of the suffixes that ends the word."""
    pattern = f"(?:{'|'.join(suffixes)})$"

    def with_suffix(w: Column) -> Column:
        suffix = F.regexp_extract(w, pattern, 0)
        return _bind(
            F.struct(w.alias("w"), suffix.alias("s"), _base(w, suffix).alias("b")),
            lambda x: F.when(x["s"] == "", x["w"]).otherwise(rule(x["w"], x["b"], x["s"])),
        )

    return _bind(word, with_suffix)


def _map_suffix(suffix: Column, table: dict[str, str]) -> Column:
    out = F.lit("")
    for old, new in table.items():
        if new:
            out = F.when(suffix == old, new).otherwise(out)
    return out


def _plural(w: Column) -> Column:
    """Step 1a."""
    return (
        F.when(w.rlike("(?:..sses|.ies)$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("[^s]s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def _repair(b: Column) -> Column:
    """End of step 1b: the word after ed or ing was cut off."""
    return (
        F.when(b.rlike(".(?:at|bl|iz)$"), F.concat(b, F.lit("e")))
        .when(b.rlike(DOUBLE_END), _base(b, F.lit("x")))
        .when(b.rlike(MEASURE_IS_1) & b.rlike(SHORT_END), F.concat(b, F.lit("e")))
        .otherwise(b)
    )


def _past(w: Column, b: Column, s: Column) -> Column:
    """Step 1b."""
    return (
        F.when(w == "eed", "e")
        .when(s == "eed", F.when(b.rlike(MEASURE_OVER_0), F.concat(b, F.lit("ee"))).otherwise(w))
        .when(b.rlike(HAS_VOWEL), _repair(b))
        .otherwise(w)
    )


@build_once
def stem(name: str) -> Column:
    """The Porter stem of a folded term; short and very long terms stay as they are."""
    long_base = lambda w, b, s: F.when(
        b.rlike(MEASURE_OVER_1) & ((s != "ion") | b.rlike("[st]$")), b
    ).otherwise(w)
    replace_by = lambda table: lambda w, b, s: F.when(
        b.rlike(MEASURE_OVER_0), F.concat(b, _map_suffix(s, table))
    ).otherwise(w)
    vowel_before = lambda w, b, s: F.when(b.rlike(HAS_VOWEL), F.concat(b, F.lit("i"))).otherwise(w)
    final_e = lambda w, b, s: F.when(
        b.rlike(MEASURE_OVER_1) | (b.rlike(MEASURE_IS_1) & ~b.rlike(SHORT_END)), b
    ).otherwise(w)
    double_l = lambda w: F.when(
        w.endswith("ll") & w.rlike(MEASURE_OVER_1), _base(w, F.lit("l"))
    ).otherwise(w)

    term = F.col(name)
    word = F.regexp_replace(term, "^y", "Y")
    word = _bind(word, _plural)
    word = _cut_suffix(word, ("eed", "ed", "ing"), _past)
    word = _cut_suffix(word, ("y",), vowel_before)
    word = _cut_suffix(word, STEP2, replace_by(STEP2))
    word = _cut_suffix(word, STEP3, replace_by(STEP3))
    word = _cut_suffix(word, STEP4, long_base)
    word = _cut_suffix(word, ("e",), final_e)
    word = _bind(word, double_l)
    size = F.octet_length(term)
    return F.when((size < 3) | (size > 64) | ~term.rlike(RULED_END), term).otherwise(F.regexp_replace(word, "^Y", "y"))
