"""English stems by rules on suffixes, after Porter's second algorithm, as one expression and as SQL.

Left out are its special beginnings (gener-, commun-, arsen-) and its
possessives, as tokens have no apostrophes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

_V, _C = "[aeiouy]", "[^aeiouy]"
_R1, _R2 = f"{_V}{_C}", f"{_V}{_C}.*{_V}{_C}"
_SHORT = f"{_C}{_V}[^aeiouywxY]$|^{_V}{_C}$"

# Words with stems of their own.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}

# Suffix, what the part before it must match, replacement; of each step the first rule that fits acts.
STEPS = [
    [("sses", "", "ss"), ("ied", "..", "i"), ("ied", "", "ie"), ("ies", "..", "i"), ("ies", "", "ie"), ("us", "", "us"), ("ss", "", "ss"), ("s", f"{_V}.", "")],
    [
        ("eedly", _R1, "ee"), ("eedly", "", "eedly"), ("ingly", _V, "~"), ("edly", _V, "~"), ("eed", _R1, "ee"), ("eed", "", "eed"),
        ("ing", _V, "~"), ("ed", _V, "~"),
    ],
    [
        ("at~", "", "ate"), ("bl~", "", "ble"), ("iz~", "", "ize"), *[(2 * c + "~", "", c) for c in "bdfgmnprt"],
        ("~", f"^{_C}*{_V}[^aeiouywxY]$|^{_V}{_C}$", "e"), ("~", "", ""),
    ],
    [("y", f".{_C}$", "i"), ("Y", f".{_C}$", "i")],
    [
        ("ational", _R1, "ate"), ("ization", _R1, "ize"), ("fulness", _R1, "ful"), ("ousness", _R1, "ous"), ("iveness", _R1, "ive"), ("tional", _R1, "tion"),
        ("biliti", _R1, "ble"), ("lessli", _R1, "less"), ("entli", _R1, "ent"), ("ation", _R1, "ate"), ("alism", _R1, "al"), ("aliti", _R1, "al"),
        ("ousli", _R1, "ous"), ("iviti", _R1, "ive"), ("fulli", _R1, "ful"), ("enci", _R1, "ence"), ("anci", _R1, "ance"), ("abli", _R1, "able"),
        ("izer", _R1, "ize"), ("ator", _R1, "ate"), ("alli", _R1, "al"), ("bli", _R1, "ble"), ("ogi", f"(?:{_R1}.*|{_V})l$", "og"),
        ("li", f"(?:{_R1}.*[cdeghkmnrt]|{_V}[cdghkmnrt])$", ""),
    ],
    [
        ("ational", _R1, "ate"), ("tional", _R1, "tion"), ("alize", _R1, "al"), ("icate", _R1, "ic"), ("iciti", _R1, "ic"), ("ative", _R2, ""),
        ("ical", _R1, "ic"), ("ness", _R1, ""), ("ful", _R1, ""),
    ],
    [
        ("ement", _R2, ""), ("ement", "", "ement"), ("ance", _R2, ""), ("ence", _R2, ""), ("able", _R2, ""), ("ible", _R2, ""), ("ment", _R2, ""), ("ment", "", "ment"),
        ("ant", _R2, ""), ("ent", _R2, ""), ("ism", _R2, ""), ("ate", _R2, ""), ("iti", _R2, ""), ("ous", _R2, ""), ("ive", _R2, ""), ("ize", _R2, ""),
        ("ion", f"(?:{_R2}.*[st]|{_R1}.*{_V}[st])$", ""), ("al", _R2, ""), ("er", _R2, ""), ("ic", _R2, ""),
    ],
    [("e", _R2, ""), ("e", _SHORT, "e"), ("e", _R1, ""), ("l", f"(?:{_R2}.*|{_R1}.*{_V})l$", "")],
]

# Words that no search asks for.
STOP_WORDS = [
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "before", "but", "by", "can", "did", "do", "does",
    "for", "from", "had", "has", "have", "he", "her", "his", "how", "i", "if", "in", "into", "is", "it", "its", "me", "my", "no", "nor", "not",
    "of", "on", "or", "our", "she", "so", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "too",
    "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "you", "your",
]


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words under three letters are their own."""

    def step(rules):
        def run(w: Column) -> Column:
            out = None
            for suffix, before, new in rules:
                head = F.substring(w, F.lit(1), F.char_length(w) - len(suffix))
                fits = F.endswith(w, F.lit(suffix)) & (head.rlike(before) if before else F.lit(True))
                made = F.concat(head, F.lit(new))
                out = F.when(fits, made) if out is None else out.when(fits, made)
            return out.otherwise(w)

        return run

    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")
    for rules in STEPS:
        marked = once(marked, step(rules))
    own = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    return F.coalesce(F.try_element_at(own, word), F.when(F.char_length(word) < 3, word).otherwise(F.translate(marked, "Y", "y")))


_RULES = [[(suffix, re.compile(before).search if before else None, new) for suffix, before, new in rules] for rules in STEPS]


def stem_of(word: str) -> str:
    """As :func:`stem`, of one word, for tasks that have texts at hand."""
    if word in IRREGULAR or len(word) < 3:
        return IRREGULAR.get(word, word)
    marked = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    for rules in _RULES:
        for suffix, before, new in rules:
            if marked.endswith(suffix):
                head = marked[: len(marked) - len(suffix)]
                if before is None or before(head):
                    marked = head + new
                    break
    return marked.replace("Y", "y")


def stems_sql(words: str) -> str:
    """CTEs that end in ``stems`` (word, stem), of a table ``words`` (word): the same rules."""
    parts = [f"st0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS s FROM {words})"]
    for k, rules in enumerate(STEPS, 1):
        cases = " ".join(
            f"WHEN suffix(s, '{suffix}')"
            + (f" AND regexp_matches(left(s, length(s) - {len(suffix)}), '{before}')" if before else "")
            + f" THEN left(s, length(s) - {len(suffix)}) || '{new}'"
            for suffix, before, new in rules
        )
        parts.append(f"st{k} AS (SELECT word, CASE {cases} ELSE s END AS s FROM st{k - 1})")
    own = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in IRREGULAR.items())
    parts.append(f"stems AS (SELECT word, CASE word {own} ELSE CASE WHEN length(word) < 3 THEN word ELSE replace(s, 'Y', 'y') END END AS stem FROM st{len(STEPS)})")
    return ",\n".join(parts)
