"""Text, value and date expressions.  All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words, scales, currencies and hedges that are folded in values.
ONES = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = {"k": 1e3, "m": 1e6, "b": 1e9, "bn": 1e9, "thousand": 1e3, "million": 1e6, "billion": 1e9}
CURRENCIES = r"(?U)\br\$|\b(?:sgd|usd|brl|eur|myr|gbp|jpy)\b|[$€£¥₹]"
HEDGES = r"(?U)~|≈|\b(?:approx(?:imately)?|about|around|circa|roughly|estimated)\b"
#: Letters within parentheses are a remark on a number, which does not count.
REMARK = r"(?U)\([^)]*[^\W\d_][^)]*\)"
#: A signed decimal number, perhaps a scale, perhaps a per cent sign.
NUMBER_SHAPE = r"^(-?\d+(?:\.\d+)?)\s*(k|m|b|bn|thousand|million|billion)?\s*%?$"
PERIOD = r"^(?:(?:q[1-4]|h[12]|fy|20[0-9]{2})[\s/-]+)+"
LOOSE_PERIOD = r"^(?:(?:q[1-4]|h[12]|fy|20[0-9]{2})\b[\s/-]*)+"


#: A number in plain digits, which needs no normalization.
PLAIN_NUMBER = r"\A-?[0-9]+(?:\.[0-9]+)?\z"


def once(value: Column, body) -> Column:
    """Evaluate ``value`` once a row and hand it to ``body``; a plain reference would be worked out at each use."""
    return F.transform(F.array(value), body)[0]


def fold(text: Column) -> Column:
    """Lower case with sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column) -> Column:
    """Runs of any white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_blank(text: Column) -> Column:
    """No character but white space; the first other one ends the search."""
    return ~text.rlike(r"(?U)\S")


def normalize_text(text: Column) -> Column:
    """Newlines as \\n, no blanks at line ends, no blank lines at either end."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?U)[^\S\n]+(?=\n|$)", "")
    return F.regexp_replace(lines, r"^\n+|\n+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_text(text), 256)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1 unless the text is empty."""
    return F.when(F.char_length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.char_length(text) / 4))).cast("int")


def snippet(text: Column, size: int = 200) -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def _one_of(token: Column, words: list[str], first: int, step: int = 1) -> Column:
    """The number that a word of the list stands for, else null."""
    at = F.array_position(F.array(*map(F.lit, words)), token)
    return F.when(at > 0, first + step * (at - 1))


def expand_cardinals(text: Column) -> Column:
    """Number words as digits, tens with the ones after them as one number; texts without such words pass by."""

    def shown(tokens: Column, t: Column, i: Column) -> Column:
        ten, one = _one_of(t, TENS, 20, 10), _one_of(t, ONES, 0)
        after = _one_of(F.get(tokens, i + 1), ONES, 0)
        before = _one_of(F.get(tokens, i - 1), TENS, 20, 10)
        number = F.coalesce(ten + F.when(after.between(1, 9), after).otherwise(0), one)
        used = before.isNotNull() & one.between(1, 9)
        return F.when(used, F.lit(None).cast("string")).otherwise(F.coalesce(number.cast("string"), t))

    spelled = r"(?U)\b(?:" + "|".join(ONES + TENS) + r")\b"
    joined = once(F.split(text, " "), lambda ts: F.array_join(F.filter(F.transform(ts, lambda t, i: shown(ts, t, i)), lambda x: x.isNotNull()), " "))
    return F.when(text.rlike(spelled), joined).otherwise(text)


def value_text(value: Column) -> Column:
    """The text form by which values are compared; null is empty.  Plain numbers are their own."""
    given = F.coalesce(value, F.lit(""))
    v = F.regexp_replace(fold(given), "−", "-")
    v = F.regexp_replace(v, HEDGES, " ")
    v = F.regexp_replace(v, r"(?<=[a-z])-(?=[a-z])", " ")
    v = F.regexp_replace(v, r"(?<=\d),(?=\d)", "")
    return F.when(given.rlike(PLAIN_NUMBER), given).otherwise(once(squeeze(v), lambda x: squeeze(expand_cardinals(x))))


def value_number(text: Column) -> Column:
    """The number that a whole :func:`value_text` is, scale words applied, else null.  A per cent sign does not scale.

    One match takes the number and its scale, parted by a control character.
    """
    bare = F.regexp_replace(F.regexp_replace(text, CURRENCIES, " "), REMARK, " ")
    bare = F.regexp_replace(squeeze(bare), r"(?<=-)\s+(?=\d)", "")
    scales = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    scaled = lambda p: p[1].try_cast("double") * F.coalesce(F.try_element_at(scales, p[2]), F.lit(1.0))
    parts = once(F.split(F.regexp_replace(bare, NUMBER_SHAPE, "\x01$1\x01$2"), "\x01"), lambda p: F.when(F.size(p) == 3, scaled(p)))
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double")).otherwise(parts)


def values_conflict(text_a: Column, number_a: Column, text_b: Column, number_b: Column, tolerance: float = 1e-9) -> Column:
    """Two known values that differ: by number where both are numbers, else by text."""
    apart = F.abs(number_a - number_b) > F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(number_a), F.abs(number_b)))
    return F.when(number_a.isNotNull() & number_b.isNotNull(), apart).otherwise(text_a != text_b)


def strip_period(predicate: Column) -> Column:
    """A predicate in lower case without leading quarters, halves and years."""
    return F.regexp_replace(F.lower(F.trim(predicate)), PERIOD, "")


def strip_period_loosely(predicate: Column) -> Column:
    """As :func:`strip_period`, but a period needs nothing after it but the end of its word: ``q1:rev`` leaves ``:rev``, ``q1`` nothing."""
    return F.regexp_replace(F.lower(F.trim(predicate)), LOOSE_PERIOD, "")


def coerce_as_of(text: Column) -> Column:
    """Quarter as its last day, year as its last day, ISO date as it is; two quarters or anything else is null."""
    t = F.lower(squeeze(text))
    quarter = F.greatest(F.try_to_number(F.regexp_extract(t, r"\bq([1-4])\b", 1), F.lit("9")), F.lit(0))
    year = F.regexp_extract(t, r"(20\d{2})", 1)
    ends = F.element_at(F.array(*map(F.lit, ["03-31", "06-30", "09-30", "12-31"])), F.greatest(quarter.cast("int"), F.lit(1)))
    by_quarter = F.when((quarter > 0) & (year != "") & (F.regexp_count(t, F.lit(r"\bq[1-4]\b")) == 1), F.concat_ws("-", year, ends))
    by_year = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-12-31")))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    return F.coalesce(by_quarter, by_year, iso).try_cast("date")


def candidate_terms(question: Column, most: int = 40) -> Column:
    """Words of two or more letters and pairs of adjacent ones, distinct, in order."""
    words = F.regexp_extract_all(question, F.lit(r"([A-Za-z][A-Za-z'&-]+)"))
    pairs = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    return F.slice(F.array_distinct(F.concat(words, pairs)), 1, most)


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text`` without overlap."""
    gone = F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))
    return F.when(F.char_length(part) > 0, F.floor(gone / F.char_length(part)).cast("int")).otherwise(F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a norm is zero."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def confidence(value: Column, evidence_count: Column) -> Column:
    """A given confidence within 0 and 1, else 0.3 and 0.15 for each piece of evidence, at most 0.9."""
    given = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(given, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(F.least(F.lit(0.9), 0.3 + 0.15 * evidence_count))
