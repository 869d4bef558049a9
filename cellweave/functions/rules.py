"""Outer-totalistic birth/survival rules: value class, text and integer codecs, and the same codecs as columns.

A rule of ``dims`` dimensions has a birth and a survival flag for every neighbour count, 0 to 8 (2D) or 0 to 26 (3D).  Its
integer code holds the birth flags in the low bits and the survival flags above them.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Neighbour counts by number of dimensions.
COUNTS = {2: 9, 3: 27}


def _flags(values: Iterable, count: int, name: str) -> tuple[bool, ...]:
    if isinstance(values, (str, bytes)):
        raise ValueError(f"{name} must be a sequence of flags, not text")
    flags = tuple(values)
    if len(flags) != count:
        raise ValueError(f"{name} needs {count} flags, got {len(flags)}")
    for flag in flags:
        if not isinstance(flag, bool) and flag not in (0, 1):
            raise ValueError(f"{name} holds {flag!r}, which is no flag")
    return tuple(map(bool, flags))


@dataclass(frozen=True)
class Rule:
    """Birth and survival flags; validated and normalised to tuples of bool."""

    birth: tuple[bool, ...]
    survival: tuple[bool, ...]
    dims: int = 2

    def __post_init__(self) -> None:
        if self.dims not in COUNTS:
            raise ValueError("a rule has 2 or 3 dimensions")
        for name in ("birth", "survival"):
            object.__setattr__(self, name, _flags(getattr(self, name), COUNTS[self.dims], name))

    @property
    def code(self) -> int:
        return sum(1 << i for i, flag in enumerate(self.birth + self.survival) if flag)

    @property
    def text(self) -> str:
        parts = ([str(i) for i, flag in enumerate(flags) if flag] for flags in (self.birth, self.survival))
        return "B{}/S{}".format(*map(("" if self.dims == 2 else ",").join, parts))

    def __str__(self) -> str:
        return self.text


def validate_rule(rule: Rule, dims: int = 2) -> Rule:
    if not isinstance(rule, Rule):
        raise TypeError("expected a Rule")
    if rule.dims != dims:
        raise ValueError(f"expected a rule of {dims} dimensions")
    return rule


#: A section's text by dimensions: digits, or counts parted by commas (one count of two digits at most needs none).
_COUNTS = {2: r"[0-8]*", 3: r"(?:[0-9]{1,2}|[0-9]+[ \t]*(?:,[ \t]*[0-9]+[ \t]*)+)?"}
_RULE = {dims: re.compile(rf"\s*[Bb][ \t]*({counts})\s*/\s*[Ss][ \t]*({counts})\s*" if dims == 3 else rf"\s*[Bb]({counts})\s*/\s*[Ss]({counts})\s*") for dims, counts in _COUNTS.items()}


def _parse(text: str, dims: int) -> Rule:
    if not isinstance(text, str):
        raise TypeError("a rule's text must be a string")
    found = _RULE[dims].fullmatch(text)
    sections = [[int(n) for n in re.findall("[0-9]" if dims == 2 else "[0-9]+", section)] for section in found.groups()] if found else [[-1]]
    for counts in sections:
        if sorted(set(counts) & set(range(COUNTS[dims]))) != sorted(counts):
            raise ValueError(f"{text!r} is no rule of the form {'B3/S23' if dims == 2 else 'B6/S5,6,7'} with different counts up to {COUNTS[dims] - 1}")
    return Rule(*[tuple(i in counts for i in range(COUNTS[dims])) for counts in sections], dims=dims)


def parse_rule(text: str) -> Rule:
    """2D text such as ``B3/S23``: one digit a count, either case, blanks around the slash and at the ends."""
    return _parse(text, 2)


def parse_rule_3d(text: str) -> Rule:
    """3D text such as ``B6/S5,6,7``: counts parted by commas; a section without a comma is one count."""
    return _parse(text, 3)


def format_rule(rule: Rule) -> str:
    return validate_rule(rule, rule.dims).text


def rule_to_masks(rule: Rule) -> tuple[list[int], list[int]]:
    return [int(x) for x in rule.birth], [int(x) for x in rule.survival]


def masks_to_rule(birth: Iterable, survival: Iterable, dims: int = 2) -> Rule:
    return Rule(tuple(birth), tuple(survival), dims)


def rule_to_int(rule: Rule) -> int:
    return validate_rule(rule, rule.dims).code


def int_to_rule(code: int, dims: int = 2) -> Rule:
    code, bits = operator.index(code), 2 * COUNTS[dims]
    if not 0 <= code < 1 << bits:
        raise ValueError(f"a {dims}D rule code has {bits} bits")
    flags = [bool(code >> i & 1) for i in range(bits)]
    return Rule(tuple(flags[: bits // 2]), tuple(flags[bits // 2 :]), dims)


#: The rules known by name.
CONWAY = parse_rule("B3/S23")
HIGHLIFE = parse_rule("B36/S23")
DEFAULT_3D_RULE = parse_rule_3d("B6/S5,6,7")


# The same codecs over columns.


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often (or inside of which lambdas) the body names it."""
    return F.transform(F.array(value), body)[0]


def _code_of(counts: Column) -> Column:
    """Sum of 2^count over an array of counts, in a long."""
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + F.call_function("shiftleft", F.lit(1).cast("long"), c))


def rule_code(text: Column, dims: int = 2) -> Column:
    """The integer code of a rule's text; null where the text is no rule."""
    pattern = r"^\s*[Bb]([0-8]*)\s*/\s*[Ss]([0-8]*)\s*$" if dims == 2 else r"^\s*[Bb]([0-9, \t]*?)\s*/\s*[Ss]([0-9, \t]*?)\s*$"

    def tokens(section: Column) -> Column:
        if dims == 2:
            return F.filter(F.split(section, ""), lambda x: x != "")
        return F.when(F.trim(section) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(section, ","), lambda x: F.trim(x)))

    def read(section: Column) -> Column:
        """A section's code, null where it is none."""

        def coded(found: Column) -> Column:
            counts = F.transform(found, lambda x: x.try_cast("int"))
            valid = F.forall(found, lambda x: x.rlike("^[0-9]+$")) if dims == 3 else F.lit(True)
            return let(counts, lambda c: F.when(valid & (F.size(F.array_distinct(c)) == F.size(c)) & F.forall(c, lambda n: F.coalesce(n < COUNTS[dims], F.lit(False))), _code_of(c)))

        whole = F.when(section.contains(",") | (F.length(section) <= 2), section) if dims == 3 else section
        return let(tokens(whole), coded)

    def both(sections: Column) -> Column:
        return let(F.transform(sections, read), lambda codes: codes[0] + F.call_function("shiftleft", codes[1], F.lit(COUNTS[dims])))

    return let(text, lambda t: F.when(t.rlike(pattern), let(F.array(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)), both)))


def rule_bit(code: Column, bit: Column) -> Column:
    """Bit number ``bit`` of a code, 0 or 1."""
    return F.call_function("shiftright", code, bit).bitwiseAND(F.lit(1).cast("long")).cast("int")


def rule_masks(code: Column, dims: int = 2) -> tuple[Column, Column]:
    """Birth and survival flags of a code, as arrays of 0 and 1."""
    n = COUNTS[dims]
    flags = lambda shift: F.transform(F.sequence(F.lit(shift), F.lit(shift + n - 1)), lambda i: rule_bit(code, i))
    return flags(0), flags(n)


def rule_text(code: Column, dims: int = 2) -> Column:
    """The canonical text of a code."""
    n = COUNTS[dims]

    def section(shift: int) -> Column:
        counts = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: rule_bit(code, i + shift) == 1)
        return F.array_join(F.transform(counts, lambda c: c.cast("string")), "" if dims == 2 else ",")

    return F.concat(F.lit("B"), section(0), F.lit("/S"), section(n))


def editor_state(text: Column, dims: int = 2) -> Column:
    """What a rule editor shows for a text: whether it is a rule, its canonical text, and a flag for each count's switches."""

    def state(code: Column) -> Column:
        birth, survival = rule_masks(code, dims)
        shown = lambda c: F.when(code.isNotNull(), c)
        return F.struct(code.isNotNull().alias("valid"), shown(rule_text(code, dims)).alias("rule"), shown(birth).alias("birth"), shown(survival).alias("survival"))

    return let(rule_code(text, dims), state)
