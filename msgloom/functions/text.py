"""Small helpers shared by the other expressions."""

from __future__ import annotations

# The code points with the Unicode White_Space property.
_WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
UNICODE_WHITESPACE = "".join(map(chr, _WHITE_SPACE))


def literal(text: str) -> str:
    """A string literal without escapes."""
    if "'" in text:
        raise ValueError("quotes are not needed in fixed texts")
    return f"r'{text}'"


def trim_unicode(value: str) -> str:
    """Drop Unicode white space at both ends (Spark's own trim drops only U+0020)."""
    return f"btrim({value}, {literal(UNICODE_WHITESPACE)})"


def first_match(value: str, pattern: str, group: int = 0) -> str:
    """First match of a pattern, NULL if there is none.

    Names its input once. Expressions built from it stay small when the optimizer
    copies them, for instance into a filter.
    """
    return f"get(regexp_extract_all({value}, {literal(pattern)}, {group}), 0)"
