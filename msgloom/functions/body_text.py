"""Message text out of the binary rich-text column.

Two encodings occur. The structured one is a serialised object stream, which is read by its
grammar: types, classes and objects, a string being a length and its UTF-8 bytes. The other is
only marked: readable bytes between two class names. Both are read with native binary
and string functions, over the whole value.
"""

from __future__ import annotations

import re

from msgloom.functions.text import first_match, literal, trim_unicode

# Signature of an object stream, and the tag before a string in it.
STREAM_SIGNATURE = "\u0004\u000bstreamtyped"
STRING_TAG = "\u0084\u0001+"
# Fixed value: either tag of a string, as a pattern of three characters. Later strings refer
# back to the class and the type of the first.
ANY_STRING_TAG = r"\x84(?:\x01\+|[\x92-\xFF]{2})"
# Length bytes that announce a longer little-endian length.
LENGTH_2_BYTES = 0x81
LENGTH_4_BYTES = 0x82
# Marks of a stream for something new, nil, the end of an object, a real number, and the
# number of the first reference.
NEW, NIL, END_OF_OBJECT, REAL, FIRST_REFERENCE = 0x84, 0x85, 0x86, 0x83, -110
# The classes before the text of an ordinary stream, with lengths and versions.
TEXT_CLASSES = (
    r"\x19NSMutableAttributedString\x00", r"\x12NSAttributedString\x00", r"\x08NSObject\x00",
    r"\x0FNSMutableString\x01", r"\x08NSString\x01",
)
# Strings of the stream that are not the message.
NOT_BODY_PREFIX = "__"
NOT_BODY_SUFFIX = "AttributeName"
# The two markers, and junk that may stand before the text.
START_MARKER = "NSString"
END_MARKER = "NSDictionary"
JUNK_PREFIXES = ("+2", "iI", "+ ", "+\n", "+!", "+(", "+*", "+<")

# \G ties every match to the end of the one before, so the junk is eaten prefix by
# prefix without a nested repetition that could exhaust the stack.
_JUNK = r"\G(?:" + "|".join(re.escape(p) for p in JUNK_PREFIXES) + r")[ \n\t]*+"
_MARKED = f"(?s){START_MARKER}(.*?){END_MARKER}"
_BODY = f"(?s)^(?!{NOT_BODY_PREFIX}).+(?<!{NOT_BODY_SUFFIX})\\z"


def _bound(name: str, value: str, body: str) -> str:
    """SQL for `body` in which `name` is `value`, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _byte(at: str) -> str:
    return f"CAST(ascii(decode(substr(blob, {at}, 1), 'ISO-8859-1')) AS BIGINT)"


# SQL for the number that stands at position `at` of `blob`, without its sign: its first byte, how
# many more it has, its value, and the position behind it. As a size it announces a string there.
_SPAN = _bound("x", _byte("at"), _bound("more", f"CASE x WHEN {LENGTH_2_BYTES} THEN 2 WHEN {LENGTH_4_BYTES} THEN 4 ELSE 0 END", f"""
    struct(x, more, CAST(at + 1 + more AS INT) AS start,
        if(more = 0, x, aggregate(sequence(more, 1, -1), 0L, (n, i) -> n * 256 + {_byte('at + i')})) AS size)"""))
# SQL for whether all bytes of that string are there, and for the string where it can be a body.
_WHOLE = "(span.x < 128 OR span.more > 0) AND span.start + span.size - 1 <= octet_length(blob)"
_CUT = f"CASE WHEN {_WHOLE} THEN substr(blob, span.start, CAST(span.size AS INT)) END"
_BODY_OF_SPAN = first_match(trim_unicode(f"try_validate_utf8(CAST({_CUT} AS STRING))"), _BODY)

# An object of these classes, as it begins: its chain ends with nil or a known class.
_OBJECT = rf"\x84(?:\x84\x84(?:{'|'.join(TEXT_CLASSES)}))+[\x85\x92-\xFF]"
_ORDINARY = rf"(?s)^{STREAM_SIGNATURE}\x81..\x84\x01@{_OBJECT}(?:\x92{_OBJECT})?{re.escape(STRING_TAG)}"

# The reader of the grammar is a pushdown automaton. Its stack `todo` is a text whose first
# character says what comes next: a type character of the stream, or one of these.
_ROOT, _GROUP, _CLASS, _SHARED = "0123"


def _step() -> str:
    """SQL for the state after one symbol: position, stack, shared strings, text found, and
    whether the stream broke the grammar."""

    def state(at: str, todo: str = "rest", types: str = "s.types", found: str = "CAST(NULL AS STRING)", bad: str = "false") -> str:
        return f"struct(CAST({at} AS INT) AS at, {todo} AS todo, {types} AS types, {found} AS found, {bad} AS bad)"

    broken = state("s.at", "s.todo", bad="true")
    end = "span.start + span.size"
    strings = f"op IN ('{_ROOT}', '{_GROUP}', '{_SHARED}', ':', '%')"
    # A shared string is new, or a reference to one; a group goes on with the types it names.
    follows = f"concat(if(op IN ('{_ROOT}', '{_GROUP}'), concat(name, op), ''), rest)"
    new = _bound("name", "decode(substr(blob, span.start, CAST(span.size AS INT)), 'ISO-8859-1')",
                 state(end, follows, "concat(s.types, array(name))"))
    modulus = "CASE span.more WHEN 0 THEN 256L WHEN 2 THEN 65536L ELSE 4294967296L END"
    number = _bound("m", modulus, f"CAST(span.size - if(2 * span.size < m, 0, m) - ({FIRST_REFERENCE}) AS INT)")
    known = _bound("name", f"get(s.types, {number})", f"if(name IS NULL, {broken}, {state('span.start', follows)})")
    # Something else that is shared is nil, new, or a reference.
    inside = f"CASE op WHEN '@' THEN '{_CLASS}{_GROUP}' WHEN '*' THEN '{_SHARED}' ELSE '{_SHARED}i{_CLASS}' END"
    raw = _bound("n", "regexp_extract(rest, r'^([0-9]{1,9})[cC]\\]', 1)", f"""if(n = '' OR s.at + CAST(n AS INT) - 1 > octet_length(blob),
        {broken}, {state("s.at + CAST(n AS INT)", "substr(rest, length(n) + 3)")})""")
    one = f"""CASE
        WHEN op = '[' THEN {raw}
        WHEN op IN ('{{', '}}') THEN {state('s.at', "if(op = '}', rest, regexp_replace(rest, r'^[^=}]*=?', ''))")}
        WHEN s.at > octet_length(blob) THEN {broken}
        WHEN op = '{_GROUP}' AND b = {END_OF_OBJECT} OR op IN ('c', 'C') OR b = {NIL} AND op IN ('{_SHARED}', '{_CLASS}', '@', '#', '*', '+', ':', '%')
            THEN {state('s.at + 1')}
        WHEN {strings} THEN CASE WHEN b <> {NEW} THEN {known} WHEN {_WHOLE} THEN {new} ELSE {broken} END
        WHEN op IN ('{_CLASS}', '@', '#', '*') AND b = {NEW} THEN {state('s.at + 1', f"concat({inside}, rest)")}
        WHEN op = '+' THEN if({_WHOLE}, {state(end, found=_BODY_OF_SPAN)}, {broken})
        WHEN op IN ('f', 'd') AND b = {REAL} THEN {state("s.at + if(op = 'f', 5, 9)")}
        WHEN op RLIKE '^[{_CLASS}@#*sSiIlLqQBfd]' THEN {state('span.start')}
        ELSE {broken} END"""
    span = _bound("at", f"s.at + if(b = {NEW} AND {strings}, 1, 0)", _bound("span", _SPAN, one))
    return _bound("op", "left(s.todo, 1)", _bound("rest", "substr(s.todo, 2)", _bound("b", _byte("s.at"), span)))


def _by_grammar() -> str:
    """SQL for the end of reading a stream `blob`: what was found, and whether the grammar broke
    before. A stream has fewer than three symbols a byte, but for nests of empty types; two loops, one
    inside the other, allow for as many, and neither needs a long sequence."""
    first = _bound("at", f"{len(STREAM_SIGNATURE) + 1}", _bound("span", _SPAN, "span.start"))
    over = f"s.found IS NOT NULL OR s.bad OR (s.todo = '{_ROOT}' AND s.at > octet_length(blob))"
    loop = "sequence(1, CAST(ceil(sqrt(3.0D * octet_length(blob))) AS INT))"
    inner = f"aggregate({loop}, s, (s, i) -> if({over}, s, {_step()}))"
    return f"""aggregate({loop}, struct({first} AS at, '{_ROOT}' AS todo,
        CAST(array() AS ARRAY<STRING>) AS types, CAST(NULL AS STRING) AS found, false AS bad),
        (s, j) -> if({over}, s, {inner}), s -> struct(s.found AS found, s.bad OR s.todo <> '{_ROOT}' AND s.found IS NULL AS bad))"""


def structured_text(blob: str) -> str:
    """The first string of an object stream that can be a message body; NULL if there is none.
    Strings that are not UTF-8 are passed over.

    An ordinary stream begins with known classes, and its text is at once behind them. Any other is
    read symbol by symbol, so that tags inside other data mean nothing. Where a stream
    breaks the grammar its strings are looked for by their tags.

    Lambdas bind each intermediate value, so it is written and computed once. Strings by tags
    take one step per tag, each from the end of the string before, with a position and the
    text found as state.
    """
    ordinary = f"nullif(length(regexp_extract(l, {literal(_ORDINARY)}, 0)), 0)"
    at_once = _bound("at", f"{ordinary} + 1", f"if(at IS NULL, NULL, {_bound('span', _SPAN, _BODY_OF_SPAN)})")
    step = _bound("at", f"nullif(regexp_instr(substr(l, s.at), {literal(ANY_STRING_TAG)}), 0) + s.at + {len(STRING_TAG) - 1}",
                  _bound("span", _SPAN, f"struct(if({_WHOLE}, CAST(span.start + span.size AS INT), at) AS at, {_BODY_OF_SPAN} AS found)"))
    by_tags = f"""aggregate(sequence(1, regexp_count(l, {literal(ANY_STRING_TAG)})),
        struct(nullif(instr(l, {literal(STRING_TAG)}), 0) AS at, CAST(NULL AS STRING) AS found),
        (s, i) -> if(s.found IS NOT NULL OR s.at IS NULL, s, {step}), s -> s.found)"""
    by_grammar = _bound("read", _by_grammar(), f"if(read.bad, if(contains(l, {literal(STRING_TAG)}), {by_tags}, NULL), read.found)")
    found = f"if(startswith(l, {literal(STREAM_SIGNATURE)}), coalesce({at_once}, {by_grammar}), NULL)"
    return _bound("blob", blob, _bound("l", "decode(blob, 'ISO-8859-1')", found))


def marked_text(blob: str) -> str:
    """Readable text between the two markers, without leading junk; NULL if empty."""
    readable = rf"regexp_replace(decode({blob}, 'ISO-8859-1'), r'[^\x20-\x7E\n\t]', ' ')"
    between = f"btrim(regexp_extract({readable}, {literal(_MARKED)}, 1), ' \n\t')"
    return first_match(f"regexp_replace({between}, {literal(_JUNK)}, '')", r"(?s)^.+\z")


def inferred_text(blob: str) -> str:
    """The text of a blob: structured if possible, else marked."""
    return f"coalesce({structured_text(blob)}, {marked_text(blob)})"
