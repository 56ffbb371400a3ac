"""The domain of the first web link in a text."""

from __future__ import annotations

from msgloom.functions.text import first_match, literal

# A secure link is preferred, wherever it stands.
SECURE, PLAIN = "https://", "http://"
# What ends a link (besides white space), and what is not part of it at its end.
LINK_END = ")>,;"
LINK_TAIL = ".!?"

_LINK = rf"(?sU)^(?:.*?(?={SECURE})|.*?(?={PLAIN}))(https?://[^\s{LINK_END}]*)"
_USER = r"(?:[^/\\?#]*@)?"
_HOST = r"(\[[0-9A-Fa-f:.]+\]|[^\x00-\x20\x7F<>^|%\[\]:@/\\?#]+)"
_PORT = r"(?::0*(?:[0-9]{0,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]))?"
_AUTHORITY = rf"^https?:[/\\]*{_USER}{_HOST}{_PORT}(?=[/\\?#]|\z)"


def link_token(text: str) -> str:
    """The first https link, else the first http link; NULL if there is none."""
    return f"rtrim({literal(LINK_TAIL)}, {first_match(text, _LINK, 1)})"


def link_domain(text: str) -> str:
    """Lower-case host of the link without user, port and one leading `www.`; NULL
    for a link without a valid host or port.

    Hosts stay as written: Unicode names are not turned into their ASCII form
    and numeric addresses are not rewritten.
    """
    host = f"lower({first_match(link_token(text), _AUTHORITY, 1)})"
    return rf"regexp_replace({host}, r'^www\.', '')"
