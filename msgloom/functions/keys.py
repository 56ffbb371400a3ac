"""Contact keys: phone numbers and e-mail addresses in one spelling."""

from __future__ import annotations


def phone_key(phone: str) -> str:
    """Keep ASCII digits, and a plus sign in first place."""
    return rf"regexp_replace({phone}, r'(?!^)\+|[^0-9+]', '')"


def email_key(email: str) -> str:
    return f"lower({email})"


def contact_key(value: str) -> str:
    """Either kind: whatever has an @ is an e-mail address."""
    return f"if(contains({value}, '@'), {email_key(value)}, {phone_key(value)})"
