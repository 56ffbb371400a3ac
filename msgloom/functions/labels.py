"""Readable labels for reaction codes and send effects."""

from __future__ import annotations

from msgloom.functions.text import first_match

# Reaction codes.
REACTIONS = {
    2000: "Loved",
    2001: "Liked",
    2002: "Disliked",
    2003: "Laughed",
    2004: "Emphasized",
    2005: "Questioned",
    3000: "Removed heart",
    3001: "Removed like",
    3002: "Removed dislike",
    3003: "Removed laugh",
    3004: "Removed emphasis",
    3005: "Removed question mark",
}
NO_REACTION = "no-reaction"
NO_EFFECT = "no-effect"
# Parts dropped from an effect name.
EFFECT_AFFIXES = ("CK", "Effect")


_LABELS = "map(" + ", ".join(f"{number}L, '{label}'" for number, label in REACTIONS.items()) + ")"


def reaction_label(code: str) -> str:
    return f"coalesce(try_element_at({_LABELS}, {code}), '{NO_REACTION}')"


def effect_label(style: str) -> str:
    """Last dotted part of the style id without its affixes."""
    last = first_match(style, r"(?s)[^.]+\z")
    for affix in EFFECT_AFFIXES:
        last = f"replace({last}, '{affix}', '')"
    return f"coalesce({last}, '{NO_EFFECT}')"
