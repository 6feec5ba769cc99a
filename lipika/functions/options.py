"""Transliteration options: a bit mask, its names, and the dialects in which names are written."""

from __future__ import annotations

import re

NONE, TAMIL_TRADITIONAL, TAMIL_SUPERSCRIPTED, ASCII_NUMERALS, IGNORE_ACCENTS, RETAIN_MARKERS = 0, 1, 2, 4, 8, 16

#: Option names and their bits.
NAMES = {
    "None": NONE,
    "TamilTraditional": TAMIL_TRADITIONAL,
    "TamilSuperscripted": TAMIL_SUPERSCRIPTED,
    "ASCIINumerals": ASCII_NUMERALS,
    "IgnoreVedicAccents": IGNORE_ACCENTS,
    "RetainSpecialMarkers": RETAIN_MARKERS,
}
DELIMITERS = " \t,:;/|&"


def split_set(text: str, delimiters: str = DELIMITERS) -> list[str]:
    """Pieces between any of the delimiters; empty ones stay, but for a last empty one."""
    pieces = re.split("[" + re.escape(delimiters) + "]", text)
    return pieces[:-1] if pieces and not pieces[-1] else pieces


def parse(text: str, dialect: str = "strict") -> int:
    """The mask of named options.

    ``strict`` names are case-sensitive and split at a set of delimiters; an empty piece sets the unused bit 32.  ``loose`` names ignore case
    and are split at white space and commas.  ``plain`` names are case-sensitive and split at single spaces.  Unknown names count for nothing.
    """
    if dialect == "loose":
        known = {k.lower(): v for k, v in NAMES.items()}
        bits = [known.get(x, 0) for x in re.split(r"[\s,]+", text.lower())]
    elif dialect == "plain":
        bits = [NAMES.get(x, 0) for x in text.split(" ")]
    else:
        bits = [32 if not x else NAMES.get(x, 0) for x in split_set(text)]
    mask = 0
    for bit in bits:
        mask |= bit
    return mask


def names(mask: int) -> list[str]:
    """Lower-case names of the mask's options."""
    return [k.lower() for k, v in NAMES.items() if v and mask & v] or ["none"]


def add(*masks: int) -> int:
    """One mask with the options of all."""
    out = NONE
    for mask in masks:
        out |= mask
    return out
