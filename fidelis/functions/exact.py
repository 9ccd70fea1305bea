"""Values in plain Python, for code that works on Arrow batches: exact decimals and Chinese numerals."""

from __future__ import annotations

from fidelis.functions.registry import BIG, DIGITS, NARROW, UNITS, WIDE

_NARROWED = str.maketrans(WIDE, NARROW)


def narrowed(text: str) -> str:
    return text.translate(_NARROWED)


def moved(number: str, places: int = 0) -> str:
    """A number in text (thousands separators allowed) with its point moved right by so many places: its shortest
    plain notation, exact at any length."""
    digits = narrowed(number).replace(",", "").strip()
    minus = digits.startswith("-")
    whole, _, part = digits.lstrip("+-").partition(".")
    if places >= 0:
        part = part.ljust(places, "0")
        whole, part = whole + part[:places], part[places:]
    else:
        whole = whole.rjust(-places, "0")
        whole, part = whole[:places], whole[places:] + part
    whole, part = whole.lstrip("0"), part.rstrip("0")
    if not whole and not part:
        return "0"
    return "-" * minus + (whole or "0") + ("." + part if part else "")


def zh_value(text: str) -> int | None:
    """Value of a Chinese numeral; None when any other character occurs or there is none."""
    whole = part = last = 0
    for c in text:
        if c in DIGITS:
            last = DIGITS[c]
        elif c in UNITS:
            part, last = part + max(last, 1) * UNITS[c], 0
        elif c in BIG:
            whole, part, last = whole + (part + last) * BIG[c], 0, 0
        else:
            return None
    return whole + part + last if text else None
