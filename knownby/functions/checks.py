"""Checks of arguments before a plan is built."""

from __future__ import annotations


def insist(*rules: tuple[bool, str]) -> None:
    """Raise one error that names every rule that does not hold."""
    broken = [text for holds, text in rules if not holds]
    if broken:
        raise ValueError("; ".join(broken))
