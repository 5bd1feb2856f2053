"""Line patterns made from the log formats that servers document."""

from __future__ import annotations

import re

DOTTED = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
ADDRESS = rf"{DOTTED}|[0-9A-Fa-f:]+"

_DIRECTIVE = re.compile(r"%\{[A-Za-z-]+\}i|%[A-Za-z]")


def line_pattern(layout: str, pieces: dict[str, str], blank: str = " ") -> str:
    """A format such as ``%h %l %u [%t]`` with each directive replaced by its piece.

    Other characters stand for themselves, a blank for ``blank``. A piece brings its own group
    where its value is wanted.
    """
    pattern, at = "", 0
    for found in _DIRECTIVE.finditer(layout):
        pattern += _literal(layout[at:found.start()], blank) + pieces[found.group()]
        at = found.end()
    return pattern + _literal(layout[at:], blank)


def date_shape(layout: str) -> str:
    """Pattern of the texts that a date format such as ``dd/MMM/yyyy`` can give: three M are a name, other letters digits."""
    out = layout.replace("MMM", "@@@")
    return "".join("[A-Za-z]" if c == "@" else "[0-9]" if c.isalpha() else "\\" + c if c in "[]()." else c for c in out)


def _literal(text: str, blank: str) -> str:
    return "".join(blank if c == " " else "\\" + c if c in "[]()." else c for c in text)
