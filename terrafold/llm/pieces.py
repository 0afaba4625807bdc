"""Texts cut where a byte-level pattern can't look across, so that equal pieces are encoded once per task.

The pattern's matches never hold a blank after their first character, except in runs of white space. Cut before every blank, a
text whose blanks stand alone gives pieces whose encodings, joined, are the encoding of the text."""

from __future__ import annotations

import re

_MIXED = re.compile(r"[^\S ] [^\S ]")
#: Distinct pieces remembered by one task; past this the memory starts anew.
MEMORY = 300_000


def pieces(text: str) -> list[str]:
    """Pieces of ``text``; the text itself where runs of white space make cuts unsafe."""
    if "  " in text or text.endswith(" ") or _MIXED.search(text):
        return [text]
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]
