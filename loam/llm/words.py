"""Words of operators 12 and 13: A-Z lower-cased, then runs of digits, letters a-z and all that is not ASCII, as UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

#: Every other ASCII byte becomes a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20


def word_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The text's words in order, in lists of about PIECE bytes; no word is cut."""
    text = (text or b"").translate(TABLE)
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = text.find(b" ", end)
            end = len(text) if gap < 0 else gap
        yield text[at:end].split()
        at = end


def words(text: bytes | None) -> list[bytes]:
    return [w for some in word_lists(text) for w in some]
