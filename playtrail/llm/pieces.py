"""Texts as short pieces that tokenizers treat independently, so that a piece is encoded once per worker.

In a text whose white space is single spaces and line feeds, never two together, every token of the usual
byte-level pattern lies inside a line feed, or inside a word together with the space before it. Where full stops and
commas follow letters or digits only, no token reaches across their front either. Other texts are left to the caller.
"""

from __future__ import annotations

import re

# A full stop or comma that does not follow a letter or digit, and so may belong to the token before it.
_AFTER_MARK = re.compile(r"[.,](?<=[\W_].)")
KEPT_CHARS = 4_000_000
LONGEST_KEPT = 256


def pieces_of(text: str) -> list[str] | None:
    """The pieces, which join to the text; None if its white space is not as plain as that."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return None
    if not text.replace("\n", "").isprintable():
        return None
    text = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
    if not _AFTER_MARK.search(text):
        text = text.replace(".", "\0.").replace(",", "\0,")
    return text.split("\0")


_MARKS = """!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


def word_and_marks(piece: str) -> tuple[str, ...] | None:
    """A piece that is letters, with or without a space before and ASCII marks behind, as its one or two words; else None."""
    word = piece.rstrip(_MARKS)
    if not (word[1:] if word[:1] == " " else word).isalpha():
        return None
    return (word, piece[len(word):]) if len(word) < len(piece) else (word,)


class PieceCoder:
    """Texts to bytes by way of ``encode(pieces) -> list of bytes``; ``split(text)`` serves texts with other white space.

    Known pieces are kept in two generations: when the younger is full, the older goes, and what is met again there moves to the
    younger. Very long pieces are not kept.
    """

    def __init__(self, encode, split):
        self.encode, self.split = encode, split
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.chars = 0

    def code(self, texts: list[str | None]) -> list[bytes]:
        if self.chars > KEPT_CHARS:
            self.known, self.older, self.chars = {"": b""}, self.known, 0
        known, cut = self.known, []
        for text in texts:
            pieces = pieces_of(text) if text else []
            cut.append(self.split(text) if pieces is None else pieces)
        unseen = dict.fromkeys(p for pieces in cut for p in set(pieces).difference(known))
        self.chars += sum(map(len, unseen))
        again = {p: self.older[p] for p in unseen if p in self.older}
        known.update(again)
        new = [p for p in unseen if p not in again]
        if new:
            known.update(zip(new, self.encode(new)))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > LONGEST_KEPT:
                self.chars -= len(p)
                del known[p]
        return out
