"""Cutting a text where a byte-level BPE never joins: before each space that is followed by no white space.

The pattern of such tokenizers takes at most one space in front of a word, and no match goes on from anything
else into white space, so a match starts at each of these cuts and none goes over it. ``str.isspace`` holds for
all that the pattern calls white space, so no cut is made where the pattern would not make it.
"""

from __future__ import annotations


class Odd(Exception):
    """A piece that does not stand for a segment: the cut before it is not certain."""


class Pieces(dict):
    """From what follows a single space to what ``make`` gives for the segment, made once for each."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str):
        if not piece or piece[0].isspace():
            raise Odd
        self[piece] = out = self.make(" " + piece)
        return out


def careful(text: str) -> list[str]:
    """The segments of any text; joined, they give the text."""
    out: list[str] = []
    open_: list[str] = []
    for k, p in enumerate(text.split(" ")):
        if k and p and not p[0].isspace():
            if open_:
                out.append("".join(open_))
            open_ = [" ", p]
        else:
            open_ += [" ", p] if k else [p]
    last = "".join(open_)
    return [*out, last] if last else out
