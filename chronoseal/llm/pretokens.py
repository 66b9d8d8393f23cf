"""Splitting texts into the words that byte-level BPE merges inside, in whole arrays.

Words are runs of letters, of numbers, or of other characters, each with one space before it if there is one; white
space keeps its last character for the next word; the seven English contractions are words where a word starts.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
#: Characters with the property White_Space.
WHITE_SPACE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point.

    Two Unicode versions are at hand, one older and one newer than that of the tokenizers library; where they agree
    so does the library, and of the rest (recent letters) the library's own splitting decides.
    """
    if not _CLASSES:
        first = {"L": _LETTER, "N": _NUMBER}
        old = np.fromiter((first.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        new = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for number, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for run in regex.findall(pattern, every):
                new[np.frombuffer(run.encode("utf-32-le"), np.uint32)] = number
        pieces = ByteLevel(add_prefix_space=False).pre_tokenize_str
        for c in np.flatnonzero(old != new):
            joins = {n: len(pieces(sample + chr(c))) == 1 for n, sample in ((_LETTER, "a"), (_NUMBER, "1"))}
            old[c] = next((n for n, one in joins.items() if one), _OTHER)
        old[list(WHITE_SPACE)] = _SPACE
        _CLASSES.append(old)
    return _CLASSES[0]


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and lengths of the words of UTF-8 texts; ``offsets`` are byte positions no word crosses."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = code_points(data)
    n = len(points)
    place = np.flatnonzero((data & 0xC0) != 0x80) if n < len(data) else np.arange(n)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(place, offsets)] = True
    edge[0] = edge[n] = True
    kind = classes()[points]
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # White space before a word keeps all but its last character; a last space joins the word.
    after = np.flatnonzero(start[1:n] & ~edge[1:n] & (kind[:-1] == _SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    _contractions(points, kind, edge, start)
    starts = place[np.flatnonzero(start[:n])]
    return starts, np.diff(starts, append=len(data))


def _contractions(points: np.ndarray, kind: np.ndarray, edge: np.ndarray, start: np.ndarray) -> None:
    n = len(points)
    at = np.flatnonzero(points == 0x27)
    if not len(at):
        return
    before = np.maximum(at - 1, 0)
    free = edge[at] | ((kind[before] != _OTHER) & (points[before] != 0x20))
    at = at[free & ~edge[at + 1]]
    one = points[at + 1]
    two = np.where(edge[np.minimum(at + 2, n)], 0, points[np.minimum(at + 2, n - 1)])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    for picked, size in ((at[short], 2), (at[long], 3)):
        start[picked + 1] = False
        start[picked + size] = True
