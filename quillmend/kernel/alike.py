"""Documents in chunks that are alike but for their digits are folded once.

Streams of one producer repeat themselves: the same members and the same cuts, other numbers. The scanner tells digits apart in
two cases only, whether the first of a run is a zero (``01`` is no number) and within escapes and entities of character codes. So
what a fold does to a document is settled by its *shape*, the chunks with their digits blanked (but for zeros that begin a run),
and the digits of its changes are digits of the chunks. Which ones is told by folding three stand-ins in which every digit's
place is spelled by the digits themselves. What has codes, or is long, is folded as it comes.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from functools import lru_cache
from itertools import accumulate, product

import numpy as np

from ..options import Options
from .fold import Fold

#: Between chunks, and for a blanked digit.
CUT, _BLANK = "\x1f", "\x1e"
_CUT_BYTE, _BLANK_BYTE, _ZERO = 0x1F, 0x1E, 0x30
#: An escape by a character's code, cut or not.
_CODE = re.compile(f"\\\\{CUT}*[xu]".encode())
#: What the three stand-ins have for the digits in turn; a digit that a fold writes by itself is the same in all of them.
_PLACES = [x for x in product(b"123456789", repeat=3) if len(set(x)) > 1]
#: Longer documents (bytes, with a cut between chunks) aren't worth keeping; at most so many shapes and so many of the last seen ones are kept.
LONG, _KEPT, _SEEN = 8192, 2048, 1 << 16


def _blanked(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bytes of documents, which begin at ``starts``, with their digits blanked, but for zeros that begin a run (which a cut doesn't end)."""
    digit = (data - _ZERO).astype(np.uint8) < 10
    after = np.zeros(len(data), bool)
    after[1:] = digit[:-1]
    after[2:] |= (data[1:-1] == _CUT_BYTE) & digit[:-2]
    firsts = starts[starts < len(data)]
    after[firsts] = False
    seconds = firsts[firsts + 1 < len(data)]
    seconds = seconds[data[seconds] == _CUT_BYTE] + 1
    after[seconds] = False
    return np.where(digit & ((data != _ZERO) | after), np.uint8(_BLANK_BYTE), data)


class _Kept:
    """What a fold does to the documents of a shape.

    columns: what is the same for all; text: the bytes of the changes and, if asked for, outputs, each so many as ``lengths`` says, in which
    the bytes ``at`` are those of the joined chunks at ``places``.
    """

    __slots__ = ("at", "chunks", "columns", "lengths", "places", "text")

    def __init__(self, columns: dict[str, list], text: np.ndarray, lengths: np.ndarray, at: np.ndarray, places: np.ndarray):
        self.columns, self.text, self.lengths, self.at, self.places = columns, text, lengths, at, places
        self.chunks = len(columns["accepted"])

    def filled(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of bytes for each document of this shape in ``data``."""
        rows = np.empty((len(starts), len(self.text)), np.uint8)
        rows[:] = self.text
        if len(self.at):
            rows[:, self.at] = data[starts[:, None] + self.places]
        return rows


class Folds:
    """Folds whole documents: lists of their chunks in, columns of what each chunk did out (see :meth:`Fold.push`)."""

    FIELDS = ("accepted", "output", "keep", "text", "error_kind", "error_position")

    def __init__(self, options: Options = Options(), whole: bool = True):  # noqa: B008
        self.options, self.whole = options, whole
        self.kept: OrderedDict[bytes, _Kept | None] = OrderedDict()
        self.seen: set[int] = set()

    def fold(self, chunks: list[str]) -> dict[str, list]:
        data = np.frombuffer(CUT.join(chunks).encode("utf-8", "surrogatepass"), np.uint8)
        kept = self.shapes(data, np.array([0, len(data)]), [len(chunks)])[0] if chunks else None
        if not kept:
            return self._plainly(chunks)
        row = kept.filled(data, np.array([0]))[0].tobytes()
        ends = list(accumulate(kept.lengths.tolist(), initial=0))
        texts = [row[a:b].decode("utf-8", "surrogatepass") for a, b in zip(ends, ends[1:], strict=False)]
        n = kept.chunks
        return kept.columns | {"text": texts[:n], "output": texts[n:] if self.whole else [None] * n}

    def shapes(self, data: np.ndarray, offsets: np.ndarray, counts: list[int]) -> list[_Kept | None]:
        """What is kept for each document (chunks joined by ``CUT``: bytes and where they begin; how many chunks); None: fold it as it comes."""
        blanked, edges = _blanked(data, offsets[:-1]).tobytes(), offsets.tolist()
        blanks = np.flatnonzero(data == _BLANK_BYTE)
        unclear = set((np.searchsorted(offsets, blanks, "right") - 1).tolist())
        return [None if i in unclear or b - a > LONG else self._of(blanked[a:b], n) for i, (a, b, n) in enumerate(zip(edges, edges[1:], counts, strict=False))]

    def _of(self, key: bytes, chunks: int) -> _Kept | None:
        if key in self.kept:
            self.kept.move_to_end(key)
            kept = self.kept[key]
            return kept if kept and kept.chunks == chunks else None  # else a chunk has a CUT of its own
        if key.count(_CUT_BYTE) != chunks - 1 or (b"&" in key and b"#" in key) or (b"\\" in key and _CODE.search(key)):
            return None
        mark = hash(key)
        if mark in self.seen:
            self.seen.discard(mark)
            kept = self.kept[key] = self._learned(key)
            if len(self.kept) > _KEPT:
                self.kept.popitem(last=False)
            return kept
        if len(self.seen) >= _SEEN:
            self.seen.clear()
        self.seen.add(mark)
        return None

    def _plainly(self, chunks: list[str]) -> dict[str, list]:
        fold = Fold(self.options)
        rows = [fold.push(c, self.whole) for c in chunks]
        return {x: [r[x] for r in rows] for x in self.FIELDS}

    def _learned(self, key: bytes) -> _Kept | None:
        """Folds the stand-ins; None where they don't tell, so that documents of this shape are folded as they come."""
        joined = np.frombuffer(key, np.uint8)
        places = np.flatnonzero(joined == _BLANK_BYTE)
        n = len(places)
        if n > len(_PLACES):
            return None
        found = []
        for i in range(3):
            stand_in = joined.copy()
            stand_in[places] = [x[i] for x in _PLACES[:n]]
            chunks = stand_in.tobytes().decode("utf-8", "surrogatepass").split(CUT)
            columns = self._plainly(chunks)
            # a chunk that was dropped moves those around it together: other digits may come first then, or be codes
            dropped = [j for j, a in enumerate(columns["accepted"]) if not a and chunks[j]]
            if any(chunks[j + 1][:1] in "0123456789xu" for j in dropped if j + 1 < len(chunks)):
                return None
            texts = CUT.join(columns["text"] + (columns["output"] if self.whole else []))
            found.append(({x: columns[x] for x in self.FIELDS if x not in ("text", "output")}, texts.encode("utf-8", "surrogatepass")))
        (same, a), (second, b), (third, c) = found
        if not same == second == third or not len(a) == len(b) == len(c):
            return None
        index = {x: int(p) for x, p in zip(_PLACES, places, strict=False)}
        differ = [(i, x) for i, x in enumerate(zip(a, b, c, strict=True)) if not x[0] == x[1] == x[2]]
        if any(x not in index for _, x in differ):
            return None
        text = np.frombuffer(a, np.uint8)
        cuts = np.flatnonzero(text == _CUT_BYTE)
        if len(cuts) != (2 if self.whole else 1) * len(same["accepted"]) - 1:
            return None
        at = np.array([i for i, _ in differ], np.int64)
        return _Kept(same, np.delete(text, cuts), np.diff(cuts, prepend=-1, append=len(text)) - 1, at - np.searchsorted(cuts, at), np.array([index[x] for _, x in differ], np.int64))


@lru_cache(8)
def folds(options: Options, whole: bool) -> Folds:
    """The shapes that this process has seen under these options, over all its tasks."""
    return Folds(options, whole)
