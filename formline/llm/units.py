"""Exact tokenizer results from memoised pieces of text.

The tokenizers used here split a text into words by a pattern before any merge.
A space between two characters that are not white space always starts a new word
(it is either dropped or the first character of the word after it), so the ids of
a text are the ids of its pieces between such spaces. Pieces repeat, within and
across documents, and a worker keeps the results of short ones in a bounded memo.
"""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import types

import numpy as np
import pyarrow.compute as pc

#: Entries of a memo, and the longest piece it keeps between batches.
MEMO_ENTRIES, MEMO_CHARS = 250_000, 64
#: Characters of text handled at a time.
SLICE_CHARS = 1_000_000


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def worker_store(name: str | None = None) -> dict:
    """A dictionary that lives as long as the Python worker, across tasks of the same operator.

    A worker serves one operator after the other, so what another one left is given back;
    operators that keep nothing call this without a name.
    """
    module = sys.modules.setdefault("_formline_worker", types.ModuleType("_formline_worker"))
    stores = module.__dict__.setdefault("stores", {})
    if set(stores) - {name}:
        for other in set(stores) - {name}:
            del stores[other]
        give_back()
    return stores.setdefault(name, {}) if name else {}


def odd(piece: str) -> bool:
    """Whether the spaces around ``piece`` may not be cut."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


def merged(pieces: list[str]) -> list[str]:
    """Join pieces again wherever the space between them may not be cut."""
    out = [pieces[0]]
    for piece in pieces[1:]:
        if not out[-1] or out[-1][-1].isspace() or not piece or piece[0].isspace():
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out


def slices(texts: list[str]):
    """Ranges of documents of about ``SLICE_CHARS`` characters each."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= SLICE_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_slices(column):
    """``(start, stop, texts)`` of an Arrow column of texts, about ``SLICE_CHARS`` bytes at a time.

    Only one slice is turned into Python strings at once.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right")))
        yield start, stop, column.slice(start, stop - start).to_pylist()
        start = stop


class Memo:
    """Values of pieces in two generations, about ``entries`` in all.

    A full young generation becomes the old one; what is asked for again moves back,
    so frequent pieces are never dropped.
    """

    def __init__(self, entries: int = MEMO_ENTRIES):
        self.entries, self.young, self.old = entries, {}, {}

    def fill(self, wanted: set, make) -> list:
        """Have all of ``wanted`` in ``young``; ``make`` turns a list of pieces into values. Returns what was made."""
        if len(self.young) >= self.entries // 2:
            self.old, self.young = self.young, {}
        missing = wanted - self.young.keys()
        back = missing & self.old.keys()
        self.young.update((piece, self.old.pop(piece)) for piece in back)
        made = list(missing - back)
        self.young.update(zip(made, make(made)))
        return made

    def forget_long(self, made: list) -> None:
        for piece in made:
            if len(piece) > MEMO_CHARS:
                self.young.pop(piece, None)


def one_thread() -> None:
    """Keeps ``tokenizers`` on the core of its task; by itself it starts a thread for every core of the machine."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
