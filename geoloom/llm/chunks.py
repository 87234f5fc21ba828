"""Texts cut at places that no token crosses, and what is known of each chunk; used inside tasks.

A single space between two characters that are no white space ends a chunk: a byte-level
vocabulary starts a piece there, whatever stands around, and a piece vocabulary whose pieces hold
the space mark only in front does so as well.  So tokens of a text are those of its chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa

_TWO, _CUT = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")


def cut(text: str) -> list[str]:
    """The chunks of a text, without the space between two of them; an empty text is one empty chunk."""
    if text and not text[0].isspace() and not text[-1].isspace() and not _TWO.search(text):
        return text.split(" ")
    return _CUT.split(text)


def open_ended(chunk: str) -> bool:
    """Whether a chunk has white space at an end, as only the first and the last of a text can: what it is
    cut into depends on the neighbour that it would get in a row of chunks."""
    return not chunk or chunk.strip() != chunk


class Remembered:
    """key -> what ``make`` gives for it; recent keys are kept, past ``most`` of them the older ones go."""

    def __init__(self, make: Callable[[list], list], most: int = 200_000):
        self.make, self.most = make, most
        self.known: dict = {}
        self.older: dict = {}

    def learn(self, keys: set) -> None:
        """Make sure that ``known`` has the keys."""
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        away = [k for k in keys if k not in known]
        new = [k for k in away if k not in older] if older else away
        if len(new) < len(away):
            known.update((k, older[k]) for k in away if k in older)
        if new:
            known.update(zip(new, self.make(new), strict=True))

    def of(self, lists: list[list]) -> list[list]:
        """The values of lists of keys."""
        try:
            return [list(map(self.known.__getitem__, x)) for x in lists]
        except KeyError:
            self.learn(set().union(*lists))
            return [list(map(self.known.__getitem__, x)) for x in lists]


def by_size(batches: Iterator[pa.RecordBatch], most: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, in batches of texts of about ``most`` bytes together; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
        lengths = [len(x.as_buffer()) if x.is_valid else 0 for x in column]
        first = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                if i > first:
                    held.append(batch.slice(first, i - first))
                yield _joined(held)
                held, size, first = [], 0, i
            size += n
        if len(lengths) > first:
            held.append(batch.slice(first))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
