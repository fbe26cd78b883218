"""A run-length index over short texts, for matches of a fixed length.

The rows are all places of the texts where ``span`` bytes start, sorted by the
text from there on (equal rests by text number).  Each row's Burrows-Wheeler
letter is the byte before it.  Rows of one letter and one ``span``-byte match
class are kept as one run: its letter, its first row, where its rows lead one
byte to the left, and the least document among its rows as the sample kept for
the run.  A step to the left keeps the order of rows with one letter, so a row's
neighbour is found from its run's entry alone; ``linked`` lists the rows that
such steps reach (a text's last place is not reached from the right).

``matching`` streams every text from its last place to its first, one step to
the left per byte and all texts together, and reports at each place the least
document that holds the same ``span`` bytes.
"""

from __future__ import annotations

import numpy as np


class RunLengthIndex:
    def __init__(self, texts: list[bytes], docs: np.ndarray, span: int):
        n = len(texts)
        self.docs = np.asarray(docs, np.int64)
        self.places = np.fromiter(map(len, texts), np.int64, n) - span + 1
        width = int(self.places.max()) + span - 1
        sizes = self.places + span - 1
        grid = np.zeros((n, width), np.uint8)
        grid[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
        text = np.repeat(np.arange(n), self.places)
        place = np.arange(len(text)) - np.repeat(np.cumsum(self.places) - self.places, self.places)
        flat = np.concatenate((grid.ravel(), np.zeros(width, np.uint8)))
        # the rest of each text from a place on, padded; rows of one text are views of it
        rests = np.lib.stride_tricks.sliding_window_view(flat, width)[text * width + place]
        beyond = np.arange(width) >= (sizes[text] - place)[:, None]
        rests[beyond] = 0
        order = np.argsort(np.ascontiguousarray(rests).view(f"S{width}").ravel(), kind="stable")
        text, place, rests = text[order], place[order], rests[order]
        letter = np.where(place > 0, flat[text * width + place - 1].astype(np.int64), -1)

        same = (rests[1:, :span] == rests[:-1, :span]).all(1)
        first_of_class = np.concatenate(([True], ~same))
        first_of_run = first_of_class | np.concatenate(([True], letter[1:] != letter[:-1]))
        self.start = np.flatnonzero(first_of_run)
        self.match_class = (np.cumsum(first_of_class) - 1)[self.start]
        self.sample = np.minimum.reduceat(self.docs[text], self.start)
        self.least = np.minimum.reduceat(self.sample, np.flatnonzero(np.concatenate(([True], self.match_class[1:] != self.match_class[:-1]))))

        # the i-th row with a letter leads to the i-th linked row that begins with it
        self.linked = np.flatnonzero(place < self.places[text] - 1)
        begins = np.searchsorted(rests[self.linked, 0], np.arange(257))
        ranked = np.argsort(letter, kind="stable")
        before = np.empty(len(letter), np.int64)
        before[ranked] = np.arange(len(letter)) - np.searchsorted(letter[ranked], letter[ranked])
        head = letter[self.start]
        self.leads = np.where(head >= 0, begins[np.maximum(head, 0)] + before[self.start], -1)
        self.last_row = np.empty(n, np.int64)
        ends = place == self.places[text] - 1
        self.last_row[text[ends]] = np.flatnonzero(ends)

    def matching(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, least document with the same bytes) for every place."""
        out, row, text, left = [], self.last_row, np.arange(len(self.places)), self.places - 1
        while len(row):
            run = np.searchsorted(self.start, row, side="right") - 1
            out.append((text, left, self.least[self.match_class[run]]))
            on = left > 0
            run, row, text, left = run[on], row[on], text[on], left[on] - 1
            row = self.linked[self.leads[run] + row - self.start[run]]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
