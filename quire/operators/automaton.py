"""Many patterns in one pass: an Aho-Corasick automaton over UTF-8 bytes, run over whole Arrow batches.

The automaton is a dense table of states and byte classes, so a task steps thousands of texts at once with numpy: texts are cut
into lanes, each lane begins early enough to be in the right state at its first own byte, and all lanes read a byte a step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bytes a lane answers for, and the most entries of the table (4 bytes each) that may be broadcast.
LANE, MOST_ENTRIES = 512, 1 << 27


class Automaton:
    """All of ``terms`` (different, none empty); an occurrence names a term by its place in that sequence."""

    def __init__(self, terms: Sequence[bytes]):
        self.terms = list(terms)
        if len(set(self.terms)) != len(self.terms) or b"" in self.terms:
            raise ValueError("terms have to be different and not empty")
        self.size = np.array([len(t) for t in self.terms], np.int64)
        self.longest = int(self.size.max(initial=0))
        used = np.unique(np.frombuffer(b"".join(self.terms), np.uint8))
        self.cls = np.zeros(256, np.int64)
        self.cls[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        children, parent, via, depth, ends = self._trie()
        n = len(parent)
        if n * self.width > MOST_ENTRIES:
            raise ValueError(f"{n} states of {self.width} byte classes are too many for one table: split the terms")
        table = np.full((n, self.width), -1, np.int32)
        at = np.fromiter(children, np.int64, len(children))
        table[at // self.width, at % self.width] = np.fromiter(children.values(), np.int32, len(children))
        table[0][table[0] < 0] = 0
        fail, self.link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.ends = ends
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(1, self.longest + 2))
        for d, (low, high) in enumerate(zip(cut[:-1], cut[1:], strict=True), 1):
            s = order[low:high]
            if d > 1:
                fail[s] = table[fail[parent[s]], via[s]]
            row = table[s]
            table[s] = np.where(row >= 0, row, table[fail[s]])
            self.link[s] = np.where(ends[fail[s]] >= 0, fail[s], self.link[fail[s]])
        #: A state's first state that ends a term: itself, or the longest shorter one; 0 for none.
        self.first = np.where(ends >= 0, np.arange(n, dtype=np.int32), self.link)
        self.table = table.reshape(-1)

    def _trie(self):
        cls, width = self.cls.tolist(), self.width
        children: dict[int, int] = {}
        parent, via, depth, last = [0], [0], [0], {}
        for i, term in enumerate(self.terms):
            s = 0
            for b in term:
                key = s * width + cls[b]
                to = children.get(key)
                if to is None:
                    to = children[key] = len(parent)
                    parent.append(s)
                    via.append(cls[b])
                    depth.append(depth[s] + 1)
                s = to
            last[s] = i
        ends = np.full(len(parent), -1, np.int64)
        ends[list(last)] = list(last.values())
        return children, np.array(parent), np.array(via), np.array(depth), ends

    def scan(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, end, term) of every occurrence, by text and end, longest first: text t is data[at[t]:at[t + 1]], ``end`` is in ``data``."""
        none = np.empty(0, np.int64)
        if not self.terms or not len(data):
            return none, none, none
        sizes = np.diff(at)
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = at[text] + nth * LANE
        stop = np.minimum(begin + LANE, at[text + 1])
        warm = np.maximum(at[text], begin - (self.longest - 1))
        order = np.argsort(warm - stop, kind="stable")
        warm, begin, length = warm[order], begin[order], (stop - warm)[order]
        codes = self.cls[data]
        state = np.zeros(len(warm), np.int64)
        alive = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        ends, states = [], []
        for t, n in enumerate(alive.tolist()):
            where = warm[:n] + t
            now = self.table[state[:n] * self.width + codes[where]]
            state[:n] = now
            hit = np.flatnonzero(self.first[now])
            if len(hit):
                hit = hit[where[hit] >= begin[:n][hit]]
                ends.append(where[hit])
                states.append(self.first[now[hit]])
        if not ends:
            return none, none, none
        end, at_state = np.concatenate(ends), np.concatenate(states)
        out_end, out_term, out_nth = [], [], []
        nth = 0
        while len(end):
            out_end.append(end)
            out_term.append(self.ends[at_state])
            out_nth.append(np.full(len(end), nth))
            at_state, nth = self.link[at_state], nth + 1
            go = at_state > 0
            end, at_state = end[go], at_state[go]
        end, term, nth = np.concatenate(out_end), np.concatenate(out_term), np.concatenate(out_nth)
        order = np.lexsort((nth, end))
        end = end[order]
        return np.searchsorted(at, end, side="right") - 1, end + 1, term[order]
