"""Which of many phrases occur in a text, in one pass over it: an Aho-Corasick automaton with its tables in numpy.

Texts are stepped through side by side, long ones in pieces that overlap, so a step is one lookup for thousands of texts
and the work grows with their length only. Phrases are UTF-8; one of more than DEPTH bytes is entered by its first DEPTH, and
looked for as a whole where those occur.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a phrase in the automaton.
DEPTH = 12
#: Bytes of a piece of text, and pieces that are stepped through at a time.
PIECE, LANES = 512, 16_384
#: Steps after which what was found is counted once.
TIDY = 32


class Automaton:
    """phrases: different non-empty byte strings."""

    def __init__(self, phrases: list[bytes]):
        self.phrases = phrases
        heads = [p[:DEPTH] for p in phrases]
        letters = np.frombuffer(b"".join(heads), np.uint8)
        used = np.unique(letters)
        #: Bytes that no phrase has are one class, the first.
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        lengths = np.array([len(h) for h in heads], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if heads else np.zeros(0, np.int64)
        state = np.zeros(len(heads), np.int64)
        levels, n_states = [], 1  # (parents, classes, children) of each depth; children are numbered in order
        for depth in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > depth)
            edges, which = np.unique(state[on] * self.width + self.classes[letters[begins[on] + depth]], return_inverse=True)
            levels.append((edges // self.width, edges % self.width, n_states + np.arange(len(edges))))
            state[on] = n_states + which
            n_states += len(edges)
        self.n_states = n_states
        self.goto = np.zeros((n_states, self.width), np.int32)
        self.fail = np.zeros(n_states, np.int32)
        for depth, (parents, by, children) in enumerate(levels):
            # Of the parents' rows only the failure's part is filled yet, so it names where a child's suffix leads.
            self.fail[children] = self.goto[parents, by] if depth else 0
            self.goto[parents, by] = children
            self.goto[children] = self.goto[self.fail[children]] if depth else 0
            if not depth:
                self.goto[children] = self.goto[0]
        order = np.argsort(state, kind="stable")
        self.ends, self.by_end = np.searchsorted(state[order], np.arange(n_states + 1)), order
        own = np.diff(self.ends) > 0
        own[0] = False
        self.found, self.next = own.copy(), np.zeros(n_states, np.int32)  # whether a phrase ends here or at a suffix, and at which
        for _, _, children in levels:
            suffix = self.fail[children]
            self.next[children] = np.where(own[suffix], suffix, self.next[suffix])
            self.found[children] |= self.found[suffix]
        self.own = own

    def _states(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """text * n_states + state, once each: the states with phrases that each text reaches."""
        lengths = np.diff(cuts)
        stride = PIECE - DEPTH + 1
        pieces = np.maximum(1, -(-(lengths - DEPTH + 1) // stride))
        owner = np.repeat(np.arange(len(lengths)), pieces)
        begin = cuts[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stride
        length = np.minimum(PIECE, cuts[1:][owner] - begin)
        order = np.argsort(-length, kind="stable")
        flat, out = self.goto.reshape(-1), []
        for first in range(0, len(order), LANES):
            lanes = order[first : first + LANES]
            at, left, whose = begin[lanes], length[lanes], owner[lanes] * self.n_states
            state, seen = np.zeros(len(lanes), np.int64), []
            for step in range(int(left[0])):
                on = int(np.searchsorted(-left, -step, "left"))  # lanes with more than so many bytes
                state = flat[state[:on] * self.width + self.classes[data[at[:on] + step]]]
                hit = np.flatnonzero(self.found[state])
                if len(hit):
                    seen.append(whose[hit] + state[hit])
                    if len(seen) == TIDY:
                        seen = [np.unique(np.concatenate(seen))]
                state = state.astype(np.int64)
            out += seen
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def occurrences(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, phrase) of each phrase that occurs in the text data[cuts[k]:cuts[k + 1]], once each, in order."""
        reached = self._states(data, cuts)
        text, state = reached // self.n_states, reached % self.n_states
        texts, found = [], []
        while len(text):
            here = self.own[state]
            n = (self.ends[state + 1] - self.ends[state])[here]
            begin = np.repeat(self.ends[state[here]] - np.cumsum(n) + n, n)
            found.append(self.by_end[begin + np.arange(n.sum())])
            texts.append(np.repeat(text[here], n))
            state = self.next[state]
            text, state = text[state > 0], state[state > 0]
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(texts) * len(self.phrases) + np.concatenate(found))
        text, phrase = pairs // len(self.phrases), pairs % len(self.phrases)
        long = np.array([len(self.phrases[p]) > DEPTH for p in phrase.tolist()], bool)
        stays, whole, held = np.ones(len(pairs), bool), None, -1
        for k in np.flatnonzero(long).tolist():
            if text[k] != held:
                held = int(text[k])
                whole = data[cuts[held] : cuts[held + 1]].tobytes()
            stays[k] = self.phrases[phrase[k]] in whole
        return text[stays], phrase[stays]
