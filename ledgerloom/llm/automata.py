"""Minimal acyclic automata over sorted words, with word numbers, built and asked in arrays.

A state stands for a set of endings. Each arc carries how many words of its state come before
those behind it, so the sum along a path is the word's place among the sorted words (a minimal
perfect hash). States with the same endings are found by a 64-bit hash of the endings: two
different sets meet with a chance of about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import array_file, read_array
from .textcore import mix, ranges

_LETTER_BITS = 21  # of a code point


@dataclass
class Letters:
    """Words as code points, one word after another."""

    codes: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, words: pa.Array) -> Letters:
        size = np.asarray(pc.utf8_length(words), np.int64)
        codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        return cls(codes, np.cumsum(size) - size, size)

    def backward(self) -> Letters:
        """Each word from its last letter to its first."""
        if not len(self.codes):
            return self
        stop = np.repeat(self.start + self.size, self.size)
        return Letters(self.codes[np.repeat(self.start, self.size) + stop - 1 - np.arange(len(self.codes))], self.start, self.size)


@dataclass
class Automaton:
    root: int
    key: np.ndarray  # state and letter of each arc, in order
    target: np.ndarray
    skip: np.ndarray  # words of the state that come before those behind the arc
    first: np.ndarray  # first arc of each state, one more than states
    final: np.ndarray
    note: np.ndarray  # a row of values for each word, by its number

    @classmethod
    def build(cls, w: Letters, note: np.ndarray) -> Automaton:
        """w: distinct words in the order of their code points; note: a row for each."""
        n = len(w.size)
        same = np.zeros(n, np.int64)  # letters shared with the word before
        alive = np.arange(1, n)
        depth = 0
        while len(alive):
            alive = alive[(w.size[alive] > depth) & (w.size[alive - 1] > depth)]
            alive = alive[w.codes[w.start[alive] + depth] == w.codes[w.start[alive - 1] + depth]]
            same[alive] += 1
            depth += 1
        # nodes of the trie, depth by depth; each one's words stand together
        parents, letters, levels, at = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [0, 1], np.zeros(n, np.int64)
        alive, depth, end = np.flatnonzero(w.size > 0), 0, at.copy()
        while len(alive):
            new = same[alive] <= depth
            new[0] = True
            node = levels[-1] + np.cumsum(new) - 1
            parents.append(at[alive[new]])
            letters.append(w.codes[w.start[alive[new]] + depth])
            at[alive] = node
            levels.append(int(node[-1]) + 1)
            depth += 1
            end[alive[w.size[alive] == depth]] = node[w.size[alive] == depth]
            alive = alive[w.size[alive] > depth]
        parent, letter = np.concatenate(parents), np.concatenate(letters)
        final = np.zeros(len(parent), bool)
        final[end] = n > 0
        # from the deepest nodes up: the hash and the number of each node's endings
        endings, words = np.zeros(len(parent), np.uint64), final.astype(np.int64)
        arc = mix(letter.astype(np.uint64) + np.uint64(1))
        for lo, hi in zip(levels[-2::-1], levels[:0:-1], strict=True):
            endings[lo:hi] = mix(endings[lo:hi] + final[lo:hi].astype(np.uint64))
            if lo:
                np.add.at(endings, parent[lo:hi], mix(arc[lo:hi] ^ endings[lo:hi]))
                np.add.at(words, parent[lo:hi], words[lo:hi])
        _, sample, state = np.unique(endings, return_index=True, return_inverse=True)
        chosen = np.zeros(len(parent), bool)
        chosen[sample] = True
        arcs = np.flatnonzero(chosen[parent])
        arcs = arcs[arcs > 0]  # the root has no arc to it
        key = (state[parent[arcs]] << _LETTER_BITS) | letter[arcs]
        order = np.argsort(key)
        arcs, key = arcs[order], key[order]
        first = np.searchsorted(key >> _LETTER_BITS, np.arange(len(sample) + 1))
        upto = np.concatenate(([0], np.cumsum(words[arcs])))
        origin = key >> _LETTER_BITS
        skip = upto[:-1] - upto[first[origin]] + final[sample][origin]
        return cls(int(state[0]), key, state[arcs], skip, first, final[sample].astype(np.int64), note)

    def save(self, path: str) -> None:
        with array_file(path) as write:
            write(np.array([self.root, len(self.key), len(self.final), *self.note.shape], np.int64))
            for x in (self.key, self.target, self.skip, self.first, self.final, self.note):
                write(x.astype(np.int64))

    @classmethod
    def load(cls, path: str) -> Automaton:
        x = read_array(path, np.int64)
        root, arcs, states, rows, cols = (int(v) for v in x[:5])
        cuts = np.cumsum([5, arcs, arcs, arcs, states + 1, states, rows * cols])
        key, target, skip, first, final, note = (np.asarray(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        return cls(root, key, target, skip, first, final, note.reshape(rows, cols))

    def step(self, state: np.ndarray, number: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of them have such an arc, state behind it, number so far)."""
        want = (state << _LETTER_BITS) | letter
        at = np.minimum(np.searchsorted(self.key, want), max(len(self.key) - 1, 0))
        ok = np.flatnonzero(self.key[at] == want) if len(self.key) else np.zeros(0, np.int64)
        return ok, self.target[at[ok]], number[ok] + self.skip[at[ok]]

    def one_error(self, w: Letters, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, number) for words that differ from a query by exactly one inserted, deleted or
        replaced letter, none of them among its first `exact` letters, which stand as they are."""
        state, number = np.full(len(w.size), self.root), np.zeros(len(w.size), np.int64)
        alive, depth = np.arange(len(w.size)), 0
        whole = []
        while len(alive):
            reached = exact[alive] <= depth
            whole.append(alive[reached])
            alive = alive[~reached]
            ok, state_, number_ = self.step(state[alive], number[alive], w.codes[w.start[alive] + depth])
            alive = alive[ok]
            state[alive], number[alive] = state_, number_
            depth += 1
        alive, found = np.sort(np.concatenate(whole)) if whole else alive, []
        place = exact.copy()
        while len(alive):
            s, n, p = state[alive], number[alive], place[alive]
            more = p < w.size[alive]
            here = np.zeros(len(alive), np.int64)
            here[more] = w.codes[w.start[alive[more]] + p[more]]
            # every arc of the state: its letter put in, or put for the query's next letter
            n_arcs = self.first[s + 1] - self.first[s]
            arc, of = ranges(self.first[s], n_arcs), np.repeat(np.arange(len(alive)), n_arcs)
            other = more[of] & ((self.key[arc] & ((1 << _LETTER_BITS) - 1)) != here[of])
            query = np.concatenate((alive[of], alive[of[other]], alive[more]))
            to = np.concatenate((self.target[arc], self.target[arc[other]], s[more]))
            so_far = np.concatenate((n[of] + self.skip[arc], n[of[other]] + self.skip[arc[other]], n[more]))
            left = np.concatenate((p[of], p[of[other]] + 1, p[more] + 1))
            found.append(np.stack((query, to, so_far, left)))
            ok, s, n = self.step(s[more], n[more], here[more])
            alive = alive[more][ok]
            state[alive], number[alive] = s, n
            place[alive] += 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(self._rest(w, *np.concatenate(found, axis=1)), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def _rest(self, w: Letters, query: np.ndarray, state: np.ndarray, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(query, number) of those whose letters from place on lead to a word's end."""
        found = []
        while len(query):
            over = place == w.size[query]
            ends = over & (self.final[state] > 0)
            found.append(np.stack((query[ends], number[ends]), axis=1))
            query, state, number, place = query[~over], state[~over], number[~over], place[~over]
            ok, state, number = self.step(state, number, w.codes[w.start[query] + place])
            query, place = query[ok], place[ok] + 1
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)
