"""Levenshtein automata intersected with a trie: one table that finds lexicon terms in many tokens at once."""

from __future__ import annotations

import numpy as np

#: Spelling errors allowed in a term of at least so many characters.
ERRORS = ((8, 2), (5, 1))
LEAST_LENGTH = ERRORS[-1][0]
#: States of a table at most; states that a term adds, about, by its errors (terms are dealt to tables by that).
MOST_STATES, STATES_OF = 60_000, {0: 10, 1: 80, 2: 1100}


def allowed(term: str, stem: bool) -> int:
    return 0 if stem else next((d for n, d in ERRORS if len(term) >= n), 0)


class _TooLarge(Exception):
    pass


class LexiconAutomaton:
    """Accepts tokens within the allowed Levenshtein distance of a word, and tokens that begin with a stem, of any lexicon.

    ``codes(tokens)`` is 0 for a token that is not accepted, else 1 + 3 * entry + distance, with the least distance, then
    the first entry. A large lexicon is
    split, in the order of its terms, into several tables; the best hit over all counts.
    """

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = list(entries)
        self.tables: list[tuple[LexiconTable, np.ndarray]] = []
        todo, size = [], MOST_STATES
        for i in sorted(range(len(self.entries)), key=lambda i: (self.entries[i], i)):
            size += STATES_OF[allowed(*self.entries[i])]
            if size > MOST_STATES // 2:
                todo.append([])
                size = 0
            todo[-1].append(i)
        while todo:
            part = todo.pop()
            try:
                # entries of a part keep their order, which decides between equal distances
                part = sorted(part)
                self.tables.append((LexiconTable([self.entries[i] for i in part]), np.array(part)))
            except _TooLarge:
                part = sorted(part, key=lambda i: (self.entries[i], i))
                todo += [part[: len(part) // 2], part[len(part) // 2 :]]

    def codes(self, tokens: list[str]) -> np.ndarray:
        best = np.zeros(len(tokens), np.int64)
        rank = np.full(len(tokens), np.iinfo(np.int64).max)  # distance, then entry
        for table, where in self.tables:
            found = table.codes(tokens).astype(np.int64)
            hit = np.flatnonzero(found)
            entry, distance = where[(found[hit] - 1) // 3], (found[hit] - 1) % 3
            order = distance * len(self.entries) + entry
            better = order < rank[hit]
            hit, entry, distance = hit[better], entry[better], distance[better]
            rank[hit], best[hit] = order[better], 1 + 3 * entry + distance
        return best.astype(np.int32)


class LexiconTable:
    """One table of a lexicon: accepts tokens within the allowed Levenshtein distance of a word, and tokens that begin with a stem.

    ``entries`` are (term, is_stem). States of the deterministic automaton are sets of (trie node, errors): the product
    of the lexicon's trie with the Levenshtein automata of its terms. ``codes(tokens)`` is 0 for a token that is not
    accepted, else 1 + 3 * entry + distance, with the least distance, then the first entry.
    """

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = list(entries)
        children: list[dict[str, int]] = [{}]
        term_at: list[int] = [-1]
        reach = [0]  # errors allowed by any term at or below the node
        for i, (term, stem) in enumerate(self.entries):
            node, d = 0, allowed(term, stem)
            reach[0] = max(reach[0], d)
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    term_at.append(-1)
                    reach.append(0)
                node = children[node][c]
                reach[node] = max(reach[node], d)
            if term_at[node] < 0:
                term_at[node] = i
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for x in children for c in x}))}

        def closed(found: dict[int, int]) -> frozenset:
            todo = list(found.items())
            while todo:  # a character of the term is left out
                node, e = todo.pop()
                for child in children[node].values():
                    if e + 1 <= reach[child] and found.get(child, 9) > e + 1:
                        found[child] = e + 1
                        todo.append((child, e + 1))
            return frozenset(found.items())

        def stem_of(state: frozenset) -> int:
            return min((term_at[n] for n, e in state if e == 0 and term_at[n] >= 0 and self.entries[term_at[n]][1]), default=-1)

        def steps(state: frozenset) -> tuple[frozenset, dict[str, frozenset]]:
            """The state after a character that no node of ``state`` goes on with, and after each of the others."""
            other: dict[int, int] = {}

            def add(found: dict[int, int], node: int, e: int) -> None:
                if e <= reach[node] and found.get(node, 9) > e:
                    found[node] = e

            same: dict[str, list[tuple[int, int]]] = {}
            for node, e in state:
                add(other, node, e + 1)  # a character too many
                for x, child in children[node].items():
                    add(other, child, e + 1)  # another one in its place
                    same.setdefault(x, []).append((child, e))
            after = {}
            for c, going in same.items():
                found = dict(other)
                for child, e in going:
                    if e == 0:
                        found[child] = 0  # a path without errors needs no budget
                    else:
                        add(found, child, e)
                after[c] = closed(found)
            return closed(other), after

        start = closed({0: 0})
        number, queue, rows, accept = {start: 1}, [start], {}, {}
        stems: dict[int, int] = {}
        letters = [None, *sorted(self.alphabet)]
        while queue:
            state = queue.pop()
            k = number[state]
            best = min(((e, term_at[n]) for n, e in state if term_at[n] >= 0 and e <= allowed(*self.entries[term_at[n]])), default=None)
            accept[k] = 0 if best is None else 1 + 3 * best[1] + best[0]
            row = []
            otherwise, following = steps(state)
            for c in letters:
                after = following.get(c, otherwise)
                if not after:
                    row.append(0)
                    continue
                if (s := stem_of(after)) >= 0:
                    row.append(-1 - s)
                    stems[s] = 0
                    continue
                if after not in number:
                    number[after] = len(number) + 1
                    queue.append(after)
                    if len(number) > MOST_STATES:
                        raise _TooLarge
                row.append(number[after])
            rows[k] = row
        n = len(number) + 1
        for j, s in enumerate(sorted(stems)):
            stems[s] = n + j
        self.table = np.zeros((n + len(stems), len(letters)), np.int32)
        self.accept = np.zeros(n + len(stems), np.int32)
        for k, row in rows.items():
            self.table[k] = [stems[-1 - x] if x < 0 else x for x in row]
            self.accept[k] = accept[k]
        for s, k in stems.items():
            self.table[k] = k
            self.accept[k] = 1 + 3 * s

    def codes(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros(len(tokens), np.int32)
        if not self.entries or not tokens:
            return out
        points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(lengths) - lengths
        lookup = np.zeros(int(max(map(ord, self.alphabet))) + 2, np.int32)
        for c, k in self.alphabet.items():
            lookup[ord(c)] = k
        letters = lookup[np.minimum(points, len(lookup) - 1)]
        alive, states, at = np.arange(len(tokens)), np.ones(len(tokens), np.int32), 0
        while len(alive):
            ended = lengths[alive] <= at
            out[alive[ended]] = self.accept[states[ended]]
            alive, states = alive[~ended], states[~ended]
            states = self.table[states, letters[starts[alive] + at]]
            going = states > 0
            alive, states, at = alive[going], states[going], at + 1
        return out
