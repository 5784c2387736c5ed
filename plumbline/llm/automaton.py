"""Suffix automata over word sequences and matching statistics against them."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    """Generalised suffix automaton: accepts every run of consecutive symbols of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict[Hashable, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, symbol: Hashable, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: Sequence[Hashable]) -> None:
        last, next_, link, length = 0, self.next, self.link, self.length
        for symbol in sequence:
            q = next_[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, symbol, q)
                continue
            new, p = self._state(length[last] + 1, 0, {}), last
            while p != -1 and symbol not in next_[p]:
                next_[p][symbol] = new
                p = link[p]
            if p != -1:
                q = next_[p][symbol]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
            last = new

    def statistics(self, sequence: Sequence[Hashable]) -> list[int]:
        """For each position the length of the longest run ending there that the automaton accepts."""
        state, size, out, next_, link, length = 0, 0, [], self.next, self.link, self.length
        for symbol in sequence:
            while state and symbol not in next_[state]:
                state = link[state]
                size = length[state]
            q = next_[state].get(symbol)
            if q is None:
                state, size = 0, 0
            else:
                state, size = q, size + 1
            out.append(size)
        return out


def spans(statistics: list[int], least: int) -> list[tuple[int, int]]:
    """Maximal spans [a, b) covered by matches of at least so many symbols."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(statistics):
        if n >= least:
            a, b = i - n + 1, i + 1
            while out and out[-1][1] >= a:
                a = min(a, out.pop()[0])
            out.append((a, b))
    return out
