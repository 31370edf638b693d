"""Generalised suffix automaton of word sequences."""

from __future__ import annotations


class WordAutomaton:
    """States as parallel lists: transitions, suffix link, length of the longest string."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, nxt: dict, length: int, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def extend(self, last: int, word) -> int:
        """The state of the string of ``last`` followed by ``word``; strings share states."""
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(word)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        new = self._state({}, length[last] + 1, 0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word, q: int) -> int:
        twin = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def by_length(self) -> list[int]:
        return sorted(range(1, len(self.next)), key=self.length.__getitem__)
