"""A phrase automaton: a trie of words with failure links, walked once a text."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence


class Phrases:
    """Finds all of many phrases in a run of words, in one step a word.

    Every state is the longest end of the words read that begins some phrase; where no phrase goes on with
    the next word, the failure link leads to the next shorter such end. A state lists the phrases that end
    there, its own and those of the states behind its link.
    """

    def __init__(self, phrases: Iterable[Sequence[str]]):
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        for k, words in enumerate(phrases):
            at = 0
            for w in words:
                if w not in self.step[at]:
                    self.step[at][w] = len(self.step)
                    self.step.append({})
                    self.ends.append(())
                at = self.step[at][w]
            if at:
                self.ends[at] += (k,)
        self.link = [0] * len(self.step)
        waiting = deque(self.step[0].values())
        while waiting:
            at = waiting.popleft()
            for w, to in self.step[at].items():
                back = self.link[at]
                while back and w not in self.step[back]:
                    back = self.link[back]
                self.link[to] = self.step[back].get(w, 0)
                self.ends[to] += self.ends[self.link[to]]
                waiting.append(to)

    def found(self, words: Iterable[str]) -> set[int]:
        """Numbers of the phrases that stand in the words."""
        at, out = 0, set()
        for w in words:
            while at and w not in self.step[at]:
                at = self.link[at]
            at = self.step[at].get(w, 0)
            if self.ends[at]:
                out.update(self.ends[at])
        return out
