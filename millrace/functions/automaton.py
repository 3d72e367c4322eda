"""A multi-pattern automaton over words: finds the phrases of a list of any length in one pass over a text."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import deque
from collections.abc import Iterable, Sequence

# Characters that are written in place of letters; some stand for one of two.
LOOK_ALIKES = [str.maketrans("0134578@$!|+", f"o{one}eastbas{one}{one}t") for one in "il"]


def folded(word: str) -> set[str]:
    """What a disguised word may read as: without case, accents and inner marks, look-alikes as letters, drawn-out letters once."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))
    return {re.sub(r"(.)\1{2,}", r"\1", "".join(c for c in bare.translate(t) if c.isalpha())) for t in LOOK_ALIKES}


class Automaton:
    """Phrases (sequences of words) as a trie with failure links.

    ``step[state]`` maps a word to the next state, ``fail[state]`` is the state of the longest proper suffix in the trie, ``length[state]``
    the words of the phrase that ends there (0: none) and ``shorter[state]`` the next state along the links where one ends. A text's
    words are each read once, so the cost does not grow with the list.
    """

    def __init__(self, phrases: Iterable[Sequence[str]]) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.length = [0]
        for phrase in phrases:
            state = 0
            for word in phrase:
                if word not in self.step[state]:
                    self.step[state][word] = len(self.step)
                    self.step.append({})
                    self.length.append(0)
                state = self.step[state][word]
            self.length[state] = len(phrase)
        self.fail, self.shorter = [0] * len(self.step), [0] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            state = queue.popleft()
            for word, child in self.step[state].items():
                at = self.fail[state]
                while at and word not in self.step[at]:
                    at = self.fail[at]
                link = self.step[at].get(word, 0)
                self.fail[child] = link if link != child else 0
                self.shorter[child] = self.fail[child] if self.length[self.fail[child]] else self.shorter[self.fail[child]]
                queue.append(child)

    def find(self, words: Sequence[str]) -> list[tuple[int, int]]:
        """All places (first word, word after the last) where a phrase occurs."""
        state, out = 0, []
        for i, word in enumerate(words):
            while state and word not in self.step[state]:
                state = self.fail[state]
            state = self.step[state].get(word, 0)
            at = state if self.length[state] else self.shorter[state]
            while at:
                out.append((i + 1 - self.length[at], i + 1))
                at = self.shorter[at]
        return out


def longest_first(found: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places that do not overlap: longer ones first, then earlier ones; in order of place."""
    kept: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0] - s[1], s[0])):
        at = bisect.bisect_left(kept, (a, b))
        if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or b <= kept[at][0]):
            kept.insert(at, (a, b))
    return kept
