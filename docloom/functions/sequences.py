"""Python's difflib.SequenceMatcher ratio of texts, with less work for the same number.

A difflib match begins at a seed, a character of the second text that isn't popular there
(from POPULAR characters on, one that stands in over a hundredth of the places and once more is),
and grows over equal neighbours. ``Sequence`` keeps what a comparison needs of a text, and walks the
places of seeds alone.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import cached_property

#: Length from which difflib leaves popular characters out of the seeds. Fixed value.
POPULAR = 200
#: Length of the substrings that two texts of a high ratio must share.
GRAM = 6


class Sequence:
    """A text with the counts, seeds and substrings that comparisons ask for; each is made once, when first asked."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def counts(self) -> dict[str, int]:
        return {c: self.text.count(c) for c in set(self.text)}

    @cached_property
    def seeds(self) -> dict[str, list[int]]:
        """The places of each character that isn't popular."""
        n = len(self.text)
        most = n // 100 + 1 if n >= POPULAR else n
        out: dict[str, list[int]] = {c: [] for c, k in self.counts.items() if k <= most}
        for i, c in enumerate(self.text):
            if c in out:
                out[c].append(i)
        return out

    @cached_property
    def grams(self) -> tuple[set[str], int]:
        """Substrings of GRAM characters, and how many of them repeat an earlier one."""
        t = self.text
        some = {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}
        return some, max(0, len(t) - GRAM + 1) - len(some)


def ratio_of(matched: int, a: Sequence, b: Sequence) -> float:
    """difflib's ratio for so many matched characters."""
    n = len(a.text) + len(b.text)
    return 2.0 * matched / n if n else 1.0


def common(a: Sequence, b: Sequence) -> int:
    """Characters in both, each as often as in the text that has fewer: no fewer than match."""
    other = b.counts
    return sum(min(k, other[c]) for c, k in a.counts.items() if c in other)


def most_matched(a: Sequence, b: Sequence) -> int:
    """An upper bound of ``matched`` for a b with popular characters.

    Matches are common substrings that don't overlap. Each has a seed but one, which may stand
    at the beginning of both; and a match of m characters holds m - GRAM + 1 common substrings
    of GRAM characters or more.
    """
    counts = a.counts
    matches = 1 + sum(min(len(places), counts[c]) for c, places in b.seeds.items() if c in counts)
    (own, again), (other, too) = a.grams, b.grams
    return len(own & other) + min(again, too) + (GRAM - 1) * matches


def matched(a: Sequence, b: Sequence) -> int:
    """Characters that SequenceMatcher(None, a, b) matches: the longest run of seeds first, then left and right of it."""
    s, t, seeds = a.text, b.text, b.seeds
    at = [i for i, c in enumerate(s) if c in seeds]
    found = [seeds[s[i]] for i in at]
    total, todo = 0, [(0, len(s), 0, len(t), 0, len(at))]
    while todo:
        alo, ahi, blo, bhi, first, last = todo.pop()
        i, j, size = alo, blo, 0
        before, runs = -2, {}
        for p in range(first, last):
            x, new = at[p], {}
            if x != before + 1:
                runs = {}
            for y in found[p]:
                if y < blo:
                    continue
                if y >= bhi:
                    break
                new[y] = k = runs.get(y - 1, 0) + 1
                if k > size:
                    i, j, size = x - k + 1, y - k + 1, k
            before, runs = x, new
        while i > alo and j > blo and s[i - 1] == t[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and s[i + size] == t[j + size]:
            size += 1
        if size:
            total += size
            if alo < i and blo < j:
                todo.append((alo, i, blo, j, first, bisect_left(at, i, first, last)))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi, bisect_left(at, i + size, first, last), last))
    return total


def ratio(a: Sequence, b: Sequence, least: float) -> float | None:
    """SequenceMatcher(None, a, b).ratio(), or None where it is under least; bounds by lengths, characters and substrings go first."""
    if ratio_of(min(len(a.text), len(b.text)), a, b) < least or ratio_of(common(a, b), a, b) < least:
        return None
    if len(b.text) >= POPULAR and ratio_of(most_matched(a, b), a, b) < least:
        return None
    r = ratio_of(matched(a, b), a, b)
    return r if r >= least else None
