"""Longest common stretches of texts with a whole block of quotes, by one pass over each text."""

from __future__ import annotations


class Runs:
    """A suffix automaton of several quotes. A state stands for the stretches that end at the same places of the quotes.

    `holders` of a state has bit i set if quote i holds its stretches.
    """

    def __init__(self, quotes: list[str]):
        self.n = len(quotes)
        self.onward: list[dict[str, int]] = [{}]
        self.shorter, self.longest, self.holders = [-1], [0], [0]
        for i, quote in enumerate(quotes):
            at = 0
            for c in quote:
                at = self._extended(at, c)
                self.holders[at] |= 1 << i
        for s in sorted(range(1, len(self.onward)), key=self.longest.__getitem__, reverse=True):
            self.holders[self.shorter[s]] |= self.holders[s]

    def _state(self, onward: dict[str, int], longest: int) -> int:
        self.onward.append(onward)
        self.longest.append(longest)
        self.shorter.append(0)
        self.holders.append(0)
        return len(self.onward) - 1

    def _extended(self, at: int, c: str) -> int:
        """The state of the stretch of state `at` and c behind it."""
        if c in self.onward[at]:
            return self._split(at, c)
        new = self._state({}, self.longest[at] + 1)
        while at >= 0 and c not in self.onward[at]:
            self.onward[at][c] = new
            at = self.shorter[at]
        self.shorter[new] = self._split(at, c) if at >= 0 else 0
        return new

    def _split(self, at: int, c: str) -> int:
        """The state after `at` by c, parted from the longer stretches that it stood for as well."""
        old = self.onward[at][c]
        if self.longest[old] == self.longest[at] + 1:
            return old
        part = self._state(dict(self.onward[old]), self.longest[at] + 1)
        self.shorter[part], self.shorter[old] = self.shorter[old], part
        while at >= 0 and self.onward[at].get(c) == old:
            self.onward[at][c] = part
            at = self.shorter[at]
        return part

    def of(self, text: str) -> list[int]:
        """For each quote the length of its longest stretch in the text."""
        onward, shorter, longest, holders = self.onward, self.shorter, self.longest, self.holders
        best, at, n = {}, 0, 0
        for c in text:
            while (to := onward[at].get(c)) is None and at:
                at = shorter[at]
                n = longest[at]
            if to is None:
                continue
            at = to
            n += 1
            if best.get(at, 0) < n:
                best[at] = n
        # longest stretches first; a state's shorter ones come up at their own length, if some quote is still open by then
        levels: dict[int, set[int]] = {}
        for s, n in best.items():
            levels.setdefault(n, set()).add(s)
        out, still = [0] * self.n, (1 << self.n) - 1
        n = max(levels, default=0)
        while n and still:
            for s in levels.pop(n, ()):
                if found := holders[s] & still:
                    still ^= found
                    while found:
                        low = found & -found
                        out[low.bit_length() - 1] = n
                        found ^= low
                if less := longest[shorter[s]]:
                    levels.setdefault(less, set()).add(shorter[s])
            n -= 1
        return out
