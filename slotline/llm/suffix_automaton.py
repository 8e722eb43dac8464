"""A generalised suffix automaton of token sequences: which stretches of a stream occur in which template, and where.

A state stands for token strings that end at the same places of the templates; its link leads to the longest suffix
with further places. Reading a stream token by token keeps the longest suffix that occurs in any template (the matching
statistic), in time linear in the stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """Of templates given as lists of token ids, each 0 or more."""

    def __init__(self, templates: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.size = [len(t) for t in templates]
        places: list[dict[int, list[int]]] = [{}]  # of each state: its ends in each template
        for number, tokens in enumerate(templates):
            last = 0
            for end, token in enumerate(tokens, 1):
                last = self._extend(last, token)
                while len(places) < len(self.next):
                    places.append({})
                places[last].setdefault(number, []).append(end)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            up = self.link[state]
            if up > 0:
                for number, ends in places[state].items():
                    places[up].setdefault(number, []).extend(ends)
        self.places = [{k: sorted(set(ends)) for k, ends in p.items()} for p in places]
        #: of each state and template: the longest suffix's state that occurs there
        self.holder: list[dict[int, int]] = [{}]
        for state in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            while len(self.holder) < len(self.next):
                self.holder.append({})
            self.holder[state] = {**self.holder[self.link[state]], **dict.fromkeys(self.places[state], state)}

    def _extend(self, last: int, token: int) -> int:
        found = self.next[last].get(token)
        if found is not None:  # another template has been here
            return found if self.length[found] == self.length[last] + 1 else self._split(last, token, found)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            found = self.next[at][token]
            self.link[new] = found if self.length[found] == self.length[at] + 1 else self._split(at, token, found)
        return new

    def _state(self, length: int, steps: dict[int, int], link: int = 0) -> int:
        self.next.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, token: int, found: int) -> int:
        """A state for the strings of ``found`` that are no longer than those of ``at`` and the token."""
        own = self._state(self.length[at] + 1, dict(self.next[found]), self.link[found])
        self.link[found] = own
        while at >= 0 and self.next[at].get(token) == found:
            self.next[at][token] = own
            at = self.link[at]
        return own

    def statistics(self, stream: Sequence[int]) -> Iterator[tuple[int, int]]:
        """(length, state) after each token: the longest suffix of the stream so far that occurs in a template."""
        state, length = 0, 0
        steps, link, size = self.next, self.link, self.length
        for token in stream:
            while state and token not in steps[state]:
                state = link[state]
                length = size[state]
            state = steps[state].get(token, 0)
            length = length + 1 if state else 0
            yield length, state

    def matches(self, stream: Sequence[int], least: int) -> Iterator[tuple[int, int, int, list[int]]]:
        """(template, start, end, ends in it) of every stretch of ``least`` or more tokens that occurs in a template and
        that, there, the next token does not continue. Each template has its own: a stretch is not hidden by a longer one
        of another template."""
        open_: dict[int, tuple[int, int]] = {}
        at = 0
        for at, (length, state) in enumerate(self.statistics(stream), 1):
            now = {}
            if length >= least:
                for number, holder in self.holder[state].items():
                    own = length if holder == state else self.length[holder]
                    if own >= least:
                        now[number] = (own, holder)
            for number, (own, holder) in open_.items():
                if now.get(number, (0, 0))[0] != own + 1:
                    yield number, at - 1 - own, at - 1, self.places[holder][number]
            open_ = now
        for number, (own, holder) in open_.items():
            yield number, at - own, at, self.places[holder][number]
