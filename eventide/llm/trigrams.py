"""Boolean trigram queries that every match of a regular expression satisfies.

A query is a conjunction of clauses; a clause is a disjunction of sets of trigrams that must all occur.
It is derived from runs of the expression that can only be one of a few strings. Letters are folded to
lower case. A rule without any clause has no mandatory trigram.
"""

from __future__ import annotations

import re
from itertools import product

# The blank and the letters by their frequency in English text.
BY_FREQUENCY = " etaoinshrdlucmfwypvbgkjqxz"
#: Strings that a run may stand for before it is closed.
MOST_STRINGS = 64

Clause = list[frozenset[str]]


def _grams(text: str) -> frozenset[str]:
    low = text.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def _clause(strings: set[str]) -> Clause:
    """None of the sets may hold another: the smaller one is the weaker demand."""
    sets = {_grams(x) for x in strings}
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


class _Reader:
    """Walks a parsed expression; ``strings`` are what the open run can be."""

    def __init__(self) -> None:
        self.strings, self.clauses = {""}, []

    def close(self) -> None:
        if (clause := _clause(self.strings)) and all(clause):
            self.clauses.append(clause)
        self.strings = {""}

    def follow(self, choices: set[str] | None) -> None:
        """Choices for what comes next; None: too many to list."""
        if choices is None or len(self.strings) * len(choices) > MOST_STRINGS:
            self.close()
            if choices is None or len(choices) > MOST_STRINGS:
                return
        self.strings = {a + b for a, b in product(self.strings, choices)}

    def read(self, parsed) -> None:
        for op, arg in parsed:
            name = str(op)
            choices = finite(op, arg)
            if choices is not None:
                self.follow(choices)
            elif name == "SUBPATTERN":
                self.read(arg[-1])
            elif name == "MAX_REPEAT" and arg[0] > 0:
                once = finite_sequence(arg[2])
                self.follow({x * arg[0] for x in once} if once is not None and len(once) == 1 else None)
                self.close()
            elif name != "AT":
                self.close()


def finite(op, arg) -> set[str] | None:
    """The strings that a part can match, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        found: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                found.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if name == "SUBPATTERN":
        return finite_sequence(arg[-1])
    if name == "BRANCH":
        parts = [finite_sequence(x) for x in arg[1]]
        return None if any(x is None for x in parts) else set().union(*parts)
    if name == "MAX_REPEAT" and arg[1] == 1:
        once = finite_sequence(arg[2])
        return None if once is None else once | ({""} if arg[0] == 0 else set())
    return None


def finite_sequence(parsed) -> set[str] | None:
    found = {""}
    for op, arg in parsed:
        choices = finite(op, arg)
        if choices is None or len(found) * len(choices) > MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, choices)}
    return found


def trigram_query(pattern: str) -> list[Clause]:
    reader = _Reader()
    reader.read(re._parser.parse(pattern))
    reader.close()
    return reader.clauses


def thinned(query: list[Clause], most: int) -> list[Clause]:
    """The query with only so many trigrams in each set, those of the rarest letters: a weaker demand, for a smaller index."""
    rank = lambda gram: sum(BY_FREQUENCY.index(c) if c in BY_FREQUENCY else len(BY_FREQUENCY) for c in gram)
    return [[frozenset(sorted(s, key=lambda g: (-rank(g), g))[:most]) for s in clause] for clause in query]
