"""Required trigrams of regular expressions and a trigram index over text chunks.

A regular expression can only match a text that holds certain substrings.  ``required_strings``
reads them off the parsed expression as a conjunction of alternatives.  The index is kept chunk
by chunk: for each chunk a bitmap of the required trigrams it holds.  Intersecting the postings of
an expression is then a test of bits in the chunk's own row, which needs no shuffle.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as P
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_MAX_ALTERNATIVES = 64
_BITS = 62
#: A conjunct is a set of strings of which one at least must occur.
Conjunct = frozenset


def _cross(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= _MAX_ALTERNATIVES else None


def _class_chars(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 4:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 4 else None


def _walk(seq) -> tuple[set[str] | None, list[Conjunct]]:
    """(exact strings or None, conjuncts) of a parsed sequence."""
    exact: set[str] | None = {""}
    run: set[str] = {""}
    found: list[Conjunct] = []

    def flush() -> None:
        nonlocal run
        if "" not in run:
            found.append(frozenset(run))
        run = {""}

    for op, arg in seq:
        part: set[str] | None = None
        inner: list[Conjunct] = []
        if op is C.LITERAL:
            part = {chr(arg).lower()}
        elif op is C.IN:
            part = _class_chars(arg)
        elif op is C.SUBPATTERN:
            part, inner = _walk(arg[3])
        elif op is C.BRANCH:
            walks = [_walk(b) for b in arg[1]]
            exacts = [w[0] for w in walks]
            if all(e is not None for e in exacts) and len(set().union(*exacts)) <= _MAX_ALTERNATIVES:
                part = set().union(*exacts)
            else:
                best = [max(([frozenset(e)] if e and "" not in e else []) + c, key=_strength, default=None) for e, c in walks]
                if all(best):
                    inner = [frozenset().union(*best)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            e, c = _walk(body)
            if low == high == 1:
                part, inner = e, c
            elif low == 0 and high == 1 and e is not None:
                part = e | {""}
            elif low >= 1:
                inner = c + ([frozenset(e)] if e and "" not in e else [])
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        joined = _cross(run, part) if part is not None else None
        if joined is not None:
            run = joined
            exact = None if exact is None else _cross(exact, part)
        else:
            flush()
            exact = None
            if part is not None:
                run = set(part)
            found += inner
    if exact is None:
        flush()
    return exact, found


def _strength(c: Conjunct) -> tuple[int, int]:
    return (min((len(s) for s in c), default=0), -len(c))


def required_strings(pattern: str) -> list[Conjunct]:
    """Conjuncts of lower-case strings; a text that matches holds one string of each (without regard to case)."""
    exact, found = _walk(P.parse(pattern))
    if exact is not None and "" not in exact:
        found = [*found, frozenset(exact)]
    return [c for c in found if min(len(s) for s in c) >= 3]


def trigrams_of(text: str) -> list[str]:
    return [text[i : i + 3] for i in range(len(text) - 2)]


#: Rough frequency of letters in text and code, the more frequent the earlier.
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"


def _commonness(trigram: str) -> int:
    return sum(26 - _COMMON.index(c) if c in _COMMON else 3 for c in trigram)


#: A string is told by these trigrams together.
Told = frozenset


@dataclass(frozen=True)
class TrigramQuery:
    """For each expression its conjuncts, each a set of strings (as sets of trigrams) of which a chunk must hold one."""

    names: tuple[str, ...]
    clauses: tuple[tuple[frozenset[Told], ...], ...]
    trigrams: tuple[str, ...]

    @staticmethod
    def of(patterns: dict[str, str], conjuncts: int = 2, each: int = 2) -> "TrigramQuery":
        """Keeps the ``conjuncts`` strongest conjuncts, and of each string its ``each`` least common trigrams.

        Fewer trigrams only make the filter weaker, never wrong.  Raises where an expression has no
        required trigram, as every chunk would be its candidate.
        """
        kept: dict[str, list[Conjunct]] = {}
        for name, pattern in patterns.items():
            kept[name] = sorted(required_strings(pattern), key=_strength, reverse=True)[:conjuncts]
            if not kept[name]:
                raise ValueError(f"{name}: no trigram is required")
        told = lambda s: Told(sorted(set(trigrams_of(s)), key=lambda t: (_commonness(t), t))[:each])
        clauses = tuple(tuple(_minimal({told(s) for s in c}) for c in cs) for cs in kept.values())
        every = {t for cs in clauses for c in cs for s in c for t in s}
        return TrigramQuery(tuple(patterns), clauses, tuple(sorted(every)))

    def _mask(self, trigrams: Told) -> list[int]:
        masks = [0] * (-(-len(self.trigrams) // _BITS))
        for t in trigrams:
            k = self.trigrams.index(t)
            masks[k // _BITS] |= 1 << (k % _BITS)
        return masks

    def index_sql(self, text: str) -> str:
        """SQL of the chunk's posting bitmap: one bit for each required trigram over lower-case text."""
        quoted = [t.replace("\\", "\\\\").replace("'", "\\'") for t in self.trigrams]
        words = []
        for start in range(0, len(quoted), _BITS):
            words.append(" | ".join(f"if(contains(t, '{t}'), {1 << k}L, 0L)" for k, t in enumerate(quoted[start : start + _BITS])))
        return f"transform(array(lower({text})), t -> array({', '.join(words)}))[0]"

    def rules_sql(self, postings: str) -> str:
        """SQL of the expressions whose postings meet in the chunk, as a bitmap in the order of ``names``.

        The bitmap is bound to a lambda variable, so Catalyst cannot copy its expression into each
        of the bit tests.
        """
        tests = []
        for n, conjuncts in enumerate(self.clauses):
            held = []
            for c in conjuncts:
                strings = sorted([" AND ".join(f"(p[{w}] & {m}L) = {m}L" for w, m in enumerate(self._mask(s)) if m) for s in c])
                held.append("(" + " OR ".join(f"({x})" for x in strings) + ")")
            tests.append(f"if({' AND '.join(held)}, {1 << n}L, 0L)")
        return f"transform(array({postings}), p -> {' | '.join(tests)})[0]"

    def index(self, text: str) -> Column:
        return F.expr(self.index_sql(text))

    def rules(self, postings: str) -> Column:
        return F.expr(self.rules_sql(postings))

    def holds(self, text: str) -> int:
        """The same bitmap of expressions in Python."""
        low = text.lower()
        met = lambda cs: all(any(all(t in low for t in s) for s in c) for c in cs)
        return sum(1 << n for n, cs in enumerate(self.clauses) if met(cs))


def _minimal(strings: set[Told]) -> frozenset[Told]:
    """Without the strings that need all trigrams of another one: these are met whenever the other is."""
    return frozenset(s for s in strings if not any(o < s for o in strings))
