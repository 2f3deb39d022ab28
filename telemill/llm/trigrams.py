"""Boolean trigram queries derived from regular expressions.

A query is in disjunctive form: a tuple of clauses, each a set of trigrams that a text must all hold. Any match of the
pattern satisfies one clause at least. The empty clause is satisfied by every text, so a pattern that has it must be
tried on all of them. Trigrams are lower-cased; ``re`` parses the pattern, whose syntax must be one that it shares with
the engine that runs it.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser as parser

Query = tuple[frozenset[str], ...]

ANY: Query = (frozenset(),)
MOST_STRINGS = 64  # alternatives that are followed one by one; more are taken as unknown
MOST_CLAUSES = 64
MOST_CHARACTERS = 8  # a class of more is unknown


def _or(a: Query, b: Query) -> Query:
    return _least({*a, *b})


def _and(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_CLAUSES:  # the shorter one alone is weaker, and still right
        return min(a, b, key=len)
    return _least({x | y for x, y in product(a, b)})


def _least(clauses: set[frozenset[str]]) -> Query:
    """Without clauses that another one implies."""
    return tuple(sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted))


def _held(strings: frozenset[str]) -> Query:
    """What a text holds that has one of ``strings`` inside."""
    return _least({frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings})


def _class(members: list) -> frozenset[str] | None:
    out: set[str] = set()
    for kind, x in members:
        if kind is op.LITERAL:
            out.add(chr(x).lower())
        elif kind is op.RANGE and x[1] - x[0] < MOST_CHARACTERS:
            out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= MOST_CHARACTERS else None


def _node(kind, x) -> tuple[frozenset[str] | None, Query]:
    """All strings that a part of a pattern matches, or None if they are not known; and its query."""
    if kind is op.LITERAL:
        return frozenset({chr(x).lower()}), ANY
    if kind is op.IN:
        return _class(x), ANY
    if kind is op.SUBPATTERN:
        return _sequence(x[3])
    if kind is op.BRANCH:
        parts = [_sequence(p) for p in x[1]]
        query = parts[0][1] if parts[0][0] is None else _held(parts[0][0])
        for strings, own in parts[1:]:
            query = _or(query, own if strings is None else _held(strings))
        known = all(s is not None for s, _ in parts)
        union = frozenset().union(*[s for s, _ in parts]) if known else frozenset()
        return (union, query) if known and len(union) <= MOST_STRINGS else (None, query)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, part = x
        strings, query = _sequence(part)
        if least == 0:
            return (strings | {""}, ANY) if strings is not None and most == 1 else (None, ANY)
        if strings is not None:
            query = _held(strings)
        return (strings, query) if least == most == 1 else (None, query)
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return frozenset({""}), ANY
    return None, ANY


def _sequence(parts) -> tuple[frozenset[str] | None, Query]:
    strings, query, known = frozenset({""}), ANY, True
    for kind, x in parts:
        own, asked = _node(kind, x)
        if own is not None and len(strings) * len(own) <= MOST_STRINGS:
            strings = frozenset(a + b for a, b in product(strings, own))
            continue
        # what was gathered so far stands in front of something unknown: it is one condition, and a new run begins
        query, known = _and(_and(query, _held(strings)), asked), False
        strings = own if own is not None else frozenset({""})
    return (strings, query) if known else (None, _and(query, _held(strings)))


def trigram_query(pattern: str) -> Query:
    """The query of ``pattern``; ``ANY`` if a match need not hold any trigram."""
    strings, query = _sequence(parser.parse(pattern))
    query = query if strings is None else _held(strings)
    return ANY if frozenset() in query else query
