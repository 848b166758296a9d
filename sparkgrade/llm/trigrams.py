"""Boolean trigram queries from regular expressions.

A text that matches an expression must hold certain three-letter strings. The query is a
disjunction of conjunctions: a set of sets of trigrams, of which all of some set must occur
(in lower case). ``None``: no trigram is mandatory, so the expression must scan every text.
"""

from __future__ import annotations

import re
from itertools import product

Query = frozenset[frozenset[str]] | None

MOST_STRINGS = 128


def absorbed(sets: set[frozenset[str]]) -> frozenset[frozenset[str]]:
    """Without conjunctions that imply another one."""
    return frozenset(s for s in sets if not any(o < s for o in sets))


def either(queries: list[Query]) -> Query:
    if any(q is None for q in queries):
        return None
    return absorbed({s for q in queries for s in q})


def both(left: Query, right: Query) -> Query:
    if left is None or right is None:
        return left if right is None else right
    return absorbed({a | b for a in left for b in right})


def of_strings(strings: set[str]) -> Query:
    """Query for texts that hold one of ``strings``."""
    if any(len(s) < 3 for s in strings):
        return None
    return absorbed({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def class_strings(items: list) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if str(kind) == "LITERAL":
            found.add(chr(value).lower())
        elif str(kind) == "RANGE" and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def exact(node: tuple) -> set[str] | None:
    """All lower-cased strings that a node matches, if they are few."""
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return {chr(value).lower()}
    if kind == "IN":
        return class_strings(value)
    if kind == "SUBPATTERN":
        return exact_sequence(list(value[-1]))
    if kind == "BRANCH":
        parts = [exact_sequence(list(p)) for p in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind == "MAX_REPEAT" and value[1] <= 4 and (inner := exact_sequence(list(value[2]))) is not None:
        found = {"".join(c) for n in range(value[0], value[1] + 1) for c in product(inner, repeat=n)}
        return found if len(found) <= MOST_STRINGS else None
    return None


def exact_sequence(nodes: list[tuple]) -> set[str] | None:
    run = {""}
    for node in nodes:
        part = exact(node)
        if part is None or len(run) * len(part) > MOST_STRINGS:
            return None
        run = {a + b for a in run for b in part}
    return run


def of_sequence(nodes: list[tuple]) -> Query:
    query, run = None, {""}
    for node in nodes:
        part = exact(node)
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        query = both(query, of_strings(run))
        run = part if part is not None else {""}
        if part is None:
            query = both(query, of_node(node))
    return both(query, of_strings(run))


def of_node(node: tuple) -> Query:
    kind, value = str(node[0]), node[1]
    if kind == "SUBPATTERN":
        return of_sequence(list(value[-1]))
    if kind == "BRANCH":
        return either([of_sequence(list(p)) for p in value[1]])
    if kind == "MAX_REPEAT" and value[0] >= 1:
        return of_sequence(list(value[2]) * min(3, value[0]))
    return None


def trigram_query(pattern: str) -> Query:
    """The query of a regular expression without back references and lookaround."""
    return of_sequence(list(re._parser.parse(pattern)))
