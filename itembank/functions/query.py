"""Keyword queries compiled to one Column at plan time.

A request, nested as it comes, becomes a flat list of clauses, each with the index of the clause around it. Checks,
predicates, scores and word lists are then single passes over that list. All of this runs on the driver over the request,
never over data; Catalyst sees one predicate.
"""
from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from itembank.functions.text import as_col

MAX_DEPTH = 8
# The default score boosts (words, points); any word of an entry earns its points once.
DEFAULT_BOOSTS = [(("脊椎动物学",), 30), (("文献题", "图表题"), 5)]
# What separates words, by the place they are written in. The first search rule whose sign is found applies.
WORD_LIST = r"[\s,，;；、/|]+"
SEARCH_RULES = [("OR", r"[|/]| or ", r"\s*[|/]\s*|\s+or\s+"), ("AND", r"", r"[\s,，;；]+")]
COMPAT_RULES = [("OR", r"[|/]| or ", r"\s*(?:\||/|or)\s*"), ("AND", r"", r"[\s,，;；]+")]
FOLDS = {"lower": lambda w: " ".join(w.lower().split()), "casefold": str.casefold}


@dataclass(frozen=True)
class Clause:
    """around: index of the enclosing clause, -1 for the outermost. every: all parts must hold, else any."""

    around: int
    depth: int
    every: bool
    words: tuple[str, ...]


def keyword_list(value: Any) -> list[str]:
    """Distinct normalised keywords of a string or list; anything else has none."""
    given = {str: lambda: re.split(WORD_LIST, value), list: lambda: map(str, value)}.get(type(value), list)()
    return [w for w in dict.fromkeys(map(FOLDS["lower"], given)) if w]


def _as_asked(node: Any, depth: int) -> tuple[bool, list[str], list]:
    """A node of a strict query; every fault is an error."""
    faults = {
        "query is too deep or not an object": lambda: depth > MAX_DEPTH or not isinstance(node, dict),
        "op must be AND or OR": lambda: str(node.get("op", "OR")).upper() not in ("AND", "OR"),
        "keywords must be non-blank strings": lambda: not isinstance(node.get("keywords", []), list)
        or any(not isinstance(w, str) or w.isspace() or not w for w in node.get("keywords", [])),
        "a query needs keywords or clauses": lambda: not isinstance(node.get("clauses", []), list)
        or not (node.get("keywords") or node.get("clauses")),
    }
    for fault, found in faults.items():
        if found():
            raise ValueError(fault)
    return str(node.get("op", "OR")).upper() == "AND", node.get("keywords", []), node.get("clauses", [])


def _as_meant(node: Any, depth: int) -> tuple[bool, list[str], list]:
    """A node of a forgiving query: plain words are an OR, an unknown op is OR, must and any lists are clauses."""
    if not isinstance(node, dict):
        return False, keyword_list(node), []
    if node.keys() & {"keywords", "clauses"} or not node.keys() & {"must_keywords", "any_keywords"}:
        below = node.get("clauses")
        return str(node.get("op")).upper() == "AND", keyword_list(node.get("keywords")), below if isinstance(below, list) else []
    return True, [], [*([w] for w in keyword_list(node.get("must_keywords"))), keyword_list(node.get("any_keywords"))]


def compile_query(query: Any, strict: bool = False) -> list[Clause]:
    """The clauses of a query, outer ones first. A forgiving query may have clauses without any word; they say nothing."""
    read, out = _as_asked if strict else _as_meant, []
    waiting = deque([(query, -1, 0)])
    while waiting:
        node, around, depth = waiting.popleft()
        every, words, below = read(node, depth)
        waiting.extend((b, len(out), depth + 1) for b in below)
        out.append(Clause(around, depth, every, tuple(words)))
    return out


def flat_query(words: list[str], every: bool) -> list[Clause]:
    return [Clause(-1, 0, every, tuple(words))]


def matches(clauses: list[Clause], corpus, mode: str = "lower") -> Column:
    """Predicate of a query; one without words keeps every row."""
    corpus, fold = as_col(corpus), FOLDS[mode]
    parts: dict[int, list[Column]] = {}
    for i in range(len(clauses) - 1, -1, -1):
        clause = clauses[i]
        held = [corpus.contains(fold(w)) for w in clause.words] + parts.get(i, [])
        if held:
            parts.setdefault(clause.around, []).insert(0, reduce(and_ if clause.every else or_, held))
    return parts.get(-1, [F.lit(True)])[0]


def contains_any(corpus, words: list[str], mode: str = "lower") -> Column:
    return matches(flat_query(words, False), corpus, mode) if words else F.lit(False)


def words_of(clauses: list[Clause]) -> list[str]:
    return [w for clause in clauses for w in clause.words]


def query_score(clauses: list[Clause], corpus, boosts=None) -> Column:
    """Points of every keyword found, less at greater depth, plus the boosts."""
    corpus = as_col(corpus)
    points = [(corpus.contains(w), max(8, 40 - 6 * clause.depth)) for clause in clauses for w in clause.words]
    points += [(contains_any(corpus, list(words)), n) for words, n in (DEFAULT_BOOSTS if boosts is None else boosts)]
    return reduce(lambda total, p: total + F.when(p[0], p[1]).otherwise(0), points, F.lit(0))


def search_tokens(text: str, compat: bool = False) -> tuple[list[str], str]:
    """Tokens and mode of a search box query.

    ``|``, ``/`` or the word ``or`` mean OR. ``compat`` also splits at ``or`` inside words.
    """
    text = FOLDS["lower"](text or "")
    mode, _, separator = next(rule for rule in (COMPAT_RULES if compat else SEARCH_RULES) if re.search(rule[1], text))
    return (list(filter(None, map(str.strip, re.split(separator, text)))), mode) if text else ([], "RECENT")
