"""Basic graph patterns: what matches them, triples made of matches, and updates of a graph by pattern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subject, predicate and object: terms as they stand in the table, or variables, which begin with a question mark.
Pattern = tuple[str, str, str]


def is_variable(term: str) -> bool:
    return term.startswith("?")


def _solutions(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """A column for each variable of the pattern, named without its question mark."""
    conditions: list[Column] = []
    places: dict[str, Column] = {}
    for place, term in zip("spo", pattern):
        if not is_variable(term):
            conditions.append(F.col(place) == term)
        elif term[1:] in places:
            conditions.append(F.col(place) == places[term[1:]])
        else:
            places[term[1:]] = F.col(place)
    found = reduce(DataFrame.filter, conditions, triples)
    return found.select(*[column.alias(name) for name, column in places.items()])


def match(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """The solutions of all patterns together: one column for each variable, one row for each way to fill them.

    Triples of a graph are a set, so repeated rows count once. Patterns are joined on the variables they share, each with
    those before it; patterns that hang together by no variable would multiply all their solutions and are refused.
    """
    graph = triples.select("s", "p", "o").distinct()
    left, bound, result = list(patterns), set(), None
    while left:
        connected = [p for p in left if result is None or bound & set(p)]
        if not connected:
            raise ValueError(f"no variable joins {left} with the other patterns")
        chosen = min(connected, key=lambda p: sum(map(is_variable, p)))
        left.remove(chosen)
        found = _solutions(graph, chosen)
        variables = {t for t in chosen if is_variable(t)}
        result = found if result is None else result.join(found, sorted(t[1:] for t in variables & bound))
        bound |= variables
    if result is None:
        raise ValueError("there is no pattern")
    return result


def construct(solutions: DataFrame, templates: list[Pattern]) -> DataFrame:
    """The distinct triples that the templates give with each solution; a template with an unbound variable gives none."""
    filled = lambda term: F.col(term[1:]) if is_variable(term) else F.lit(term)
    known = [t for t in templates if all(not is_variable(x) or x[1:] in solutions.columns for x in t)]
    made = F.array(*[F.struct(*[filled(x).alias(c) for x, c in zip(t, "spo")]) for t in known]) if known else F.array().cast("array<struct<s:string,p:string,o:string>>")
    rows = solutions.select(F.explode(made).alias("t")).select("t.s", "t.p", "t.o")
    return rows.dropna().distinct()
