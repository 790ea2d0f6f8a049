"""The registry that every module of queries adds to."""

from __future__ import annotations

from sightline.functions.names import ALIKE, EDIT, PAIRS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder of tables) under its own name, with the SQL that it must equal; a name is taken once."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are called {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def weighted_sql(a: str, b: str) -> str:
    """The weighted likeness, 0 to 100, of two strings that aren't empty in DuckDB's SQL: the table of edits as a fold of its rows, each a fold of its cells."""
    alike = " ".join([*PAIRS, *(p[::-1] for p in PAIRS)])
    cost = f"CASE WHEN ({a})[i[1]] = ({b})[j[1]] THEN 0 WHEN contains('{alike}', ({a})[i[1]] || ({b})[j[1]]) THEN {ALIKE} ELSE {EDIT} END"
    count = lambda x: f"list_transform(range(1, length({x}) + 1), lambda k: [k::INTEGER])"
    row = f"list_reduce({count(b)}, lambda row, j: list_append(row, least(row[j[1]] + {EDIT}, above[j[1] + 1] + {EDIT}, above[j[1]] + {cost})::INTEGER), [{EDIT} * i[1]])"
    distance = f"list_reduce({count(a)}, lambda above, i: {row}, list_transform(range(length({b}) + 1), lambda k: ({EDIT} * k)::INTEGER))[length({b}) + 1]"
    longest = f"(greatest(length({a}), length({b})) * {EDIT})"
    return f"CAST(greatest(0, 100 * ({longest} - {distance}) // {longest}) AS INTEGER)"
