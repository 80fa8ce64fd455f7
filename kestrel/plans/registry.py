"""Registry of named queries and their DuckDB oracle SQL.

Each query is a callable ``(spark, sf_dir) -> DataFrame``; the oracle is SQL
over the driver's tables, with the stand-in views inlined as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from kestrel.sources.fixtures import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def expand_rnd(sql: str) -> str:
    """Expand ``RND(expr, d)`` into the engine-independent rounding form.

    Mirrors :func:`kestrel.functions.scalar.rnd`, so the oracle rounds with
    the same IEEE operations as the Spark side.
    """
    out, i = [], 0
    while True:
        j = sql.find("RND(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k, comma = 1, j + 4, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        expr = expand_rnd(sql[j + 4:comma])
        d = int(sql[comma + 1:k - 1])
        out.append(f"(round_even(({expr}) * 1e{d}, 0) / 1e{d})")
        i = k


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = expand_rnd(with_views(oracle, *views))
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from kestrel.plans import (  # noqa: F401
        q_capacity,
        q_clean,
        q_relational,
        q_select,
        q_wrapper,
        q_models,
        q_trees,
        q_mrmr,
        q_forecast,
    )
