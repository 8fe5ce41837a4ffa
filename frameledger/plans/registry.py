"""Registered queries: each Spark plan beside the plain SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from frameledger.plans.inputs_sql import INPUT_SQL

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None, uses: str = ""):
    """Register `fn(spark, sf_dir)`; `sql` may read the input views named in `uses`."""
    def register(fn):
        name = fn.__name__
        assert name not in QUERIES, name
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            CHECKS[name] = with_inputs(sql, uses.split())
        return fn
    return register


def with_inputs(sql: str, uses: list[str]) -> str:
    """Prefix the input views a check needs as common table expressions, in dependency order."""
    ordered: list[str] = []

    def need(name):
        for dep in INPUT_SQL[name][0].split():
            need(dep)
        if name not in ordered:
            ordered.append(name)

    for u in uses:
        need(u)
    views = [f"{n} AS ({INPUT_SQL[n][1].strip()})" for n in ordered]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(views + [body[len("WITH RECURSIVE "):]])
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(views + [body[len("WITH "):]])
    return ("WITH " + ",\n".join(views) + "\n" if views else "") + body
