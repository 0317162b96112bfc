"""Queries of the core operators over the test tables, and the SQL that says the same."""

from __future__ import annotations

import importlib

MODULES = ("texts", "retrieval", "evaluation", "audits", "events")


def _modules():
    return [importlib.import_module(f"corvane.queries.{m}") for m in MODULES]


def queries() -> dict:
    out = {}
    for m in _modules():
        out |= {k: f for k, f in vars(m).items() if callable(f) and getattr(f, "__module__", "") == m.__name__ and k.split("_")[0] in PREFIXES}
    return out


#: First parts of query names.
PREFIXES = {"txt", "ext", "src", "snk", "chk", "emb", "vec", "bm25", "fus", "qg", "prj", "qr", "met", "st", "hx", "sg", "sc", "en", "vis", "cal", "eq", "ag", "rel", "qt", "ev"}


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in _modules():
        out |= m.sql()
    return out
