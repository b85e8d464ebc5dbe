"""Every registered query of the core library, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ("scalar", "coarse", "support", "assembly", "evaluation")


def _parts():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: v for m in _parts() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _parts() for k, v in m.ORACLE.items()}
