"""Every registered query and its SQL twin, by name."""

from __future__ import annotations

from importlib import import_module

#: Modules that hold ``QUERIES`` (name -> (spark, sf_dir) -> DataFrame) and ``ORACLE`` (name -> SQL).
MODULES: tuple[str, ...] = ("operators.timeline", "operators.htmltree", "operators.fidelity", "operators.resources", "operators.styles", "operators.shadow", "operators.matching", "operators.mapping", "operators.rewrite", "operators.export", "operators.subtree_choice", "operators.report", "operators.cascade", "operators.sheetlist", "operators.raw_events", "operators.fallback", "operators.projections", "operators.subtrees", "operators.capsule", "operators.fallback_export", "plans.capture")


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"vitrail.{name}"), attribute))
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
