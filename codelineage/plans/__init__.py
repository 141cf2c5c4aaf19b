"""Query registries: every operator bound to the supplied tables."""

from __future__ import annotations

from importlib import import_module

AREAS = ("provenance", "evaluation", "files", "code", "survey", "topics")


def registries():
    return [import_module(f"codelineage.plans.{area}").R for area in AREAS]
