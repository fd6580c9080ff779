"""All registered queries: importing this module fills the registry."""

from __future__ import annotations

import importlib

from trenchline.plans.registry import CHECKS, QUERIES

AREAS = ("text", "sources", "geometry", "quality", "matching", "gates", "ownership",
         "corridors", "outputs", "placed", "network", "walks")

for _area in AREAS:
    importlib.import_module(f"trenchline.plans.queries_{_area}")

__all__ = ["QUERIES", "CHECKS"]
