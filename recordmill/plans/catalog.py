"""All registered queries; importing this module fills the registry."""

import importlib

from recordmill.plans.registry import ORACLE, QUERIES

SECTIONS = ["ingest", "cleaning", "joining", "timelines", "scores", "splitting", "resampling", "calibration", "validation", "embedding", "fits", "grouping", "streams"]

for _section in SECTIONS:
    importlib.import_module(f"recordmill.plans.{_section}")

__all__ = ["ORACLE", "QUERIES"]
