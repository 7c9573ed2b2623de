"""All registered queries; importing a plan module registers what it defines."""

from __future__ import annotations

from fluxgauge.plans import jobs, observability, read_model, recovery, streams, tracing, write_path  # noqa: F401
from fluxgauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
