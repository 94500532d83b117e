"""All registered queries outside the optional subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from lanternfish.plans import analytics, catalogue, timelines

QUERIES: dict = catalogue.QUERIES | analytics.QUERIES | timelines.QUERIES
ORACLES: dict[str, str] = catalogue.ORACLES | analytics.ORACLES | timelines.ORACLES
