"""All registered queries and their SQL twins."""

from __future__ import annotations

from vigilframe.plans import features, models, reports

QUERIES: dict = {**features.QUERIES, **reports.QUERIES, **models.QUERIES}
ORACLES: dict = {**features.ORACLES, **reports.ORACLES, **models.ORACLES}
