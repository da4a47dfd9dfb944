"""All registered queries of the core library with their SQL."""

from __future__ import annotations

from . import annotation, matrices, models, prepare, problems, roundtrip

MODULES = (problems, annotation, prepare, matrices, models, roundtrip)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
