"""Every registered query; importing the modules fills the registry."""

from __future__ import annotations

from keepsake.plans import crawl, habits, ingest, listing, relations, search, vectors  # noqa: F401
from keepsake.plans.registry import ORACLES, QUERIES  # noqa: F401
