"""Every registered query with its SQL twin."""

from crestline.registry import ingest, planning, posts, report, streams, tags, upkeep  # noqa: F401
from crestline.registry.base import COVERS, QUERIES, SQL

__all__ = ["COVERS", "QUERIES", "SQL"]
