"""Every registered query of the engine, by name, and the SQL that equals it."""

from __future__ import annotations

from .catalog import boards, lifecycle, more, parts  # noqa: F401  (they register their queries)
from .catalog.queries import QUERIES, SQL, flagship

FLAGSHIP = flagship
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
