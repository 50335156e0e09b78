"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import extra, hosting, lake, rules, search, wider  # noqa: F401  they register their queries
from .plans.registry import QUERIES, SQL  # noqa: F401
