"""All registered queries of the library, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from sheaf.plans import answering, overviews, parsing, retrieval

_PLANS = (retrieval, answering, overviews, parsing)
QUERIES: dict[str, Callable] = {name: run for plan in _PLANS for name, run in plan.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLE.items()}
FLAGSHIP = "rrf_fusion"
