"""All registered queries."""

from quaero.plans import (  # noqa: F401
    conversations,
    corpus,
    dense_search,
    lexical_search,
    questions,
    relational_queries,
    routes,
    runs,
    streams,
)
from quaero.plans.registry import BUILDERS, TWINS

__all__ = ["BUILDERS", "TWINS"]
