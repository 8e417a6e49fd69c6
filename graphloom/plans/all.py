"""All queries of this library."""

from . import contract_queries, graph_queries, join_queries, language_queries, metric_queries, packing_queries, scalar_queries  # noqa: F401
from .catalog import QUERIES, SQL  # noqa: F401
