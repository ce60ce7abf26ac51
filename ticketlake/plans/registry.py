"""All registered queries of the library."""

from ticketlake.plans import io_queries  # noqa: F401  (registers its queries)
from ticketlake.plans.queries import QUERIES

__all__ = ["QUERIES"]
