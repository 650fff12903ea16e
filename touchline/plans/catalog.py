"""All match queries and their SQL, from the modules that register them."""

from touchline.plans import flow_queries, join_queries, model_queries, player_queries, prematch_queries, report_queries, source_queries  # noqa: F401
from touchline.plans.queries import ORACLES, QUERIES  # noqa: F401
