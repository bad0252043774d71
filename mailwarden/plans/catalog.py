"""All registered queries."""
from mailwarden.plans import clusters, corpus, evaluation  # noqa: F401
from mailwarden.plans.registry import QUERIES, SQL  # noqa: F401
