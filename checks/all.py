"""All registered queries."""

from checks import catalog, chat, contexts, routing, sampling, scoring, tasks  # noqa: F401, I001
from checks import flows  # noqa: F401  (its SQL is made of the others)
from checks.base import ORACLES, QUERIES  # noqa: F401
