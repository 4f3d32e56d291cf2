"""All registered queries: each module of plans adds its own to the catalog."""

from quillon.plans import answering, core, corpus, parsing, stored, streams  # noqa: F401
from quillon.plans.catalog import ORACLES, QUERIES  # noqa: F401
