"""Registered queries over the driver's tables, and their SQL."""

from tidemill.plans import calendar, markets, screens, stores, streams, studies, summaries, zones  # noqa: F401
from tidemill.plans.registry import ORACLES, QUERIES  # noqa: F401
