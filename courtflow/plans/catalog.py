"""All registered queries."""

from courtflow.plans import calibration, exchange, geometry, league, live, possession, quality, readings, service, shooting, tracking, zones  # noqa: F401
from courtflow.plans.registry import CHECKS, QUERIES  # noqa: F401
