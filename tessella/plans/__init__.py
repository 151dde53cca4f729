"""Query plans: registered queries over the test tables, and the session builder."""

from . import engine, evaluation, graphs, requests, search, services, texts  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
