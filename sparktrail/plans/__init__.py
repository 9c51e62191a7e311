"""The registered queries: importing this fills registry.QUERIES and registry.ORACLE."""

from . import answers, generated, inference, logs, programs, recovery, replays, reports, studies, texts  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
