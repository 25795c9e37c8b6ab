"""All checking statements; importing the modules registers them."""

from . import activity, advice, charts, checks, compliance, exchange, facts  # noqa: F401
from . import history, policy, reports  # noqa: F401
from .common import ORACLE  # noqa: F401
