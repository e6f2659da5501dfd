"""All registered queries."""

from caseledger.plans import intaking, linking, listing, merging, texts  # noqa: F401
from caseledger.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
