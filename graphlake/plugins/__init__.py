"""The official plugins."""

from graphlake.plugins.rules import rules
from graphlake.plugins.soft_delete import soft_delete
from graphlake.plugins.timestamps import timestamps
from graphlake.plugins.validation import validation

__all__ = ["rules", "soft_delete", "timestamps", "validation"]
