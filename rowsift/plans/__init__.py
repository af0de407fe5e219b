"""End-to-end jobs built from the operators."""

from .analyze import Review, analyze
from .runs import Run

__all__ = ["Review", "Run", "analyze"]
