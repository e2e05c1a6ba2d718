"""Connected components, as the library's core has them."""

from urbanloom.core.graph import components

__all__ = ["components"]
