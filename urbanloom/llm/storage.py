"""Scratch tables in the shared folder that the cluster names, as the library's core has them."""

from urbanloom.core.tables import scratch_path, shared_dir, stored

__all__ = ["scratch_path", "shared_dir", "stored"]
