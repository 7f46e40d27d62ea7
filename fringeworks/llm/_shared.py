"""Folders and tables shared by the driver and the executors."""

from __future__ import annotations

from ..plans.tables import discard, new_folder, shared_folder, stored

__all__ = ["discard", "new_folder", "shared_folder", "stored"]
