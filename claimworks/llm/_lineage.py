"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

from claimworks.operators.lineage import kept as cut
from claimworks.operators.lineage import shared_folder

__all__ = ["cut", "shared_folder"]
