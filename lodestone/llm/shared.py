"""Shared folders and tables, for these operators."""

from __future__ import annotations

from lodestone.plans.durable import new_path, removed, shared_folder, written

__all__ = ["new_path", "removed", "shared_folder", "written"]
