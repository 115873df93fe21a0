"""Cutting lineage with tables in the folder that all executors share, and freeing them again."""

from __future__ import annotations

from ..scratch import fresh_names, materialize, new_path, release, remove, shared_dir

__all__ = ["fresh_names", "materialize", "new_path", "release", "remove", "shared_dir"]
