"""The library's tables in the shared folder."""

from tessera.sources.store import discard, fresh_path, shared_dir, written

__all__ = ["discard", "fresh_path", "shared_dir", "written"]
