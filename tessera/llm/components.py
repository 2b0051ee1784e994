"""The library's connected components."""

from tessera.operators.components import components

__all__ = ["components"]
