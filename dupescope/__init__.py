"""dupescope: exact-duplicate analytics on Spark."""

from .schema import EngineConfig

__all__ = ["EngineConfig"]
__version__ = "0.1.0"
