from . import conform, models, tables

__all__ = ["conform", "models", "tables"]
