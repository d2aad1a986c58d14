from . import classify, semantics

__all__ = ["classify", "semantics"]
