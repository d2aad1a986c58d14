from . import joins, quantiles, regress, series

__all__ = ["joins", "quantiles", "regress", "series"]
