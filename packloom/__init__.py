"""packloom: contrastive training-data preparation and embedding evaluation as Spark jobs."""

from packloom.config import PackConfig, resolve_eos

__all__ = ["PackConfig", "resolve_eos"]
