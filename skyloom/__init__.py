"""Skyloom: a PySpark-native engine for star catalogues, guide-star groups and sky maps."""

from .contracts import LoadRequest, SearchConfig
from .operators.scoring import BatchScorer, HeuristicScorer
from .plans.build import compare, create_pass, inspect, resume, run
from .sources.stars import load, read_stars, write_stars

__all__ = ["BatchScorer", "HeuristicScorer", "LoadRequest", "SearchConfig", "compare", "create_pass", "inspect", "load", "read_stars", "resume", "run", "write_stars"]
