"""Data-quality profiling and reviewable cleaning of messy tables on Spark."""

from tablewash.plans.dataset import Dataset
from tablewash.plans.recipe import Proposal, Recipe

__all__ = ["Dataset", "Proposal", "Recipe"]
