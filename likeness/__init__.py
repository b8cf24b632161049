"""How good is a synthetic table?  Fidelity, distance and novelty as Spark DataFrame operators."""

from likeness.api import compute_upsilon, generate_syndata

__all__ = ["compute_upsilon", "generate_syndata"]
