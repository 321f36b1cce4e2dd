"""What a caller may put in place of the engine's own parts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from .functions.hashing import embed, hash_embedding


@dataclass(frozen=True)
class Embedder:
    """A model of embeddings: its name (the embedding cache is keyed by it), its dimension, a column
    function from text to vector for tables, and a function of one string for queries."""

    name: str
    dim: int
    column: Callable[[Column], Column]
    one: Callable[[str], list[float]]


#: The embedder that needs no model.
HASH = Embedder("hash", 64, hash_embedding(64), lambda text: embed(text, 64))
