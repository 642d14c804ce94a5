"""Reproducible resampling draws.

Draws are pure integer arithmetic on (replicate, position), so they do not depend on partitioning, retries or
engine. Each round squares modulo a prime: a purely linear rule would make the draws of one replicate an arithmetic
progression and distort the spread.
"""

from __future__ import annotations

from pyspark.sql import Column

PRIME = 2147483647
ROUNDS = 3


def draw(replicate: Column, position: Column, seed: int, size: Column) -> Column:
    """Index in [0, size) for one draw of one replicate."""
    z = (replicate.cast("bigint") * 1000003 + position.cast("bigint") * 7919 + seed) % PRIME
    for _ in range(ROUNDS):
        z = (z * (z + 48271) + 12345) % PRIME
    return z % size


def draw_sql(replicate: str, position: str, seed: int, size: str) -> str:
    """The same draw as SQL text."""
    z = f"(({replicate})::BIGINT * 1000003 + ({position})::BIGINT * 7919 + {seed}) % {PRIME}"
    for _ in range(ROUNDS):
        z = f"(({z}) * (({z}) + 48271) + 12345) % {PRIME}"
    return f"(({z}) % ({size}))"
