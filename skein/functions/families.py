"""Seeded hash families; every family is a list of literals, so a run can be repeated exactly."""

from __future__ import annotations

import random


def offsets(n: int, elements: int, code_len: int, seed: int) -> list[int]:
    """n distinct start positions of codes, ascending."""
    room = elements - code_len + 1
    if n > room:
        raise ValueError(f"only {room} distinct offsets exist")
    return sorted(random.Random(seed).sample(range(room), n))


def projection(length: int, seed: int, dist: str = "uniform") -> list[float]:
    """A projection vector: uniform on [0, 1), or normal, which suits standardized values."""
    r = random.Random(f"projection {seed}")
    return [r.random() if dist == "uniform" else r.gauss(0, 1) for _ in range(length)]


def draws(tables: int, shingle_bits: int, seed: int, n_draws: int | None = None) -> list[list[float]]:
    """Uniform draws in [0, 2**shingle_bits) for each table; half as many as there are shingles unless stated."""
    r = random.Random(f"draws {seed}")
    kinds = 2**shingle_bits
    return [[r.random() * kinds for _ in range(n_draws or max(1, kinds // 2))] for _ in range(tables)]
