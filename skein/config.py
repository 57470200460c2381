"""Validated parameters of the three encodings."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Breakpoints that part the standard normal curve into 3 to 10 areas of equal size, to two decimals.
BREAKPOINTS = {
    3: [-0.43, 0.43],
    4: [-0.67, 0.0, 0.67],
    5: [-0.84, -0.25, 0.25, 0.84],
    6: [-0.97, -0.43, 0.0, 0.43, 0.97],
    7: [-1.07, -0.57, -0.18, 0.18, 0.57, 1.07],
    8: [-1.15, -0.67, -0.32, 0.0, 0.32, 0.67, 1.15],
    9: [-1.22, -0.76, -0.43, -0.14, 0.14, 0.43, 0.76, 1.22],
    10: [-1.28, -0.84, -0.52, -0.25, 0.0, 0.25, 0.52, 0.84, 1.28],
}


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _offsets_fit(offsets: list[int], code_len: int, length: int) -> None:
    _need(1 <= code_len <= 18, "a code holds 1 to 18 digits")
    _need(len(set(offsets)) == len(offsets) > 0, "offsets must be distinct")
    _need(min(offsets) >= 0 and max(offsets) + code_len <= length, "an offset leaves the encoding")


@dataclass(frozen=True)
class ClipConfig:
    """Binary clipping: 1 where a value reaches the threshold; growth rewards long runs of agreement."""

    elements: int
    threshold: float
    offsets: list[int] = field(default_factory=list)
    code_len: int = 8
    growth: float = 0.1

    def __post_init__(self):
        _need(self.growth >= 0, "growth must not be negative")
        _offsets_fit(self.offsets, self.code_len, self.elements)


@dataclass(frozen=True)
class SaxConfig:
    """Symbols over the means of segments of standardized values."""

    elements: int
    mean: float
    sd: float
    segment: int
    alphabet: int
    offsets: list[int] = field(default_factory=list)
    code_len: int = 3
    exact_ratio: bool = False

    def __post_init__(self):
        _need(self.segment >= 1 and self.elements >= self.segment, "a segment holds 1 to `elements` values")
        _need(self.alphabet in BREAKPOINTS, "the alphabet has 3 to 10 symbols")
        _need(self.sd > 0, "sd must be positive")
        _offsets_fit(self.offsets, self.code_len, self.words)

    @property
    def words(self) -> int:
        return self.elements // self.segment

    @property
    def breakpoints(self) -> list[float]:
        return BREAKPOINTS[self.alphabet]


@dataclass(frozen=True)
class ShingleConfig:
    """Sign bits of a sliding projection, counted as shingles and hashed by weighted consistent draws."""

    elements: int
    projection: list[float]
    stride: int
    shingle_bits: int
    shingle_stride: int
    draws: list[list[float]]  # one list of draws in [0, 2**shingle_bits) per table

    def __post_init__(self):
        _need(self.stride >= 1 and self.shingle_stride >= 1, "strides are 1 or more")
        _need(1 <= self.shingle_bits <= 12, "shingles have 1 to 12 bits")
        _need(len(self.projection) <= self.elements, "the projection is longer than the window")
        _need(self.bits >= self.shingle_bits, "fewer sketch bits than a shingle has")
        _need(all(0 <= x < self.kinds for row in self.draws for x in row) and len(self.draws) > 0, "draws lie in [0, 2**shingle_bits)")

    @property
    def bits(self) -> int:
        return (self.elements - len(self.projection)) // self.stride + 1

    @property
    def shingles(self) -> int:
        return (self.bits - self.shingle_bits) // self.shingle_stride + 1

    @property
    def kinds(self) -> int:
        return 2**self.shingle_bits
