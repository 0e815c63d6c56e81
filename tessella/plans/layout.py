"""Teams of ranks and the blocking of matrices over grids of processors: pure arithmetic."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, isqrt, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Team:
    """Some ranks of the world, sorted and distinct; a member's number is its place."""

    members: tuple[int, ...]

    @classmethod
    def of(cls, members) -> Team:
        return cls(tuple(sorted(set(members))))

    @classmethod
    def world(cls, ranks: int) -> Team:
        return cls(tuple(range(ranks)))

    def __len__(self) -> int:
        return len(self.members)

    def __contains__(self, rank: int) -> bool:
        return rank in self.members

    def resolve(self, rank: int) -> int:
        return self.members.index(rank)

    def to_world(self, number: int) -> int:
        return self.members[number]


def split_world(ranks: int, parts: int) -> list[Team]:
    """Consecutive teams of ceil(ranks / parts)."""
    size = ceil(ranks / parts)
    return [Team.of(range(a, min(a + size, ranks))) for a in range(0, ranks, size)]


def factor(n: int) -> tuple[int, int]:
    """The two factors of n nearest to its square root, the greater first."""
    q = next(q for q in range(isqrt(n), 0, -1) if n % q == 0)
    return n // q, q


@dataclass(frozen=True)
class Blocking:
    """A processor grid and tile shape; a tile dimension of 0 is the matrix over the grid."""

    grid: tuple[int, int]
    tile: tuple[int, int] = (0, 0)

    @classmethod
    def square(cls, ranks: int) -> Blocking:
        return cls((isqrt(ranks), isqrt(ranks)))

    @classmethod
    def row(cls, ranks: int) -> Blocking:
        return cls((ranks, 1))

    @classmethod
    def column(cls, ranks: int) -> Blocking:
        return cls((1, ranks))

    @classmethod
    def rect(cls, ranks: int) -> Blocking:
        return cls(factor(ranks))

    @classmethod
    def custom(cls, grid: tuple[int, int], tile: tuple[int, int]) -> Blocking:
        return cls(grid, tile)

    @classmethod
    def fitted(cls, m: int, n: int, ranks: int, least: int = 1024, pieces: int = 8) -> Blocking:
        """A grid with the aspect ratio of the matrix. Where it has few columns, tiles are split
        along the columns, into at most ``pieces`` (or the grid's columns) of at least ``least``."""
        p, q = max(1, int(sqrt(m * ranks / n))), max(1, int(sqrt(n * ranks / m)))
        if p * q != ranks:
            lesser = max(d for d in range(1, min(p, q, ranks) + 1) if ranks % d == 0)
            p, q = (lesser, ranks // lesser) if p <= q else (ranks // lesser, lesser)
        parts = q if q >= pieces else next((k for k in range(pieces, q, -1) if ceil(n / k) >= least), q)
        return cls((p, q), (ceil(m / p), ceil(n / parts)))

    def tile_shape(self, m: int, n: int) -> tuple[int, int]:
        return self.tile[0] or ceil(m / self.grid[0]), self.tile[1] or ceil(n / self.grid[1])

    def tile_grid(self, m: int, n: int) -> tuple[int, int]:
        tm, tn = self.tile_shape(m, n)
        return ceil(m / tm), ceil(n / tn)

    def owner(self, ti: int, tj: int) -> int:
        return tj % self.grid[1] + ti % self.grid[0] * self.grid[1]

    def columns(self, m: int, n: int) -> dict[str, Column]:
        """Derived columns ti, tj and rank for rows with i and j."""
        tm, tn = self.tile_shape(m, n)
        ti, tj = F.expr(f"i div {tm}"), F.expr(f"j div {tn}")
        return {"ti": ti, "tj": tj, "rank": tj % self.grid[1] + ti % self.grid[0] * self.grid[1]}


def block_matmul(m: int, n: int, k: int, ranks: int) -> tuple[Blocking, Blocking, Blocking]:
    """Blockings for A (m by k), B (k by n) and C (m by n)."""
    p, q = factor(ranks)
    inner = ceil(ranks / p) if m * k >= k * n else ceil(ranks / q)
    return Blocking((p, inner)), Blocking((inner, q)), Blocking((p, q))


def same_layout(a: Blocking, b: Blocking, shape_a: tuple[int, int], shape_b: tuple[int, int]) -> bool:
    return a.grid == b.grid and a.tile_shape(*shape_a) == b.tile_shape(*shape_b) and a.tile_grid(*shape_a) == b.tile_grid(*shape_b)
