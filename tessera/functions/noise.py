"""Perlin and simplex noise as Arrow-batched functions over the classic permutation of 0..255.

Lattice indices are truncated towards 0, so negative coordinates differ from a floor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSIC = bytes.fromhex(
    "97a0895b5a0f830dc95f6035c2e907e18c24671e458e086325f0150a17be0694f778ea4b001ac53e5efcdbcb75230b2039b12158ed953857ae147d88aba844af"
    "4aa547868b301ba64d929ee7536fe57a3cd385e6dc695c29372ef528f4668f3641193fa101d85049d14c84bbd05912a9c8c4878274bc9f56a4646dc6adba0340"
    "34d9e2fa7c7b05ca2693767eff5255d4cfce3be32f103a11b6bd1c2adfb7aad577f898022c9aa346dd99659ba72bac09811627fd13626c6e4f71e0e8b2b97068"
    "daf661e4fb22f2c1eed2900cbfb3a2f1513391ebf90eef6b31c0d61fb5c76a9db854ccb07379322d7f0496fe8aeccd5dde72431d1848f38d80c34e42d73d9cb4"
)


def permutation(seed: int | None = None) -> np.ndarray:
    """512 entries: the classic table, or one shuffled by a seed, twice."""
    p = np.frombuffer(CLASSIC, np.uint8).astype(np.int64)
    if seed is not None:
        p = np.random.default_rng(seed).permutation(p)
    return np.concatenate([p, p])


#: Gradient of each low nibble: weights of x, y and z.
_GRAD2 = np.array([(1, 1), (-1, 1), (1, -1), (-1, -1), (1, 0), (-1, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (0, 1), (0, -1), (1, 1), (0, -1), (-1, 1), (0, -1)])
_GRAD3 = np.array([(1, 1, 0), (-1, 1, 0), (1, -1, 0), (-1, -1, 0), (1, 0, 1), (-1, 0, 1), (1, 0, -1), (-1, 0, -1), (0, 1, 1), (0, -1, 1), (0, 1, -1), (0, -1, -1), (1, 1, 0), (0, -1, 1), (-1, 1, 0), (0, -1, -1)])


def perlin(p: np.ndarray, *xs: np.ndarray) -> np.ndarray:
    """Gradient noise of 2 or 3 coordinates: corner gradients, blended along one axis after the other."""
    grads = _GRAD2 if len(xs) == 2 else _GRAD3
    cell = [np.trunc(x).astype(np.int64) for x in xs]
    frac = [x - c for x, c in zip(xs, cell)]
    fade = [f * f * f * (f * (f * 6 - 15) + 10) for f in frac]

    def corner(at: tuple[int, ...]) -> np.ndarray:
        h = np.zeros(len(xs[0]), np.int64)
        for c, d in zip(cell, at):
            h = p[h + (c & 255) + d]
        g = grads[h & 15]
        return sum(g[:, k] * (f - d) for k, (f, d) in enumerate(zip(frac, at)))

    def blend(at: tuple[int, ...]) -> np.ndarray:
        axis = len(xs) - len(at) - 1
        if axis < 0:
            return corner(at)
        a, b = blend((0, *at)), blend((1, *at))
        return a + fade[axis] * (b - a)

    return blend(())


def _hash(p: np.ndarray, cells) -> np.ndarray:
    h = np.zeros(len(cells[0]), np.int64)
    for c in reversed(cells):
        h = p[c + h]
    return h


def simplex(p: np.ndarray, *xs: np.ndarray) -> np.ndarray:
    """Simplex noise of 2 or 3 coordinates: the contributions of the 3 or 4 corners of the simplex."""
    n = len(xs)
    skew, back, reach = ((np.sqrt(3) - 1) / 2, (3 - np.sqrt(3)) / 6, 0.5) if n == 2 else (1 / 3, 1 / 6, 0.6)
    s = sum(xs) * skew
    cell = [np.trunc(x + s).astype(np.int64) for x in xs]
    t = sum(cell) * back
    first = np.stack([x - (c - t) for x, c in zip(xs, cell)])
    if n == 2:
        lead = (first[0] > first[1]).astype(np.int64)
        steps = [np.stack([lead, 1 - lead])]
    else:
        x, y, z = first
        xy, yz, xz = x >= y, y >= z, x >= z
        top = np.where(xy, np.where(yz | xz, 0, 2), np.where(~yz, 2, 1))
        low = np.where(xy, np.where(yz, 2, 1), np.where(yz & xz, 2, 0))
        axis = np.arange(3)[:, None]
        steps = [(axis == top).astype(np.int64), (axis != low).astype(np.int64)]
    corners = [np.zeros_like(steps[0]), *steps, np.ones_like(steps[0])]
    total = 0.0
    for k, d in enumerate(corners):
        v = first - d + k * back
        w = np.maximum(reach - (v * v).sum(0), 0) ** 4
        h = _hash(p, [(c & 255) + e for c, e in zip(cell, d)])
        if n == 2:
            h &= 7
            u, o = np.where(h < 4, v[0], v[1]), 2 * np.where(h < 4, v[1], v[0])
        else:
            h &= 15
            u, o = np.where(h < 8, v[0], v[1]), np.where(h < 4, v[1], np.where((h == 12) | (h == 14), v[0], v[2]))
        total = total + w * (np.where(h & 1, -u, u) + np.where(h & 2, -o, o))
    return total * (40 if n == 2 else 32)


def _column(kind, xs: tuple[Column, ...], seed: int | None) -> Column:
    p = permutation(seed)
    if len(xs) == 2:

        @F.pandas_udf("double")
        def two(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(kind(p, x.to_numpy(float), y.to_numpy(float)))

        return two(*xs)

    @F.pandas_udf("double")
    def three(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(kind(p, x.to_numpy(float), y.to_numpy(float), z.to_numpy(float)))

    return three(*xs)


def perlin2d(x: Column, y: Column, seed: int | None = None) -> Column:
    return _column(perlin, (x, y), seed)


def perlin3d(x: Column, y: Column, z: Column, seed: int | None = None) -> Column:
    return _column(perlin, (x, y, z), seed)


def simplex2d(x: Column, y: Column, seed: int | None = None) -> Column:
    return _column(simplex, (x, y), seed)


def simplex3d(x: Column, y: Column, z: Column, seed: int | None = None) -> Column:
    return _column(simplex, (x, y, z), seed)
