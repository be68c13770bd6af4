"""NumPy kernels for images and volumes: components, running extremes, growth through a mask, distances, spline weights."""

from __future__ import annotations

import itertools

import numpy as np


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number in the component of each of n numbers, under the edges i - j."""
    parent = np.arange(n)
    while len(i):
        a, b = parent[i], parent[j]
        keep = a != b
        if not keep.any():
            break
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def sparse_components(places: np.ndarray, labels: np.ndarray, reach: int = 1) -> np.ndarray:
    """The first row (in order of places) of the region of each row. places: n x axes, distinct and in order; rows are neighbours if
    no coordinate differs by more than `reach`, and of one region if neighbours have one label."""
    n, axes = places.shape
    low = places.min(0) if n else np.zeros(axes, np.int64)
    size = (places.max(0) - low if n else low) + 1 + 2 * reach
    step = np.r_[np.cumprod(size[::-1])[::-1][1:], 1].astype(np.int64)
    code = (places - low) @ step
    ends = []
    for d in itertools.product(range(-reach, reach + 1), repeat=axes):
        if d > (0,) * axes:
            at = np.searchsorted(code, code + np.array(d) @ step)
            i = np.flatnonzero((code[np.minimum(at, n - 1)] == code + np.array(d) @ step) & (at < n))
            same = labels[i] == labels[at[i]]
            ends.append((i[same], at[i][same]))
    i, j = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
    return joined(n, i, j)


def running(a: np.ndarray, half: int, axis: int, low: bool) -> np.ndarray:
    """Minimum (or maximum) over [i - half, i + half] along an axis; places outside do not count. Running extremes of blocks of one
    window from both ends meet in every window, so the cost does not depend on `half`."""
    if half == 0:
        return a
    best, fill = (np.minimum, np.inf) if low else (np.maximum, -np.inf)
    a = np.moveaxis(a, axis, -1)
    n, w = a.shape[-1], 2 * half + 1
    size = -(-(n + 2 * half) // w) * w
    padded = np.full((*a.shape[:-1], size), fill)
    padded[..., half : half + n] = a
    blocks = padded.reshape(*a.shape[:-1], -1, w)
    ahead = best.accumulate(blocks, -1).reshape(padded.shape)
    back = best.accumulate(blocks[..., ::-1], -1)[..., ::-1].reshape(padded.shape)
    return np.moveaxis(best(back[..., :n], ahead[..., w - 1 : w - 1 + n]), -1, axis)


def disk_extreme(image: np.ndarray, radius: int, low: bool) -> np.ndarray:
    """Minimum (or maximum) over a disk: a running extreme along x for each length of a chord, moved to each of its rows."""
    best, fill = (np.minimum, np.inf) if low else (np.maximum, -np.inf)
    out = np.full(image.shape, fill)
    chords: dict[int, list[int]] = {}
    for dy in range(-radius, radius + 1):
        chords.setdefault(int(np.sqrt(radius * radius - dy * dy)), []).append(dy)
    for half, rows in chords.items():
        line = running(image, half, 1, low)
        for dy in rows:
            if abs(dy) < len(image):
                to, of = (slice(0, len(image) - dy), slice(dy, None)) if dy >= 0 else (slice(-dy, None), slice(0, len(image) + dy))
                out[to] = best(out[to], line[of])
    return out


def moved(a: np.ndarray, by: int, axis: int, fill) -> np.ndarray:
    """out[i] = a[i + by] along an axis, `fill` outside."""
    out = np.full(a.shape, fill, a.dtype)
    n = a.shape[axis]
    if abs(by) < n:
        to, of = (slice(0, n - by), slice(by, None)) if by >= 0 else (slice(-by, None), slice(0, n + by))
        cut = lambda s: tuple(s if k == axis else slice(None) for k in range(a.ndim))
        out[cut(to)] = a[cut(of)]
    return out


#: Distance and label of a place in one number; NOTHING is farther than any.
SHIFT, NOTHING = 40, np.int64(1) << 62


def grown(key: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Distances and labels (distance << SHIFT | label) after growth through the mask: each place takes the least of its neighbours',
    one step farther, until nothing changes. Places outside the mask keep what they have and pass it on."""
    while True:
        near = key
        for axis in range(key.ndim):
            near = np.minimum(near, np.minimum(moved(near, 1, axis, NOTHING), moved(near, -1, axis, NOTHING)))
        new = np.where(mask & (near < NOTHING), np.minimum(key, near + (np.int64(1) << SHIFT)), key)
        if (new == key).all():
            return key
        key = new


def expanded(labels: np.ndarray, radius: float) -> np.ndarray:
    """Labels (0: none) grown to places whose nearest labelled place is within `radius` (Euclidean); the smaller label of equally near
    ones. Squared distances add up axis by axis, so the least of (distance, label) is found an axis at a time."""
    reach = int(radius)
    key = np.where(labels > 0, labels.astype(np.int64), NOTHING)
    for axis in range(labels.ndim):
        best = key
        for d in range(-reach, reach + 1):
            if d:
                other = moved(key, d, axis, NOTHING)
                best = np.minimum(best, np.where(other < NOTHING, other + (np.int64(d * d) << SHIFT), NOTHING))
        key = best
    far, label = key >> SHIFT, key & ((np.int64(1) << SHIFT) - 1)
    return np.where((key < NOTHING) & (far <= radius * radius), label, 0)


def spline_coefficients(a: np.ndarray, axis: int) -> np.ndarray:
    """Coefficients of the interpolating cubic B-spline along an axis, with mirrored ends: a recursion there and one back."""
    a = np.moveaxis(np.asarray(a, float), axis, 0)
    n = len(a)
    if n == 1:
        return np.moveaxis(a, 0, axis)
    z = np.sqrt(3.0) - 2
    period = 2 * n - 2
    powers = z ** np.arange(period)
    mirrored = np.concatenate([a, a[-2:0:-1]]) if n > 2 else a
    c = np.empty_like(a)
    c[0] = np.tensordot(powers[: len(mirrored)], mirrored, 1) / (1 - z**period)
    for k in range(1, n):
        c[k] = a[k] + z * c[k - 1]
    c[-1] = z / (z * z - 1) * (c[-1] + z * c[-2])
    for k in range(n - 2, -1, -1):
        c[k] = z * (c[k + 1] - c[k])
    return np.moveaxis(6 * c, 0, axis)


def spline_weights(t: float) -> list[float]:
    """Weights of the four coefficients around a place: those at floor - 1, floor, floor + 1 and floor + 2, t the fraction."""
    return [(1 - t) ** 3 / 6, 2 / 3 - t * t * (2 - t) / 2, 2 / 3 - (1 - t) ** 2 * (1 + t) / 2, t**3 / 6]
