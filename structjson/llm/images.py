"""Copies of images by local descriptors.

Corners are found on a small pyramid, each is given the direction of its patch's
centroid and 128 binary tests in a pattern turned to it. Corners meet in Hamming
tables together with a neighbour: a slot holds the same 12 bits of both descriptors and
how the two lie to each other. Pairs of images that meet in a slot, with both corners
near in all bits, are matched corner by corner, and are copies when a similarity
transform explains enough of the matches, so crops, turns and edits still match.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, written

SCALES = (1.0, 0.7071, 0.5)
CORNERS = 24
RADIUS = 7
BITS = 128
#: Corners nearest to each with which it shares slots; bits of a slice; slices of a descriptor.
NEIGHBOURS, SLICE, SLICES = 6, 12, 8
#: Slices in which rows first meet only the first of their slot, which joins large groups.
STARS = 1
_rng = np.random.default_rng(7)
#: Two points of the patch for each test.
TESTS = np.clip(_rng.normal(0, RADIUS / 2, (BITS, 2, 2)), -RADIUS, RADIUS)
_YX = np.stack(np.meshgrid(np.arange(-RADIUS, RADIUS + 1), np.arange(-RADIUS, RADIUS + 1), indexing="ij"), -1).reshape(-1, 2)
_DISC = _YX[(_YX**2).sum(1) <= RADIUS**2]
FEATURES = "image_id long, places array<float>, bits binary, digest binary"
#: Half the images that a task compares, about.
BLOCK = 8192


def _blur(x: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        p = np.pad(x, ((0, 0), (1, 1), (0, 0)), mode="edge")
        x = (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4
        p = np.pad(x, ((0, 0), (0, 0), (1, 1)), mode="edge")
        x = (p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]) / 4
    return x


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    def weights(n: int) -> np.ndarray:
        m = max(1, int(n * scale))
        at = np.clip((np.arange(m) + 0.5) / scale - 0.5, 0, n - 1)
        low = np.minimum(np.floor(at).astype(int), n - 1)
        w = np.zeros((m, n), np.float32)
        w[np.arange(m), low] += 1 - (at - low)
        w[np.arange(m), np.minimum(low + 1, n - 1)] += at - low
        return w

    return np.einsum("ih,bhw,jw->bij", weights(x.shape[1]), x, weights(x.shape[2]), optimize=True)


def describe(images: np.ndarray, corners: int = CORNERS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the grey ``images`` (count, height, width): places ``(x, y, scale, angle)`` and 16-byte descriptors."""
    found: list[list] = [[] for _ in images]
    for scale in SCALES:
        x = _blur(images.astype(np.float32) if scale == 1 else _resize(images.astype(np.float32), scale))
        h, w = x.shape[1:]
        if min(h, w) < 2 * RADIUS + 3:
            continue
        gy, gx = np.gradient(x, axis=1), np.gradient(x, axis=2)
        a, b, c = _blur(gx * gx, 2), _blur(gy * gy, 2), _blur(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        edge = RADIUS + 1
        inner = r[:, edge:-edge, edge:-edge]
        peak = inner > 1e-3
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= inner >= r[:, edge + dy : h - edge + dy, edge + dx : w - edge + dx]
        img, ys, xs = np.nonzero(peak)
        strength = inner[img, ys, xs]
        ys, xs = ys + edge, xs + edge
        patch = x[img[:, None], ys[:, None] + _DISC[:, 0], xs[:, None] + _DISC[:, 1]]
        angle = np.arctan2((patch * _DISC[:, 0]).sum(1), (patch * _DISC[:, 1]).sum(1))
        cos, sin = np.cos(angle), np.sin(angle)
        ty, tx = TESTS[..., 0], TESTS[..., 1]
        py = np.clip(np.rint(ys[:, None, None] + sin[:, None, None] * tx + cos[:, None, None] * ty).astype(int), 0, h - 1)
        px = np.clip(np.rint(xs[:, None, None] + cos[:, None, None] * tx - sin[:, None, None] * ty).astype(int), 0, w - 1)
        v = x[img[:, None, None], py, px]
        bits = np.packbits(v[..., 0] < v[..., 1], axis=1)
        for k, at in enumerate(img):
            found[at].append((-strength[k], xs[k] / scale, ys[k] / scale, scale, angle[k], bits[k]))
    out = []
    most = int(corners * max(1.0, math.sqrt(images.shape[1] * images.shape[2]) / 64))  # larger images have more
    for f in found:
        f = sorted(f, key=lambda t: t[:4])[:most]
        out.append((np.array([t[1:5] for t in f], np.float32).reshape(-1, 4), np.array([t[5] for t in f], np.uint8).reshape(-1, BITS // 8)))
    return out


def consensus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], hamming: int = 20, pixels: float = 2.5) -> tuple[int, int]:
    """Matches of two images, and how many of them one similarity transform explains."""
    (pa_, da), (pb, db) = a, b
    if not len(pa_) or not len(pb):
        return 0, 0
    d = np.bitwise_count(da[:, None] ^ db[None]).sum(2)
    i = np.arange(len(da))
    j = d.argmin(1)
    good = (d[i, j] <= hamming) & (d.argmin(0)[j] == i)
    i, j = i[good], j[good]
    if len(i) < 2:
        return len(i), 0
    p = pa_[i, 0] + 1j * pa_[i, 1]
    q = pb[j, 0] + 1j * pb[j, 1]
    u, v = np.triu_indices(len(i), 1)
    far = np.abs(p[u] - p[v]) > 4
    u, v = u[far], v[far]
    if not len(u):
        return len(i), 0
    m = (q[u] - q[v]) / (p[u] - p[v])
    sane = (np.abs(m) > 0.3) & (np.abs(m) < 3.4)
    u, m = u[sane], m[sane]
    if not len(u):
        return len(i), 0
    off = q[u] - m * p[u]
    near = np.abs(m[:, None] * p[None] + off[:, None] - q[None]) <= pixels
    return len(i), int(near.sum(1).max())


def image_features(images: DataFrame, corners: int = CORNERS) -> DataFrame:
    """``image_id, places, bits, digest`` of every row of ``images(image_id, width, height, pixels)``; 8-bit grey pixels by rows.

    Null pixels, or other than width * height of them, give no descriptors and no digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, ws, hs, data = (part.column(k).to_pylist() for k in range(4))
                places, bits, digests = [[] for _ in ids], [b"" for _ in ids], [None for _ in ids]
                shapes: dict[tuple, list[int]] = {}
                for k, (w, h, x) in enumerate(zip(ws, hs, data)):
                    if x is not None and w and h and len(x) == w * h:
                        shapes.setdefault((h, w), []).append(k)
                        digests[k] = hashlib.blake2b(b"%d %d " % (w, h) + x, digest_size=16).digest()
                for shape, which in shapes.items():
                    stack = np.stack([np.frombuffer(data[k], np.uint8).reshape(shape) for k in which])
                    for k, (p, d) in zip(which, describe(stack, corners)):
                        places[k], bits[k] = p.ravel().tolist(), d.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(places, pa.list_(pa.float32())), pa.array(bits, pa.binary()), pa.array(digests, pa.binary())], ["image_id", "places", "bits", "digest"])

    return images.select(F.col("image_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "pixels").mapInArrow(run, FEATURES)


def _neighbours(places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all images: the image, a corner, a neighbour of it, and a number for how the two lie to each other; by image."""
    out: list[tuple] = []
    turn = lambda x: np.floor(x % (2 * np.pi) / (2 * np.pi) * 8).astype(np.int64) & 7
    width = max((len(x) for x in places), default=0)
    step = max(1, (1 << 20) // max(1, width) ** 2)
    for first in range(0, len(places) if width > 1 else 0, step):
        part = places[first : first + step]
        held = np.array([len(x) for x in part])
        at = np.zeros((len(part), width, 4), np.float32)
        here = np.arange(width) < held[:, None]
        at[here] = np.concatenate(part)
        p = at[..., 0] + 1j * at[..., 1]
        gap = np.abs(p[:, :, None] - p[:, None])
        gap[(gap < 4) | ~(here[:, :, None] & here[:, None])] = np.inf
        # Distances sort like their bits; of equal ones the first corner counts.
        near = np.sort(gap.view(np.uint32).astype(np.uint64) << np.uint64(32) | np.arange(width, dtype=np.uint64), 2)[:, :, :NEIGHBOURS]
        image, a, rank = np.nonzero((near >> np.uint64(32)).astype(np.uint32).view(np.float32) < np.inf)
        b = (near[image, a, rank] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        one, two = at[image, a], at[image, b]
        # Where the neighbour lies, seen from the corner's own direction, size and scale.
        lies = turn(np.angle(p[image, b] - p[image, a]) - one[:, 3]) * 8 + turn(two[:, 3] - one[:, 3])
        lies = lies * 16 + np.rint(2 * np.log2(two[:, 2] / one[:, 2])).astype(np.int64) + 4
        lies = lies * 64 + np.floor(2 * np.log2(gap[image, a, b] * one[:, 2] / 4)).astype(np.int64) + 8
        out.append(((image + first).astype(np.int32), a.astype(np.int16), b.astype(np.int16), lies.astype(np.int32)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int32, np.int16, np.int16, np.int32))
    who, a, b, lies = (np.concatenate(x) for x in zip(*out))
    if len(lies):  # numbers without gaps, so that slots take few bits
        lies -= lies.min()
        used = np.zeros(lies.max() + 1, np.int32)
        used[lies] = 1
        lies = (np.cumsum(used, dtype=np.int32) - 1)[lies]
    return who, a, b, lies


def _pieces(words: np.ndarray, k: int) -> np.ndarray:
    """Slice ``k`` of all descriptors ``(images, corners, 2)``, as numbers."""
    ones = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=2)[:, :, k * SLICE : (k + 1) * SLICE]
    return ones.astype(np.int32) @ (1 << np.arange(SLICE, dtype=np.int32))


def _padded(bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors as words ``(images, corners, 2)``, and 255 at the corners that an image lacks."""
    words = np.zeros((len(bits), max(map(len, bits)), BITS // 64), np.uint64)
    lacks = np.full(words.shape[:2], 255, np.uint8)
    for k, x in enumerate(bits):
        words[k, : len(x)] = x.view(np.uint64)
        lacks[k, : len(x)] = 0
    return words, lacks


def _points(places: list[np.ndarray], width: int) -> np.ndarray:
    """Corners as complex numbers ``(images, width)``."""
    out = np.zeros((len(places), width), np.complex64)
    for k, p in enumerate(places):
        out[k, : len(p)] = p[:, 0] + 1j * p[:, 1]
    return out


def _explained(p: np.ndarray, q: np.ndarray, pixels: float = 2.5) -> np.ndarray:
    """As in :func:`consensus`, how many of its matches ``p, q`` one transform explains; a column is a pair of images.

    In real numbers, with the pairs as the last axis, which numpy does many at once.
    """
    best = np.zeros(p.shape[1], np.uint16)
    for u in range(len(p) - 1):
        # All corners seen from corner u; a transform takes u and a later corner to their matches.
        px, py, qx, qy = (np.ascontiguousarray(y) for x in (p - p[u], q - q[u]) for y in (x.real, x.imag))
        ax, ay, bx, by = (x[u + 1 :] for x in (px, py, qx, qy))
        size = ax * ax + ay * ay
        far = size > 16
        size[~far] = 1
        mx, my = (bx * ax + by * ay) / size, (by * ax - bx * ay) / size
        scale = mx * mx + my * my
        far &= (scale > 0.3**2) & (scale < 3.4**2)
        dx = mx[:, None] * px
        dx -= my[:, None] * py
        dx -= qx
        dy = mx[:, None] * py
        dy += my[:, None] * px
        dy -= qy
        dx *= dx
        dy *= dy
        dx += dy
        inside = (dx <= pixels * pixels).sum(1, dtype=np.uint16)
        np.maximum(best, np.where(far, inside, 0).max(0), out=best)
    return best


def _distinct(codes: np.ndarray) -> np.ndarray:
    """``np.unique``, which hashes integers and is slower than to sort them."""
    codes = np.sort(codes)
    return codes[np.r_[True, codes[1:] != codes[:-1]]] if len(codes) else codes


def _matches(words: np.ndarray, lacks: np.ndarray, u: np.ndarray, v: np.ndarray, hamming: int) -> tuple[np.ndarray, np.ndarray]:
    """By corner of the images ``u`` and pair: the corner of ``v`` that is nearest, and whether each is the other's nearest, within ``hamming`` bits.

    The pairs are the last axis, along which numpy takes the least of many at once. Of
    equally near corners the first counts.
    """
    corners = words.shape[1]
    x, y = (np.ascontiguousarray(words[w].transpose(2, 1, 0)) for w in (u, v))
    lack_x, lack_y = (np.ascontiguousarray(lacks[w].T) for w in (u, v))
    some = lack_x.any() or lack_y.any()
    # A distance and a corner in one number; distances are below 256.
    kind = np.uint16 if corners <= 256 else np.uint32
    number = np.arange(corners, dtype=kind)[:, None]
    to = np.empty((corners, len(u)), kind)
    back = np.full(to.shape, np.iinfo(kind).max, kind)
    for i in range(corners):
        d = np.bitwise_count(x[0][i] ^ y[0])
        for k in range(1, len(x)):
            d += np.bitwise_count(x[k][i] ^ y[k])
        if some:
            d |= lack_x[i]
            d |= lack_y
        d = d.astype(kind)
        d *= kind(corners)
        np.minimum(back, d + kind(i), out=back)
        d += number
        d.min(0, out=to[i])
    back %= kind(corners)
    near, to = np.divmod(to, kind(corners))
    return to, (near <= hamming) & (np.take_along_axis(back, to.astype(np.intp), 0) == number)


def _ranges(begin: np.ndarray, end: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that have partners, the number of their partners ``begin`` up to ``end``, and all these partners, in parts of about ``most``."""
    rows = np.flatnonzero(end > begin)
    begin = begin[rows]
    n = end[rows] - begin
    total = np.cumsum(n)
    pieces = np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, most), "left")
    for at, to in zip(pieces, [*pieces[1:], len(rows)]):
        k = n[at:to]
        yield rows[at:to], k, np.arange(k.sum()) + np.repeat(begin[at:to] - (np.cumsum(k) - k), k)


def _meetings(lying: tuple, piece: np.ndarray, group: np.ndarray, side: np.ndarray | None, words: np.ndarray, near: int, star: bool) -> Iterator[np.ndarray]:
    """Pairs ``x, y`` of images of different groups that meet in a slot of one slice, as ``x * images + y``, x below y.

    Images of one side do not meet, unless it is below 0. Both corners and neighbours
    must be within ``near`` bits. ``star`` pairs each row with the first of its slot only,
    of whatever side; otherwise all rows of a slot meet, in pieces of about a million.
    """
    who, a, b, lies = lying
    if not len(who):
        return
    size, corners = words.shape[:2]
    a, b = (who.astype(np.int64) * corners + x for x in (a, b))
    # Images of a run do not meet: those of a group, or of a side apart from groups that others have a part in.
    run = group
    if side is not None and not star:
        low, high = np.full(size, size), np.full(size, -1)
        np.minimum.at(low, group, side)
        np.maximum.at(high, group, side)
        run = np.where((side < 0) | (low < high)[group], group, size + side)
    # Rows are numbered by the run of their image; so numbered they lie in their slot.
    order = np.argsort(run, kind="stable")
    count = np.bincount(who, minlength=size)
    runs = np.repeat(run[order], count[order])
    moved = np.zeros(size, np.int64)
    moved[order] = np.cumsum(count[order]) - count[order]
    moved -= np.cumsum(count) - count
    row = np.arange(len(who)) + moved[who]
    at = np.empty_like(row)
    at[row] = np.arange(len(who))
    piece = piece.ravel().astype(np.int64)
    slot = (lies.astype(np.int64) << SLICE | piece[a]) << SLICE | piece[b]
    bits = len(who).bit_length()
    if int(slot.max()).bit_length() + bits > 63:
        slot = np.unique(slot, return_inverse=True)[1]
    # A slot and a row in one number, which sorts several times as fast as by argsort.
    slot <<= bits
    slot |= row
    slot.sort()
    row = slot & ((1 << bits) - 1)
    slot >>= bits
    low = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    length = np.diff(np.r_[low, len(slot)])
    del slot, piece  # arrays of all rows take most of a task's memory
    # Slots of a single run go.
    meets = runs[row[low]] != runs[row[low + length - 1]]
    row, length = row[np.repeat(meets, length)], length[meets]
    if not len(row):
        return
    low = np.cumsum(length) - length
    end = np.repeat(low + length, length)
    if star:
        begin = np.repeat(low, length)
        end = begin + 1
    else:
        starts = runs[row]
        starts = np.r_[True, starts[1:] != starts[:-1]]
        starts[low] = True
        starts = np.flatnonzero(starts)
        begin = np.r_[starts[1:], len(row)]
        begin = np.repeat(begin, begin - starts)
    at = at[row]
    who, a, b = who[at], a[at], b[at]
    del row, runs, at
    g, side = group[who], None if side is None or star else side[who]
    held = [np.ascontiguousarray(words[:, :, k]).ravel()[c] for c in (a, b) for k in range(words.shape[2])]
    del a, b
    for i, k, j in _ranges(begin, end):
        d = np.bitwise_count(np.repeat(held[0][i], k) ^ held[0][j])
        close = np.flatnonzero(d <= near)
        i, j, d = np.repeat(i, k)[close], j[close], d[close]
        for n in range(1, len(held)):
            own = np.bitwise_count(held[n][i] ^ held[n][j])
            d = own + d if n % words.shape[2] else own
            close = np.flatnonzero(d <= near)
            i, j, d = i[close], j[close], d[close]
        apart = g[i] != g[j]
        if side is not None:
            apart &= (side[i] != side[j]) | (side[i] < 0)
        x, y = who[i[apart]].astype(np.int64), who[j[apart]]
        yield _distinct(np.minimum(x, y) * size + np.maximum(x, y))


def _gathered(parts: Iterator[np.ndarray], most: int = 2_000_000) -> Iterator[np.ndarray]:
    """The numbers of ``parts``, each once among about ``most``."""
    held, n = [], 0
    for codes in parts:
        held.append(codes)
        n += len(codes)
        if n > most:
            yield _distinct(np.concatenate(held))
            held, n = [], 0
    if n:
        yield _distinct(np.concatenate(held))


def _copies(first: list[tuple], second: list[tuple] | None, near: int, matched: int, explained: float, hamming: int = 20) -> Iterator[tuple[int, int]]:
    """Copies among images ``(id, places, bits)`` of two blocks, or of one; pairs already connected by others are left out."""
    side = None if second is None else np.repeat([0, 1], [len(first), len(second)])
    return _copies_of(first + (second or []), side, near, matched, explained, hamming)


def _copies_of(images: list[tuple], side: np.ndarray | None, near: int, matched: int, explained: float, hamming: int = 20) -> Iterator[tuple[int, int]]:
    """As :func:`_copies`, of images of any number of blocks ``side``; those of one block are compared with each other only if it is below 0."""
    size = len(images)
    words, lacks = _padded([x[2] for x in images])
    points = _points([x[1] for x in images], words.shape[1])
    lying = _neighbours([x[1] for x in images])
    least = np.clip([len(x[2]) for x in images], 4, matched)
    root = np.arange(size)
    batch = max(1, (1 << 20) // words.shape[1] ** 2)
    tried = np.zeros(0, np.int64)
    # First what joins large groups of copies, then every meeting that is left; slice by slice, which bounds memory.
    for star, k in [*((True, k) for k in range(STARS)), *((False, k) for k in range(SLICES))]:
        seen = [tried]
        for codes in _gathered(_meetings(lying, _pieces(words, k), root.copy(), side, words, near, star)):
            if len(tried):
                codes = codes[tried[np.minimum(np.searchsorted(tried, codes), len(tried) - 1)] != codes]
            seen.append(codes)
            for at in range(0, len(codes), 4 * batch):
                u, v = np.divmod(codes[at : at + 4 * batch], size)
                new = root[u] != root[v]
                u, v = u[new], v[new]
                if not len(u):
                    continue
                need = np.minimum(least[u], least[v])
                # The matches of all these pairs: pair, corner, corner.
                found = []
                for part in range(0, len(u), batch):
                    to, good = _matches(words, lacks, u[part : part + batch], v[part : part + batch], hamming)
                    pair, i = np.nonzero(good.T)
                    found.append((pair + part, i, to[i, pair]))
                pair, i, j = (np.concatenate(x) for x in zip(*found))
                n = np.bincount(pair, minlength=len(u))
                begin = np.cumsum(n) - n
                for count in np.unique(n[n >= need]).tolist():
                    of = np.flatnonzero((n == count) & (n >= need))
                    for some in range(0, len(of), step := max(1, (1 << 16) // count**2)):
                        these = of[some : some + step]
                        m = begin[these] + np.arange(count)[:, None]
                        inside = _explained(points[u[these], i[m]], points[v[these], j[m]])
                        for c in these[(inside >= need[these]) & (inside >= explained * count)].tolist():
                            x, y = int(u[c]), int(v[c])
                            if root[x] != root[y]:
                                root[root == root[y]] = root[x]
                                yield images[x][0], images[y][0]
        tried = _distinct(np.concatenate(seen))


def _block_copies(near: int, matched: int, explained: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(held):
            side, images = np.array([x[0] for x in held]), [x[1:] for x in held]
            found = list(_copies_of(images, side, near, matched, explained))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

        now, held = None, []
        for batch in batches:
            *rows, places, bits = batch.columns
            ends = np.cumsum(pc.list_value_length(places).to_numpy(zero_copy_only=False))
            places = np.split(places.flatten().to_numpy(zero_copy_only=False), ends[:-1])
            for line, own, i, p, d in zip(*(c.to_pylist() for c in rows), places, bits.to_pylist()):
                if line != now:
                    if held:
                        yield linked(held)
                    now, held = line, []
                held.append((own, i, p.reshape(-1, 4), np.frombuffer(d, np.uint8).reshape(-1, BITS // 8)))
        if held:
            yield linked(held)

    return run


def _order(images: int, block: int) -> int:
    """The prime nearest, in proportion, to the number of times that the images fill two blocks; 2 at least."""
    want = images / (2 * block)
    primes = [2]
    while primes[-1] < want:
        k = primes[-1] + 1
        while any(k % p == 0 for p in primes if p * p <= k):
            k += 1
        primes.append(k)
    return min(primes[-2:], key=lambda p: max(p / want, want / p)) if want else 2


def _lines(order: int, point: Column) -> Column:
    """The lines of an affine plane that pass through ``point`` (0 up to ``order`` squared): line, and the point, or -1 on one of them.

    Any two points are on one line together, so that any two images of different points
    are compared once, and those of a point on the line where it is -1.
    """
    x, y = F.floor(point / order).cast("int"), F.pmod(point, F.lit(order)).cast("int")
    slopes = [
        F.struct((F.lit(m * order) + F.pmod(y - F.lit(m) * x, F.lit(order))).cast("int").alias("line"), F.when(x == m, F.lit(-1)).otherwise(point).cast("int").alias("own"))
        for m in range(order)
    ]
    return F.array(*slopes, F.struct((F.lit(order * order) + x).cast("int").alias("line"), point.cast("int").alias("own")))


def image_copies(images: DataFrame, near: int = 14, matched: int = 6, explained: float = 0.5, corners: int = CORNERS, block: int = BLOCK) -> DataFrame:
    """``image_id, n_corners, component_id`` of every row of ``images(image_id, width, height, pixels)``.

    ``component_id`` is the smallest id that copies of copies reach. Images of equal
    size and pixels are copies. Of different ones, all pairs that share a slot of the
    Hamming tables, with both corners within ``near`` bits, are tried, unless other
    copies of their blocks connect them. They are copies if ``matched`` corners (fewer,
    4 at least, where an image has fewer) and a share of ``explained`` of the matches
    follow one transform. Each task compares about two blocks of ``block`` images, those on a line of
    an affine plane over which they are dealt, so what is sent grows with the square of the images. An image of 64 x 64 pixels has up
    to ``corners`` descriptors, its strongest corners, and larger ones more, as their side grows.

    Null or malformed pixels and rows without an id match nothing, blank images only
    equal ones; a null id has a null component. Rows that repeat are matched by id.
    Other columns are left out; an empty table gives no rows.
    """
    feats = written(image_features(images, corners), "features")
    usable = feats.where("image_id is not null and digest is not null")
    # One image stands for all equal ones.
    equal = usable.groupBy("digest").agg(F.min("image_id").alias("a"))
    links = usable.select("digest", F.col("image_id").alias("b")).join(equal, "digest").select("a", "b").where("a < b")
    one = usable.where("length(bits) > 0").join(equal.withColumnRenamed("a", "image_id"), ["digest", "image_id"]).dropDuplicates(["digest"])
    one = written(one.select("image_id", "places", "bits"), "images")
    order = _order(one.count(), block)
    point = F.pmod(F.xxhash64("image_id"), F.lit(order * order)).cast("int")
    lines = one.withColumn("at", F.explode(_lines(order, point))).select("at.line", "at.own", "image_id", "places", "bits")
    # A task for each line: twice as many ranges, so that each line fills one. By id, as a transform explains more of two images one way than the other.
    spread = lines.repartitionByRange(2 * order * (order + 1), "line").sortWithinPartitions("line", "image_id", "bits")
    same = spread.mapInArrow(_block_copies(near, matched, explained), "a long, b long")
    links = written(links.union(same), "same")
    parts = components(links).withColumnRenamed("node", "image_id")
    return feats.join(parts, "image_id", "left").select(
        "image_id", (F.octet_length("bits") / (BITS // 8)).cast("int").alias("n_corners"), F.coalesce("component", "image_id").alias("component_id")
    )


def rendered(vectors: DataFrame, side: int = 64) -> DataFrame:
    """Grey images of ``vectors(vec_id, embedding)``: a vector's components are the
    control points of a smooth field. Equal directions give equal images; a null or
    unusable vector gives null pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v or []], float)
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    pixels.append(None)
                    continue
                n = int(np.ceil(np.sqrt(len(x))))
                grid = np.zeros(n * n)
                grid[: len(x)] = x / np.sqrt((x**2).mean())
                field = _resize(grid.reshape(1, n, n).astype(np.float32), side / n)[0]
                pixels.append(np.rint(127.5 + 120 * np.tanh(1.5 * field)).astype(np.uint8).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([side] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(pixels, pa.binary())], ["image_id", "width", "height", "pixels"]
            )

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "image_id long, width int, height int, pixels binary")
