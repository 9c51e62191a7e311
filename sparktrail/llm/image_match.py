"""Media columns: local image descriptors find cropped or edited copies.

Corners (Harris) are found on an image at several scales. Each gets the
orientation of its patch (intensity centroid) and 256 binary tests of pixel
pairs, turned by that orientation. Tables of chosen bits of the tests are held
against each other: descriptors that agree in all bits of a table and differ in few of the 256 are a
correspondence. Correspondences between two images vote for a change of angle,
scale and position; enough votes of different corners in one cell are geometric
consensus, and link the images: MIN_VOTES, and where many corners have matches a
fifth of these, counted in the image that has fewer. Votes are of different
corners in both images.

In a bucket of a table every descriptor meets every other. Images are dealt to tiles,
and each two tiles are a cell: one task counts how often two images meet in all tables,
compares the descriptors of those that meet as often as a link needs votes, and judges
their correspondences, a piece at a time, so that no correspondence leaves it.
Of a cell come the images with links, the number of these and the trees they make,
however many links there are. Images with the same corners and descriptors are one
class, compared once and counted with its size. The groups that links join are found
by distributed components. The counts of a bucket and the comparisons of a group of copies grow
with their squares, as each two are looked at. The tables are what the search may
miss by: descriptors that differ in many bits may agree in none of them; the README
has the measured recall.

Defined cases: a null image, or one without corners (too small, or flat), is
linked with none; a null id is linked with none, other ids may be of any type that sorts; copies under the same id count
as one image; repeated rows come back as often; equal votes and corners are taken
in the order of their places; pictures are read whole, however large; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import checkpoint, components, in_order, join_unique, map_arrow, stored

CORNERS, STEP = (20, 8, 4), 1.5  # the strongest at each scale, besides those of each cell
CELL, CORNER_AREA = 64, 256  # the strongest of each cell, one for so many pixels
RADIUS, TABLES, TABLE_BITS, MAX_DIFFER, MIN_VOTES = 7, 8, 24, 48, 4
VOTE_SHARE = 5  # one vote at least for so many matched corners: with many, some agree by chance
TILE = 1 << 18  # points of a tile; a cell is held whole by its task
SPREAD, SPREAD_TILE = 12, 1 << 12  # smaller tiles, so that there are cells for many tasks
COPIES = 3  # other tiles that an image is sent to in a pass
PIECE = 1 << 19  # pairs of points looked at together
COUNTED = 1 << 16  # of these, those counted together, whose counters stay near the processor
PIXELS = 3 << 14  # of pictures of one size that are described together
ANGLES = 24
_RNG = np.random.default_rng(20240501)
PAIRS = np.clip(np.round(_RNG.normal(0, RADIUS / 2, (256, 4))), -RADIUS, RADIUS)
BITS = np.stack([_RNG.permutation(256)[:TABLE_BITS] for _ in range(TABLES)])
#: The 256 bits of each table as four words, as the tests are packed.
MASKS = np.stack([np.packbits(np.isin(np.arange(256), own)).view(">u8").astype(np.uint64) for own in BITS])
_ODD = _RNG.integers(0, 1 << 63, 4, np.uint64) << np.uint64(1) | np.uint64(1)
#: corner holds level, y and x: level << 48 | y << 24 | x, counted in pixels of that level.
KEYPOINT = "img_id long, corner long, angle float, d0 long, d1 long, d2 long, d3 long, keys array<int>"
WORDS = ["d0", "d1", "d2", "d3"]


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """The means of the squares around each place of the last two axes."""
    p = np.concatenate([a[..., :1, :]] * r + [a] + [a[..., -1:, :]] * r, -2)
    p = np.concatenate([p[..., :1]] * r + [p] + [p[..., -1:]] * r, -1)
    c = np.zeros((*p.shape[:-2], p.shape[-2] + 1, p.shape[-1] + 1))
    np.cumsum(p, -2, out=p)
    np.cumsum(p, -1, out=c[..., 1:, 1:])
    n = 2 * r + 1
    out = c[..., n:, n:] - c[..., :-n, n:]
    out -= c[..., n:, :-n]
    out += c[..., :-n, :-n]
    out /= n * n
    return out


def _resized(a: np.ndarray, factor: float) -> np.ndarray:
    h, w = int(a.shape[-2] / factor), int(a.shape[-1] / factor)
    y, x = np.minimum(np.arange(h) * factor, a.shape[-2] - 1), np.minimum(np.arange(w) * factor, a.shape[-1] - 1)
    i, j = np.minimum(y.astype(int), a.shape[-2] - 2), np.minimum(x.astype(int), a.shape[-1] - 2)
    v, u = (y - i)[:, None], x - j
    across = np.take(a, j, -1) * (1 - u) + np.take(a, j + 1, -1) * u
    return np.take(across, i, -2) * (1 - v) + np.take(across, i + 1, -2) * v


_DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if y * y + x * x <= RADIUS * RADIUS])


#: The different places of the tests, and which of them each test compares.
_PLACES, _FIRST = np.unique(PAIRS.reshape(-1, 2), axis=0, return_inverse=True)
_FIRST, _SECOND = _FIRST.reshape(-1, 2).T


def _ranks(groups: np.ndarray) -> np.ndarray:
    """For each value its place among the equal ones."""
    order = np.argsort(groups, kind="stable")
    first = np.r_[True, groups[order][1:] != groups[order][:-1]]
    rank = np.empty(len(groups), np.int64)
    rank[order] = np.arange(len(groups)) - np.maximum.accumulate(np.where(first, np.arange(len(groups)), 0))
    return rank


def _strongest(picture: np.ndarray, y: np.ndarray, x: np.ndarray, h: int, w: int, most: int) -> np.ndarray:
    """Which corners, given strongest first, are kept of each picture: the first of all and of each cell, so that every part of a large picture keeps its own."""
    down, across = -(-h // CELL), -(-w // CELL)
    room = np.minimum(CELL, h - y // CELL * CELL) * np.minimum(CELL, w - x // CELL * CELL)
    rank = _ranks((picture * down + y // CELL) * across + x // CELL)
    return (rank < -(-room // CORNER_AREA)) | (_ranks(picture) < most)


def _responses(smooth: np.ndarray) -> np.ndarray:
    """Harris' measure of corners, of all but the border."""
    gy, gx = np.empty_like(smooth), np.empty_like(smooth)
    for g, at in ((gy, lambda s: np.s_[..., s, :]), (gx, lambda s: np.s_[..., s])):
        inside = np.subtract(smooth[at(np.s_[2:])], smooth[at(np.s_[:-2])], out=g[at(np.s_[1:-1])])
        inside /= 2
        g[at(0)] = smooth[at(1)] - smooth[at(0)]
        g[at(-1)] = smooth[at(-1)] - smooth[at(-2)]
    a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    response = a * b
    c *= c
    response -= c
    a += b
    response -= 0.05 * a**2
    return response


def described(grays: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pictures of one size: the picture, (x, y, level, angle), with x and y in pixels of the level, and the 256 tests of the strongest corners of each level."""
    image, pictures, points, tests = grays.astype(np.float64), [], [], []
    for level, most in enumerate(CORNERS):
        h, w = image.shape[1:]
        edge = RADIUS * 2
        if min(h, w) <= 2 * edge:
            break
        smooth = _box(image, 1)
        response = _responses(smooth)
        core = response[:, edge : h - edge, edge : w - edge]
        peak = core > 1e-3
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= core >= response[:, edge + dy : h - edge + dy, edge + dx : w - edge + dx]
        of, y, x = np.nonzero(peak)
        if len(of):
            best = np.lexsort((x, y, -core[of, y, x], of))
            of, y, x = of[best], y[best] + edge, x[best] + edge
            best = _strongest(of, y, x, h, w, most)
            of, y, x = of[best], y[best], x[best]
            flat, start = smooth.ravel(), (of * h * w)[:, None]
            patch = flat[start + (y * w + x)[:, None] + (_DISC[:, 0] * w + _DISC[:, 1])]
            angle = np.arctan2((patch * _DISC[:, 0]).sum(1), (patch * _DISC[:, 1]).sum(1))
            cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
            py, px = _PLACES.T
            values = flat[start + np.rint(y[:, None] + py * cos + px * sin).astype(int) * w + np.rint(x[:, None] + px * cos - py * sin).astype(int)]
            tests.append(np.take(values, _FIRST, 1) < np.take(values, _SECOND, 1))
            points.append(np.stack([x, y, np.full(len(y), level), angle], 1))
            pictures.append(of)
        image = _resized(image, STEP)
    if not points:
        return np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros((0, 256), bool)
    return np.concatenate(pictures), np.concatenate(points), np.concatenate(tests)


def describe(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What described() gives for one picture."""
    return described(gray[None])[1:]


def _parts(batch: pa.RecordBatch, rows: int = 256):
    """Small pieces of a batch, as a picture takes far more memory than its row."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _keys(tests: np.ndarray) -> np.ndarray:
    """The bits of each table, below its number."""
    bits = np.packbits(np.take(tests, BITS.ravel(), 1).reshape(len(tests), TABLES, TABLE_BITS), axis=2, bitorder="little").astype(np.int32)
    return bits[:, :, 0] | bits[:, :, 1] << 8 | bits[:, :, 2] << 16 | np.arange(TABLES, dtype=np.int32) << TABLE_BITS


def keypoints(images: DataFrame, img_id: str = "img_id", image: str = "image") -> DataFrame:
    """A row for each corner; `image` is struct<height:int,width:int,gray:binary>."""

    def run(batches):
        for batch in (part for whole in batches for part in _parts(whole)):
            ids, points, words, keys, alike = [], [], [], [], defaultdict(list)
            for i, im in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is not None and im is not None and im["gray"] and im["height"] * im["width"] == len(im["gray"]):
                    alike[im["height"], im["width"]].append((i, im["gray"]))
            for (h, w), own in alike.items():
                for some in (own[k : k + max(1, PIXELS // (h * w))] for k in range(0, len(own), max(1, PIXELS // (h * w)))):
                    of, p, t = described(np.frombuffer(b"".join(gray for _, gray in some), np.uint8).reshape(-1, h, w))
                    if len(p):
                        ids.append(np.array([i for i, _ in some], np.int64)[of])
                        points.append(p)
                        words.append(np.packbits(t, axis=1).view(">i8").astype(np.int64))
                        keys.append(_keys(t))
            if ids:
                p, w = np.concatenate(points), np.concatenate(words)
                x, y, level = p[:, :3].astype(np.int64).T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * TABLES), pa.array(np.concatenate(keys).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids)), pa.array(level << 48 | y << 24 | x), pa.array(p[:, 3].astype(np.float32)), *(pa.array(w[:, c].copy()) for c in range(4)), lists],
                    names=["img_id", "corner", "angle", "d0", "d1", "d2", "d3", "keys"],
                )

    return map_arrow(images.select(F.col(img_id).cast("long").alias("img_id"), F.col(image).alias("image")), run, KEYPOINT)


def _cells(batches):
    """A table for the rows of each cell, which is the first column, from batches sorted by it."""
    held, last = [], None
    for batch in batches:
        cell = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if held and cell[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = cell[start]
    if held:
        yield pa.Table.from_batches(held)


def _run_ends(keys: list[np.ndarray]) -> np.ndarray:
    """For each row the end of its run of rows with equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))


def _cuts(cost: np.ndarray, ends: np.ndarray, most: int):
    """(start, end) of pieces that end at some of `ends` and cost `most` together, or are one step."""
    total = np.cumsum(cost)
    start, at = 0, total[ends - 1]
    while start < len(cost):
        before = total[start - 1] if start else 0
        end = int(ends[max(np.searchsorted(at, before + most, "right") - 1, np.searchsorted(ends, start, "right"))])
        yield start, end
        start = end


class _Points:
    """The points of a cell in the order of their images, which are numbered in the order of their ids."""

    def __init__(self, cell: pa.Table, tiles: int):
        number, tile, img, size = (cell.column(c).to_numpy() for c in range(4))
        lists = cell.column(4).combine_chunks()
        fields = dict(zip(["corner", "angle", *WORDS], lists.flatten().flatten()))
        self.ids, row = np.unique(img, return_inverse=True)
        self.size = np.zeros(len(self.ids), np.int64)
        self.size[row] = size
        n = lists.value_lengths().to_numpy()
        order = np.argsort(np.repeat(row, n), kind="stable")
        self.own = np.repeat(row, n)[order]
        self.corner = fields["corner"].to_numpy()[order]
        self.angle = fields["angle"].to_numpy()[order].astype(np.float64)
        self.words = np.stack([fields[w].to_numpy()[order] for w in WORDS], 1).view(np.uint64)
        self.level = self.corner >> 48
        self.scale = STEP ** self.level.astype(np.float64)
        self.x, self.y = (self.corner & 0xFFFFFF) * self.scale, (self.corner >> 24 & 0xFFFFFF) * self.scale
        tile = np.repeat(tile, n)[order]
        first, second = divmod(int(number[0]), tiles)
        side = np.flatnonzero(tile == first)
        self.same, self.sides = first == second, (side, side if first == second else np.flatnonzero(tile == second))

    def links(self, min_votes: int, most: int = PIECE):
        """(a, b, votes) of all linked images of the two sides, a piece at a time."""
        hashes = [sum((word & bits) * odd for word, bits, odd in zip(self.words.T, mask, _ODD)) for mask in MASKS]
        todo = [self.sides]
        while todo:
            left, right = todo.pop()
            if not len(left) or not len(right):
                continue
            met = _Met(hashes, left, right, self.same and left is right)
            own, other = self.own[left], self.own[met.order]
            cost = met.n.sum(0)
            for s, e in _cuts(cost, np.flatnonzero(np.r_[own[1:] != own[:-1], True]) + 1, most):
                if cost[s:e].sum() > most and self.own[right[0]] != self.own[right[-1]]:  # one image that meets very many points
                    middle = self.own[right[len(right) // 2]]
                    cut = np.searchsorted(self.own[right], middle, "left" if middle > self.own[right[0]] else "right")
                    todo += [(left[s:e], right[:cut]), (left[s:e], right[cut:])]
                    continue
                votes = [self._votes(table, left[i], met.order[j]) for table, i, j in met.pairs(s, e, own, other, min_votes, most)]
                votes = [v for v in votes if len(v[0])]
                if votes:
                    cols = [np.concatenate(c) for c in zip(*votes)]
                    order = np.lexsort((cols[1], cols[0]))
                    yield _consensus([c[order] for c in cols], min_votes)

    def _votes(self, table: np.ndarray, i: np.ndarray, j: np.ndarray):
        """(a, b, corner of a, corner of b, cell) of the correspondences among points i and j, which meet in a table."""
        own, corner, level, scale, x, y = self.own, self.corner, self.level, self.scale, self.x, self.y
        if self.same:
            once = own[i] < own[j]
            table, i, j = table[once], i[once], j[once]
        differ = [word[i] ^ word[j] for word in self.words.T]
        near = np.flatnonzero(sum(np.bitwise_count(d).astype(np.int16) for d in differ) <= MAX_DIFFER)
        table, i, j, differ = table[near], i[near], j[near], [d[near] for d in differ]
        # A pair is told by the first table in which it agrees, and where it does not agree at all only the hash of the bits is equal.
        agree = [np.bitwise_or.reduce([d & bits for d, bits in zip(differ, mask)]) == 0 for mask in MASKS]
        keep = np.choose(table, agree)
        for t, equal in enumerate(agree):
            keep &= ~equal | (table <= t)
        i, j = i[keep], j[keep]
        swap = own[i] > own[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        turn = self.angle[j] - self.angle[i]
        ratio = scale[j] / scale[i]
        dx = x[j] - ratio * (np.cos(turn) * x[i] - np.sin(turn) * y[i])
        dy = y[j] - ratio * (np.sin(turn) * x[i] + np.cos(turn) * y[i])
        at = lambda d: np.floor(d / 16.0 - 0.5).astype(np.int64) + (1 << 24)
        cell = np.round(turn / (2 * np.pi / ANGLES)).astype(np.int64) % ANGLES << 58 | level[j] - level[i] + 32 << 52 | at(dx) << 26 | at(dy)
        return own[i], own[j], corner[i], corner[j], cell


class _Met:
    """Which points of the right side the points of the left meet in the tables.

    The points of the right stand in the order of the hashes of each table, those of one
    hash by their images; equal bits have equal hashes, and now and then others too.
    `order` has them table after table; `start` and `n`, with a row for each table, say where in it
    are those that a point of the left meets. On one and the same side these are the points after its own.
    """

    def __init__(self, hashes: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool):
        bits = np.uint64(64 - max(8, (4 * len(right)).bit_length()))
        self.order = np.empty(len(hashes) * len(right), np.int32)
        self.start, self.n = np.empty((2, len(hashes), len(left)), np.int64)
        for table, h in enumerate(hashes):
            slot = h[right] >> bits
            place = (np.sort(slot << np.uint64(32) | np.arange(len(right), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            count = np.bincount(slot.astype(np.int64), minlength=1 << 64 - int(bits))
            end = np.cumsum(count)
            own = slot if same else h[left] >> bits
            own = own.astype(np.int64)
            if same:
                self.start[table, place] = np.arange(1, len(right) + 1)
            else:
                self.start[table] = end[own] - count[own]
            self.n[table] = end[own] - self.start[table]
            self.start[table] += table * len(right)
            self.order[table * len(right) : (table + 1) * len(right)] = right[place]

    def pairs(self, s: int, e: int, own: np.ndarray, other: np.ndarray, min_votes: int, most: int):
        """(table, places in left, places in order) of the pairs of points s to e with those they meet, whose images may have as many votes as a link needs.

        Each meeting is counted for its two images, some of which share a counter, so
        images that are left out have met less often than min_votes, and few that stay have.
        """
        n = self.n[:, s:e]
        cost = n.sum(0)
        if cost.sum() > most:  # two images that alone have more
            for table, (start, n) in enumerate(zip(self.start[:, s:e], n)):
                for k, m in _cuts(n, np.arange(1, e - s + 1), most):
                    place = np.repeat(np.arange(k, m), n[k:m])
                    yield np.full(len(place), table), s + place, (start - np.cumsum(n) + n)[place] + np.arange(len(place)) + n[:k].sum()
            return
        found, ends = [], np.flatnonzero(np.r_[own[s + 1 : e] != own[s : e - 1], True]) + 1
        for k, m in _cuts(cost, ends, COUNTED):
            met = n[:, k:m].ravel()
            end = np.cumsum(met)
            total = int(end[-1])
            j = np.repeat(self.start[:, s + k : s + m].ravel() - end + met, met)
            j += np.arange(total)
            counters = (1 << (2 * total).bit_length()) - 1
            pair = np.repeat(np.tile((own[s + k : s + m] - own[s + k]) * 1_000_003 & counters, len(n)), met)
            pair += other[j]
            pair &= counters
            may = np.flatnonzero(np.bincount(pair)[pair] >= min_votes)
            table, i = np.divmod(np.searchsorted(end, may, "right"), m - k)
            found.append((table, i + (s + k), j[may]))
        yield tuple(np.concatenate(c) for c in zip(*found))


def _consensus(cols: list[np.ndarray], min_votes: int):
    """(a, b, votes) from sorted rows (a, b, corner of a, corner of b, cell): the most different corners in one cell."""
    end = _run_ends(cols[:2])
    first = np.r_[0, end[:-1][end[:-1] != end[1:]]]
    run = np.searchsorted(first, np.arange(len(end)), "right") - 1
    many = np.bincount(run)[run] >= min_votes
    corner, other, cell = (c[many] for c in cols[2:])
    run = run[many]
    if not len(run):
        return run, run, run
    need = np.full(len(first), np.iinfo(np.int64).max)
    for ends in (corner, other):
        order = np.lexsort((ends, run))
        new = np.r_[True, (run[order][1:] != run[order][:-1]) | (ends[order][1:] != ends[order][:-1])]
        need = np.minimum(need, np.bincount(run[order][new], minlength=len(first)))
    need = np.maximum(min_votes, -(-need // VOTE_SHARE))
    # The two cells nearest to a value on each axis, so that no vote is lost at a border.
    cell = np.concatenate([cell + (u << 26) + v for u in (0, 1) for v in (0, 1)])
    run = np.tile(run, 4)
    votes = []
    for ends in (corner, other):  # different corners in both images: one that meets many has one vote
        ends = np.tile(ends, 4)
        order = np.lexsort((ends, cell, run))
        at, ends = (run[order], cell[order]), ends[order]
        new_cell = np.r_[True, (at[0][1:] != at[0][:-1]) | (at[1][1:] != at[1][:-1])]
        new = new_cell | np.r_[True, ends[1:] != ends[:-1]]
        votes.append(np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_cell)))
    best = np.zeros(len(first), np.int64)
    np.maximum.at(best, at[0][new_cell], np.minimum(*votes))
    won = np.flatnonzero(best >= need)
    return cols[0][first[won]], cols[1][first[won]], best[won]


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's tree, from those before, when links (a, b) are added."""
    x, y = root[a], root[b]
    while (differ := x != y).any():
        x, y = x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
        x, y = root[x], root[y]
    return root


def _packed(points: DataFrame, part: int = 256) -> DataFrame:
    """(img_id, points): the points of an image in rows of `part` at most, as very many rows go to a task together."""
    lists = points.groupBy("img_id").agg(F.collect_list(F.struct("corner", "angle", *WORDS)).alias("all"))
    starts = F.sequence(F.lit(1), F.size("all"), F.lit(part))
    return lists.select("img_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, part))).alias("points"))


def _in_cells(images: DataFrame, run, schema: str, tile: int) -> DataFrame:
    """What run(points of a cell) gives for each two tiles of images (img_id, n, points).

    Cells are worked off in passes, in each of which an image goes to a few other
    tiles, so that the disk holds these copies, however many tiles there are.
    """
    total = images.agg(F.sum(F.size("points"))).first()[0] or 0
    tiles = max(1, -(-total // tile), min(SPREAD, -(-total // SPREAD_TILE)))
    passes = -(-tiles // COPIES)

    def search(batches):
        for cell in _cells(batches):
            for found in run(_Points(cell, tiles)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=[c.split()[0] for c in schema.split(", ")])

    rows = images.withColumn("tile", F.pmod(F.xxhash64("img_id", F.lit(3)), F.lit(tiles)))
    out = None
    for n in range(passes):
        others = F.filter(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda o: F.pmod(o + F.col("tile"), F.lit(passes)) == n)  # noqa: B023
        cells = rows.withColumn("other", F.explode(others)).select((F.least("tile", "other") * tiles + F.greatest("tile", "other")).alias("cell"), "tile", "img_id", "n", "points")
        found = stored(map_arrow(cells.repartition(2 * tiles * COPIES, "cell").sortWithinPartitions("cell"), search, schema), "links")
        out = found if out is None else out.union(found)
    return out


def links(points: DataFrame, min_votes: int = MIN_VOTES, tile: int = TILE) -> DataFrame:
    """(a, b, votes): all pairs of images with geometric consensus, for points made by keypoints()."""

    def run(cell):
        for a, b, votes in cell.links(min_votes):
            yield cell.ids[a], cell.ids[b], votes

    return _in_cells(stored(_packed(points).withColumn("n", F.lit(1).cast("long")), "packed"), run, "a long, b long, votes long", tile)


def linked(images: DataFrame, min_votes: int = MIN_VOTES, tile: int = TILE) -> DataFrame:
    """(a, b, others): for each image (img_id, n, points) that has links in a cell, the least image of its tree there and the sum of n of those it is linked with."""

    def run(cell):
        root, others = np.arange(len(cell.ids)), np.zeros(len(cell.ids), np.int64)
        for a, b, _ in cell.links(min_votes):
            np.add.at(others, a, cell.size[b])
            np.add.at(others, b, cell.size[a])
            root = _joined(root, a, b)
        has = others > 0
        yield cell.ids[has], cell.ids[root[has]], others[has]

    return _in_cells(images, run, "a long, b long, others long", tile)


def classes(points: DataFrame, min_votes: int = MIN_VOTES) -> DataFrame:
    """(img_id, first, n): the least id and the number of the images with the same points. Images of too few corners, which even a copy doesn't link, are each alone."""
    row = F.xxhash64("corner", "angle", "d0", "d1", "d2", "d3")
    prints = points.groupBy("img_id").agg(F.count("*").alias("rows"), F.bit_xor(row).alias("h1"), F.sum(F.shiftright(row, 20)).alias("h2"), (F.size(F.collect_set("corner")) < min_votes).alias("few"))
    prints = checkpoint(prints.withColumn("alone", F.when(F.col("few"), F.col("img_id"))))
    same = ["rows", "h1", "h2", "alone"]
    firsts = prints.groupBy(*same).agg(F.min("img_id").alias("first"), F.count("*").alias("n"))
    on = [prints[c].eqNullSafe(firsts[c]) for c in same]
    return prints.join(firsts, on).select("img_id", "first", "n")


def image_copies(images: DataFrame, img_id: str = "img_id", image: str = "image", min_votes: int = MIN_VOTES) -> DataFrame:
    """img_id, component_id (the least id that links reach) and n_links (linked images, all of them counted) of every row, with ids of the type they have."""
    rows = images.select(F.col(img_id).alias("img_id"), F.col(image).alias("image"))
    if isinstance(rows.schema["img_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _copies(rows, min_votes).select(*[F.col(c).cast(rows.schema["img_id"].dataType).alias(c) for c in ("img_id", "component_id")], "n_links")
    # ids that are no integers are numbered in their order, each different one once
    known = in_order(rows.select(F.col("img_id").alias("_id")).where("_id is not null").distinct(), [F.asc("_id")], "_n")
    numbered = join_unique(rows, "img_id", known, "_id", "left").select(F.col("_n").alias("img_id"), "image")
    found = _copies(numbered, min_votes)
    own = known.select(F.col("_id").alias("_own"), F.col("_n").alias("_own_n"))
    out = join_unique(found, "img_id", own, "_own_n", "left").drop("_own_n")
    out = join_unique(out, "component_id", known, "_n", "left")
    return out.select(F.col("_own").alias("img_id"), F.col("_id").alias("component_id"), "n_links")


def _copies(images: DataFrame, min_votes: int) -> DataFrame:
    img_id, image = "img_id", "image"
    points = stored(keypoints(images, img_id, image).drop("keys"), "keypoints")  # found once, read twice
    alike = checkpoint(classes(points, min_votes))
    sizes = alike.where("img_id = first").select("first", "n")
    firsts = _packed(points).join(sizes, F.col("img_id") == F.col("first")).select("img_id", "n", "points")
    found = linked(stored(firsts, "packed"), min_votes)
    ends = found.groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    named = alike.join(components(found.select("a", "b")), F.col("first") == F.col("node"), "left").select(F.col("img_id").alias("me"), "first", F.coalesce("root", "first").alias("root"), "n")
    named = named.join(ends, F.col("first") == F.col("node"), "left").select("me", "root", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    ids = images.select(F.col(img_id).cast("long").alias("img_id"))
    return ids.join(named, F.col("img_id") == F.col("me"), "left").select("img_id", F.coalesce("root", "img_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def rendered(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", grid: int = 24, side: int = 72) -> DataFrame:
    """(img_id, image): each vector drawn as a grey texture; a fixed pattern says which of its values is the height at each point of a square grid, and heights are blended between.

    A null or empty vector has no picture; null and infinite values count as 0. Vectors are
    dealt out anew, as a file may hold all of them in one piece and a picture takes a task some thousand times what its vector takes.
    """

    def run(batches):
        kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("gray", pa.binary())])
        for batch in (part for whole in batches for part in _parts(whole)):
            lists, out = batch.column(1), [None] * batch.num_rows
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.nan_to_num(pc.fill_null(pc.cast(lists.flatten(), pa.float64(), safe=False), 0.0).to_numpy(zero_copy_only=False), posinf=0.0, neginf=0.0)
            for size in np.unique(n[n > 0]):
                own, pattern = np.flatnonzero(n == size), np.random.default_rng(7).integers(0, size, (grid + 1, grid + 1))
                at = (np.cumsum(n) - n)[own]
                for some in (slice(k, k + max(1, PIXELS // side**2)) for k in range(0, len(own), max(1, PIXELS // side**2))):
                    v = values[at[some, None] + np.arange(size)]
                    big = _resized(v[:, pattern], grid / side)[:, :side, :side]
                    most = np.abs(v).max(1)[:, None, None]
                    gray = np.clip(np.round(127.5 + 127.5 * big / np.where(most, most, 1.0)), 0, 255).astype(np.uint8)
                    for i, g in zip(own[some], gray):
                        out[i] = {"height": g.shape[0], "width": g.shape[1], "gray": g.tobytes()}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["img_id", "image"])

    rows = vectors.select(F.col(vec_id).alias("img_id"), F.col(vector).alias("v")).repartition(3 * vectors.sparkSession.sparkContext.defaultParallelism)
    return map_arrow(rows, run, f"img_id {dict(rows.dtypes)['img_id']}, image struct<height:int,width:int,gray:binary>")
