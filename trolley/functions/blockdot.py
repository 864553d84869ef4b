"""Per-task kernel of the sparse product (used by ``operators.similarity``).

A task receives, per item, the entries of a block of left users and the right entries they meet. It
computes the dot products of every left user with every right user that shares an item (row-wise
sparse product: expand each left entry against the right entries of the same item, accumulate per
user pair), turns them into similarities with both masses (taken from the users' whole rows; see
``functions.measures``), and keeps only the top-k per owner under the total order (similarity desc, id asc).
Pair products never leave the task; the task emits at most k rows per user it owns.

Memory is bounded by processing left users in chunks of at most ``MAX_EXPANSION`` expanded entries
(unless one user alone exceeds them). Where most pairs of a chunk share items the accumulator is dense, at most
``MAX_CELLS`` cells; where few do, the products are sorted by pair, so work follows the products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from trolley.functions.measures import COSINE, Measure

MAX_CELLS = 1 << 22
MAX_EXPANSION = 1 << 22
SPARSE = 4          # cells per product from which on pairs are sorted instead of counted in cells


def topk_per_owner(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int):
    """Indices of the k best (sim desc, other asc) entries per owner."""
    if owner.size == 0:
        return np.empty(0, dtype=np.int64)
    near = _not_below_kth(owner, sim, k)
    order = np.lexsort((other[near], -sim[near], owner[near]))
    o = owner[near][order]
    start = np.r_[True, o[1:] != o[:-1]]
    first = np.maximum.accumulate(np.where(start, np.arange(o.size), 0))
    rank = np.arange(o.size) - first
    return near[order[rank < k]]


def _not_below_kth(owner: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Indices of all entries, or, where the owners come in runs, of those that are at least their owner's k-th
    similarity (ties stay): sorting these few is enough."""
    if np.any(owner[1:] < owner[:-1]) or np.isnan(sim).any():
        return np.arange(owner.size)
    cuts = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1, owner.size]
    sizes = np.diff(cuts)
    least = np.full(sizes.size, -np.inf)
    for i in np.flatnonzero(sizes > k).tolist():
        least[i] = np.partition(sim[cuts[i]:cuts[i + 1]], sizes[i] - k)[sizes[i] - k]
    return np.flatnonzero(sim >= np.repeat(least, sizes))


def _numbered(users: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct users in order, and each entry's place among them; without sorting where their ids lie close."""
    low = int(users.min()) if users.size else 0
    span = int(users.max()) - low + 1 if users.size else 0
    if span > 8 * users.size + (1 << 16):
        return np.unique(users, return_inverse=True)
    held = np.zeros(span, bool)
    held[users - low] = True
    return np.flatnonzero(held) + low, (np.cumsum(held) - 1)[users - low]


class _Side:
    """One side's rows with local user ids, finished masses and an item-sorted view."""

    def __init__(self, users: np.ndarray, items: np.ndarray, values: np.ndarray, measure: Measure = COSINE):
        self.ids, self.local = np.unique(users, return_inverse=True)
        self.mass = measure.of_rows(values, self.local, self.ids.size)
        self.measure = measure
        order = np.argsort(items, kind="stable")
        self.items_sorted = items[order]
        self.local_sorted = self.local[order]
        self.values_sorted = values[order]
        self.items = items
        self.values = values


class _Entries:
    """One side's entries whose masses come with them, in the order given."""

    def __init__(self, users: np.ndarray, values: np.ndarray, masses: np.ndarray, measure: Measure):
        self.ids, self.local = _numbered(users)
        mass = np.empty(self.ids.size)
        mass[self.local] = masses       # the same in all entries of a user
        self.mass = measure.finish(mass, np.sqrt)
        self.measure = measure
        self.local_sorted = self.local
        self.values = self.values_sorted = values


def block_scores(left: _Side, right: _Side, k: int, right_topk: bool):
    """Top-k per left user (and, when ``right_topk``, per right user) of the similarity with the other side.

    Returns two tuples of arrays ``(owner_id, other_id, similarity)``.
    """
    lo = np.searchsorted(right.items_sorted, left.items, side="left")
    hi = np.searchsorted(right.items_sorted, left.items, side="right")
    return _scores(left, right, lo, hi, k, right_topk)


def _summed(keys: np.ndarray, weights: np.ndarray):
    """The distinct keys, sorted, and the sum of each one's weights."""
    if np.all(weights == 1):        # as of rows of 1s: the sums are counts, and the keys alone are sorted
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.diff(np.r_[first, keys.size]).astype(np.float64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(weights[order], first)


def _scores(left, right, lo: np.ndarray, hi: np.ndarray, k: int, right_topk: bool):
    """``block_scores`` where left entry e meets the right entries ``lo[e]`` to ``hi[e]``."""
    n_right = right.ids.size
    fan = (hi - lo).astype(np.int64)
    # group the left entries by local user; chunk users by expansion and accumulator size
    by_user = np.argsort(left.local, kind="stable")
    user_of = left.local[by_user]
    per_user = np.bincount(left.local, weights=fan, minlength=left.ids.size).astype(np.int64)
    rows_per_user = np.bincount(left.local, minlength=left.ids.size)
    row_start = np.r_[0, np.cumsum(rows_per_user)]
    sparse = int(fan.sum()) * SPARSE < left.ids.size * n_right
    max_users = left.ids.size if sparse else max(1, MAX_CELLS // max(1, n_right))

    out_l, out_r = [], []
    u0 = 0
    n_left = left.ids.size
    while u0 < n_left:
        u1, budget = u0, 0
        while u1 < n_left and (u1 == u0 or (u1 - u0 < max_users and budget + per_user[u1] <= MAX_EXPANSION)):
            budget += per_user[u1]
            u1 += 1
        entries = by_user[row_start[u0]:row_start[u1]]
        owner = user_of[row_start[u0]:row_start[u1]] - u0
        counts = fan[entries]
        cells = (u1 - u0) * n_right
        acc, parts = None, []
        # expand in sub-batches of at most MAX_EXPANSION products (one entry expands to at most
        # one block of users), so a long row crossed with popular items stays within memory
        cum = np.cumsum(counts)
        start = 0
        while start < entries.size:
            base = cum[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(cum, base + MAX_EXPANSION, side="right")))
            sub, c = entries[start:end], counts[start:end]
            total = int(c.sum())
            if total:
                rep = np.repeat(np.arange(sub.size), c)
                offs = np.arange(total) - np.repeat(np.cumsum(c) - c, c)
                rpos = lo[sub][rep] + offs
                pair = owner[start:end][rep] * n_right + right.local_sorted[rpos]
                product = left.values[sub][rep] * right.values_sorted[rpos]
                if sparse:
                    parts.append(_summed(pair, product))
                else:
                    part = np.bincount(pair, weights=product, minlength=cells)
                    acc = part if acc is None else acc + part
            start = end
        if acc is not None:
            nz = np.flatnonzero(acc > 0)
            dot = acc[nz]
        elif parts:
            nz, dot = parts[0] if len(parts) == 1 else _summed(*(np.concatenate(x) for x in zip(*parts)))
            nz, dot = nz[dot > 0], dot[dot > 0]
        if acc is not None or parts:
            if nz.size:
                a = nz // n_right + u0
                b = nz % n_right
                sim = left.measure.similarity(dot, left.mass[a], right.mass[b])
                lid, rid = left.ids[a], right.ids[b]
                keep = lid != rid
                lid, rid, sim = lid[keep], rid[keep], sim[keep]
                sel = topk_per_owner(lid, rid, sim, k)
                out_l.append((lid[sel], rid[sel], sim[sel]))
                if right_topk:
                    sel = topk_per_owner(rid, lid, sim, k)
                    out_r.append((rid[sel], lid[sel], sim[sel]))
        u0 = u1

    def cat(parts):
        if not parts:
            e = np.empty(0, dtype=np.int64)
            return e, e, np.empty(0, dtype=np.float64)
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))

    res_l = cat(out_l)
    res_r = cat(out_r)
    if right_topk and res_r[0].size:
        sel = topk_per_owner(res_r[0], res_r[1], res_r[2], k)
        res_r = tuple(x[sel] for x in res_r)
    return res_l, res_r


PAIRS = pa.schema([("user_id", pa.int64()), ("neighbor_id", pa.int64()), ("similarity", pa.float64()), ("rank", pa.int64())])
PACKED = pa.schema([("gid", pa.int32()), ("items", pa.int32()), ("lefts", pa.int32()), ("rights", pa.int32()), ("data", pa.binary())])
PACK_ENTRIES = 2_000_000    # right entries packed at a time
CODEC = "zstd"


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: equal bytes come together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _from_planes(data: np.ndarray, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(data.reshape(width, -1).T).reshape(-1).view(dtype)


PLANES, SAME, SMALL = range(3)      # how a column is written: all its bytes, one value, or 32-bit whole numbers


def _encoded(x: np.ndarray) -> bytes:
    """A column of 64-bit values, in the shortest of the forms that give back every bit."""
    bits = x.view(np.int64)
    if x.size and np.all(bits == bits[0]):
        return bytes([SAME]) + bits[:1].tobytes()
    with np.errstate(invalid="ignore"):
        small = x.astype(np.int32)
    if np.array_equal(small.astype(x.dtype).view(np.int64), bits):
        return bytes([SMALL]) + _planes(small)
    return bytes([PLANES]) + _planes(x)


def _decoded(data: np.ndarray, n: int, dtype) -> tuple[np.ndarray, int]:
    """The ``n`` values of a column at the start of the data, and the bytes that it takes."""
    form = data[0]
    if form == SAME:
        return np.repeat(data[1:9].copy().view(dtype), n), 9
    width = 4 if form == SMALL else 8
    x = _from_planes(data[1:1 + width * n], np.int32 if form == SMALL else dtype)
    return x.astype(dtype, copy=False), 1 + width * n


def _packed(batches: list) -> pa.RecordBatch:
    """One row per group with the entries of all its items, compressed column by column; ids as differences."""
    table = pa.Table.from_batches(batches).combine_chunks()
    gid = table.column("gid").to_numpy()
    order = np.argsort(gid, kind="stable")
    gid, table = gid[order], table.take(order)
    cuts = np.flatnonzero(np.diff(gid)) + 1
    out = []
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), gid.size]):
        sizes, entries, counts = [], [], []
        for s in "lr":
            users, values, masses = (table.column(f"{s}_{c}").slice(lo, hi - lo).combine_chunks() for c in ("users", "values", "masses"))
            sizes.append(_planes(users.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)))
            ids = users.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            entries += [_encoded(np.diff(ids, prepend=np.int64(0))),
                        *(_encoded(c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) for c in (values, masses))]
            counts.append(ids.size)
        data = b"".join(sizes + entries)
        out.append((gid[lo], hi - lo, *counts, len(data).to_bytes(8, "little") + pa.compress(data, codec=CODEC, asbytes=True)))
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), PACKED)], schema=PACKED)


def pack_task(entries: int = PACK_ENTRIES):
    """Packs rows (``gid`` and the arrays of ``routed_task``) for the network: an entry takes a few bytes of its 24."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += len(batch.column("r_users").flatten())
            if n >= entries:
                yield _packed(held)
                held, n = [], 0
        if held:
            yield _packed(held)
    return run


def _unpacked(row: dict):
    """``(sizes, users, values, masses)`` of the left and of the right entries of a packed row."""
    n, packed = row["items"], row["data"]
    data = np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec=CODEC), np.uint8)
    sizes, data = np.split(data[:8 * n], 2), data[8 * n:]
    for i, count in enumerate((row["lefts"], row["rights"])):
        columns = []
        for dtype in (np.int64, np.float64, np.float64):
            column, taken = _decoded(data, count, dtype)
            columns.append(column)
            data = data[taken:]
        ids, values, masses = columns
        yield _from_planes(sizes[i], np.int32).astype(np.int64), np.cumsum(ids), values, masses


def routed_task(k: int, measure: Measure = COSINE):
    """Kernel for one group, packed: per item its entries in a left block and in a part of its buyers.

    The entries are arrays: ``l_users``, ``l_values``, ``l_masses`` and the same with ``r_``. The lists
    come in order with their ranks, which are final where the right side is in one part.
    """
    def run(table: pa.Table) -> pa.Table:
        pieces = [tuple(_unpacked(row)) for row in table.select(["items", "lefts", "rights", "data"]).to_pylist()]

        def side(i: int) -> tuple:
            sizes, *entries = (np.concatenate(x) for x in zip(*(piece[i] for piece in pieces)))
            return _Entries(*entries, measure), sizes
        (left, l_sizes), (right, r_sizes) = side(0), side(1)
        end = np.cumsum(r_sizes)
        (user, other, sim), _ = _scores(left, right, np.repeat(end - r_sizes, l_sizes), np.repeat(end, l_sizes), k, False)
        first = np.flatnonzero(np.r_[True, user[1:] != user[:-1]]) if user.size else np.empty(0, np.int64)
        rank = np.arange(1, user.size + 1) - np.repeat(first, np.diff(np.r_[first, user.size]))
        return pa.table([user, other, sim, rank], schema=PAIRS)
    return run
