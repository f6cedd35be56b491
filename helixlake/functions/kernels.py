"""Dense work on small arrays in numpy; no Spark here."""

from __future__ import annotations

import numpy as np


def pair_blocks(codes: np.ndarray, letters: int, block: int = 24):
    """Co-occurrence counts of columns of an (rows, columns) array of letter codes, -1 for none.

    Yields (i, j, a, b, n) arrays for columns i < j and n > 0, a block of column pairs at a
    time, from products of one-hot matrices.
    """
    width = codes.shape[1]

    def one_hot(begin: int, end: int) -> np.ndarray:
        part = codes[:, begin:end, None] == np.arange(letters)
        return part.reshape(len(codes), -1).astype(np.float32)

    for x in range(0, width, block):
        left = one_hot(x, min(width, x + block))
        for y in range(x, width, block):
            n = np.rint(left.T @ (left if x == y else one_hot(y, min(width, y + block)))).astype(np.int64)
            r, c = np.nonzero(n)
            i, j = x + r // letters, y + c // letters
            ok = i < j
            if ok.any():
                yield i[ok], j[ok], r[ok] % letters, c[ok] % letters, n[r[ok], c[ok]]


def letter_bits(strings, letters: str) -> np.ndarray:
    """Bitmaps (position, letter, words of 64 sequences) of an Arrow array of ASCII strings; other characters set no bit."""
    strings = strings.drop_null()
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    lengths = np.diff(ends)
    text = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(strings) else np.zeros(0, np.uint8)
    width, words = int(lengths.max(initial=0)), -(-len(strings) // 64)
    grid = np.zeros((width, words * 64), np.uint8)
    for at in range(0, len(strings), 1 << 14):  # indices are wider than letters, so few at a time
        n = lengths[at : at + (1 << 14)]
        begin = ends[at : at + len(n)] - ends[0]
        part = text[begin[0] : begin[-1] + n[-1]]
        grid[np.arange(len(part)) - np.repeat(begin - begin[0], n), np.repeat(np.arange(at, at + len(n)), n)] = part
    bits = np.empty((width, len(letters), words), np.uint64)
    for a, letter in enumerate(letters.encode()):
        bits[:, a] = np.packbits(grid == letter, axis=1).view(np.uint64)
    return bits


def shared_bits(bits: np.ndarray, words: int = 1024):
    """Sequences that two (position, letter) bitmaps share, counted ``words`` at a time.

    Yields (i, j, a, b, n) arrays of positions i <= j and letters with n > 0, for one i at a time.
    """
    width, letters, size = bits.shape
    for i in range(width):
        n = np.zeros((width - i, letters, letters), np.int64)
        for at in range(0, size, words):
            right = bits[i:, :, at : at + words]
            for a in range(letters):
                n[:, a] += np.bitwise_count(right & right[0, a]).sum(axis=2, dtype=np.int64)
        j, a, b = np.nonzero(n)
        yield np.full(len(j), i), j + i, a, b, n[j, a, b]


def pair_tables(grid: np.ndarray, letters: int):
    """Counts of letter pairs for positions i < j, from a grid (position, sequence) of letters from 1; 0 is none.

    Yields (i, j, table of letters x letters). Of many sequences two pairs of positions are counted at
    once, and four tables are sums of that count.
    """
    (width, size), base = grid.shape, letters + 1
    if size * 8 < base**4:
        for i in range(width):
            left = grid[i].astype(np.intp) * base
            for j in range(i + 1, width):
                yield i, j, np.bincount(left + grid[j], minlength=base**2).reshape(base, base)[1:, 1:]
        return
    codes = grid[0::2].astype(np.uint32) * base
    codes[: width // 2] += grid[1::2]
    for p in range(len(codes)):
        left = codes[p].astype(np.intp)
        if 2 * p + 1 < width:
            yield 2 * p, 2 * p + 1, np.bincount(left, minlength=base**2).reshape(base, base)[1:, 1:]
        left *= base**2
        for q in range(p + 1, len(codes)):
            n = np.bincount(left + codes[q], minlength=base**4).reshape(base, base, base, base)
            for a in range(min(2, width - 2 * p)):
                part = n.sum(axis=1 - a)
                for b in range(min(2, width - 2 * q)):
                    yield 2 * p + a, 2 * q + b, part.sum(axis=2 - b)[1:, 1:]


def repeated_pairs(seq: np.ndarray, pos: np.ndarray, letter: np.ndarray, letters: int, most: int = 1 << 22):
    """The same from entries (sequence, position, letter from 0) that may occur several times: each meets every one of its sequence at another position.

    Yields (i, j, a, b, n) arrays, of about ``most`` pairs at a time.
    """
    if not len(seq):
        return
    span = (int(pos.max()) + 1) * letters
    key, times = np.unique(seq.astype(np.int64) * span + pos * letters + letter, return_counts=True)
    seq, cell = np.divmod(key, span)
    after = np.searchsorted(seq, seq, side="right") - np.arange(len(seq)) - 1
    before = np.concatenate([[0], np.cumsum(after)])
    low = 0
    while low < len(seq):
        high = max(low + 1, int(np.searchsorted(before, before[low] + most, side="right")) - 1)
        left = np.repeat(np.arange(low, high), after[low:high])
        right = left + 1 + np.arange(len(left)) - (before[left] - before[low])
        apart = cell[left] // letters != cell[right] // letters
        left, right = left[apart], right[apart]
        pair, at = np.unique(cell[left] * span + cell[right], return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, at, times[left] * times[right])
        x, y = np.divmod(pair, span)
        yield x // letters, y // letters, x % letters, y % letters, n
        low = high


def mutual_information_dense(codes: np.ndarray, letters: int, least: int = 10) -> np.ndarray:
    """The scores over all cells, for tests of the sparse form."""
    width = codes.shape[1]
    hot = codes[:, :, None] == np.arange(letters)
    freq = (hot.sum(0) + 1) / (hot.sum((0, 2))[:, None] + letters)
    out = np.zeros((width, width))
    for i in range(width):
        for j in range(i + 1, width):
            n = hot[:, i].astype(float).T @ hot[:, j].astype(float)
            if n.sum() >= least:
                p = (n + 1 / letters) / (n.sum() + 1)
                out[i, j] = out[j, i] = (p * np.log(p / np.outer(freq[i], freq[j]))).sum()
    return out


def cosine_basis(n: int) -> np.ndarray:
    """Rows k of the orthonormal cosine transform of type II over n points."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt(2 / n)
    basis[0] = np.sqrt(1 / n)
    return basis


def cosine_transform(x: np.ndarray) -> np.ndarray:
    """Orthonormal cosine transform of type II along the second axis of (series, n, dim), by a Fourier transform of the reordered points."""
    n = x.shape[1]
    ordered = np.concatenate([x[:, ::2], x[:, 1::2][:, ::-1]], axis=1)
    turned = np.fft.fft(ordered, axis=1) * np.exp(-0.5j * np.pi * np.arange(n) / n)[None, :, None]
    out = turned.real * np.sqrt(2 / n)
    out[:, 0] /= np.sqrt(2)
    return out


def average_linkage_split(distance: np.ndarray) -> np.ndarray:
    """Two groups (0 holds the first point) by average linkage; distances equal to 12 places merge the lowest indices first."""
    n = len(distance)
    group = np.arange(n)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    while alive.sum() > 2:
        live = np.flatnonzero(alive)
        part = d[np.ix_(live, live)].round(12)
        k = int(np.argmin(part))
        i, j = sorted((live[k // len(live)], live[k % len(live)]))
        mean = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = mean, mean
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        group[group == j] = i
    return (group != group[0]).astype(int)


def average_linkage_splits(distance: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """``average_linkage_split`` of many groups at once: (groups, points), -1 where not alive.

    ``distance`` (groups, points, points), ``alive`` flags each group's points.  Each step merges
    one pair in every group that has more than two clusters left.  Distances are compared to 12
    places, so that equal ones are ties whatever order their terms were added in.
    """
    groups, n = alive.shape
    d = np.where(alive[:, :, None] & alive[:, None, :], distance.astype(float), np.inf)
    d[:, np.arange(n), np.arange(n)] = np.inf
    size, label = alive.astype(float), np.where(alive, np.arange(n), -1)
    left = alive.sum(1)
    while (open_ := np.flatnonzero(left > 2)).size:
        i, j = np.unravel_index(d[open_].round(12).reshape(len(open_), -1).argmin(1), (n, n))
        i, j = np.minimum(i, j), np.maximum(i, j)
        a, b = size[open_, i][:, None], size[open_, j][:, None]
        x, y = d[open_, i], d[open_, j]
        known = np.isfinite(x) & np.isfinite(y)
        mean = np.full(x.shape, np.inf)
        np.divide(np.where(known, x, 0) * a + np.where(known, y, 0) * b, a + b, out=mean, where=known)
        d[open_, i], d[open_, :, i] = mean, mean
        d[open_, j], d[open_, :, j] = np.inf, np.inf
        size[open_, i] += size[open_, j]
        label[open_] = np.where(label[open_] == j[:, None], i[:, None], label[open_])
        left[open_] -= 1
    first = np.where(alive.any(1), label[np.arange(groups), alive.argmax(1)], -1)
    return np.where(alive, (label != first[:, None]).astype(int), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)


def split_heads(vectors: np.ndarray, limit: float = 0.15, active: float = 0.1, least: float = 1.0) -> list:
    """Two nearly orthogonal groups of the heads of each of many layers (layers, heads, dim), or None for a layer.

    Heads above ``active`` (four or more) are split by average linkage on 1 - cosine; both
    summed vectors reach ``least`` and their cosine stays within ``limit``.  A layer's result is
    (isolated, main, cosine, isolated norm, main norm); the smaller group is isolated, on
    equal sizes that of the lowest head.
    """
    live = np.linalg.norm(vectors, axis=2) > active
    live &= live.sum(1)[:, None] >= 4
    u = vectors / (np.linalg.norm(vectors, axis=2, keepdims=True) + 1e-10)
    side = average_linkage_splits(np.clip(1 - u @ u.transpose(0, 2, 1), 0, 2), live)
    sums = [(np.where(side[:, :, None] == k, vectors, 0)).sum(1) for k in (0, 1)]
    norms, counts = [np.linalg.norm(x, axis=1) for x in sums], [(side == k).sum(1) for k in (0, 1)]
    out: list = []
    for g in range(len(vectors)):
        small = int(counts[1][g] < counts[0][g])
        n, big = norms, 1 - small
        if not counts[0][g] or not counts[1][g] or min(n[0][g], n[1][g]) < least:
            out.append(None)
            continue
        cos = float(sums[0][g] @ sums[1][g] / (n[0][g] * n[1][g]))
        ok = abs(cos) <= limit
        out.append((np.flatnonzero(side[g] == small), np.flatnonzero(side[g] == big), cos, float(n[small][g]), float(n[big][g])) if ok else None)
    return out


def anchor_split(vectors: np.ndarray):
    """Magnitudes, cosines to the centroid and the split around the most isolated head of one layer.

    Returns None where no head reaches 0.01; the split is None where the lowest cosine is not
    below 0.1, the anchor's magnitude not above 0.5, or a group is empty.
    """
    size = np.linalg.norm(vectors, axis=1)
    if size.max(initial=0) < 0.01:
        return None
    centre = vectors.mean(0)
    norm = np.linalg.norm(centre)
    cos = np.where((size > 0.01) & (norm > 0), vectors @ centre / np.maximum(size * norm, 1e-300), 0.0)
    anchor = int(cos.argmin())
    split = None
    if cos[anchor] < 0.1 and size[anchor] > 0.5:
        near = vectors @ vectors[anchor] / np.maximum(size * size[anchor], 1e-300)
        inside = np.where(size > 0.01, near, 0.0) > 0.3
        inside[anchor] = True
        if not inside.all():
            x, y = vectors[inside].sum(0), vectors[~inside].sum(0)
            nx, ny = np.linalg.norm(x), np.linalg.norm(y)
            split = (anchor, np.flatnonzero(inside), np.flatnonzero(~inside), float(x @ y / (nx * ny)) if nx > 0 and ny > 0 else 0.0, float(nx), float(ny))
    return size, cos, split


def consistent_core(groupings: list[tuple[set[int], set[int]]], least: float = 0.20, detections: int = 3, times: np.ndarray | None = None):
    """(heads, consistency) that stay in one group, or None; a grouping counts as often as ``times`` says.

    Heads of at least half the detections (three or more) are cut in two by average linkage on
    1 - frequency of being together; the more consistent group is taken, the smaller one if
    both reach ``least``; then heads are removed while that raises the consistency.
    """
    n = np.ones(len(groupings)) if times is None else np.asarray(times, float)
    total = n.sum()
    if total < detections:
        return None
    every = sorted(set().union(*[set(a) | set(b) for a, b in groupings]))
    side = np.array([[[h in group for h in every] for group in pair] for pair in groupings], float).transpose(1, 0, 2)  # group, grouping, head
    often = n @ (side[0] + side[1])
    kept = np.flatnonzero(2 * often >= total)
    if len(kept) < 3:
        return None
    side = side[:, :, kept]
    whole = side[0] + side[1]
    both, same = (whole * n[:, None]).T @ whole, sum((x * n[:, None]).T @ x for x in side)
    far = 1 - np.divide(same, both, out=np.zeros_like(same), where=both > 0)
    np.fill_diagonal(far, 0)
    cut = average_linkage_split(far)

    def together(core: np.ndarray) -> float:
        return float(n @ (side[:, :, core].all(2).any(0)) / total)

    groups = [np.flatnonzero(cut == k) for k in (0, 1)]
    scores = [together(g) for g in groups]
    if all(s >= least for s in scores):
        core = min(groups, key=len)
    else:
        core = groups[0] if scores[0] >= scores[1] else groups[1]
    now = together(core)
    while len(core) > 2:
        best, gain = None, 0.0
        for h in core:
            more = together(core[core != h]) - now
            if more > gain:
                best, gain = h, more
        if best is None or now >= 0.8 and gain < 0.05:
            break
        core = core[core != best]
        now += gain
    return ([every[kept[h]] for h in core], now) if now >= least else None


def best_of_rows(scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``most`` largest scores of each row, and of all that equal the last of them."""
    most = min(most, scores.shape[1])
    last = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
    return np.nonzero(scores >= last[:, None])
