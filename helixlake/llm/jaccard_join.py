"""Links between documents whose sets of word shingles are nearly equal, without loss.

Documents with equal sets form a class, found by a 128-bit fingerprint.  Two sets linked
at a similarity t share one of their first n - ceil(t n) + 1 shingles in any fixed order, so
classes are routed to buckets by these (hash order, with the most frequent shingles
last).  Each class then joins the family of one leader: the class that leads most of its
buckets, a bucket's leader being the class that meets most others in its buckets.  So a
group of near copies, however large, becomes one family, and its sets meet once.

- A family's classes are compared in one cell, or in cells of two tiles each if it is large.
  In a cell all are compared with the leader, then by a dual traversal of signature trees:
  nodes hold the OR of their classes' shingle bitmaps and the range of their sizes, and
  pairs of nodes are descended together, unless sizes or the largest possible overlap
  rule a link out or both hold one component.  What is left is compared on whole sets,
  if no link has joined it meanwhile; a cell gives fewer links than it has classes.
- Classes of different families and components that still share a bucket are compared the
  same way, by trees over the bucket's rows; only their pairs travel to be verified.

All comparisons use the 64-bit hashes of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm.common import discard, keep_cache, matching, slices, stored, table, text_or_empty, unique_ids
from helixlake.llm.graph import components

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
BITS = 2048  # of a class's bitmap in a bucket
TILE = 1_000_000  # shingles of a family's tile
ROWS = 20_000  # rows of a bucket's tile


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K[3]
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; words as in the contract."""
    keep_cache("words", _words.clear)
    if len(_words) > 200_000:
        _words.clear()
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: A-Z alone are lowered, ASCII white space alone splits
    counts = [len(w) for w in words]
    flat = np.fromiter((h for w in words for h in map(_words.__getitem__, w)), np.uint64, sum(counts))
    rolled = np.zeros(max(0, len(flat) - width + 1), np.uint64)
    for i in range(width):
        rolled = _mixed(rolled + _K[i % 4]) + flat[i : len(flat) - width + 1 + i] if len(flat) >= width else rolled
    rolled = _mixed(rolled)
    out, at = [], 0
    for n in counts:
        if n >= width:
            s = np.sort(rolled[at : at + n - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            x = np.full(1, n, np.uint64)
            for h in flat[at : at + n]:
                x = _mixed(x + _K[0]) + h
            out.append(_mixed(x))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def fingerprint(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def index_length(n: int, percent: int) -> int:
    """The first of two linked sets' common shingles is among so many of the smaller one's."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for part in slices(batches, 1):
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _longs(*columns: object) -> list[pa.Array]:
    return [pa.array(c, pa.int64()) for c in columns]


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, mark, n) of all documents, and (shingle, times) of those that are met twice in a task's part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[np.ndarray] = []
        seen: set[bytes] = set()

        def common() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(met) if met else np.zeros(0, np.uint64), return_counts=True)
            tokens, times = tokens[times > 1], times[times > 1]
            nothing = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([nothing, pa.nulls(len(tokens), pa.binary()), nothing, pa.array(tokens.view(np.int64)), pa.array(times)], names)

        for ids, texts in _blocks(batches):
            sets = shingle_sets(texts, width)
            marks = [fingerprint(s) for s in sets]
            for s, m in zip(sets, marks, strict=True):
                if m not in seen:
                    seen.add(m)
                    met.append(s[: 2 * prefix_length(len(s), percent)])
            nothing = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), nothing, nothing], names)
            if sum(map(len, met)) > 1_000_000:
                yield common()
                met, seen = [], set()
        yield common()

    names = ["doc_id", "mark", "n", "shingle", "times"]
    return docs.mapInArrow(work, "doc_id bigint, mark binary, n bigint, shingle bigint, times bigint")


def _routes(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(shingle, doc_id, n, early) of the first shingles that documents of like size share; those in ``frequent`` come last in the order.

    A task sends one document of each set; early tells that the shingle is within the
    document's index_length.  Of two linked documents the smaller one has their first common
    shingle early, so a row stays only if it is early with a document as large or larger
    behind it, or has an early one as small or smaller before it.  The rows are
    shuffled once, by shingle and size, and looked at as they stream by.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for ids, texts in _blocks(batches):
            if len(seen) > 200_000:
                seen = set()
            tokens, owners, sizes, early = [], [], [], []
            for i, s in zip(ids, shingle_sets(texts, width), strict=True):
                mark = fingerprint(s)
                if not len(s) or mark in seen:
                    continue
                seen.add(mark)
                n, p = len(s), prefix_length(len(s), percent)
                if len(frequent):
                    late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                    s = np.concatenate([s[~late][:p], s[late][:p]])[:p]
                tokens.append(s[:p])
                owners.append(np.full(p, i, np.int64))
                sizes.append(np.full(p, n, np.int32))
                early.append(np.arange(p) < index_length(n, percent))
            if tokens:
                yield pa.RecordBatch.from_arrays([*_longs(np.concatenate(tokens).view(np.int64), np.concatenate(owners)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(early))], names)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row, which waits for the next batch
        sure = False  # whether that row is known to stay
        key, small = None, -1  # the shingle and the size of its last early row
        for batch in batches:
            if not len(batch):
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            k, o, n, e = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            same = k[1:] == k[:-1]
            keep = np.zeros(len(k), bool)
            keep[0] = sure
            near = same & (100 * n[:-1] >= percent * n[1:])
            keep[:-1] |= near & (e[:-1] | (e[1:] & (n[1:] == n[:-1])))
            # The last early row before each row, of the same shingle; sizes ascend within one.
            at = np.maximum.accumulate(np.where(e, np.arange(len(k)), -1))
            before = np.concatenate([[-1], at[:-1]])
            begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(k)), 0))
            size = np.where(before >= begin, n[np.maximum(before, 0)].astype(np.int64), np.where((begin == 0) & (k == key), small, -1))
            keep |= (size >= 0) & (100 * size >= percent * n)
            last = len(k) - 1
            out = keep[:last]
            if out.any():
                yield pa.RecordBatch.from_arrays([*_longs(k[:last][out], o[:last][out]), pa.array(n[:last][out]), pa.array(e[:last][out])], names)
            if before[last] >= begin[last]:
                small = int(n[before[last]])
            elif not (begin[last] == 0 and k[last] == key):
                small = -1
            held, sure, key = [c[last:] for c in (k, o, n, e)], bool(keep[last]), k[last]
        if held is not None and sure:
            k, o, n, e = held
            yield pa.RecordBatch.from_arrays([*_longs(k, o), pa.array(n), pa.array(e)], names)

    names = ["shingle", "doc_id", "n", "early"]
    kinds = "shingle bigint, doc_id bigint, n int, early boolean"
    return docs.mapInArrow(send, kinds).repartition("shingle").sortWithinPartitions("shingle", "n").mapInArrow(several, kinds)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, np.uint8)
    out[(s % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two sorted runs are merged
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class SignatureTree:
    """Classes in leaves, leaves in nodes: OR of bitmaps, range of sizes, most hidden shingles, one component and family or none.

    Leaves are in the order of family, component and size.  A hidden shingle shares its bit
    with another one of its set.
    """

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, component: np.ndarray, family: np.ndarray, early: np.ndarray | None = None, fan: int = 8):
        self.order = np.lexsort((sizes, component, family))
        self.early = np.ones(len(sizes), bool) if early is None else early[self.order]
        words = np.ascontiguousarray(bitmaps[self.order]).view(np.uint64)
        n = sizes[self.order].astype(np.int64)
        hidden = n - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        self.fan, self.levels = fan, [(words, n, n, hidden, component[self.order], family[self.order])]
        while len(n := self.levels[-1][1]) > 1:
            w, low, high, h, *marks = self.levels[-1]
            at = np.arange(0, len(n), fan)
            ends = [(np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)) for c in marks]
            pure = [np.where((lo == hi) & (lo >= 0), lo, -1) for lo, hi in ends]
            self.levels.append((np.bitwise_or.reduceat(w, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(h, at), *pure))

    def _level(self, k: int) -> tuple[np.ndarray, ...]:
        return self.levels[min(k, len(self.levels) - 1)]

    def pairs(self, other: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs (of this tree, of the other) that may be linked, by descending from both roots together; with itself, each pair once."""
        top, same = np.zeros(1, np.int64), other is self
        depth = max(len(self.levels), len(other.levels))
        todo = [(depth, top, top)]  # pairs of nodes whose children are to be paired, depth first
        steps = np.arange(self.fan)
        while todo:
            level, a, b = todo.pop()
            level -= 1
            (w, low, high, hidden, comp, fam), (w2, low2, high2, hidden2, comp2, fam2) = self._level(level), other._level(level)
            if level < depth - 1:
                x = (a[:, None] * self.fan + steps).repeat(self.fan, axis=1).ravel()
                y = np.tile(b[:, None] * self.fan + steps, (1, self.fan)).ravel()
                ok = (x < len(low)) & (y < len(low2))
                a, b = x[ok], y[ok]
            if same:
                ok = a <= b if level else a < b
                a, b = a[ok], b[ok]
            keep = (100 * high[a] >= percent * low2[b]) & (100 * high2[b] >= percent * low[a])
            keep &= ~((comp[a] == comp2[b]) & (comp[a] >= 0)) & ~((fam[a] == fam2[b]) & (fam[a] >= 0))
            a, b = a[keep], b[keep]
            most = np.minimum(hidden[a], hidden2[b])
            step = max(1, 1_000_000 // w.shape[1])
            for k in range(0, len(a), step):
                most[k : k + step] += np.bitwise_count(w[a[k : k + step]] & w2[b[k : k + step]]).sum(axis=1, dtype=np.int64)
            keep = (100 + percent) * most >= percent * (low[a] + low2[b])
            a, b = a[keep], b[keep]
            if level == 0:
                keep = self.early[a] & (low[a] <= low2[b]) | other.early[b] & (low2[b] <= low[a])
                if keep.any():
                    yield self.order[a[keep]], other.order[b[keep]]
                continue
            todo += [(level, a[k : k + 512], b[k : k + 512]) for k in range(0, len(a), 512)]


def _by_key(batches: Iterator[pa.RecordBatch], keys: int, take) -> Iterator[tuple[tuple, list]]:
    """(key, rows) of runs of equal keys in the first columns; ``take`` makes rows of a part of a batch."""
    now, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        key = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            mine = tuple(k[x].item() for k in key)
            if held and mine != now:
                yield now, held
                held = []
            now = mine
            held += take(batch.slice(x, y - x))
    if held:
        yield now, held


def cell_links(sets: list[np.ndarray], tile: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what is linked among a cell's sets: of the first one, the leader, with all, and of different tiles, or within the one."""
    n = np.array([len(s) for s in sets], np.int64)
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)[:-1]])
    lead = sets[0]
    shared = np.add.reduceat(lead[np.minimum(np.searchsorted(lead, flat), len(lead) - 1)] == flat, starts, dtype=np.int64)
    near = 100 * shared >= percent * (n + n[0] - shared)
    near[0] = False
    links = [(0, int(i)) for i in np.flatnonzero(near)]
    root = np.arange(len(sets))
    root[near] = 0
    if near.sum() == len(sets) - 1:
        return links
    bits = 1 << max(10, int(32 * n.max()).bit_length())
    maps = np.stack([bitmap(s, bits) for s in sets])
    rest = [np.flatnonzero(tile[1:] == t) + 1 for t in np.unique(tile[1:])]
    none = np.full(len(sets), -1)
    trees = [SignatureTree(n[at], maps[at], root[at], none[at]) for at in rest]
    one, other = (0, 0) if len(rest) == 1 else (0, 1)
    for i, j in trees[one].pairs(trees[other], percent):
        i, j = rest[one][i], rest[other][j]
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if root[a] != root[b] and linked(sets[a], sets[b], percent):
                links.append((a, b))
                root[root == root[b]] = root[a]
    return links


def _family_links(texts: DataFrame, families: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of one family (class, n, family) that join all that are linked."""
    sizes = stored(families.groupBy("family").agg(F.expr(f"cast(ceil(sum(n) / {TILE}) as int)").alias("tiles"), F.count("*").alias("k")).filter("k > 1").drop("k"), "tiles")
    cells = families.join(sizes.hint("merge"), "family").withColumn("tile", F.expr("cast(pmod(xxhash64(class), tiles) as int)")).withColumn("leader", F.col("class") == F.col("family"))
    every = "flatten(transform(sequence(0, tiles - 1), x -> transform(sequence(x, tiles - 1), y -> struct(x AS x, y AS y))))"
    own = "transform(sequence(0, tiles - 1), u -> struct(least(u, tile) AS x, greatest(u, tile) AS y))"
    cells = stored(cells.select("class", "family", "tile", "leader", "tiles"), "cells")
    held = matching(texts, "doc_id", cells, "class", ("family", "tile", "leader", "tiles"))
    rows = held.withColumn("cell", F.explode(F.expr(f"CASE WHEN leader THEN {every} ELSE {own} END"))).select("family", "cell.x", "cell.y", "leader", "tile", F.col("doc_id").alias("class"), "t")

    def take(part: pa.RecordBatch) -> list:
        tiles, names, at, out = *(part.column(i).to_pylist() for i in (4, 5)), 0, []
        for _, ts in _blocks([part.select([5, 6])]):
            out += zip(tiles[at : at + len(ts)], names[at : at + len(ts)], shingle_sets(ts, width), strict=True)
            at += len(ts)
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_key(batches, 3, take):
            if len(held) > 1:
                names = np.array([name for _, name, _ in held])
                links = cell_links([s for _, _, s in held], np.array([t for t, _, _ in held]), percent)
                if links:
                    a, b = np.array(links).T
                    yield pa.RecordBatch.from_arrays(_longs(names[a], names[b]), ["a", "b"])

    cell = ["family", "x", "y"]
    return stored(rows.repartition(*cell).sortWithinPartitions(*cell, F.desc("leader")).mapInArrow(work, "a bigint, b bigint"), "links")


def _tree_pairs(open_routes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Class pairs (a, b), a > b, with the family of a, of different families and components that no signature tree of a bucket rules out."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([*_longs(ids), pa.array([bitmap(s, BITS).tobytes() for s in shingle_sets(ts, width)], pa.binary())], ["class", "bitmap"])

    classes = stored(open_routes.select("class").distinct(), "active")
    bitmaps = matching(texts, "doc_id", classes, "class").mapInArrow(maps, "class bigint, bitmap binary")
    tiles = stored(open_routes.groupBy("shingle").agg(F.expr(f"cast(ceil(count(*) / {ROWS}) as int)").alias("tiles")), "tiles")
    rows = open_routes.join(tiles.hint("merge"), "shingle").withColumn("tile", F.expr("cast(pmod(xxhash64(class), tiles) as int)"))
    rows = rows.join(bitmaps.hint("merge"), "class").withColumn("u", F.explode(F.expr("sequence(0, tiles - 1)")))
    rows = rows.select("shingle", F.least("u", "tile").alias("x"), F.greatest("u", "tile").alias("y"), "tile", "class", "n", "component", "family", "early", "bitmap")

    def take(part: pa.RecordBatch) -> list:
        return [[*(part.column(i).to_numpy(zero_copy_only=False) for i in range(3, 9)), np.frombuffer(b"".join(part.column(9).to_pylist()), np.uint8).reshape(len(part), -1)]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_key(batches, 3, take):
            tile, names, sizes, component, family, early, maps_ = (np.concatenate(c) for c in zip(*held, strict=True))
            parts = [np.flatnonzero(tile == t) for t in np.unique(tile)]
            comp, fam = (np.unique(c, return_inverse=True)[1].astype(np.int64) for c in (component, family))
            trees = [SignatureTree(sizes[at], maps_[at], comp[at], fam[at], early[at]) for at in parts]
            for i, j in trees[0].pairs(trees[-1], percent):
                i, j = parts[0][i], parts[-1][j]
                high = names[i] > names[j]
                yield pa.RecordBatch.from_arrays(_longs(np.where(high, names[i], names[j]), np.where(high, names[j], names[i]), np.where(high, family[i], family[j])), ["a", "b", "bucket"])

    cell = ["shingle", "x", "y"]
    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(work, "a bigint, b bigint, bucket bigint").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, bucket) of classes whose whole sets are linked.

    A bucket's pairs are cut into cells of about a thousand classes on each side, and each
    text is sent once to each cell that compares it, so that neither a class with very many
    partners nor a large bucket meets in one task.
    """
    wide = stored(pairs.groupBy("bucket").agg(*[F.ceil(F.approx_count_distinct(c) / 1000).alias(f"n_{c}") for c in "ab"]), "wide")
    part = lambda c: F.pmod(F.xxhash64(c), F.greatest(F.lit(1), F.col(f"n_{c}")))
    dealt = pairs.join(wide.hint("merge"), "bucket").select("bucket", part("a").alias("x"), part("b").alias("y"), "a", "b")
    cell = ["bucket", "x", "y"]
    need = dealt.select(*cell, F.explode(F.array("a", "b")).alias("class")).distinct()
    classes = stored(need.select("class").distinct(), "needed")
    sets = matching(texts, "doc_id", classes, "class").select(F.col("doc_id").alias("class"), "t")
    held = need.join(sets.hint("merge"), "class").select(*cell, F.lit(0).alias("kind"), F.col("class").alias("a"), F.lit(0).cast("long").alias("b"), "t")
    rows = held.unionByName(dealt.select(*cell, F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("t")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            for *key, kind, a, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, mine = key, {}
                if kind == 0:  # the texts of a cell come first
                    mine[a] = shingle_sets([t], width)[0]
                elif linked(mine[a], mine[b], percent):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays(_longs(*zip(*found, strict=True)), ["a", "b"])

    return stored(rows.repartition(*cell).sortWithinPartitions(*cell, "kind").mapInArrow(work, "a bigint, b bigint"), "links")


def _families(routes: DataFrame, percent: int) -> DataFrame:
    """(class, n, family) of all classes of the routes; a family is named by its leader, a class of like size."""
    score = routes.groupBy("class").agg(F.sum("others").alias("score"))
    lead = routes.join(score, "class").groupBy("shingle").agg(F.max(F.struct("score", (-F.col("class")).alias("first"), F.col("class").alias("lead"), F.col("n").alias("size"))).alias("best"))
    like = 100 * F.least("n", "best.size") >= percent * F.greatest("n", "best.size")
    votes = routes.join(stored(lead, "lead").hint("merge"), "shingle").groupBy("class", F.when(like, F.col("best.lead")).otherwise(F.col("class")).alias("lead")).agg(F.count("*").alias("votes"), F.max("n").alias("n"), F.max("best.score").alias("score"))
    chosen = votes.groupBy("class").agg(F.max("n").alias("n"), F.max(F.struct("votes", "score", (-F.col("lead")).alias("first"), F.col("lead").alias("family"))).alias("best"))
    chosen = stored(chosen.select("class", "n", F.col("best.family").alias("family")), "chosen")
    # A leader that follows another one stays with its own family.
    leads = stored(chosen.select("family").distinct(), "leads")
    return stored(chosen.join(leads.select(F.col("family").alias("class"), F.lit(True).alias("leads")), "class", "left").select("class", "n", F.when(F.col("leads"), F.col("class")).otherwise(F.col("family")).alias("family")), "families")


def _grouped(texts: DataFrame, width: int, percent: int, frequent_most: int) -> DataFrame:
    """doc_id, n_shingles, component_id of (doc_id, t); the ids are unique and not null."""
    met = stored(_classes(texts, width, percent), "classes")
    members = met.filter("mark IS NOT NULL").select("doc_id", "mark", "n")
    often = met.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times")).filter("times >= 32")
    # A fixed number of the most frequent shingles, at most 1 MB; only their place in the order depends on it.
    top = often.orderBy(F.desc("times"), "shingle").limit(frequent_most).toPandas()["shingle"].to_numpy(np.int64)
    first = stored(members.groupBy("mark").agg(F.min("doc_id").alias("class")), "first")
    named = stored(members.join(first.hint("merge"), "mark").select("doc_id", "class", "n"), "members")
    sent = _routes(texts, width, percent, np.sort(top.view(np.uint64)))
    sent = stored(sent.join(named.select("doc_id", "class").hint("merge"), "doc_id").groupBy("shingle", "class").agg(F.max("n").cast("long").alias("n"), F.max("early").alias("early")), "sent")
    full = stored(sent.groupBy("shingle").agg((F.count("*") - 1).alias("others")).filter("others > 0"), "full")
    routes = stored(sent.join(full.hint("merge"), "shingle"), "routes")
    discard(met, first, sent, full)
    families = _families(routes, percent)
    links = _family_links(texts, families, width, percent)
    found = components(links).select(F.col("node").alias("class"), "component")
    marked = routes.join(families.select("class", "family"), "class").join(found, "class", "left").select("shingle", "class", "n", "early", "family", F.coalesce("component", "class").alias("component"))
    marked = stored(marked, "marked")
    ends = [f(c).alias(f"{name}_{c}") for c in ("family", "component") for name, f in (("low", F.min), ("high", F.max))]
    several = stored(marked.groupBy("shingle").agg(*ends).filter("low_family < high_family AND low_component < high_component").select("shingle"), "several")
    left = stored(marked.join(several.hint("merge"), "shingle"), "open")
    discard(routes, families, marked, several)
    pairs = stored(_tree_pairs(left, texts, width, percent), "pairs")
    links = links.unionByName(_verified(pairs, texts, width, percent))
    found = components(links).select(F.col("node").alias("class"), "component")
    # A class is named by its smallest document, so the smallest class is the smallest document.
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "class"))
    return named.join(found, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80, frequent_most: int = 1 << 17) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reached by links) for every row.

    A document's set: distinct shingles of ``width`` words, A-Z lowered; with fewer words
    the whole sequence; none without words or text, and then no links.  Sets link where
    100 * intersection >= percent * union.  All links count: leaders, families and the order
    of shingles change only how much is compared.  Rows that share an id, or have none, are
    documents of their own; the smallest id is that of any row reached, null if none has
    one.  No rows in, no rows out; further columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("t"))
    if unique_ids(rows, "doc_id"):
        return _grouped(rows, width, percent, frequent_most)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = _grouped(rows.select(F.col("row").alias("doc_id"), "t"), width, percent, frequent_most).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("group"))
    known = stored(found.join(rows.select("row", "doc_id"), "row"), "known")
    least = stored(known.groupBy("group").agg(F.min("doc_id").alias("component_id")), "least")
    return known.join(least.hint("merge"), "group").select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80, frequent_most: int = 1 << 17) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id.

    Of several rows with that id, or where no row has one, any one row stays.
    """
    if unique_ids(docs, doc_id):
        stay = near_duplicates(docs, text, doc_id, width, percent, frequent_most).filter("doc_id = component_id").select(F.col("doc_id").alias("_keep"))
        return docs.join(stay.hint("merge"), docs[doc_id] == stay["_keep"], "left_semi")
    rows = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("t"), F.monotonically_increasing_id().alias("row")), "rows")
    found = _grouped(rows.select(F.col("row").alias("doc_id"), "t"), width, percent, frequent_most).select(F.col("doc_id").alias("row"), "component_id")
    best = found.join(rows.select("row", "id"), "row").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"))
    stay = best.select(F.col("best.row").alias("row"))
    return rows.join(stay.hint("merge"), "row", "left_semi").select("doc.*")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLE: dict[str, str] = {}
