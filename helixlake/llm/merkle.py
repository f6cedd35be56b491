"""A Merkle tree per group of rows and one over the groups, with proofs for all rows.

Rows are leaves; every 8 consecutive nodes have a parent.  Only every third level is stored
(an aligned subtree of up to 512 stored nodes lies below each node of the next stored
level), the levels between are computed and dropped.  Proofs go down from the top: per
stored level an aligned subtree is put together from its stored nodes, the interior
nodes are computed again, each node gets the siblings on its way up through the subtree,
followed by those of the subtree's own root, and the interior nodes are gone with the row.
The siblings of higher levels are joined once per subtree, not once per leaf.

A subtree has at most 512 nodes, whatever the groups' sizes, so a group with a third of all
rows is spread over all tasks.  All work is in DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixlake.llm.common import discard, stored, table

FAN, STEPS = 8, 3
BLOCK = FAN**STEPS
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATH = "array<struct<before: string, after: string>>"


def digest(text: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the text's UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def field_code(value: Column) -> Column:
    """``-`` for null, otherwise the number of bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(F.concat(*[field_code(v) for v in values]))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def parents(nodes: Column) -> Column:
    """Digests of runs of FAN consecutive nodes; one node remains as it is."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), lambda k: digest(F.array_join(F.slice(nodes, k * FAN + 1, FAN), "")))
    return F.when(F.size(nodes) > 0, runs)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds rank (from 0, by ``order`` within the group) and size (of the group); stored, rows without order among equals.

    Rows are sorted by ranges, so that neither a group nor a key that many rows share has to
    lie in one task: equal rows are told apart by a number.  Ranks come from the ranges'
    counts, a row per range and group.
    """
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    by = [F.asc_nulls_first(c) for c in (group, *order, "_row")]
    placed = stored(keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    ranges = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = W.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(F.col(group).alias("_group"), F.col("_part").alias("_range"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    both = placed.join(ranges, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_range")))
    out = stored(both.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("rank"), "size"), "ranked")
    discard(placed)
    return out


@dataclass
class Tree:
    """Stored levels of trees: level k holds (tree, rank, size, hash) of every node 3 * k levels above the leaves; the last one has a node per tree."""

    levels: list[DataFrame] = field(default_factory=list)


def _steps(size: Column) -> Column:
    """Levels of a subtree: until one node is left, 3 at most."""
    return F.when(size > FAN * FAN, 3).when(size > FAN, 2).when(size > 1, 1).otherwise(0)


def _subtrees(level: DataFrame, *carried: str) -> DataFrame:
    """(tree, block, size, nodes): an aligned subtree a row, its nodes in order with the ``carried`` columns."""
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    return level.groupBy("tree", block.alias("block"), "size").agg(F.sort_array(F.collect_list(F.struct("rank", "hash", *carried))).alias("nodes"))


def _interior(blocks: DataFrame) -> DataFrame:
    """Adds the levels of a subtree, level0 .. level3: none above a single node of a whole tree."""
    steps = _steps(F.col("size"))
    out = blocks.withColumn("level0", F.col("nodes.hash")).withColumn("steps", steps)
    return reduce(lambda df, k: df.withColumn(f"level{k}", F.when(F.col("steps") >= k, parents(F.col(f"level{k - 1}"))).otherwise(F.col(f"level{k - 1}"))), range(1, STEPS + 1), out)


def build(leaves: DataFrame) -> Tree:
    """Stored levels above stored ``leaves`` (tree, rank, size, hash): one pass per three levels, until each tree has one node."""
    tree = Tree([leaves])
    while tree.levels[-1].agg(F.max("size")).first()[0] not in (None, 1):
        above = _interior(_subtrees(tree.levels[-1].select("tree", "rank", "size", "hash")))
        size = F.ceil(F.col("size") / BLOCK).cast("long")
        tree.levels.append(stored(above.select("tree", F.col("block").alias("rank"), size.alias("size"), F.element_at("level3", 1).alias("hash")), "level"))
    return tree


def _siblings(rank: Column) -> Column:
    """Path of a node within its subtree: per level what stands before and behind it in its run, joined."""
    steps = []
    for k in range(STEPS):
        place = (F.pmod(rank, F.lit(BLOCK)) / FAN**k).cast("int")
        first = place - F.pmod(place, F.lit(FAN))
        level = F.col(f"level{k}")
        part = lambda begin, n, level=level: F.array_join(F.slice(level, begin + 1, n), "")
        steps.append(F.struct(part(first, place - first).alias("before"), part(place + 1, first + FAN - 1 - place).alias("after")))
    return F.slice(F.array(*steps), 1, F.col("steps"))


def paths(level: DataFrame, above: DataFrame, shown) -> DataFrame:
    """For each node of a stored level what ``shown(node, path, above)`` gives, a struct; one array of at most 512 a row.

    ``above`` has (tree, rank, path, ...) of the next stored level; its path follows.
    """
    carried = [c for c in level.columns if c not in ("tree", "rank", "size", "hash")]
    blocks = _interior(_subtrees(level, *carried))
    over = above.select(F.struct(*above.columns).alias("above"), F.col("tree").alias("_tree"), F.col("rank").alias("_rank"))
    both = blocks.join(over, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_rank")))
    known = F.transform("nodes", lambda node: F.struct(node.alias("node"), F.concat(_siblings(node["rank"]), F.col("above.path")).alias("path")))
    each = F.transform(known, lambda x: shown(x["node"], x["path"], F.col("above")))
    return both.select("tree", each.alias("each"))


def all_paths(tree: Tree, tops: DataFrame) -> DataFrame:
    """(tree, rank, path, root columns) of the nodes one stored level above the leaves; ``tops`` has those of the trees' last nodes, with rank 0."""
    above = tops
    more = [c for c in tops.columns if c not in ("tree", "rank", "path")]
    for level in reversed(tree.levels[1:-1]):
        found = paths(level, above, lambda node, path, up: F.struct(node["rank"].alias("rank"), path.alias("path"), *[up[c].alias(c) for c in more]))
        above = stored(found.select("tree", F.inline("each")), "paths")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings in order."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


@dataclass
class Manifest:
    """Stored trees of a dataset: ``groups`` over its rows, ``whole`` over the groups' roots in order of the groups."""

    groups: Tree
    whole: Tree

    def root(self) -> str | None:
        """The digest of the whole dataset; None without rows."""
        top = self.whole.levels[-1].select("hash").first()
        return top[0] if top else None


def group_key(group: Column) -> Column:
    """A key for groups that is never null and sorts as they do, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def build_manifest(leaves: DataFrame, group: str, order: str) -> Manifest:
    """The manifest of rows with a column ``hash``: a tree per ``group``, leaves by ``order``, then by hash, nulls first.

    Further columns of ``leaves`` stay with them.  Rows may repeat or have no ``order``; equal
    leaves are interchangeable.  No rows give trees without nodes.
    """
    rows = leaves.withColumn("tree", group_key(F.col(group)))
    groups = build(ranked(rows, "tree", [order, "hash"]))
    tops = groups.levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    return Manifest(groups, build(ranked(tops, "tree", ["name"])))


def proofs(manifest: Manifest, shown) -> DataFrame:
    """A row per leaf: the fields of ``shown(leaf, path, above)``, ``above`` with subroot and root.

    ``leaf`` has the leaf's own columns, ``path`` is from the leaf to the whole dataset's root.
    """
    whole, groups = manifest.whole, manifest.groups
    last = whole.levels[-1].select("tree", "rank", F.expr(f"cast(array() AS {_PATH})").alias("path"), F.col("hash").alias("root"))
    above = all_paths(whole, last)
    name = lambda node, path, up: F.struct(node["name"].alias("tree"), F.lit(0).cast("long").alias("rank"), path.alias("path"), node["hash"].alias("subroot"), up["root"].alias("root"))
    tops = stored(paths(whole.levels[0], above, name).select(F.inline("each")), "paths")
    return paths(groups.levels[0], all_paths(groups, tops), shown).select(F.inline("each"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, hash, tampered): a leaf per document and, where 3 divides the checksum of its id, that of the text with A-Z in lower case."""
    leaf = lambda text: leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return docs.select("doc_id", "lang", leaf(F.col("text")).alias("hash"), F.when(chosen, leaf(lower_ascii(F.col("text")))).alias("tampered"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = stored(document_leaves(table(spark, sf_dir, "documents")), "digests")
    manifest = build_manifest(leaves, "lang", "doc_id")
    discard(leaves)

    def shown(leaf: Column, path: Column, above: Column) -> Column:
        folded = fold(F.coalesce(leaf["tampered"], leaf["hash"]), path)
        return F.struct(leaf["doc_id"].alias("doc_id"), leaf["hash"].alias("leaf"), above["subroot"].alias("subroot"), above["root"].alias("root"), proof_digest(path).alias("proof_sha256"), folded.alias("folded_root"))

    return proofs(manifest, shown).withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(level: str, path: str, depth: int) -> str:
    """``depth`` levels above {level}0(tree, i, h, n), and from {path}0(row, tree, i, f, proof) on what leaves have gathered below them."""
    out = []
    for k in range(depth):
        a, b, run = f"{level}{k}", f"{path}{k}", f"PARTITION BY tree, i // {FAN} ORDER BY i ROWS BETWEEN"
        out.append(f"""
      {level}{k + 1} AS (SELECT tree, i // {FAN} AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + {FAN - 1}) // {FAN} AS n FROM {a} GROUP BY tree, i // {FAN}),
      {a}_s AS (SELECT tree, i, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {a}),
      {path}{k + 1} AS (SELECT row, p.tree, p.i // {FAN} AS i, CASE WHEN n > 1 THEN sha256(before || f || after) ELSE f END AS f, proof || before || after AS proof FROM {b} p JOIN {a}_s s ON p.tree = s.tree AND p.i = s.i)""")
    return ",".join(out)


#: Levels in the SQL: groups of up to 8 ** 8 rows, up to 8 ** 3 groups.
_DEPTH, _TOP = 8, 3
_CODE = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_CODE.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{0}")) + ")"
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))),
        lambda c, d: list_reduce(list_prepend(xor(c, d), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLE = {
    "op11_merkle_manifest": f"""
      WITH leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.format("text")} AS h, row_number() OVER () AS row,
                        CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS tampered FROM documents),
      l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves),
      g0 AS (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n FROM l),
      p0 AS (SELECT row, tree, i, coalesce(tampered, h) AS f, '' AS proof FROM l),{_tree_sql("g", "p", _DEPTH)},
      w0 AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS i, h, count(*) OVER () AS n FROM g{_DEPTH}),
      q0 AS (SELECT row, '' AS tree, w0.i, f, proof FROM p{_DEPTH} p JOIN w0 ON w0.name = p.tree),{_tree_sql("w", "q", _TOP)}
      SELECT doc_id, l.h AS leaf, w0.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
      FROM l JOIN q{_TOP} q USING (row) JOIN w0 ON w0.name = l.tree, w{_TOP} r"""
}
