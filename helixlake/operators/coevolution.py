"""Coevolution of alignment columns: from sequences to scored partners.

Tables: msa(protein_id, seq_id, seq_name, aligned), residues(protein_id, seq_id, pos, aa),
counts(protein_id, pos_i, pos_j, aa_i, aa_j, n), mi(protein_id, pos_i, pos_j, mi, mi_apc) with
pos_i < pos_j, edges(protein_id, pos, partner).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixlake.functions.kernels import letter_bits, pair_tables, repeated_pairs, shared_bits
from helixlake.storage import stored

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
_CELL = ["protein_id", "pos_i", "pos_j", "aa_i", "aa_j", "n"]


def _with_protein(msa: DataFrame, per_protein: DataFrame) -> DataFrame:
    """Sequences with what is known of their protein, a row each.

    These rows are sent to the sequences: a join by protein would deal a whole family to one task.
    """
    return msa.join(F.broadcast(per_protein), "protein_id")


def sample_sequences(msa: DataFrame, max_seqs: int = 5000, seed: int = 42, digits: int = 4) -> DataFrame:
    """At most ``max_seqs`` sequences per protein, uniformly: those whose md5 of seed and name comes first, ties by seq_id.

    Sequences are counted by the first ``digits`` of their digest, with map-side combining; the
    counts of any parts of the data add up.  Up to the place where they reach
    ``max_seqs``, rows go on to be ranked, so a large family sends few rows to its task.
    """
    hashed = msa.withColumn("_md5", F.md5(F.concat_ws(":", F.lit(str(seed)), "seq_name")))
    bins = hashed.groupBy("protein_id", F.substring("_md5", 1, digits).alias("_bin")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("protein_id").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    reached = bins.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < max_seqs)
    limits = reached.groupBy("protein_id").agg(F.max("_bin").alias("_last"))
    near = _with_protein(hashed, limits).filter(F.substring("_md5", 1, digits) <= F.col("_last"))
    order = W.partitionBy("protein_id").orderBy("_md5", "seq_name", "seq_id")
    return near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_seqs).select(*msa.columns)


def pad_sequences(msa: DataFrame) -> DataFrame:
    """Aligned sequences filled with '-' to the longest of their protein."""
    longest = msa.groupBy("protein_id").agg(F.max(F.length("aligned")).alias("_longest"))
    return _with_protein(msa, longest).withColumn("aligned", F.expr("rpad(aligned, _longest, '-')")).drop("_longest")


def reference_rows(msa: DataFrame, proteins: DataFrame) -> DataFrame:
    """Per protein the aligned row whose ungapped letters agree with the sequence at most offsets; the earliest on ties."""
    ungapped = F.upper(F.regexp_replace("aligned", "[-.]", ""))
    same = F.zip_with(F.split(ungapped, ""), F.split(F.upper("sequence"), ""), lambda a, b: F.when((a == b) & (a != ""), 1).otherwise(0))
    scored = _with_protein(msa, proteins.select("protein_id", "sequence")).withColumn("score", F.aggregate(same, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))))
    best = F.max_by(F.struct("seq_id", "aligned", "sequence", "score"), F.struct(F.col("score"), -F.col("seq_id")))
    return scored.groupBy("protein_id").agg(best.alias("r")).select("protein_id", "r.*")


def column_map(reference: DataFrame) -> DataFrame:
    """(protein_id, col, pos): residues of the reference row, numbered, up to the sequence's length."""
    cells = reference.select("protein_id", F.length("sequence").alias("seq_len"), F.posexplode(F.split("aligned", "")).alias("col", "ch")).filter(~F.col("ch").isin("-", ".", "*", ""))
    order = W.partitionBy("protein_id").orderBy("col")
    return cells.withColumn("pos", F.row_number().over(order) - 1).filter(F.col("pos") < F.col("seq_len")).select("protein_id", "col", "pos")


def melt_residues(msa: DataFrame, col_map: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Letters of mapped columns in long form; anything but the given letters is left out.

    The map is gathered per protein and joined before the sequences are exploded.
    """
    maps = col_map.groupBy("protein_id").agg(F.sort_array(F.collect_list(F.struct("pos", "col"))).alias("_map"))
    cells = _with_protein(msa, maps).select("protein_id", "seq_id", "aligned", F.explode("_map").alias("m"))
    cells = cells.select("protein_id", "seq_id", F.col("m.pos").alias("pos"), F.upper(F.expr("substr(aligned, m.col + 1, 1)")).alias("aa"))
    return cells.filter(F.col("aa").isin(*letters))


def letter_counts(residues: DataFrame) -> DataFrame:
    return residues.groupBy("protein_id", "pos", "aa").agg(F.count("*").alias("n"))


def column_frequencies(residues: DataFrame, positions: DataFrame | None = None, letters: str = LETTERS) -> DataFrame:
    """f = (n + 1) / (N + letters) for every mapped column and letter; by default the columns where a letter was counted.

    Then the counts are stored, so that the residues are read once.
    """
    counts = letter_counts(residues)
    if positions is None:
        counts = stored(counts, "letters")
        positions = counts.select("protein_id", "pos").distinct()
    return frequencies(counts, positions, letters)


def frequencies(counts: DataFrame, positions: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The same from the letters' counts (protein_id, pos, aa, n)."""
    grid = positions.select("protein_id", "pos", F.explode(F.array(*[F.lit(a) for a in letters])).alias("aa"))
    both = grid.join(counts, ["protein_id", "pos", "aa"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = F.sum("n").over(W.partitionBy("protein_id", "pos"))
    return both.select("protein_id", "pos", "aa", ((F.col("n") + 1) / (whole + len(letters))).alias("f"))


def _parts(residues: DataFrame, letters: str) -> DataFrame:
    """(protein_id, seq_id, cells): neighbouring residues of a sequence as one array of pos * letters + letter."""
    cell = (F.col("pos").cast("long") * len(letters) + F.instr(F.lit(letters), F.col("aa")) - 1).alias("cell")
    rows = residues.select("protein_id", "seq_id", cell)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                starts = np.flatnonzero(_changes(batch.column(0), batch.column(1)))
                cells = pa.ListArray.from_arrays(pa.array(np.append(starts, len(batch)).astype(np.int32)), batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), batch.column(1).take(pa.array(starts)), cells], ["protein_id", "seq_id", "cells"])

    return rows.mapInArrow(gather, f"protein_id {kinds['protein_id']}, seq_id {kinds['seq_id']}, cells array<bigint>")


def _changes(*columns: pa.Array) -> np.ndarray:
    """For each row whether a column differs from the row before; true for the first."""
    number = lambda c: pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], np.any([np.diff(number(c)) != 0 for c in columns], axis=0)])


def _sequences(residues: DataFrame, letters: str) -> DataFrame:
    """(protein_id, seq_id, cells): each sequence's residues as one array of pos * letters + letter.

    Neighbouring rows of a sequence are put together before the shuffle, so that it moves
    sequences and not residues; parts of a sequence from several tasks are joined by it.
    """
    return _parts(residues, letters).groupBy("protein_id", "seq_id").agg(F.flatten(F.collect_list("cells")).alias("cells"))


def pair_counts_joined(residues: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Pair counts by joining each sequence's residues with themselves; only counted cells are shuffled after that."""
    kind = residues.schema["pos"].dataType
    counted = joined_counts(_parts(residues.filter("protein_id IS NOT NULL AND seq_id IS NOT NULL"), letters), letters)
    return counted.select("protein_id", F.col("pos_i").cast(kind).alias("pos_i"), F.col("pos_j").cast(kind).alias("pos_j"), "aa_i", "aa_j", "n")


def joined_counts(rows: DataFrame, letters: str = LETTERS, block_bytes: int = 1 << 25) -> DataFrame:
    """Pair counts (protein_id, pos_i, pos_j, aa_i, aa_j, n), pos_i < pos_j, of rows that are parts of sequences.

    ``rows``: protein_id, seq_id and either aligned, as in ``cell_counts``, or cells as in ``_parts``. Rows are
    dealt by sequence, and every residue meets all of its sequence at other positions, also those of other
    rows, as often as they occur. A task counts blocks of whole sequences, of about ``block_bytes``: a letter
    per position and sequence where that suffices, single pairs where a position occurs repeatedly. The
    counts of two positions are one row, in as many bytes a cell as they need, until all tasks' are added.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind, size = to_arrow_type(rows.schema["protein_id"].dataType), len(letters)
    column = "aligned" if "aligned" in rows.columns else "cells"
    codes = np.zeros(256, np.uint8)
    codes[np.frombuffer(letters.encode(), np.uint8)] = np.arange(1, size + 1)

    def entries(some: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, position and letter, from 1, of every residue."""
        if column == "cells":
            flat = some.flatten().to_numpy(zero_copy_only=False)
            pos, letter = np.divmod(flat, size)
            return np.repeat(np.arange(len(some)), pc.list_value_length(some).to_numpy(zero_copy_only=False)), pos, (letter + 1).astype(np.uint8)
        ends = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
        flat = codes[np.frombuffer(some.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        at = np.flatnonzero(flat)
        row = np.repeat(np.arange(len(some)), np.diff(ends))[at]
        return row, at - (ends[row] - ends[0]), flat[at]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of whole sequences; the last one's are kept for the next block."""
        held: list[pa.RecordBatch] = []
        held_bytes, limit = 0, block_bytes
        for batch in batches:
            held.append(batch)
            held_bytes += batch.nbytes
            if held_bytes >= limit:
                block = pa.concat_batches(held)
                last = int(np.flatnonzero(_changes(block.column(0), block.column(1)))[-1])
                if last:
                    yield block.slice(0, last)
                held = [pa.concat_batches([block.slice(last)])]
                held_bytes = held[0].nbytes
                limit = max(block_bytes, 2 * held_bytes)
        if sum(map(len, held)):
            yield pa.concat_batches(held)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            seq = np.cumsum(_changes(block.column(0), block.column(1)))
            coded = pc.dictionary_encode(block.column(0))
            which = coded.indices.to_numpy()
            for k, protein in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(which == k)
                found = pairs(block.column(2).take(pa.array(own)), np.cumsum(np.diff(seq[own], prepend=seq[own[0]]) != 0))
                packed = ((i, j, n.astype(np.min_scalar_type(n.max())).tobytes()) for i, j, n in found if n.any())
                while some := list(islice(packed, 1024)):
                    i, j, table = zip(*some, strict=True)
                    columns = [pa.array([protein] * len(i), arrow_kind), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(table, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["protein_id", "pos_i", "pos_j", "cells"])

    def pairs(parts: pa.Array, seq: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(i, j, counts of letters x letters) of rows of one protein, with the number of each row's sequence."""
        if column == "cells":
            residues = len(parts.flatten())
            where = np.unique(pc.unique(parts.flatten()).to_numpy(zero_copy_only=False) // size)
        else:
            residues = pc.sum(pc.binary_length(parts)).as_py()
            if residues != pc.sum(pc.utf8_length(parts)).as_py():
                parts = pc.replace_substring_regex(parts, "[^\\x00-\\x7f]", "-")
            where = np.arange(pc.max(pc.binary_length(parts)).as_py())
        sequences = int(seq.max()) + 1

        def found(rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            of, some = (seq, parts) if rows is None else (seq[rows], parts.take(pa.array(rows)))
            for at in range(0, len(some), 1 << 14):  # numbers are wider than letters, so few at a time
                row, pos, letter = entries(some.slice(at, 1 << 14))
                yield of[at + row], pos if column == "aligned" else np.searchsorted(where, pos), letter

        repeated = np.ones(sequences, bool)
        if len(where) * sequences <= 16 * residues:
            grid, told = np.zeros((len(where), sequences), np.uint8), np.zeros(sequences, np.int64)
            for of, pos, letter in found():
                grid[pos, of] = letter
                told += np.bincount(of, minlength=sequences)
            repeated = told != np.count_nonzero(grid, axis=0)
            grid[:, repeated] = 0
            yield from ((where[i], where[j], n) for i, j, n in pair_tables(grid, size))
        rows = np.flatnonzero(repeated[seq])
        if len(rows):  # whole sequences, about a million residues at a time
            lengths = (pc.list_value_length(parts) if column == "cells" else pc.binary_length(parts)).to_numpy(zero_copy_only=False)[rows]
            before = np.cumsum(lengths) - lengths
            first = np.searchsorted(seq[rows], seq[rows])
            for some in np.split(rows, np.flatnonzero(np.diff(before[first] >> 20)) + 1):
                of, pos, letter = (np.concatenate(x) for x in zip(*found(some), strict=True))
                for i, j, a, b, n in repeated_pairs(of, pos, letter.astype(np.int64) - 1, size):
                    order = np.lexsort((j, i))
                    for at in np.split(order, np.flatnonzero((np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1):
                        if len(at):
                            table = np.zeros((size, size), np.int64)
                            table[a[at], b[at]] = n[at]
                            yield where[i[at[0]]], where[j[at[0]]], table

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of the tables' sums; tables of a pair of positions follow one another."""
        names = pa.array(list(letters))

        def sums() -> Iterator[tuple]:
            known = total = None
            for batch in batches:
                for *pair, table in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    if pair != known:
                        if known:
                            yield *known, total.reshape(size, size)
                        known, total = pair, np.zeros(size * size, np.int64)
                    total += np.frombuffer(table, f"u{len(table) // size**2}")
            if known:
                yield *known, total.reshape(size, size)

        summed = sums()
        while some := list(islice(summed, 64)):
            at, a, b = np.nonzero(np.stack([n for *_, n in some]))
            proteins, i, j = (pa.array([x[k] for x in some], kind).take(pa.array(at)) for k, kind in enumerate((arrow_kind, pa.int64(), pa.int64())))
            n = np.concatenate([x[3][x[3] > 0] for x in some])
            yield pa.RecordBatch.from_arrays([proteins, i, j, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(n)], _CELL)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    known = rows.select("protein_id", "seq_id", column).dropna()
    # Sequences come together by sorting; numbers sort faster than names.
    dealt = known.repartition("protein_id", "seq_id").sortWithinPartitions("seq_id", "protein_id")
    pair = ["protein_id", "pos_i", "pos_j"]
    schema = f"protein_id {kinds['protein_id']}, pos_i bigint, pos_j bigint, "
    tables = dealt.mapInArrow(work, schema + "cells binary").repartition(*pair).sortWithinPartitions(*pair)
    return tables.mapInArrow(added, schema + "aa_i string, aa_j string, n bigint")


def pair_counts(residues: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Pair counts by bitmaps of blocks of sequences, as in ``cell_counts``; partial counts are summed by Spark.

    Sequences are gathered to one string each, so a family of any size is spread over tasks and
    only sequences and counted cells are shuffled.
    """
    kinds = {f.name: f.dataType.simpleString() for f in residues.schema.fields}

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = np.frombuffer(letters.encode(), np.uint8)
        for batch in batches:
            if len(batch):
                counts = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                pos, letter = np.divmod(batch.column(1).flatten().to_numpy(zero_copy_only=False), len(letters))
                width = int(pos.max(initial=-1)) + 1
                text = np.full((len(batch), width), ord("-"), np.uint8)
                text[np.repeat(np.arange(len(batch)), counts), pos] = shown[letter]
                ends = pa.py_buffer((np.arange(len(batch) + 1) * width).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.StringArray.from_buffers(len(batch), ends, pa.py_buffer(text))], ["protein_id", "aligned"])

    strings = _sequences(residues, letters).select("protein_id", "cells").mapInArrow(written, f"protein_id {kinds['protein_id']}, aligned string")
    return pair_cells(cell_counts(strings, letters))


def aligned_positions(msa: DataFrame, col_map: DataFrame) -> DataFrame:
    """(protein_id, seq_id, aligned): each sequence as a string whose character p is its letter at position p, in upper case."""
    maps = col_map.groupBy("protein_id").agg(F.sort_array(F.collect_list(F.struct("pos", "col"))).alias("_map"))
    at = lambda m: F.substr(F.col("aligned"), m["col"] + 1, F.lit(1))
    return _with_protein(msa, maps).select("protein_id", "seq_id", F.upper(F.array_join(F.transform("_map", at), "")).alias("aligned"))


def cell_counts(rows: DataFrame, letters: str = LETTERS, block_bytes: int = 1 << 24) -> DataFrame:
    """(protein_id, pos_i, pos_j, aa_i, aa_j, n) of aligned strings, pos_i <= pos_j; at pos_i = pos_j the letters' own counts.

    ``rows``: protein_id, aligned; character p stands at position p, what isn't a letter counts
    for nothing.  A task indexes blocks of sequences as they come, of about ``block_bytes``: a
    bitmap per (position, letter).  Pairs are the bits that two bitmaps share.  Nothing is melted
    or gathered by sequence, only counted cells are shuffled, and a family of any size is
    spread over all tasks.
    """
    kind = rows.schema["protein_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for batch in batches:
            coded, texts = pc.dictionary_encode(batch.column(0), null_encoding="encode"), batch.column(1)
            if pc.sum(pc.binary_length(texts)) != pc.sum(pc.utf8_length(texts)):
                texts = pc.replace_substring_regex(texts, "[^\\x00-\\x7f]", "-")
            for k, protein in enumerate(coded.dictionary.to_pylist()):
                held.setdefault(protein, []).append(texts.filter(pc.equal(coded.indices, k)))
            size += texts.nbytes
            if size >= block_bytes:
                yield from counted(held)
                held, size = {}, 0
        yield from counted(held)

    def counted(held: dict) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(letters))
        for protein, parts in held.items():
            for i, j, a, b, n in shared_bits(letter_bits(pa.concat_arrays(parts), letters)):
                columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(n)]
                yield pa.RecordBatch.from_arrays([pa.array([protein] * len(n), arrow_kind), *columns], _CELL)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)
    schema = f"protein_id {kind.simpleString()}, pos_i int, pos_j int, aa_i string, aa_j string, n bigint"
    return rows.select("protein_id", "aligned").mapInArrow(work, schema).groupBy(*_CELL[:-1]).agg(F.sum("n").alias("n"))


def moved_cells(cells: DataFrame, new: Callable[[Column], Column]) -> DataFrame:
    """Cells with positions p renumbered as ``new(p)``, one to one; a pair is turned where its order changes."""
    i, j = new(F.col("pos_i")), new(F.col("pos_j"))
    pick = lambda a, b: F.when(i <= j, a).otherwise(b)
    aa = [pick(F.col("aa_i"), F.col("aa_j")).alias("aa_i"), pick(F.col("aa_j"), F.col("aa_i")).alias("aa_j")]
    return cells.select("protein_id", F.least(i, j).alias("pos_i"), F.greatest(i, j).alias("pos_j"), *aa, "n")


def cells_of_residues(residues: DataFrame, letters: str = LETTERS, joined: bool = False) -> DataFrame:
    """The same table from residues in long form."""
    own = letter_counts(residues).select("protein_id", F.col("pos").alias("pos_i"), F.col("pos").alias("pos_j"), F.col("aa").alias("aa_i"), F.col("aa").alias("aa_j"), "n")
    return (pair_counts_joined(residues) if joined else pair_counts(residues, letters)).unionByName(own)


def pair_cells(cells: DataFrame) -> DataFrame:
    return cells.filter("pos_i < pos_j")


def letter_cells(cells: DataFrame) -> DataFrame:
    """(protein_id, pos, aa, n): the letters' own counts."""
    return cells.filter("pos_i = pos_j AND aa_i = aa_j").select("protein_id", F.col("pos_i").alias("pos"), F.col("aa_i").alias("aa"), "n")


def mutual_information(counts: DataFrame, frequencies: DataFrame, letters: int = len(LETTERS), least: int = 10) -> DataFrame:
    """(protein_id, pos_i, pos_j, total, mi) from observed cells alone.

    Every cell of the letters x letters table has the pseudo-count 1 / letters over T + 1; the
    cells not seen enter by a closed form.  Below ``least`` pairs the score is 0.
    """
    logs = frequencies.groupBy("protein_id", "pos").agg(F.sum(F.log("f")).alias("log_f"))
    f_i = frequencies.select("protein_id", F.col("pos").alias("pos_i"), F.col("aa").alias("aa_i"), F.col("f").alias("f_i"))
    f_j = frequencies.select("protein_id", F.col("pos").alias("pos_j"), F.col("aa").alias("aa_j"), F.col("f").alias("f_j"))
    totals = counts.groupBy("protein_id", "pos_i", "pos_j").agg(F.sum("n").alias("total"))
    cells = counts.join(totals, ["protein_id", "pos_i", "pos_j"]).join(f_i, ["protein_id", "pos_i", "aa_i"]).join(f_j, ["protein_id", "pos_j", "aa_j"])
    e, p = F.lit(1.0 / letters) / (F.col("total") + 1), (F.col("n") + F.lit(1.0 / letters)) / (F.col("total") + 1)
    term = p * F.log(p / (F.col("f_i") * F.col("f_j"))) - e * F.log(e / (F.col("f_i") * F.col("f_j")))
    seen = cells.groupBy("protein_id", "pos_i", "pos_j", "total").agg(F.sum(term).alias("seen"))
    l_i = logs.select("protein_id", F.col("pos").alias("pos_i"), F.col("log_f").alias("l_i"))
    l_j = logs.select("protein_id", F.col("pos").alias("pos_j"), F.col("log_f").alias("l_j"))
    both = seen.join(l_i, ["protein_id", "pos_i"]).join(l_j, ["protein_id", "pos_j"])
    mi = letters * letters * e * F.log(e) - letters * e * (F.col("l_i") + F.col("l_j")) + F.col("seen")
    return both.select("protein_id", "pos_i", "pos_j", "total", F.when(F.col("total") >= least, mi).otherwise(F.lit(0.0)).alias("mi"))


def apc(mi: DataFrame, positions: DataFrame) -> DataFrame:
    """Adds mi_apc: average product corrected scores; means include the zero diagonal."""
    n = positions.groupBy("protein_id").agg(F.countDistinct("pos").alias("n_pos"))
    ends = mi.select("protein_id", F.explode(F.array("pos_i", "pos_j")).alias("pos"), "mi").groupBy("protein_id", "pos").agg(F.sum("mi").alias("row_sum"))
    mean = ends.groupBy("protein_id").agg(F.sum("row_sum").alias("all_sum")).join(n, "protein_id").select("protein_id", "n_pos", (F.col("all_sum") / (F.col("n_pos") * F.col("n_pos"))).alias("m"))
    r_i = ends.select("protein_id", F.col("pos").alias("pos_i"), F.col("row_sum").alias("s_i"))
    r_j = ends.select("protein_id", F.col("pos").alias("pos_j"), F.col("row_sum").alias("s_j"))
    both = mi.join(mean, "protein_id").join(r_i, ["protein_id", "pos_i"]).join(r_j, ["protein_id", "pos_j"])
    fixed = F.greatest(F.col("mi") - F.col("s_i") / F.col("n_pos") * F.col("s_j") / F.col("n_pos") / F.col("m"), F.lit(0.0))
    return both.select(*mi.columns, F.when(F.col("m") > 0, fixed).otherwise(F.col("mi")).alias("mi_apc"))


def enough_columns(positions: DataFrame, least: int = 10) -> DataFrame:
    """Proteins with at least ``least`` mapped positions."""
    return positions.groupBy("protein_id").agg(F.countDistinct("pos").alias("n_pos")).filter(F.col("n_pos") >= least).select("protein_id")


def select_partners(mi: DataFrame, top_k: int = 8, mi_threshold: float = 0.1, local_window: int = 5) -> DataFrame:
    """Per position the ``top_k`` best partners farther than ``local_window``, then those above the threshold; ties go to the higher partner."""
    both = mi.select("protein_id", F.col("pos_i").alias("pos"), F.col("pos_j").alias("partner"), "mi_apc").unionByName(mi.select("protein_id", F.col("pos_j").alias("pos"), F.col("pos_i").alias("partner"), "mi_apc"))
    order = W.partitionBy("protein_id", "pos").orderBy(F.desc("mi_apc"), F.desc("partner"))
    far = both.filter(F.abs(F.col("pos") - F.col("partner")) > local_window).withColumn("rank", F.row_number().over(order))
    return far.filter((F.col("rank") <= top_k) & (F.col("mi_apc") > mi_threshold))


def symmetrize(edges: DataFrame, proteins: DataFrame | None = None) -> DataFrame:
    """Edges in both directions, once each, within 0 .. seq_len - 1 where ``proteins`` are given."""
    one = edges.select("protein_id", "pos", "partner")
    both = one.unionByName(one.select("protein_id", F.col("partner").alias("pos"), F.col("pos").alias("partner"))).distinct()
    if proteins is None:
        return both
    inside = both.join(proteins.select("protein_id", "seq_len"), "protein_id")
    return inside.filter((F.col("pos") >= 0) & (F.col("partner") >= 0) & (F.col("pos") < F.col("seq_len")) & (F.col("partner") < F.col("seq_len"))).drop("seq_len")


def merge_edges(base: DataFrame, overlay: DataFrame, proteins: DataFrame | None = None) -> DataFrame:
    return symmetrize(base.select("protein_id", "pos", "partner").unionByName(overlay.select("protein_id", "pos", "partner")), proteins)


def overlay_edges(base: DataFrame, curated: DataFrame) -> DataFrame:
    """Adds curated edges in their own direction only."""
    return base.select("protein_id", "pos", "partner").unionByName(curated.select("protein_id", "pos", "partner")).distinct()


def partner_lists(edges: DataFrame) -> DataFrame:
    return edges.groupBy("protein_id", "pos").agg(F.sort_array(F.collect_set("partner")).alias("partners"))


def coverage(edges: DataFrame, proteins: DataFrame) -> DataFrame:
    """positions_with_partners, total_positions, total_pairs, mean_partners and a flag below half coverage."""
    per = edges.groupBy("protein_id", "pos").agg(F.countDistinct("partner").alias("degree")).groupBy("protein_id").agg(F.count("*").alias("with"), F.sum("degree").alias("ends"))
    both = proteins.select("protein_id", "seq_len").join(per, "protein_id", "left").fillna(0, ["with", "ends"])
    return both.select(
        "protein_id", F.col("with").alias("positions_with_partners"), F.col("seq_len").cast("long").alias("total_positions"), F.expr("ends div 2").alias("total_pairs"),
        F.when(F.col("with") > 0, F.col("ends") / F.col("with")).otherwise(F.lit(0.0)).alias("mean_partners"), (2 * F.col("with") < F.col("seq_len")).alias("sparse"),
    )


def first_source(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Edges of the first named source that has any for a protein, with the name as method."""
    out = done = None
    for method, edges in sources:
        part = edges.select("protein_id", "pos", "partner", F.lit(method).alias("method"))
        part = part if done is None else part.join(done, "protein_id", "left_anti")
        out = part if out is None else out.unionByName(part)
        done = out.select("protein_id").distinct()
    return out


def coevolution(cells: DataFrame, positions: DataFrame | None = None, letters: str = LETTERS) -> DataFrame:
    """mi table, with mi_apc, of all proteins with enough mapped positions, from the cells' counts.

    ``cells`` is read several times, as is the score table made from it: a stored table is expected.
    ``positions`` are all mapped ones; by default those where a letter was counted.
    """
    own = letter_cells(cells)
    positions = own.select("protein_id", "pos").distinct() if positions is None else positions
    enough = enough_columns(positions)
    cells, own, positions = (x.join(enough, "protein_id", "left_semi") for x in (cells, own, positions))
    mi = stored(mutual_information(pair_cells(cells), frequencies(own, positions, letters), len(letters)), "mi")
    return apc(mi, positions)
