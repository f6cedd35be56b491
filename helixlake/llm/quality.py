"""Quality by an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted text: all documents that a table of labels calls good.
All their n-grams of code points, in any script, are counted per language in tasks and
summed; the tables of counts, probabilities and back-off weights grow with what the corpus
holds and come from joins.  Blocks of documents then ask for the n-grams they hold: these
are dealt by hash to shards, meet the model's rows there, and the answers are stored for
their block, where each document's perplexity is summed.  A trusted document is judged as
if what was counted only once, in itself, had not been counted.  Documents above a
threshold, a quantile of the trusted documents' perplexities of their language and
length, are rejected.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm.common import discard, keep_cache, matching, shared_path, slices, stored, table, text_or_empty

ORDER = 4
PART = 1_000_000  # characters that a task works on at once
BLOCK = 64_000_000  # characters whose n-grams are asked for together
_DENSE = 1 << 22


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, scattered one to one."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(lang: str, grams: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams, the rows of ``grams`` (code points); rows may be empty."""
    seed = hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    out = mixed(np.full(len(grams), int.from_bytes(seed, "little"), np.uint64) + np.uint64(grams.shape[1]))
    for column in grams.T:
        out = mixed(out + column.astype(np.uint64))
    return out


def distinct_grams(joined: str, sizes: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams as rows of code points, number of the n-gram that ends at each character).

    ``joined`` holds texts of ``sizes`` characters in a row; each is padded in front by line breaks.
    """
    pad = order - 1
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.arange(len(points)) + pad * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    padded = np.full(len(points) + pad * len(sizes), 10, np.uint32)
    padded[at] = points
    letters = np.unique(padded)
    place = np.zeros(int(letters.max(initial=0)) + 1, np.int64)
    place[letters] = np.arange(len(letters))
    signs = place[padded]
    now, count = signs[at - pad], len(letters)
    for k in range(1, order):
        key = now * len(letters) + signs[at - pad + k]
        if count * len(letters) <= _DENSE:
            met = np.zeros(count * len(letters), bool)
            met[key] = True
            now = (np.cumsum(met, dtype=np.int32) - 1)[key].astype(np.int64)
            count = int(met.sum())
        else:
            found, now = np.unique(key, return_inverse=True)
            count = len(found)
    one = np.zeros(count if len(points) else 0, np.int64)
    one[now] = np.arange(len(points))  # some place of each
    return np.stack([padded[at[one] - pad + k] for k in range(order)], axis=1), now


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[tuple]]]:
    """(language, rows (text, ...)) of about ``most`` characters each, from rows (language, text, ...)."""
    keep_cache("blocks", _blocks.clear)
    held: dict[str, list[tuple]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in slices(batches, 1):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(row[0], []).append(row[1:])
            size = len(row[1]) + 1
            sizes[row[0]] = sizes.get(row[0], 0) + size
            total += size
            if sizes[row[0]] > most:
                total -= sizes.pop(row[0])
                yield row[0], held.pop(row[0])
            if total > 4 * most:
                yield from held.items()
                held, sizes, total = {}, {}, 0
    yield from held.items()


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all given documents; null languages are one of their own, named by an empty string."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _parts(batches, PART):
            sizes = np.array([len(t) for (t,) in rows], np.int64)
            grams, now = distinct_grams("".join(t for (t,) in rows), sizes, order)
            if not len(grams):
                continue
            line = np.ascontiguousarray(grams).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            strings = [line[i : i + order] for i in range(0, len(line), order)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(strings, pa.string()), pa.array(np.bincount(now, minlength=len(grams)))], ["lang", "gram", "n"])

    rows = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(work, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, logp, backoff, lone): natural logarithms of the model's probabilities, in one table.

    logp is that of a gram's last character after the others, backoff the weight left to
    the lower order after the whole gram as a context; the empty gram has the uniform
    probability of a language's characters and one more.  The highest order uses counts,
    lower ones the number of distinct characters before; each order has three discounts.
    ``lone`` are grams that occur once.
    """
    orders = {order: stored(counts.select("lang", "gram", "n", F.col("n").alias("times")), "order")}
    for k in range(order - 1, 0, -1):
        shorter = orders[k + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"), F.sum("times").alias("times"))
        orders[k] = stored(shorter, "order")
    result = stored(orders[1].groupBy("lang").agg((-F.log(F.count("*") + F.lit(1.0))).alias("logp"), F.sum("times").alias("times")), "uniform").select("lang", F.lit("").alias("gram"), "logp", F.lit(None).cast("double").alias("backoff"), "times")
    below = result.select("lang", F.col("gram").alias("suffix"), F.exp("logp").alias("lower"))
    for k in range(1, order + 1):
        of = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        discount = [F.greatest(F.lit(0.05), F.least(F.lit(i * 0.95), i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0)))).alias(f"d{i}") for i in (1, 2, 3)]
        by_lang = stored(orders[k].groupBy("lang").agg(*of).select("lang", *discount), "discounts")  # a row per language
        rows = orders[k].join(by_lang, "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        rows = rows.select("lang", "gram", "n", "times", "d", F.expr(f"substring(gram, 1, {k - 1})").alias("context"), F.expr("substring(gram, 2)").alias("suffix"))
        context = stored(rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("cut"), F.sum("times").alias("met")), "contexts")
        scored = rows.join(context, ["lang", "context"]).join(below, ["lang", "suffix"])
        p = (F.col("n") - F.col("d") + F.col("cut") * F.col("lower")) / F.col("total")
        model = stored(scored.select("lang", "gram", p.alias("p"), "times"), "model")
        below = model.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        left = context.select("lang", F.col("context").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log(F.col("cut") / F.col("total")).alias("backoff"), F.col("met").alias("times"))
        result = result.unionByName(model.select("lang", "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff"), "times")).unionByName(left)
    return result.groupBy("lang", "gram").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff"), (F.max("times") == 1).alias("lone"))


class Answers:
    """The model's rows for the keys of a block."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, backoff: np.ndarray, lone: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logp, self.backoff, self.lone = keys[order], logp[order].astype(np.float64), backoff[order].astype(np.float64), lone[order].astype(bool)

    def _find(self, keys: np.ndarray, without: bool) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        ok = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return at, ok & ~self.lone[at] if without and len(self.keys) else ok

    def scores(self, lang: str, grams: np.ndarray, without: bool = False) -> np.ndarray | None:
        """Log probabilities of the last character of each of ``grams``; None for a language without a model."""
        order = grams.shape[1]
        at, ok = self._find(gram_keys(lang, grams[:1, :0]), False)
        if not ok.all():
            return None
        out = np.full(len(grams), self.logp[at[0]])
        for k in range(1, order + 1):
            at, ok = self._find(gram_keys(lang, grams[:, order - k : order - 1]), without and k > 1)
            left = np.where(ok, self.backoff[at], np.nan)  # a context that is never followed leaves all to the lower order
            out += np.where(np.isnan(left), 0, left)
            at, ok = self._find(gram_keys(lang, grams[:, order - k :]), without)
            out = np.where(ok & ~np.isnan(self.logp[at]), self.logp[at], out)
        return out


def asked_keys(lang: str, grams: np.ndarray) -> np.ndarray:
    """Keys of all rows that the scores of ``grams`` need."""
    order = grams.shape[1]
    ends = [(order - k, order) for k in range(order + 1)] + [(order - k, order - 1) for k in range(2, order + 1)]
    return np.unique(np.concatenate([gram_keys(lang, np.unique(grams[:, a:b], axis=0) if b - a == 1 else grams[:, a:b]) for a, b in ends]))


def _asked(docs: DataFrame, shards: int, order: int) -> DataFrame:
    """Parts of blocks (lang, ids, hashes, sizes, packed texts), and the keys that a block asks each shard for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "shard", "keys", "lang", "ids", "hashes", "sizes", "packed"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=3).compress
        task, number, keys, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def ask() -> Iterator[pa.RecordBatch]:
            own = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
            of = (own >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)  # ascends with the key
            cuts = np.searchsorted(of, np.arange(shards + 1, dtype=np.uint64))
            some = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
            nothing = [pa.nulls(len(some), t) for t in (pa.string(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([task | number] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array([own[cuts[s] : cuts[s + 1]].tobytes() for s in some], pa.binary()), *nothing], names)

        for lang, rows in _parts(batches, PART):
            texts = [r[0] for r in rows]
            sizes = [len(t) for t in texts]
            joined = "".join(texts)
            grams, _ = distinct_grams(joined, np.array(sizes, np.int64), order)
            keys.append(asked_keys(lang, grams))
            if len(keys) > 8:
                keys = [np.unique(np.concatenate(keys))]
            one = [pa.array([v], t) for v, t in ((lang, pa.string()), ([r[1] for r in rows], pa.list_(id_type)), ([r[2] for r in rows], pa.list_(pa.int64())), (sizes, pa.list_(pa.int64())), (pack(joined.encode("utf-8", "surrogatepass")), pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array([task | number], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *one], names)
            size += len(joined)
            if size > BLOCK:
                yield from ask()
                number, keys, size = number + 1, [], 0
        yield from ask()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("lang", "t", "doc_id", "_hash").mapInArrow(work, f"block bigint, shard bigint, keys binary, lang string, ids array<{kind}>, hashes array<bigint>, sizes array<bigint>, packed binary")


def _answered(asked: DataFrame, model: DataFrame, shards: int) -> DataFrame:
    """(block, keys, logp, backoff, lone) of what blocks asked for and the model has: a join by shard, then by key within it.

    Where many blocks ask, a shard is told several times, each for some of the blocks.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, gram = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = np.zeros(len(gram), np.uint64)
            groups: dict[tuple[str, int], list[int]] = {}
            for i, (name, g) in enumerate(zip(lang, gram, strict=True)):
                groups.setdefault((name, len(g)), []).append(i)
            for (name, n), at in groups.items():
                points = np.frombuffer("".join(gram[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32)
                keys[at] = gram_keys(name, points.reshape(len(at), n))
            order = np.argsort(keys)
            keys = keys[order]
            values = [batch.column(i).cast(pa.float32()).fill_null(np.nan).to_numpy()[order] for i in (2, 3)] + [batch.column(4).cast(pa.uint8()).to_numpy()[order]]
            of = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
            cuts = np.searchsorted(of, np.arange(shards + 1, dtype=np.uint64))
            some = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array([x[cuts[s] : cuts[s + 1]].tobytes() for s in some], pa.binary()) for x in (keys, *values))], ["shard", *names])

    names = ["keys", "logp", "backoff", "lone"]
    answer = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in names)])

    def meet(mine: pa.Table, told: pa.Table) -> pa.Table:
        parts = [np.concatenate([np.frombuffer(b, t) for b in told.column(c).to_pylist()] or [np.zeros(0, t)]) for c, t in zip(names, (np.uint64, np.float32, np.float32, np.uint8), strict=True)]
        order = np.argsort(parts[0])
        parts = [p[order] for p in parts]
        out: list[tuple] = []
        for block, keys in zip(mine.column("block").to_pylist(), mine.column("keys").to_pylist(), strict=True):
            own = np.frombuffer(keys, np.uint64)
            at = np.minimum(np.searchsorted(parts[0], own), max(0, len(parts[0]) - 1))
            at = at[parts[0][at] == own] if len(parts[0]) else at[:0]
            out.append((block, *(p[at].tobytes() for p in parts)))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(answer)], schema=answer)

    told = model.select("lang", "gram", "logp", "backoff", "lone").mapInArrow(tell, "shard bigint, keys binary, logp binary, backoff binary, lone binary")
    want = asked.filter("keys IS NOT NULL").select("shard", "block", "keys")
    times = max(1, (want.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // (8 * 4_000_000 * shards))
    want = want.withColumn("turn", F.pmod(F.xxhash64("block"), F.lit(times)))
    told = told.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(times - 1)).cast("array<bigint>")))
    return want.groupBy("shard", "turn").cogroup(told.groupBy("shard", "turn")).applyInArrow(meet, "block bigint, keys binary, logp binary, backoff binary, lone binary")


_blocks: OrderedDict[tuple[str, int], Answers] = OrderedDict()


def _block(path: str, block: int) -> Answers:
    """The stored answers for a block; a worker keeps the last two."""
    keep_cache("blocks", _blocks.clear)
    if (path, block) not in _blocks:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        rows = ds.dataset(at, filesystem=system, format="parquet").to_table(filter=ds.field("block") == block)
        parts = [np.concatenate([np.frombuffer(b, t) for b in rows.column(c).to_pylist()] or [np.zeros(0, t)]) for c, t in zip(("keys", "logp", "backoff", "lone"), (np.uint64, np.float32, np.float32, np.uint8), strict=True)]
        while len(_blocks) > 1:
            _blocks.popitem(last=False)
        _blocks[path, block] = Answers(*parts)
    return _blocks[path, block]


def perplexities(docs: DataFrame, model: DataFrame, order: int = ORDER) -> tuple[DataFrame, list[DataFrame]]:
    """(rows, tables that they are read from); the rows are (doc_id, lang, _hash, n_grams, perplexity, held) of (doc_id, lang, t, _hash); ``held`` is how a document of the trained ones reads without its own counts.

    Perplexity is by character; null for texts without characters and for languages without a model.
    """
    spark = docs.sparkSession
    size = model.count()
    shards = max(8, size // 250_000)
    asked = stored(_asked(docs, shards, order), "asked")
    path = shared_path(spark, "answers")
    _answered(asked, model, shards).repartition("block").sortWithinPartitions("block").write.parquet(path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(len(batch)):
                block, lang, packed = (batch.column(i)[k].as_py() for i in (0, 1, 5))
                sizes = np.array(batch.column(4)[k].as_py(), np.int64)
                grams, now = distinct_grams(unpack(packed).decode("utf-8", "surrogatepass"), sizes, order)
                some = np.flatnonzero(sizes)
                out = []
                for without in (False, True):
                    scores = _block(path, block).scores(lang, grams, without) if len(some) else None
                    value = np.full(len(sizes), np.nan)
                    if scores is not None:
                        value[some] = np.exp(-np.add.reduceat(scores[now], (np.cumsum(sizes) - sizes)[some]) / sizes[some])
                    out.append(pa.array(value, pa.float64(), mask=np.isnan(value)))
                ids, hashes = (batch.column(i)[k].values for i in (2, 3))
                yield pa.RecordBatch.from_arrays([ids.cast(id_type), pa.array([lang] * len(sizes), pa.string()), hashes, pa.array(sizes), *out], ["doc_id", "lang", "_hash", "n_grams", "perplexity", "held"])

    parts = asked.filter("packed IS NOT NULL").select("block", "lang", "ids", "hashes", "sizes", "packed")
    return parts.mapInArrow(work, f"doc_id {kind}, lang string, _hash bigint, n_grams bigint, perplexity double, held double"), [asked, spark.read.schema("block bigint").parquet(path)]


def _freed(df: DataFrame) -> DataFrame:
    """The frame; shuffle files of finished work are dropped once the driver's JVM has collected its plans."""
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def train(docs: DataFrame, good: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """The stored model of all documents whose id is in the stored, distinct ids ``_good``."""
    trusted = matching(docs.select(doc_id, lang, text), doc_id, good, "_good")
    counts = _freed(stored(gram_counts(trusted, text, lang, order), "grams"))
    return _freed(stored(kneser_ney(counts, order), "model"))


def _judged(docs: DataFrame, labels: DataFrame, text: str, lang: str, doc_id: str, quantile: float, least: int, wide_quantile: float, margin: float) -> DataFrame:
    """(doc_id, lang, _hash, n_grams, perplexity, threshold, kept) of all documents."""
    good = stored(labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_good")).distinct(), "trusted")
    model = train(docs, good, text, lang, doc_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), text_or_empty(text).alias("t")).withColumn("_hash", F.xxhash64("t"))
    read, held = perplexities(rows, model)
    known = read.join(good.hint("merge"), F.col("doc_id") == F.col("_good"), "left")
    known = known.withColumn("perplexity", F.when(F.col("_good").isNull(), F.col("perplexity")).otherwise(F.col("held")))
    band = F.floor(F.log2(F.greatest("n_grams", F.lit(1)))).cast("int")
    scores = stored(known.select("doc_id", "lang", band.alias("band"), "_hash", "n_grams", "perplexity", F.col("_good").isNotNull().alias("trusted")), "scores")
    judges = scores.filter("trusted AND perplexity IS NOT NULL")
    by_band = judges.groupBy("lang", "band").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("narrow"), F.count("*").alias("k")).filter(F.col("k") >= least).drop("k")
    by_lang = judges.groupBy("lang").agg((F.percentile_approx("perplexity", wide_quantile, 10_000) * margin).alias("wide"))
    both = scores.join(stored(by_lang, "wide"), "lang", "left").join(stored(by_band, "narrow"), ["lang", "band"], "left")
    discard(model, *held)
    judged = both.withColumn("threshold", F.coalesce("narrow", "wide"))
    kept = (F.col("n_grams") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.select("doc_id", "lang", "_hash", "n_grams", "perplexity", "threshold", kept.alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", quantile: float = 0.995, least: int = 400, wide_quantile: float = 0.9, margin: float = 1.4) -> DataFrame:
    """doc_id, lang, n_grams, perplexity, threshold, kept for every document.

    Trusted are the documents with quality 1 in ``labels`` (doc_id, quality); all of them
    train the model.  Perplexity is by character, of which there are ``n_grams``.  Short texts
    vary more, so the threshold is the ``quantile`` of the trusted documents' perplexities
    of the same language and length (by powers of two); where these are fewer than
    ``least``, it is the language's ``wide_quantile`` times ``margin``.  A language without
    trusted documents has none and keeps all its texts.  A null language is one of its own;
    null and empty texts are rejected.  Repeated labels of a document count once; repeated
    rows and rows without an id are judged alike by their text; rows that share a trusted id
    are trusted.  No rows in, no rows out; further columns are ignored.
    """
    return _judged(docs, labels, text, lang, doc_id, quantile, least, wide_quantile, margin).drop("_hash")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", quantile: float = 0.995, least: int = 400, wide_quantile: float = 0.9, margin: float = 1.4) -> DataFrame:
    """The documents that the classifier keeps, with all their columns; rows are known by id, language and text."""
    stay = _judged(docs, labels, text, lang, doc_id, quantile, least, wide_quantile, margin).filter("kept").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("_hash").alias("_of")).distinct()
    same = docs[doc_id].eqNullSafe(F.col("_id")) & (F.coalesce(docs[lang], F.lit("")) == F.col("_lang")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("_of"))
    return docs.join(stay.hint("merge"), same, "left_semi")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_quality": op5_quality}
ORACLE: dict[str, str] = {}
