"""Near-duplicate documents by HyperMinHash sketches and exact confirmation.

A document is the set of its word shingles. A sketch has one register per bucket; every shingle is
hashed into each bucket and the least hash is kept in compressed form: its number of leading zeros
and the ten bits after the first one. Registers are banded four at a time: sets that agree on a
band are candidates. With 24 bands a pair at similarity 0.8 is missed with probability 3e-6.

Candidates pass a Jaccard estimate from matching registers, corrected for registers that agree by
collision, with five standard deviations to spare; then both whole texts are compared.

Equal sets are one node from the start, so exact copies never meet. In each band's bucket one
member is the pivot that all others are compared with. Buckets whose other members are one
component by then are done. Members of the rest are dealt over blocks, and two blocks are compared
in one call that returns links alone. So every pair of a bucket is compared or already connected.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from plumbline.llm import _arrow as A
from plumbline.llm import _runtime as R
from plumbline.llm import _words as W
from plumbline.llm.components import components

ROWS, BANDS, MANTISSA = 4, 24, 10
BUCKETS = ROWS * BANDS
SLACK = 5.0
#: Shingles and members in a block of a group.
BLOCK_SHINGLES, BLOCK_MEMBERS = 60_000, 2_000
#: Slots of text keys: a filter of 8 MB at most, by which few texts are read for few keys.
SLOTS = 1 << 20
SKETCH = StructType([StructField("n_shingles", LongType()), StructField("name", BinaryType()), StructField("sketch", ArrayType(LongType()))])

_random = np.random.RandomState(20240229)
SCALE = _random.randint(1, 1 << 31, BUCKETS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
SALT = _random.randint(0, 1 << 32, BUCKETS, dtype=np.uint64).astype(np.uint32)


def sets(column, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes."""
    h, f, _, _ = W.words(*W.buffers(column), W.SPACED)
    return [np.unique(W.shingles(h[f[i] : f[i + 1]], size)) for i in range(len(column))]


def registers(found: list[np.ndarray]) -> np.ndarray:
    """The sketches of non-empty sets: a row of compressed registers each."""
    least = np.empty((len(found), BUCKETS), np.uint32)
    bounds = np.cumsum([0, *map(len, found)])
    lo = 0
    while lo < len(found):  # some whole sets at a time, so that the hashes stay in the cache
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + (1 << 15), "right")) - 1)
        x = np.concatenate(found[lo:hi])
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        at = bounds[lo:hi] - bounds[lo]
        y = np.empty_like(x)
        z = np.empty_like(x)
        for j in range(BUCKETS):
            np.bitwise_xor(x, SALT[j], out=y)
            np.multiply(y, SCALE[j], out=y)
            np.right_shift(y, 15, out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0x2C1B3C6D), out=y)
            least[lo:hi, j] = np.minimum.reduceat(y, at)
        lo = hi
    return compressed(least)


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros of 32-bit hashes and the MANTISSA bits after the first one, in 16 bits."""
    value = least.astype(np.uint64)
    top = np.frexp(np.maximum(value, 1).astype(np.float64))[1] - 1
    zeros = (31 - top).astype(np.uint16)
    fraction = ((value << np.uint64(32)) >> (top.astype(np.uint64) + np.uint64(32 - MANTISSA))) & np.uint64((1 << MANTISSA) - 1)
    return (zeros << np.uint16(MANTISSA)) | fraction.astype(np.uint16)


def sketched(part, text: str, size: int):
    found = sets(part.column(text), size)
    full = [i for i, x in enumerate(found) if len(x)]
    names: list = [None] * len(found)
    rows: list = [None] * len(found)
    if full:
        for i, r in zip(full, registers([found[i] for i in full]), strict=True):
            names[i], rows[i] = name_of(found[i]), r.astype("<u2").view("<i8")
    return [pa.array([len(x) for x in found], pa.int64()), pa.array(names, pa.binary()), pa.array(rows, pa.list_(pa.int64()))]


def unpacked(column) -> np.ndarray:
    """The registers of an Arrow column of sketches, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).view("<u2").reshape(-1, BUCKETS)


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of disjoint sets of n and m members agree."""
    both = (n + m)[:, None].astype(float)
    k = np.arange(33)[None, :]
    edge = np.exp(-both * 2.0**-k)  # the minimum of either set is above 2**-k
    cell = 2.0 ** -(k[:, 1:] + MANTISSA)
    return (cell * (n * m)[:, None] / both * (edge[:, 1:] - edge[:, :-1])).sum(1)


def estimated(n, m, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for collisions."""
    share, chance = (a == b).mean(1), np.minimum(collisions(n, m), 0.5)
    return (share - chance) / (1 - chance)


def lowest(threshold: float) -> float:
    """The least estimate of a pair that is compared: SLACK standard deviations below the threshold."""
    return threshold - SLACK * (threshold * (1 - threshold) / BUCKETS) ** 0.5


def promising(threshold: float):
    """Keeps pairs that the sizes and the estimate allow to reach the threshold."""
    low = lowest(threshold)

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(float) for c in ("n", "m"))
            a, b = (unpacked(batch.column(c)) for c in ("a_sketch", "b_sketch"))
            keep = (np.minimum(n, m) >= threshold * np.maximum(n, m)) & (estimated(n, m, a, b) >= low)
            yield batch.select(["a", "b", "a_key", "b_key", "a_name", "b_name"]).filter(pa.array(keep))

    return run


def name_of(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def confirmed(percent: int, size: int):
    """Keeps pairs whose whole texts hold sets of the similarity, in percent, or more.

    A text that isn't the node's own (another text with the same hash) confirms nothing.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                a, b = sets(A.filled(part.column("a_text")), size), sets(A.filled(part.column("b_text")), size)
                keep = []
                for x, y, *own in zip(a, b, part.column("a_name").to_pylist(), part.column("b_name").to_pylist(), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    near = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
                    keep.append(near and [name_of(x), name_of(y)] == own)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def text_key(doc_id: str, text: str) -> Column:
    """The key by which the text of a row is found again; a doc_id may be null or repeat."""
    return F.xxhash64(R.text_of(text), F.col(doc_id).cast("long"))


def texts_of(documents: DataFrame, doc_id: str, text: str, keys: DataFrame, most: int) -> DataFrame:
    """(key, text) of the distinct ``keys`` (key), ``most`` at most, one row for each different text.

    Texts that no key can be of are dropped where they are read: a key falls into one of SLOTS slots,
    and those in use are a broadcast of SLOTS numbers at most. What is left is sorted to the keys.
    """
    keys = R.written(R.gathered(keys, most), "text-keys")
    slot = F.pmod(F.col("key"), F.lit(SLOTS)).alias("slot")
    rows = documents.select(text_key(doc_id, text).alias("key"), F.col(text).alias("text")).select("key", "text", slot)
    rows = rows.join(F.broadcast(keys.select(slot).distinct()), "slot", "left_semi").drop("slot").join(keys.hint("merge"), "key", "left_semi")
    return rows.withColumn("again", F.xxhash64(F.lit(3), "text")).dropDuplicates(["key", "again"]).select("key", "text")


def links(rows: DataFrame, nodes: DataFrame, documents: DataFrame, doc_id: str, text: str, percent: int, size: int) -> DataFrame:
    """The confirmed ones of the pairs ``rows`` (a, b)."""
    spark = nodes.sparkSession
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("key").alias(f"{x}_key"), F.col("name").alias(f"{x}_name"), F.col("n_shingles").alias("n" if x == "a" else "m"), F.col("sketch").alias(f"{x}_sketch"))
    R.small_batches(spark)
    near = rows.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_key", "b_key", "a_name", "b_name", "n", "m", "a_sketch", "b_sketch")
    near = R.written(near.mapInArrow(promising(percent / 100), "a long, b long, a_key long, b_key long, a_name binary, b_name binary"), "near")
    wanted = near.select(F.col("a_key").alias("key")).union(near.select("b_key")).distinct()
    texts = R.written(texts_of(documents, doc_id, text, wanted, 2 * near.count()), "texts")
    both = near.join(texts.select(F.col("key").alias("a_key"), F.col("text").alias("a_text")), "a_key").join(texts.select(F.col("key").alias("b_key"), F.col("text").alias("b_text")), "b_key")
    return R.written(both.select("a", "b", "a_name", "b_name", "a_text", "b_text").mapInArrow(confirmed(percent, size), "a long, b long").distinct(), "links")


class Block:
    """Members of one block: their ids, components, sizes and sketches and, if they are there, in one
    array, their sets."""

    def __init__(self, cell, names: dict):
        rows = cell.values
        self.ids = rows.field("node").to_numpy()
        self.component = np.array([names.setdefault(c, len(names)) for c in rows.field("component").to_pylist()])
        self.size = rows.field("n_shingles").to_numpy()
        self.sketch = unpacked(rows.field("sketch"))
        if "members" in {f.name for f in rows.type}:
            self.shingles = W.buffers(rows.field("members"))[0].view("<u8")
            self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.kinds, self.kind = np.unique(self.size, return_inverse=True)

    def index(self) -> None:
        """Shingles in order, with their owners, for ``shared``."""
        order = np.argsort(self.shingles, kind="stable")
        self.keys, self.owners = self.shingles[order], np.repeat(np.arange(len(self.ids)), self.size)[order]

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many of the sorted shingles ``own`` each member holds."""
        lo, hi = np.searchsorted(self.keys, own), np.searchsorted(self.keys, own, "right")
        count = hi - lo
        at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(self.owners[at], minlength=len(self.ids))

    def candidates(self, other: Block, i: int, threshold: float) -> np.ndarray:
        """Members of another component than the other block's member i, whose sizes and estimates
        allow them to be as like it as the threshold."""
        n = float(other.size[i])
        fits = (np.minimum(n, self.kinds) >= threshold * np.maximum(n, self.kinds))[self.kind]
        k = np.flatnonzero(fits & (self.component != other.component[i]))
        if len(k):
            chance = np.minimum(collisions(np.full(len(self.kinds), n), self.kinds.astype(float)), 0.5)[self.kind[k]]
            share = (self.sketch[k] == other.sketch[i]).mean(1)
            k = k[(share - chance) / (1 - chance) >= lowest(threshold)]
        return k


def block_members(percent: int):
    """(bucket, node) of members of two blocks of a bucket that are a candidate pair with another."""
    def run(batches):
        for batch in batches:
            bucket, found = [], []
            for g, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                names: dict = {}
                x, y = Block(left, names), Block(right, names)
                a, b = np.zeros(len(x.ids), bool), np.zeros(len(y.ids), bool)
                for i in range(len(x.ids)):
                    k = y.candidates(x, i, percent / 100)
                    a[i] = len(k) > 0
                    b[k] = True
                ids = np.unique(np.concatenate((x.ids[a], y.ids[b])))
                found.append(ids)
                bucket.append(np.full(len(ids), g))
            join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(join(bucket), pa.int64()), pa.array(join(found), pa.int64())], names=["bucket", "node"])

    return run


def block_links(percent: int):
    """Links between the members of two blocks that no link connects yet.

    A member of the first block meets all of the second at once: those of its own component by
    then drop out, sizes and estimates drop more, and what is left is counted exactly through an
    index of the second block's shingles. What is held is a row of numbers per member, no pairs.
    """
    def run(batches):
        for batch in batches:
            found: list[tuple[int, int]] = []
            for left, right in zip(batch.column(1), batch.column(2), strict=True):
                names: dict = {}
                x, y = Block(left, names), Block(right, names)
                y.index()
                for i in range(len(x.ids)):
                    k = y.candidates(x, i, percent / 100)
                    if not len(k):
                        continue
                    both = y.shared(x.shingles[x.start[i] : x.start[i + 1]])[k]
                    for j in k[100 * both >= percent * (x.size[i] + y.size[k] - both)]:
                        one, two = x.component[i], y.component[j]
                        if one != two:
                            found.append((int(x.ids[i]), int(y.ids[j])))
                            x.component[x.component == one] = two
                            y.component[y.component == one] = two
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return run


def set_rows(size: int):
    """(name, members) of (key, text) rows."""
    def run(batches):
        for batch in batches:
            for part in W.slices(batch.set_column(1, "text", A.filled(batch.column(1))), "text", 1 << 20):
                found = sets(part.column(1), size)
                yield pa.RecordBatch.from_arrays([pa.array([name_of(x) for x in found], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], names=["name", "members"])

    return run


def paired(rows: DataFrame, weight: Column, *columns: str) -> DataFrame:
    """(bucket, left, right): the pairs of blocks in which members of different components of a bucket
    meet, each block an array of structs of ``columns``.

    A bucket's members are dealt over blocks bounded in ``weight``. Those of its largest component,
    whose blocks are numbered last, meet others only. A pair of blocks is a key of its own, so the
    pairs of a large bucket are spread over all tasks.
    """
    sums = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    sums = sums.groupBy("bucket").agg(F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("most"), F.max_by("w", F.struct("n", "component")).alias("w"), F.sum("w").alias("all"))
    sums = sums.select("bucket", "n", "most", F.ceil((F.col("all") - F.col("w")) / BLOCK_SHINGLES).alias("minor"), F.ceil(F.col("w") / BLOCK_SHINGLES).alias("major")).where("minor > 0")
    sums = R.written(sums, "bucket-sums")
    place = F.when(F.col("component") != F.col("most"), F.pmod(F.xxhash64("node"), "minor")).otherwise(F.col("minor") + F.pmod(F.xxhash64("node"), "major"))
    dealt = R.met(rows, sums, ["bucket"], "node").withColumn("block", place).withColumn("blocks", F.col("minor") + F.col("major"))
    blocks = R.written(dealt.groupBy("bucket", "block", "minor", "blocks").agg(F.collect_list(F.struct(*columns)).alias("x")), "blocks")
    # blocks that are empty have no row; a pair is (first, second), the first of the minor ones
    first = blocks.where(F.col("block") < F.col("minor")).select("bucket", F.col("block").alias("first"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("second"), F.col("x").alias("left"))
    second = blocks.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("block"), F.col("minor") - 1))).alias("first"), F.col("block").alias("second"), F.col("x").alias("right"))
    return first.join(second.hint("merge"), ["bucket", "first", "second"]).select("bucket", "left", "right")


def blocked(buckets: DataFrame, nodes: DataFrame, documents: DataFrame, doc_id: str, text: str, percent: int, size: int) -> DataFrame:
    """Links within ``buckets`` (bucket, node, component), each of several components.

    First sketches meet, and tell which members are a candidate pair with another at all; for these
    alone texts are read, and their sets meet.
    """
    spark = nodes.sparkSession
    few = F.lit(BLOCK_SHINGLES // BLOCK_MEMBERS)
    columns = ["node", "component", "n_shingles", "sketch"]
    pairs = paired(buckets.join(nodes.select("node", "n_shingles", "sketch"), "node"), few, *columns)
    R.small_batches(spark, 8)  # pairs of blocks
    maybe = R.written(pairs.mapInArrow(block_members(percent), "bucket long, node long").distinct(), "candidates")
    R.small_batches(spark)
    rows = buckets.join(maybe, ["bucket", "node"]).join(nodes.select("node", "key", "name", "n_shingles", "sketch"), "node")
    rows = R.written(R.gathered(rows, maybe.count()), "open-nodes")
    whole = texts_of(documents, doc_id, text, rows.select("key").distinct(), rows.count()).mapInArrow(set_rows(size), "name binary, members binary").dropDuplicates(["name"])
    pairs = paired(rows.join(R.written(whole, "sets"), "name"), F.greatest("n_shingles", few), *columns, "members")
    R.small_batches(spark, 8)
    found = R.written(pairs.mapInArrow(block_links(percent), "a long, b long").distinct(), "links")
    R.small_batches(spark)
    return found


def grouped(nodes: DataFrame, documents: DataFrame, doc_id: str, text: str, percent: int, size: int) -> DataFrame:
    """(node, component) of nodes that have links."""
    bands = nodes.select("node", F.posexplode("sketch").alias("band", "value"))
    most = BANDS * nodes.count()
    keys = R.written(R.gathered(bands.groupBy("band", "value").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1"), most), "keys")
    buckets = R.written(R.gathered(R.met(bands, keys, ["band", "value"], "node").where("node <> pivot").select("band", "value", "node", "pivot"), most), "buckets")
    most = buckets.count()
    pairs = R.written(R.gathered(buckets.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), most), "pairs")
    found = links(pairs, nodes, documents, doc_id, text, percent, size)
    # buckets whose members beside the pivot, which is compared with all, are in several components
    named = buckets.select("band", "value", "node").join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = R.written(R.gathered(named, most), "named")
    open_ = named.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("last")).where("least <> last")
    open_ = R.written(R.gathered(open_.select("band", "value", "n"), most), "open-keys")
    # two buckets of one hash are one, whose members meet a few more than they need
    left = R.written(R.gathered(R.met(named, open_, ["band", "value"], "node").select(F.xxhash64("band", "value").alias("bucket"), "node", "component"), most), "open")
    if left.limit(1).count():
        found = found.union(blocked(left, nodes, documents, doc_id, text, percent, size))
    return components(found)


def near_duplicates(documents: DataFrame, percent: int = 80, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``documents``: doc_id, n_shingles, component_id, kept.

    Words end at ASCII white space, A-Z count as a-z. A set holds all distinct shingles of ``size``
    words, or the whole text as one where it has fewer words. Texts are linked when their sets'
    similarity is ``percent`` or more, and component_id is the least doc_id that links reach;
    ``kept`` is true for that document alone.

    Null and empty texts have no shingles and no links. A row without doc_id takes part, and its
    component_id is null only if no linked row has a doc_id; then it is kept. Repeated rows are in
    one component, and each is returned; they are kept alike. Other columns are ignored.
    """
    return judged(documents, percent, size, doc_id, text).drop("key")


def judged(documents: DataFrame, percent: int, size: int, doc_id: str, text: str) -> DataFrame:
    """``near_duplicates`` with the key of each row's text."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(doc_id, text).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = R.written(A.extend(rows, "text", SKETCH, lambda part: sketched(part, "text", size)).drop("text"), "sketches")
    # a node is a different set, known by its least row's number
    nodes = rows.where("name is not null").groupBy("name").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc"))
    nodes = R.written(R.gathered(nodes.join(rows.select(F.col("row").alias("node"), "key", "n_shingles", "sketch"), "node"), rows.count()), "nodes")
    names = grouped(nodes, documents, doc_id, text, percent, size)
    named = nodes.select("node", "doc", "name").join(names, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    owner = R.written(R.gathered(named.join(least, "component").select("name", "component_id"), nodes.count()), "owners")
    out = rows.select("doc_id", "n_shingles", "name", "key").join(owner, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "key")


def deduplicated(documents: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """``documents`` with one row of each component: that of the least doc_id.

    Of rows repeated with the same doc_id one stays, the least text first. Rows without shingles
    are all kept, and so are rows without doc_id in a component that has no doc_id at all; a row
    without doc_id that is linked to one with a doc_id goes. Columns may have any names.
    """
    found = R.written(judged(documents, percent, size, "doc_id", "text"), "components")
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key("doc_id", "text").alias("key"))
    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct().hint("merge")  # the same plan at every size
    kept = whole.join(gone, "id", "left_anti")
    unnamed = found.where("not kept and doc_id is null").select(F.col("key").alias("gone")).distinct()
    if unnamed.limit(1).count():
        kept = kept.join(unnamed, F.col("id").isNull() & (F.col("key") == F.col("gone")), "left_anti")
    twice = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    if twice.limit(1).count():
        again = kept.join(twice, "id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("row.text")))
        kept = kept.join(twice, "id", "left_anti").unionByName(again.where("n = 1").drop("n"))
    return kept.select("row.*")


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at 80 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=80, size=4)


register_pickle_by_value(sys.modules[__name__])
