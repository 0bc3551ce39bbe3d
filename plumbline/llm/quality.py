"""Quality classifier: ridge regression on random Fourier features, then isotonic calibration.

Statistics of the whole text (never its language, source or id) are standardised and mapped to
cosines of random projections, whose products approximate a Gaussian kernel. Each partition of the
training sample sums its normal equations, a matrix of fixed size; the driver adds a fixed number
of these and solves them. A held-back part of the sample calibrates the raw scores: its label
counts in fixed bins of the score are pooled until they rise (pool adjacent violators).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from plumbline.llm import _arrow as A
from plumbline.llm import _runtime as R
from plumbline.llm import _words as W

#: Most labelled rows, by a hash of the id, that a fit takes.
SAMPLE = 60_000
#: Partitions of the training sample, and so of partial sums that the driver adds.
PARTS = 12
COSINES, RIDGE, SEED = 256, 1e-3, 20240517
BINS, LOW, HIGH = 2048, -0.5, 1.5
FOLDS = 5
#: Bytes of text that a worker measures at once (or one longer text).
PART = 1 << 20

KINDS = np.zeros(256, np.uint8)  # 0: other bytes of a character, control characters
KINDS[97:123] = 1
KINDS[65:91] = 2
KINDS[48:58] = 3
KINDS[[9, 10, 11, 12, 13, 32]] = 4
KINDS[[33, 63]] = 5
KINDS[[44, 46, 58, 59, 39, 34, 40, 41, 45]] = 6
KINDS[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 7
KINDS[192:] = 8  # the first byte of a character that isn't ASCII
NAMES = (
    "log_bytes", "log_words", "lower", "upper", "digit", "space", "exclaim", "stop", "symbol", "foreign",
    "word_length", "word_spread", "short_words", "long_words", "distinct_words", "distinct_pairs", "repeats", "top_word",
    "upper_words", "symbol_words", "stop_words", "words_a_line", "short_lines", "repeated_lines",
)


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds; an empty range is 0."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def tallied(byte_kind: np.ndarray, off: np.ndarray, values: int) -> np.ndarray:
    """How often each value below ``values`` is between the offsets: a row per value, in blocks."""
    out = np.zeros((values, len(off) - 1))
    for lo in range(0, len(byte_kind), W.BLOCK):
        part = byte_kind[lo : lo + W.BLOCK]
        first = max(0, int(np.searchsorted(off, lo, "right")) - 1)
        last = min(len(off) - 1, int(np.searchsorted(off, lo + len(part))))
        at = np.clip(off[first : last + 1] - lo, 0, len(part))
        sums = np.zeros(len(part) + 1, np.int32)
        for k in range(values):
            np.cumsum(part == k, dtype=np.int32, out=sums[1:])
            out[k, first:last] += np.diff(sums[at])
    return out


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its distinct hashes, and the count of the commonest."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, doc[at], count)
    return np.bincount(doc[at], minlength=n), most


def statistics(column) -> np.ndarray:
    """A row of NAMES for each text of an Arrow array without nulls."""
    data, off = W.buffers(column)
    n = len(column)
    kind = KINDS[data]
    size = np.diff(off)
    count = tallied(kind, off, 9)
    chars = size - tallied(data >> 6 == 2, off, 2)[1]
    h, f, s, e = W.words(data, off, W.SPACED, lower=False)
    words = np.diff(f)
    doc = np.repeat(np.arange(n), words)
    length = (e - s).astype(float)
    pairs = W.mix(h[:-1] * np.uint64(3) + h[1:])[np.diff(doc) == 0] if len(h) else h
    pair_doc = doc[:-1][np.diff(doc) == 0] if len(h) else doc
    has = lambda k: np.diff(np.concatenate(([0], np.cumsum(kind == k, dtype=np.int32)))[np.stack((s, e))], axis=0)[0]
    upper, symbol = has(2), has(7) + has(5)
    kinds, top = distinct(h, doc, n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    lines = W.NO_BREAK
    lh, lf, ls, le = W.words(data, off, lines, lower=False)
    line_words = np.searchsorted(s, le) - np.searchsorted(s, ls)
    line_doc = np.repeat(np.arange(n), np.diff(lf))
    line_kinds, _ = distinct(lh, line_doc, n)
    mean = share(per_text(length, f), words)
    columns = (
        np.log1p(size), np.log1p(words), share(count[1], chars), share(count[2], chars), share(count[3], chars), share(count[4], chars),
        share(count[5], chars), share(count[6], chars), share(count[7], chars), share(count[8], chars),
        mean, np.sqrt(np.maximum(0, share(per_text(length**2, f), words) - mean**2)), share(per_text(length <= 3, f), words), share(per_text(length > 12, f), words),
        share(kinds, words), share(distinct(pairs, pair_doc, n)[0], np.bincount(pair_doc, minlength=n)), share(per_text(again, f), words), share(top, words),
        share(per_text(upper >= 2, f), words), share(per_text(symbol > 0, f), words), share(per_text(KINDS[data[e - 1]] == 6, f), words) if len(e) else np.zeros(n),
        np.log1p(share(words, np.diff(lf))), share(per_text(line_words <= 2, lf), np.diff(lf)), 1 - share(line_kinds, np.diff(lf)),
    )
    return np.stack(columns, 1).astype(np.float32)


def measured(rows: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``rows`` and ``features``, the statistics NAMES of each whole text."""
    def compute(part):
        x = statistics(part.column(text))
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))]

    return A.extend(rows, text, StructType([StructField("features", ArrayType(FloatType()))]), compute, PART).drop(text)


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Model:
    """Projections drawn from SEED; weights and calibration come from fit()."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.RandomState(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.project = rng.normal(size=(len(mean), COSINES)) / len(mean) ** 0.5
        self.phase = rng.uniform(0, 2 * np.pi, COSINES)
        self.weights = np.zeros(COSINES + 1)
        self.edges, self.levels = np.array([0.0]), np.array([0.5])

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        out = np.cos(z @ self.project + self.phase) * (2 / COSINES) ** 0.5
        return np.concatenate((out, np.ones((len(x), 1))), 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0, 1)


def summed(rows: DataFrame, start, step) -> np.ndarray:
    """The sum over all partitions of the array that each partition sums."""
    def run(batches):
        state = start()
        for batch in batches:
            if batch.num_rows:
                step(state, matrix(batch.column(0)), batch.column(1).to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([state.astype("<f8").tobytes()], pa.binary())], names=["sum"])

    return sum(np.frombuffer(r[0], "<f8") for r in rows.select("features", "label").mapInArrow(run, "sum binary").collect())  # PARTS rows


def rising(weight: np.ndarray, total: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools neighbouring bins until their means rise; ends and levels of the pools."""
    pools: list[list[float]] = []
    for w, t, c in zip(weight, total, centre, strict=True):
        pools.append([w, t, c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w1, t1, _, end = pools.pop()
            pools[-1] = [pools[-1][0] + w1, pools[-1][1] + t1, pools[-1][2], end]
    edges = np.array([x for p in pools for x in (p[2], p[3] + 1e-9)])
    return edges, np.repeat([(t + 0.5) / (w + 1) for w, t, _, _ in pools], 2)  # Laplace's rule keeps 0 and 1 out


def sample_of(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, features, label) of the labelled ``documents`` that a fit takes, written.

    Rows are chosen by their ids, before a text is read: of more than ``sample`` labelled rows
    those with the least hashed ids, in expectation that many. Only their texts are measured.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label is not null and doc_id is not null").where(~held_out("doc_id"))
    known = R.written(documents.select("doc_id").join(known, "doc_id"), "labelled")
    count = known.count()
    chosen = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1_000_000)) < int(1e6 * min(1.0, sample / max(1, count)))
    # bounded by the sample: ids and labels; each id once, so that a text is measured once a row
    wanted = known.where(chosen).select("doc_id").distinct().hint("broadcast")
    rows = R.written(measured(documents.select("doc_id", "text").join(wanted, "doc_id", "left_semi")), "measured")
    return R.written(rows.join(labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label is not null"), "doc_id").select("doc_id", "features", "label").repartition(PARTS, "doc_id"), "sample")


def fit(rows: DataFrame) -> Model:
    """The model of ``rows`` (doc_id, features, label 0 or 1), as ``sample_of`` gives them.

    No rows, or labels of one kind, give a model whose scores are that kind's rate.
    """
    rows = rows.coalesce(PARTS)
    d = len(NAMES)

    def moments(state, x, y):
        state[0] += len(x)
        state[1 : d + 1] += x.sum(0)
        state[d + 1 :] += (x * x).sum(0)

    total = summed(rows, lambda: np.zeros(2 * d + 1), moments)
    n = max(1.0, total[0])
    mean = total[1 : d + 1] / n
    model = Model(mean, np.sqrt(np.maximum(0, total[d + 1 :] / n - mean**2)))
    side = COSINES + 1

    def equations(state, x, y):
        z = model.cosines(x)
        state[: side * side] += (z.T @ z).ravel()
        state[side * side :] += z.T @ y

    to_fit, to_calibrate = (F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(4)) > 0), (F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(4)) == 0)
    total = summed(rows.where(to_fit), lambda: np.zeros(side * side + side), equations)
    gram = total[: side * side].reshape(side, side)
    penalty = RIDGE * max(1.0, gram[-1, -1]) * np.eye(side)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(gram + penalty, total[side * side :])

    def binned(state, x, y):
        at = np.clip(((model.raw(x) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        np.add.at(state[:BINS], at, 1)
        np.add.at(state[BINS:], at, y)

    total = summed(rows.where(to_calibrate), lambda: np.zeros(2 * BINS), binned)
    used = np.flatnonzero(total[:BINS])
    if len(used):
        centre = LOW + (used + 0.5) / BINS * (HIGH - LOW)
        model.edges, model.levels = rising(total[:BINS][used], total[BINS:][used], centre)
    return model


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text is divisible by FOLDS; such rows' labels are never used."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def judged(batch, text: int, model: Model, send):
    """Batches ``send(part, scores)`` of a record batch, a bounded part of its texts at a time."""
    full = batch.set_column(text, "text", A.filled(batch.column(text)))
    done = 0
    for part in W.slices(full, "text", PART):
        yield send(batch.slice(done, part.num_rows), model.score(statistics(part.column(text)).astype(np.float64)))
        done += part.num_rows


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """A row per row of ``documents``: doc_id, held_out, score in 0 to 1, predicted 0 or 1.

    ``labels`` holds doc_id and quality. A null or empty text is scored as the empty text. Labels
    that are null, or whose document isn't there, are ignored; each of repeated labels counts. A
    row without doc_id is scored, isn't held out and has no label. Other columns are ignored.

    Every text is read once, and measured and scored in one pass; only the sample's are read twice.
    """
    model = fit(sample_of(documents, labels, sample))
    R.small_batches(documents.sparkSession)

    def send(part, s):
        return pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    def run(batches):
        for batch in batches:
            yield from judged(batch, 2, model, send)

    rows = documents.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``documents`` whose predicted quality is 1, with the columns they have.

    The model is fitted on the labelled ones of ``documents`` as in ``classify``; no column is
    added, so columns may have any names.
    """
    model = fit(sample_of(documents, labels, sample))
    R.small_batches(documents.sparkSession)
    text = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            yield from judged(batch, text, model, lambda part, s: part.filter(pa.array(s >= threshold)))

    return documents.mapInArrow(run, documents.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


register_pickle_by_value(sys.modules[__name__])
