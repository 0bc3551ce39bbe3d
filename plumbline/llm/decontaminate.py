"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (all of a shorter item). Its set is
its word shingles, ordered by rarity: how many documents of the corpus hold each. A document that
contains the window holds every shingle of it, so the rarest one is a sufficient prefix: document
shingles are joined with these prefixes alone. A match fixes where the window would lie; bounds on
that position and the remaining length drop it or all words are compared.

The windows are the query set. They are judged in blocks of a fixed size, one after another: the
driver and each worker hold one block at a time, and what is found is written before the next. No
document is dealt by what it shares, so a passage that many documents share makes no large task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _arrow as A
from plumbline.llm import _runtime as R
from plumbline.llm import _words as W

#: Words of benchmark items in one block: about 100 MB, the most that the driver or a worker holds.
BLOCK_WORDS = 1_000_000
BITS = 22
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "key long, again long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
ADDED = ("n_words", "n_hit", "spans", "items", "contaminated")


class Index:
    """The windows of one block of items and the shingles that stand for them."""

    def __init__(self, ids: list[str], texts: list[str], window: int, shingle: int):
        h, f, _, _ = W.words(*W.buffers(pa.array(texts, pa.large_string())), W.ALNUM)
        self.window, self.ids, self.words = window, ids, h
        item, start, length = [], [], []
        for i in range(len(ids)):
            n = int(f[i + 1] - f[i])
            size = min(window, n)
            if size:
                count = n - size + 1
                item.append(np.full(count, i))
                start.append(np.arange(f[i], f[i] + count))
                length.append(np.full(count, size))
        join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        self.item, self.start, self.length = join(item), join(start), join(length)
        # every shingle of every window: its length in words, its hash, its place in the window
        size = np.minimum(self.length, shingle)
        count = self.length - size + 1
        self.of = np.repeat(np.arange(len(self.item)), count)
        self.place = np.arange(len(self.of)) - np.repeat(np.cumsum(count) - count, count)
        self.sizes = sorted(set(size.tolist()))
        token = np.zeros(len(self.of), np.uint64)
        for n in self.sizes:
            rows = size[self.of] == n
            token[rows] = W.shingles(h, n)[(self.start[self.of] + self.place)[rows]]
        self.tokens, self.token = np.unique(token, return_inverse=True)
        self.seen = bitmap(self.tokens)

    def order(self, frequency: np.ndarray) -> None:
        """Keeps each window's rarest shingle (the first of equals) as its prefix."""
        rank = np.lexsort((self.place, frequency[self.token], self.of))
        first = rank[np.searchsorted(self.of[rank], np.arange(len(self.item)))]
        by = np.argsort(self.token[first], kind="stable")
        token, self.by, self.shift = self.token[first][by], by, self.place[first][by]
        used, at = np.unique(token, return_index=True)
        self.tokens, self.at = self.tokens[used], np.append(at, len(token))
        self.seen = bitmap(self.tokens)
        del self.of, self.place, self.token


def bitmap(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS, bool)
    out[tokens & np.uint64((1 << BITS) - 1)] = True
    return out


def matches(index: Index, h: np.ndarray, f: np.ndarray):
    """Where the documents' shingles are tokens of the index: (first word, token) arrays."""
    for n in index.sizes:
        if len(h) < n:
            continue
        s = W.shingles(h, n)
        at = np.flatnonzero(index.seen[s & np.uint64((1 << BITS) - 1)])
        token = np.searchsorted(index.tokens, s[at])
        token[token == len(index.tokens)] = 0
        real = index.tokens[token] == s[at]
        at, token = at[real], token[real]
        inside = at + n <= f[np.searchsorted(f, at, "right")]
        yield at[inside], token[inside]


def occurrences(index: Index, h: np.ndarray, f: np.ndarray):
    """Each place where a window occurs: (its first word in the documents, window)."""
    out = []
    for at, token in matches(index, h, f):
        count = index.at[token + 1] - index.at[token]
        entry = np.repeat(index.at[token] - np.cumsum(count) + count, count) + np.arange(count.sum())
        window, first = index.by[entry], np.repeat(at, count) - index.shift[entry]
        doc = np.searchsorted(f, np.repeat(at, count), "right") - 1
        fits = (first >= f[doc]) & (first + index.length[window] <= f[doc + 1])
        window, first = window[fits], first[fits]
        for lo in range(0, len(window), 1 << 18):
            w, p = window[lo : lo + (1 << 18)], first[lo : lo + (1 << 18)]
            offset = np.minimum(np.arange(index.window), index.length[w][:, None] - 1)
            same = (index.words[index.start[w][:, None] + offset] == h[p[:, None] + offset]).all(1)
            out.append((p[same], w[same]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def judge(index: Index, part, text: str):
    """A batch FOUND of the rows of ``part`` (key, again and text)."""
    h, f, _, _ = W.words(*W.buffers(part.column(text)), W.ALNUM)
    first, window = occurrences(index, h, f)
    doc = np.searchsorted(f, first, "right") - 1
    items: dict[int, set[str]] = {}
    for pair in np.unique(doc * len(index.ids) + index.item[window]).tolist():
        items.setdefault(pair // len(index.ids), set()).add(index.ids[pair % len(index.ids)])
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + index.length[window], -1)
    hit = np.cumsum(edge[:-1]) > 0
    spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
    for d in items:
        x = np.diff(np.concatenate(([0], hit[f[d] : f[d + 1]].astype(np.int8), [0])))
        spans[d] = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(x == 1), np.flatnonzero(x == -1), strict=True)]
    found = [pa.array(np.diff(f), pa.int64()), pa.array(spans, SPANS), pa.array([sorted(items.get(d, ())) for d in range(part.num_rows)], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*part.select(["key", "again"]).columns, *found], names=["key", "again", "n_words", "spans", "items"])


def indexes(benchmark: DataFrame, window: int, shingle: int) -> Iterator[Index]:
    """The benchmark's windows in blocks of about BLOCK_WORDS words (or one longer item), in turn; one
    block where there are none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), R.text_of("text").alias("text")).where("item_id is not null").distinct()
    items = R.written(items, "items")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // (2 * BLOCK_WORDS)))  # a word and the gap after it are two characters at least
    some = False
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        index = Index([r[0] for r in rows], [r[1] for r in rows], window, shingle)
        del rows
        some = some or len(index.item) > 0
        if len(index.item) or (k == n - 1 and not some):
            yield index


def occurring(rows: DataFrame, index: Index, text: str) -> DataFrame:
    """FOUND for the ``rows`` (key, again, text) and the windows of the block, written."""
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(index)
    counts = A.reduced(rows.select(text), text, "token long, n long", lambda: np.zeros(len(sent.value.tokens), np.int64), lambda state, part: tally(sent.value, state, part, text), totals)
    frequency = np.zeros(len(index.tokens), np.int64)
    for r in counts.groupBy("token").agg(F.sum("n").alias("n")).toLocalIterator():  # bounded by the block's shingles
        frequency[r[0]] = r[1]
    sent.destroy()
    index.order(frequency)
    sent = context.broadcast(index)

    def run(batches):
        for batch in batches:
            full = batch.set_column(2, text, A.filled(batch.column(2)))
            for part in W.slices(full, text):
                yield judge(sent.value, part, text)

    found = R.written(rows.mapInArrow(run, FOUND).dropDuplicates(["key", "again"]), "occurring")
    sent.destroy()
    return found


def union(spans: Column) -> Column:
    """The union of spans as spans in order."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (x["start"] <= last["end"]), joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans), none, add)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, text: str = "text") -> DataFrame:
    """``documents`` with what they share with ``benchmark`` (item_id, text).

    Words are runs of ``[0-9a-z]`` and non-ASCII characters after A-Z are lower-cased. Adds
    n_words, n_hit (words inside an occurrence of a window), spans (those words' merged ranges,
    end excluded), items (ids as strings, sorted, of items with an occurring window) and
    contaminated; columns of these names in ``documents`` are replaced, others may have any name.

    A null or empty text has no words and is clean; a null item text has no windows; an item
    without an id is left out. Repeated rows of documents are judged alike, repeated items count
    once. An empty benchmark leaves every document clean.
    """
    names = [c for c in documents.columns if c.lower() not in ADDED]
    known = [F.col(f"`{c}`") for c in names if c == text or c.lower() == "doc_id"]  # copies of a text differ in id
    own = {c: f"c{i}" for i, c in enumerate(names)}  # columns under names of this function's own, none of which clash
    keyed = documents.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()], F.xxhash64(*known).alias("key"), F.xxhash64(F.lit(3), *known).alias("again"))
    rows = keyed.select("key", "again", F.col(own[text]).alias(text))
    # what is found of a row is narrow; a text that nobody asks for isn't shuffled to it
    found = reduce(DataFrame.unionByName, [occurring(rows, index, text) for index in indexes(benchmark, window, shingle)])
    found = found.groupBy("key", "again").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    found = R.written(found.select("key", "again", "n_words", union(F.col("spans")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items")), "found")
    out = keyed.join(found.hint("merge"), ["key", "again"])  # the same plan at every size
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(*[F.col(x).alias(c) for c, x in own.items()], "n_words", n_hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


def tally(index: Index, state: np.ndarray, part, text: str) -> None:
    """Adds to ``state`` the documents of ``part`` that hold each shingle of the index."""
    h, f, _, _ = W.words(*W.buffers(part.column(text)), W.ALNUM)
    for at, token in matches(index, h, f):
        pairs = np.unique((np.searchsorted(f, at, "right") - 1) * len(index.tokens) + token)
        np.add.at(state, pairs % len(index.tokens), 1)


def totals(state: np.ndarray):
    at = np.flatnonzero(state)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(state[at])], names=["token", "n"])


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents against all benchmark items."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


register_pickle_by_value(sys.modules[__name__])
