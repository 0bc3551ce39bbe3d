"""Token ids of whole texts in files of patched frame-of-reference blocks.

Documents are range-partitioned and sorted by doc_id, encoded, and written as segments: rows of a
Parquet table, each with some whole documents' ids as one binary image. An image has a header, an
index of block starts, and blocks of 256 ids: the least id, a width in bits chosen among
percentiles of the differences' widths, the low bits packed at that width, and an exception list
with the places and high bits of those that don't fit.

Encoding splits a text in front of spaces and line feeds that a visible character follows, behind
such a line feed, and between a Latin letter and punctuation; byte-level pre-tokens never cross such
a place, so pieces are encoded once and looked up after that. Pieces are known by a 64-bit hash.
"""

from __future__ import annotations

import itertools
import json
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from plumbline.llm import _arrow as A
from plumbline.llm import _runtime as R
from plumbline.llm import _words as W

BLOCK, HEAD = 256, 7
MAGIC = b"PFR1"
PERCENTILES = (50, 75, 90, 95, 100)
#: Ids of a segment, from which it takes no further document.
SEGMENT = 1 << 16
#: Pieces a worker remembers; it starts anew beyond that. Longer pieces are never kept.
REMEMBERED, LONGEST = 800_000, 256
#: Words that the model gets at once.
JOINED = 128
#: What a byte is, as flags. Visible characters begin with ASCII or lead bytes under which no white space
#: lies; Latin letters of two bytes are U+00C0 to U+023F but the signs of multiplication and division.
SPACE, BREAK, VISIBLE, MARK, LETTER, LEAD, SIGNS, SIGN = (1 << i for i in range(8))
KINDS = np.zeros(256, np.uint8)
KINDS[32], KINDS[10] = SPACE, BREAK
KINDS[0x21:0x7F] |= VISIBLE
KINDS[0xC3:0xE1] |= VISIBLE
KINDS[0xE4:0xF5] |= VISIBLE
for _lo, _hi in ((33, 48), (58, 65), (91, 97), (123, 127)):  # ASCII punctuation, which ends a pre-token of letters
    KINDS[_lo:_hi] |= MARK
KINDS[65:91] |= LETTER
KINDS[97:123] |= LETTER
KINDS[0xC3:0xC9] |= LEAD
KINDS[0xC3] |= SIGNS
KINDS[[0x97, 0xB7]] |= SIGN
#: Widths in bits of the numbers of 16 bits.
WIDTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)

DOCS = ArrayType(StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType())]))
FILES = StructType([StructField("part", IntegerType()), StructField("seq", IntegerType()), StructField("n_tokens", LongType()), StructField("docs", DOCS), StructField("image", BinaryType())])


# the file format


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes, most significant bit first."""
    if width > 16:
        bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(*values.shape, 4), axis=2)[:, :, 32 - width :]
        return np.packbits(bits.reshape(len(values), -1), axis=1)
    if width == 16:
        return values.astype(">u2").view(np.uint8)
    v, w = values.astype(np.uint64).reshape(len(values), -1, 2, 4), np.uint64(width)
    four = ((v[..., 0] << w | v[..., 1]) << w | v[..., 2]) << w | v[..., 3]  # eight values are width bytes, from the left of two words
    upper, lower = four[..., 0], four[..., 1]
    out = np.zeros((*upper.shape, 2), ">u8")
    if width <= 8:
        out[..., 0] = (upper << 4 * w | lower) << 64 - 8 * w
    else:
        out[..., 0], out[..., 1] = upper << 64 - 4 * w | lower >> 8 * w - 64, lower << 128 - 8 * w
    return np.ascontiguousarray(out.view(np.uint8)[:, :, :width]).reshape(len(values), -1)


def unpacked(rows: np.ndarray, width: int) -> np.ndarray:
    if width > 16:
        wide = np.zeros((len(rows), BLOCK, 32), np.uint8)
        wide[:, :, 32 - width :] = np.unpackbits(rows, axis=1).reshape(len(rows), BLOCK, width)
        return np.packbits(wide, axis=2).view(">u4")[:, :, 0].astype(np.uint32)
    if width == 16:
        return rows.view(">u2").astype(np.uint32)
    words, w = np.zeros((len(rows), BLOCK // 8, 16), np.uint8), np.uint64(width)
    words[:, :, :width] = rows.reshape(len(rows), -1, width)
    words = words.view(">u8").astype(np.uint64)
    first, last = words[..., 0], words[..., 1]
    if width <= 8:
        upper, lower = first >> 64 - 4 * w, first >> 64 - 8 * w
    else:
        upper, lower = first >> 64 - 4 * w, first << 8 * w - 64 | last >> 128 - 8 * w
    out = np.zeros((len(rows), BLOCK // 8, 2, 4), np.uint32)
    for k in range(4):
        out[..., 0, k] = upper >> (3 - k) * w & (1 << width) - 1
        out[..., 1, k] = lower >> (3 - k) * w & (1 << width) - 1
    return out.reshape(len(rows), BLOCK)


def image(ids: np.ndarray) -> bytes:
    """The file image of an array of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(1) if blocks else np.zeros(0, np.uint32)
    apart = grid - least[:, None]
    size = WIDTHS[apart] if blocks and apart.max() < 1 << 16 else np.frexp(apart.astype(np.float64))[1].astype(np.uint8)
    order = np.sort(size, 1, kind="stable").astype(np.int64)  # of bytes by counting
    choices = np.stack([order[:, -(-BLOCK * p // 100) - 1] for p in PERCENTILES], 1) if blocks else np.zeros((0, 1), int)
    cost = choices * (BLOCK // 8) + 5 * np.stack([(size > choices[:, [k]]).sum(1) for k in range(choices.shape[1])], 1)
    width = np.take_along_axis(choices, cost.argmin(1)[:, None], 1)[:, 0] if blocks else np.zeros(0, int)
    odd = size > width[:, None]
    exceptions = odd.sum(1)
    length = HEAD + width * (BLOCK // 8) + 5 * exceptions
    start = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    body = np.zeros(int(start[-1]), np.uint8)
    at = start[:-1]
    body[at[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(blocks, 4)
    body[at + 4] = width
    body[at[:, None] + np.arange(5, 7)] = exceptions.astype("<u2").view(np.uint8).reshape(blocks, 2)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            body[at[rows][:, None] + HEAD + np.arange(w * (BLOCK // 8))] = packed(apart[rows] & np.uint32((1 << int(w)) - 1), int(w))
    block, place = np.nonzero(odd)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    lists = at[block] + HEAD + width[block] * (BLOCK // 8)
    body[lists + rank] = place
    high = (apart[block, place] >> width[block].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
    body[(lists + exceptions[block] + 4 * rank)[:, None] + np.arange(4)] = high
    return MAGIC + np.array([n], "<u8").tobytes() + start.astype("<u8").tobytes() + body.tobytes()


def ids_of(data: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """The ids lo to hi of an image; only their blocks are read."""
    if data[:4] != MAGIC:
        raise ValueError("not a token image")
    n = int(np.frombuffer(data, "<u8", 1, 4)[0])
    hi = n if hi is None else min(hi, n)
    blocks = -(-n // BLOCK)
    index = np.frombuffer(data, "<u8", blocks + 1, 12).astype(np.int64)
    body = np.frombuffer(data, np.uint8, int(index[-1]), 12 + 8 * (blocks + 1))
    first, last = lo // BLOCK, -(-hi // BLOCK)
    at = index[first:last]
    if hi <= lo:
        return np.zeros(0, np.uint32)
    field = lambda base, k, kind: np.ascontiguousarray(body[base[:, None] + np.arange(k)]).view(kind)[:, 0]
    least, width, exceptions = field(at, 4, "<u4"), body[at + 4].astype(np.int64), field(at + 5, 2, "<u2").astype(np.int64)
    out = np.zeros((len(at), BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            out[rows] = unpacked(body[at[rows][:, None] + HEAD + np.arange(w * (BLOCK // 8))], int(w))
    block = np.repeat(np.arange(len(at)), exceptions)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    lists = at[block] + HEAD + width[block] * (BLOCK // 8)
    if len(block):
        out[block, body[lists + rank]] |= field(lists + exceptions[block] + 4 * rank, 4, "<u4") << width[block].astype(np.uint32)
    return (out + least[:, None]).ravel()[lo - first * BLOCK : hi - first * BLOCK]


# encoding


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: visible ones stand for
    themselves, the others for the letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()


def cuts_at_spaces(definition: str) -> bool:
    """Whether the definition is one whose pre-tokens the encoder knows: byte-level letters, split by
    that pre-tokenizer's own pattern, without a space in front, and nothing that changes a text."""
    known = json.loads(definition)
    split, model = known.get("pre_tokenizer") or {}, known.get("model") or {}
    plain = all(known.get(k) is None for k in ("normalizer", "truncation", "padding", "post_processor"))
    bytes_ = split.get("type") == "ByteLevel" and split.get("use_regex") is True and split.get("add_prefix_space") is False
    parts = ("dropout", "continuing_subword_prefix", "end_of_word_suffix")
    return plain and bytes_ and model.get("type") == "BPE" and all(not model.get(k) for k in parts)


class WholeEncoder:
    """Any other tokenizer: whole texts go to the library, a bounded part at a time."""

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        found = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], add_special_tokens=False)
        sizes = np.array([len(e.ids) for e in found], np.int64)
        return np.fromiter(itertools.chain.from_iterable(e.ids for e in found), np.uint32, int(sizes.sum())), sizes


def room(array: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy of at least twice its length, with places for n values."""
    return array if n <= len(array) else np.concatenate((array, np.zeros(max(n - len(array), len(array)), array.dtype)))


class Table:
    """64-bit keys and their numbers from 1 on, in arrays by open addressing; at most half full."""

    def __init__(self, bits: int = 16):
        self.n, self.bits = 0, bits
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; 0 for those that aren't held."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        number = self.numbers[at]
        other = np.flatnonzero((number != 0) & (self.keys[at] != keys))
        while len(other):
            at[other] = to = (at[other] + 1) & ((1 << self.bits) - 1)
            number[other] = self.numbers[to]
            other = other[(number[other] != 0) & (self.keys[to] != keys[other])]
        return number

    def add(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of distinct keys that aren't held yet."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = np.flatnonzero(self.numbers)
            old, number = self.keys[held], self.numbers[held]
            n = self.n
            self.__init__((2 * (n + len(keys))).bit_length())
            self.n = n
            self.place(old, number)
        number = np.arange(self.n + 1, self.n + 1 + len(keys), dtype=np.int32)
        self.n += len(keys)
        self.place(keys, number)
        return number

    def place(self, keys: np.ndarray, number: np.ndarray) -> None:
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.numbers[at] == 0
            self.numbers[at[free]] = number[free]  # one of several at the same place stays
            here = self.numbers[at] == number
            self.keys[at[here]] = keys[here]
            keys, number, at = keys[~here], number[~here], (at[~here] + 1) & ((1 << self.bits) - 1)


def indices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all ranges that begin at ``start``, one range after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def between(definition: str) -> int | None:
    """A byte of no text whose letter is a token that nothing merges with: words with it between them are
    encoded like each alone. None where the vocabulary has no such byte, where whole words come first, or
    where an added token may be in a word."""
    known = json.loads(definition)
    model = known["model"]
    whole = model.get("ignore_merges") or any(t["content"].strip().isalpha() for t in known.get("added_tokens") or [])
    merged = set("".join(m if isinstance(m, str) else "".join(m) for m in model["merges"]))
    free = [b for b in (0xC0, 0xC1, *range(0xF5, 0x100)) if LETTERS[b] in model["vocab"] and LETTERS[b] not in merged]
    return free[-1] if free and not whole else None


class Encoder:
    """A byte-level BPE tokenizer that remembers pieces."""

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        kinds = KINDS.copy()  # but the first byte of an added token, which white space in front ends at, isn't visible
        kinds[[x[0] for x in self.added]] &= ~np.uint8(VISIBLE)
        self.kinds = kinds.tobytes()
        self.letters = np.array([ord(LETTERS[b]) for b in range(256)], "<u4")
        self.between = between(definition)
        self.forget()

    def forget(self) -> None:
        self.known, self.used = Table(), 0
        self.start, self.length, self.parts = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids and their numbers of words, each of which is one pre-token: the model gets many at
        once, with ``between`` behind each."""
        ends = np.cumsum(size + 1)
        letters = self.letters[data[np.minimum(indices(start, size + 1), len(data) - 1)]]
        letters[ends - 1] = self.letters[self.between]
        text = letters.tobytes().decode("utf-32-le")
        cuts = [0, *ends[JOINED - 1 : -1 : JOINED].tolist(), len(text)]
        ids = np.array([t.id for a, b in itertools.pairwise(cuts) for t in self.model.tokenize(text[a:b])], np.uint32)
        behind = ids == self.model.token_to_id(LETTERS[self.between])
        return ids[~behind], np.diff(np.flatnonzero(behind), prepend=-1) - 1

    def pieces(self, data: np.ndarray, raw: bytes, latin: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and how many each has. A Latin word, with or
        without a space in front, is one pre-token and goes to the model without the splitting."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        letters = np.add.reduceat(latin[indices(start, size)], np.cumsum(size) - size, dtype=np.int64)
        word = (letters > 0) & (letters + (data[start] == 32) == size) & (self.between is not None)
        ids, n = self.words(data, start[word], size[word]) if word.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if word.all():
            return ids, n
        rest = [raw[s : s + k].decode() for s, k in zip(start[~word].tolist(), size[~word].tolist(), strict=True)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        counts = np.zeros(len(start), np.int64)
        counts[word], counts[~word] = n, [len(x) for x in found]
        out = np.zeros(int(counts.sum()), np.uint32)
        of_word = np.repeat(word, counts)
        out[of_word], out[~of_word] = ids, list(itertools.chain.from_iterable(found))
        return out, counts

    def begins(self, data: np.ndarray, offsets: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin: at a text's first byte, at a space or line feed before a visible
        character, and, unless added tokens occur, at that character after a line feed and at ASCII
        punctuation after a Latin letter. And which bytes are of Latin letters."""
        kind = np.frombuffer(raw.translate(self.kinds), np.uint8)
        out = np.zeros(len(data), bool)
        out[offsets[:-1][offsets[:-1] < len(data)]] = True
        before, here = kind[:-1], kind[1:]
        pair = (before & LEAD != 0) & ~((before & SIGNS != 0) & (here & SIGN != 0))
        latin = kind & LETTER != 0
        latin[1:] |= pair
        ends = latin.copy()
        latin[:-1] |= pair
        seen = (here & VISIBLE != 0) & ~out[1:]
        after = (before & BREAK != 0) & seen
        out[:-1] |= (before & SPACE != 0) & seen | after
        if not any(x in raw for x in self.added):
            out[1:] |= after | (here & MARK != 0) & ends[:-1]
        return out, latin

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        first, latin = self.begins(data, offsets, raw)
        start = np.flatnonzero(first)
        size = np.diff(start, append=len(data))
        small = np.flatnonzero(size <= LONGEST)
        if self.known.n > REMEMBERED:
            self.forget()
        slot = np.zeros(len(small), np.int32)
        at = 0
        while at < len(small):  # hashes, some pieces at a time
            to = max(at + 1, int(np.searchsorted(start[small], start[small[at]] + W.BLOCK // 2)))
            s, n = start[small[at:to]], size[small[at:to]]
            lo, hi = int(s[0]), int(s[-1] + n[-1])
            up, down = W.powers(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            h = W.mix((sums[s + n - lo] - sums[s - lo]) * down[s - lo])
            slot[at:to] = self.known.find(h)
            new = at + np.flatnonzero(slot[at:to] == 0)
            if len(new):
                keys, sample, code = np.unique(h[new - at], return_index=True, return_inverse=True)
                where = small[new[sample]]
                slot[new] = self.remember(keys, *self.pieces(data, raw, latin, start[where], size[where]))[code]
            at = to
        long = np.flatnonzero(size > LONGEST)
        found, extra = self.pieces(data, raw, latin, start[long], size[long])
        store = np.concatenate((self.parts[: self.used], found)) if len(long) else self.parts
        s, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        s[small], n[small] = self.start[slot], self.length[slot]
        s[long], n[long] = self.used + np.cumsum(extra) - extra, extra
        ids = store[indices(s, n)]
        piece = np.searchsorted(start, offsets)
        sums = np.concatenate(([0], np.cumsum(n)))
        return ids, sums[piece[1:]] - sums[piece[:-1]]

    def remember(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The numbers of new pieces with these ids."""
        number = self.known.add(keys)
        self.start, self.length = room(self.start, self.known.n + 1), room(self.length, self.known.n + 1)
        self.start[number], self.length[number] = self.used + np.cumsum(counts) - counts, counts
        self.parts = room(self.parts, self.used + len(ids))
        self.parts[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return number


def encoder(definition: str) -> Encoder:
    """The worker's encoder, which serves one task after another."""
    home = sys.modules.setdefault("plumbline_worker", types.ModuleType("plumbline_worker"))
    kept = home.__dict__.get("encoder")
    if kept is None or kept[0] != hash(definition):
        kept = home.__dict__["encoder"] = hash(definition), (Encoder if cuts_at_spaces(definition) else WholeEncoder)(definition)
    return kept[1]


def with_ends(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each text's."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    kept = np.ones(len(out), bool)
    kept[np.cumsum(counts + 1) - 1] = False
    out[kept] = ids
    return out, counts + 1


def segments(definition, end: int, limit: int):
    """Rows FILES of (part, doc_id, text) rows in their order."""
    def row(part: int, seq: int, docs: list, parts: list):
        ids = np.concatenate(parts)
        kinds = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([docs], kinds), pa.array([image(ids)], pa.binary())], names=FILES.fieldNames())

    def run(batches):
        tokenizer = encoder(definition.value)
        seq, docs, parts, size, part = 0, [], [], 0, 0
        for batch in batches:
            batch = batch.set_column(2, "text", A.filled(batch.column(2)))
            for some in W.slices(batch, "text", 4 << 20):
                part = some.column(0)[0].as_py()
                ids, counts = with_ends(*tokenizer.encode(*W.buffers(some.column(2))), end)
                at = 0
                for doc, n in zip(some.column(1).to_pylist(), counts.tolist(), strict=True):
                    docs.append({"doc_id": doc, "n_tokens": n})
                    parts.append(ids[at : at + n])
                    at, size = at + n, size + n
                    if size >= limit:
                        yield row(part, seq, docs, parts)
                        seq, docs, parts, size = seq + 1, [], [], 0
        if docs:
            yield row(part, seq, docs, parts)

    return run


def write(documents: DataFrame, tokenizer: str, path: str | None = None, end: int = 0, limit: int = SEGMENT) -> DataFrame:
    """The token files of ``documents`` (doc_id, text) in ascending doc_id order.

    ``tokenizer`` is a tokenizer's definition that the driver reads; one that isn't plain byte-level
    BPE is applied to whole texts, without remembered pieces. Files go to ``path`` or to
    the shared folder. Each document's ids are followed by ``end``. A null or empty text has that
    id alone; a row without doc_id comes first; repeated rows are all written, equal ids in order
    of text. Other columns are ignored. An empty table has no segments.
    """
    spark = documents.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    R.small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(segments(definition, end, limit), FILES)
    path = path or R.scratch_path(spark, "tokens")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(FILES).parquet(path)


def placed(files: DataFrame) -> DataFrame:
    """The files with ``start``, the number of ids in all segments before."""
    total = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = total.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per partition
    starts = files.select("part", "seq", "n_tokens").join(before, F.col("part") == F.col("of"))
    here = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    starts = R.written(starts.select("part", "seq", (here + F.col("before")).alias("start")), "starts")
    return files.join(starts, ["part", "seq"])


def digests(batches):
    for batch in batches:
        for docs, data, start in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
            ids = ids_of(data.as_buffer().to_pybytes()).astype("<u4")
            doc, count = docs.values.field(0), docs.values.field(1).to_numpy()
            ends = np.cumsum(count)
            sums = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(count, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([doc, pa.array(start + ends - count), pa.array(count), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files."""
    R.small_batches(files.sparkSession)
    return placed(files).select("docs", "image", "start").mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10_token_blocks(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token files of all documents, written and read back."""
    return read_back(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or default_tokenizer()))


register_pickle_by_value(sys.modules[__name__])
