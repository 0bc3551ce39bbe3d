import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import same
from plumbline.llm import _words as W
from plumbline.llm import chat, decontaminate, gif, licenses, mixing, quality, registry, tokens, urls

DOCS = "doc_id long, text string, source string, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], DOCS)


def test_words_of_small_blocks(monkeypatch):
    texts = ["", "One two  THREE\tone", "é à\nx", "a" * 300, " "]
    data, off = W.buffers(pa.array(texts))
    whole = W.words(data, off, W.SPACED)
    monkeypatch.setattr(W, "BLOCK", 16)
    for a, b in zip(whole, W.words(data, off, W.SPACED), strict=True):
        assert np.array_equal(a, b)
    assert np.diff(whole[1]).tolist() == [0, 4, 3, 1, 0]
    assert whole[0][0] == whole[0][3] != whole[0][1]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_duckdb(spark, small, name):
    same(spark, small, registry.QUERIES[name], registry.SQL[name])


# mixing


def test_mix(spark, small):
    rows = mixing.plan(spark.read.parquet(f"{small}/documents.parquet")).toPandas()
    by = rows.assign(taken=rows["size"] * rows.copies).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert abs(by.target.sum() - by["size"].sum()) < 1e-6 * by["size"].sum()
    assert (by.target <= 3 * by["size"] + 1e-6).all()
    assert ((by.taken - by.target).abs() <= by.most).all()
    free = by[by.target < 3 * by["size"] - 1e-6]
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(by.index))}
    ratio = free.target / free.index.map(weight)
    assert ratio.max() - ratio.min() < 1e-6 * ratio.max()
    again = mixing.plan(spark.read.parquet(f"{small}/documents.parquet").repartition(7)).toPandas()
    cols = ["doc_id", "copies", "target"]
    assert rows[cols].sort_values("doc_id").reset_index(drop=True).equals(again[cols].sort_values("doc_id").reset_index(drop=True))


def test_mix_caps_and_edges(spark):
    rows = [(1, "a b", "z"), (2, "a " * 60, "y"), (2, "a " * 60, "y"), (None, "q", None), (4, None, "e"), (5, "", "e"), (6, "w " * 40, "x")]
    got = mixing.plan(docs(spark, rows)).collect()
    assert len(got) == len(rows)

    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(163)
    assert all(0 <= r.copies <= 3 for r in got)
    assert {r.source: r.target for r in got}["z"] == 6
    out = mixing.mixed(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "size"]
    assert out.count() == sum(r.copies for r in got)
    assert mixing.plan(docs(spark, [])).count() == 0


# URL filters


def test_urls(spark):
    given = [
        (1, "https://A.Example.org/es/1?x"), (2, "http://org/x"), (3, "ftp://b.com/de/9#f"), (4, "http://com/fr"), (5, None), (6, "no scheme"),
        (7, "http://example.org"), (8, "http://aexample.org/en/12"), (9, "x://example.org/en/12/é"), (10, "http://"), (1, "https://A.Example.org/es/1?x"),
    ]
    got = [tuple(r)[:5] for r in urls.judge(spark.createDataFrame(given, "page_id long, url string")).orderBy("page_id").collect()]
    assert got[0] == got[1] == (1, "a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2:6] == [(2, "org", "/x", "org/", "allow"), (3, "b.com", "/de/9", "com/de/", "block"), (4, "com", "/fr", None, "allow"), (5, "", "", None, "allow")]
    assert got[6:] == [(6, "", "", None, "allow"), (7, "example.org", "", None, "allow"), (8, "aexample.org", "/en/12", "org/", "allow"), (9, "example.org", "/en/12/é", "example.org/en/1", "block"), (10, "", "", None, "allow")]


def test_mined_rules(spark):
    rows = [(i, f"http://h{i}.example.org/{'es' if i % 2 else 'en'}/{2 + i % 7}") for i in range(60)] + [(100 + i, f"http://g{i}.net/{'es' if i % 2 else 'en'}/5") for i in range(10)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[100 + i] == (None, "block" if i % 2 else "allow") for i in range(10))
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_match_as_brute_force(spark):
    rng = np.random.default_rng(0)
    sets = [sorted({f"t{t}" for t in rng.integers(0, 8, 4)}) for _ in range(120)]
    rows = spark.createDataFrame([(s, "block" if "t1" in s and "t2" in s or "t5" in s else "allow") for s in sets], "tokens array<string>, verdict string")
    rules = urls.mine(rows, 0.05, 0.8)
    found = rules.collect()
    assert found and all(not (set(a.tokens) < set(b.tokens) and a.says == b.says and a.confidence >= b.confidence) for a in found for b in found)
    for r in found:
        n = [s for s in rows.collect() if set(r.tokens) <= set(s.tokens)]
        assert abs(sum(s.verdict == r.says for s in n) / len(n) - r.confidence) < 1e-6
    got = {tuple(r.set): r.says for r in urls.match(rows.select(F.col("tokens").alias("set")), rules).collect()}
    for s in map(tuple, sets):
        fits = [r for r in found if set(r.tokens) <= set(s)]
        assert got.get(s) == (max(fits, key=lambda r: (r.confidence, r.support, -len(r.tokens), -r.id)).says if fits else None)


# GIF


def payload(frames):
    return b"".join(np.ascontiguousarray(x.canvas[x.top : x.top + x.height, x.left : x.left + x.width, 0]).tobytes() for x in frames)


@pytest.mark.parametrize("data", [bytes(576), bytes(range(256)) * 9, b"ab" * 288 * 130, np.random.default_rng(0).integers(0, 256, 576 * 70, dtype=np.uint8).tobytes()])
def test_gif_round_trip(data):
    shown = []
    for x in gif.frames(gif.gif(data)):
        shown.append(np.ascontiguousarray(x.canvas[: x.height, : x.width, 0]).tobytes())
        assert x.delay == gif.DELAY
    assert b"".join(shown) == data


def tiny(frames, transparent=True):
    """A 2 x 2 GIF of literal codes over the colours red, green, blue and white."""
    def stream(samples):
        codes, bits, n = [4, *samples, 5], 0, 0
        width = [3] * len(codes)
        if len(samples) > 3:
            width[4:] = [3] * (len(codes) - 4)
        for c, w in zip(codes, width, strict=True):
            bits |= c << n
            n += w
        raw = bits.to_bytes(-(-n // 8), "little")
        return b"\x02" + bytes([len(raw)]) + raw + b"\0"

    out = b"GIF89a\x02\0\x02\0\x91\x03\0" + bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255])
    for disposal, clear, left, top, w, h, samples, flags in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 7, 0, clear or 0, 0]) + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (left, top, w, h)) + bytes([flags]) + stream(samples)
    return out + b"\x3b"


def test_gif_disposal_and_transparency():
    data = tiny([(1, None, 0, 0, 2, 1, [0, 1], 0), (3, 2, 0, 0, 2, 1, [2, 0], 0), (2, None, 1, 0, 1, 1, [2], 0), (0, None, 0, 1, 1, 1, [1], 0)])
    shown = [x.canvas.copy() for x in gif.frames(data)]
    red, green, blue, white = [255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]
    assert [s.tolist() for s in shown] == [
        [[red, green], [white, white]], [[red, red], [white, white]], [[red, blue], [white, white]], [[red, white], [green, white]],
    ]
    rows = [x.canvas[:, 0].tolist() for x in gif.frames(tiny([(0, None, 0, 0, 1, 2, [0, 2], 0x40)]))]
    assert rows == [[red, blue]]
    with pytest.raises(ValueError, match="not a GIF"):
        list(gif.frames(b"PNG"))


def test_media_columns(spark):
    rows = [(1, "", "s"), (2, None, "s"), (3, "é" * 288, "s"), (4, "x" * 577, "s"), (5, "long " * 20000, "s"), (6, "x" * 577, "s")]
    media = gif.store(docs(spark, rows).withColumn("media", F.lit(1)))
    got = {r.doc_id: r for r in gif.timed_frames(media, True).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert sum(r.frames[0].histogram) == 3 * 576 * min(len(p) // 576, gif.ROWS)
    assert got[4].media == got[6].media
    assert gif.timed_frames(gif.store(docs(spark, []))).count() == 0


# quality


def test_quality(spark):
    rng = np.random.default_rng(2)
    good = lambda: " ".join("".join(rng.choice(list("abcdeinorst"), int(rng.integers(2, 9)))) for _ in range(40)) + "."
    bad = lambda: " ".join(["AA!!", "B%%%"][int(rng.integers(2))] for _ in range(40))
    rows = [(i, bad() if i % 4 == 0 else good(), "s") for i in range(400)] + [(900, None, "s"), (901, "", "s"), (902, good() * 500, "s"), (None, good(), "s"), (3, good(), "s")]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, 0), (7, None, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    kept = quality.accepted(docs(spark, rows).withColumn("features", F.lit("own")), labels)
    assert kept.columns == ["doc_id", "text", "source", "size", "features"]
    assert {r.features for r in kept.collect()} == {"own"}
    assert kept.count() == sum(r.predicted for r in got)
    assert quality.classify(docs(spark, []), labels).count() == 0
    assert quality.classify(docs(spark, rows), labels.where("false")).where("score between 0 and 1").count() == len(rows)


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).where("held_out")
    r = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a")).first()
    assert r.a > 0.95


def test_rising():
    edges, levels = quality.rising(np.array([2.0, 2, 2, 2]), np.array([0.0, 2, 1, 2]), np.arange(4.0))
    assert (np.diff(levels) >= 0).all()
    assert edges.tolist() == [0, 1e-9, 1, 2 + 1e-9, 3, 3 + 1e-9]


# decontamination


def test_decontamination_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    rng = np.random.default_rng(4)
    word = lambda: ["the", "of", f"W{rng.integers(300)}", f"é{rng.integers(50)}", str(rng.integers(30))][int(rng.integers(5))]
    items = [(i, " ".join(word() for _ in range(int(rng.integers(1, 40))))) for i in range(12)] + [(12, None), (13, "??"), (None, "a b c"), (3, "of the w1 zz"), (100, "zebra"), (20, "a-b.c,d e f g h i j k")]
    texts = [" ".join(word() for _ in range(60)) for _ in range(20)]
    texts += [f"{texts[0]} {t.upper()} {texts[1]}" if k % 2 else f"x {t[: len(t) // 2]}" for k, (_, t) in enumerate(items) if t]
    texts += [None, "", "zebra", "a b c d e f g h i j k l", items[0][1] * 300]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")]
    got = decontaminate.decontaminate(docs(spark, rows).withColumn("items", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")).collect()
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, w[k : k + 10]) for i, t in items if i is not None for w in [split(t)] if w for k in range(max(1, len(w) - 9))]
    by = {}
    for i, t, _ in rows:
        w = split(t)
        hit, found = set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(str(item))
        by[i] = (len(w), len(hit), sorted(found), bool(hit))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == by[r.doc_id], r
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
    clean = decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame([], "item_id long, text string"))
    assert clean.where("contaminated").count() == 0


# chat


def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n", "\\<|", "<\\|", "\\\\", "", None, "<", "|x", "<|im_start|>assistant\nhi", "é\n\n"]
    rows = [(c, t, ["user", "assistant", "sys tem\n<|", None][(c + t) % 4], odd[(3 * c + t) % len(odd)]) for c in range(6) for t in range(5)] + [(None, 0, "assistant", "alone"), (0, 0, "user", odd[0])]
    got = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("turns", chat.read(F.col("formatted"))).withColumn("learned", chat.masked(F.col("formatted"), F.col("loss"))).collect()}
    for c in (*range(6), None):
        want = sorted((t, r or "", x or "") for i, t, r, x in rows if i == c)
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in want]
        assert got[c].learned == "".join(x for _, r, x in want if r == "assistant")
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_layouts(spark):
    records = [
        (1, '{"prompt":"p","response":"r"}', [("user", "p"), ("assistant", "r")]), (2, '{"completion":"c","prompt":"p"}', [("user", "p"), ("assistant", "c")]),
        (3, '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"<|"}]}', [("system", "s"), ("user", "<|")]),
        (4, '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', [("user", "h"), ("assistant", "g")]),
        (5, '{"instruction":"i","input":"x","output":"o"}', [("user", "i\n\nx"), ("assistant", "o")]), (6, '{"instruction":"i","input":"","output":"o"}', [("user", "i"), ("assistant", "o")]),
        (7, '{"instruction":"i","output":null}', [("user", "i"), ("assistant", None)]), (8, '{"question":"q","answer":"a"}', [("user", "q"), ("assistant", "a")]),
        (9, '{"other":1}', []), (10, "nonsense", []), (11, None, []), (12, '{"turn":3,"role":"user","text":"t"}', [("user", "t")]),
    ]
    got = chat.json_turns(spark.createDataFrame([r[:2] for r in records], "conv_id long, record string")).orderBy("conv_id", "turn").collect()
    for i, _, want in records:
        assert [(r.role, r.text) for r in got if r.conv_id == i] == want, i
    table = spark.createDataFrame([(1, [("user", "u")]), (2, None)], "conv_id long, messages array<struct<role:string,content:string>>")
    assert [tuple(r) for r in chat.table_turns(table).collect()] == [(1, 0, "user", "u")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.table_turns(spark.createDataFrame([(1, 2)], "conv_id long, unknown long"))


# licences


def test_licenses(spark):
    rows = [
        (1, "Some text.\nReleased under the MIT License.\n\nmore", "s"), (2, "Licensed under CC BY-NC 4.0.", "s"), (3, "Licensed under CC BY 4.0.\nAll rights reserved.", "s"),
        (4, "A fishing license is required at the lake.", "s"), (5, None, "s"), (6, "", "s"), (7, "word " * 30000, "s"), (7, "NOTE: this work is licensed under the GNU General Public License, version 3.", "s"), (None, "Licensed under the Apache License, Version 2.0.", "s"),
        (9, "Copyright law is hard.\nHe lost his driving licence.", "s"),
    ]
    got = [(r.doc_id, r.n_paragraphs, r.licenses, r.n_unknown) for r in licenses.scan(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 3, ["MIT"], 0), (2, 1, ["CC-BY-NC-4.0"], 0), (3, 2, ["CC-BY-4.0", "Proprietary"], 0), (4, 1, [], 1), (5, 0, [], 0), (6, 0, [], 0), (7, 1, [], 0), (7, 1, ["GPL-3.0"], 0),
        (None, 1, ["Apache-2.0"], 0), (9, 2, [], 2),
    ], key=str)
    assert licenses.scan(docs(spark, [])).count() == 0


def test_license_families_of_unseen_wordings(spark):
    rows = [(f, f"Hereby stated: {t} Thanks.") for f, texts in licenses.TEMPLATES.items() for t in texts] + [(licenses.UNKNOWN, f"Well, {t}") for t in licenses.OTHER]
    df = spark.createDataFrame(rows, "want string, text string").withColumn("words", licenses.words(F.col("text")))
    got = licenses.scanner(spark).probabilities(df).collect()
    assert np.mean([r.likely == r.want for r in got]) > 0.9


def test_unknown_class_on_statements_that_no_model_saw(spark):
    """Each held-out third is judged by a model of the others: what grants nothing is rejected, and
    the calibrated chances of what stands are no more than their share of right ones, by a margin."""
    scanner = licenses.scanner(spark)
    rows = licenses.likeliest(scanner.unseen, F.col("families"), scanner.temperature).collect()
    other = [r for r in rows if r.family == licenses.UNKNOWN]
    assert np.mean([r.likely == licenses.UNKNOWN or r.chance < licenses.LIKELY for r in other]) > 0.95
    sure = [r for r in rows if r.likely != licenses.UNKNOWN and r.chance >= licenses.LIKELY]
    assert np.mean([r.likely == r.family for r in sure]) > np.mean([r.chance for r in sure]) - 0.25


def test_hard_wrapped_licences(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    tags = "# SPDX-License-Identifier: EPL-2.0\nx = 1\n// SPDX-License-Identifier: ISC"
    rows = [(1, bsd, "s"), (2, gpl, "s"), (3, tags, "s"), (4, "Released under the GNU General Public License, version 2.", "s"), (5, "word " * 40000 + "\nLicensed under the Eclipse Public License, version 2.0.\n" + "word " * 40000, "s")]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {1: ["BSD-3-Clause"], 2: got[2], 3: ["EPL-2.0", "ISC"], 4: ["GPL-2.0"], 5: ["EPL-2.0"]}
    assert "GPL-3.0" in got[2]


# tokens


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**32])
def test_blocks(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[::97] = 5
    data = tokens.image(ids)
    assert np.array_equal(tokens.ids_of(data), ids)
    assert np.array_equal(tokens.ids_of(data, n // 3, 2 * n // 3), ids[n // 3 : 2 * n // 3])
    with pytest.raises(ValueError, match="token image"):
        tokens.ids_of(b"XXXX" + data[4:])


def test_encoder_equals_library():
    enc = tokens.Encoder(open(tokens.default_tokenizer(), encoding="utf-8").read())
    rng = np.random.default_rng(7)
    parts = [" ", "\n", "a", "é", "The", "don", "'s", "x.", ",", "1", "!", "\t", "\r", "日", "\x85", "\u3000", "<|endoftext|>", "ß", "×", "(", "_", "\xa0"]
    for added in (True, False):
        use = parts if added else [p for p in parts if "|" not in p]
        texts = ["".join(rng.choice(use, int(rng.integers(0, 25)))) for _ in range(400)] + ["", "w" * 1000, " ".join(["Word"] * 3000)]
        ids, counts = enc.encode(*W.buffers(pa.array(texts)))
        at = 0
        for t, n in zip(texts, counts, strict=True):
            assert ids[at : at + n].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t
            at += n


class Counted:
    """An object whose calls with texts are counted."""

    def __init__(self, of):
        self.of, self.texts = of, 0

    def __getattr__(self, name):
        return getattr(self.of, name)

    def tokenize(self, text):
        self.texts += 1
        return self.of.tokenize(text)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.of.encode_batch_fast(texts, **options)


def test_latin_words_are_encoded_many_at_a_time():
    """Words with accents, before punctuation or at a line's begin, cost a share of a call each."""
    enc = tokens.Encoder(open(tokens.default_tokenizer(), encoding="utf-8").read())
    enc.model, enc.tokenizer = Counted(enc.model), Counted(enc.tokenizer)
    letters = "aeéèñüßÀŷ"
    words = ["".join(letters[i // 9**k % 9] for k in range(4)) for i in range(3000)]
    text = "".join(w + (" ", ", ", "\n", "!? ")[i % 4] for i, w in enumerate(words))
    ids, _ = enc.encode(*W.buffers(pa.array([text, text])))
    assert ids.tolist() == 2 * enc.tokenizer.of.encode(text, add_special_tokens=False).ids
    assert enc.model.texts + enc.tokenizer.texts < len(words) / 50


def test_vocabularies_without_a_byte_between_words():
    """Where whole words of the vocabulary come before merges, words go to the library one by one."""
    definition = json.loads(open(tokens.default_tokenizer(), encoding="utf-8").read())
    definition["model"]["ignore_merges"] = True
    definition["model"]["vocab"]["".join(tokens.LETTERS[b] for b in "Étéqz".encode())] = len(definition["model"]["vocab"]) + 1
    enc = tokens.Encoder(json.dumps(definition))
    assert enc.between is None and enc.tokenizer.encode("Étéqz").ids == [len(definition["model"]["vocab"])]
    text = "Étéqz été\nThe end, Étéqz."
    ids, counts = enc.encode(*W.buffers(pa.array([text, "", text[:5]])))
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", text[:5])]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_added_tokens_inside_words():
    definition = json.loads(open(tokens.default_tokenizer(), encoding="utf-8").read())
    definition["added_tokens"].append({**definition["added_tokens"][0], "id": len(definition["model"]["vocab"]) + 1, "content": "don"})
    enc = tokens.Encoder(json.dumps(definition))
    texts = ["a London fog, donc don't", "the fog", " don"]
    ids, counts = enc.encode(*W.buffers(pa.array(texts)))
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_table_of_keys_that_meet():
    """Keys of one place are found, after growth too."""
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate((np.arange(40, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(40, dtype=np.uint64), rng.integers(0, 2**64, 500, dtype=np.uint64))))
    rng.shuffle(keys)
    table = tokens.Table(3)
    for at in range(0, len(keys), 31):
        assert not table.find(keys[at:]).any()
        assert table.add(keys[at : at + 31]).tolist() == list(range(at + 1, min(at + 31, len(keys)) + 1))
        assert table.find(keys[: at + 31]).tolist() == list(range(1, min(at + 31, len(keys)) + 1))


@pytest.mark.parametrize("width", range(1, 33))
def test_packed_values(width):
    """Values of each width are their lowest bits, one after another."""
    values = np.random.default_rng(width).integers(0, 2**width, (3, tokens.BLOCK), dtype=np.uint64).astype(np.uint32)
    values[0] = 2**width - 1
    rows = tokens.packed(values, width)
    assert ["".join(f"{b:08b}" for b in r) for r in rows] == ["".join(f"{v:0{width}b}" for v in r) for r in values]
    assert np.array_equal(tokens.unpacked(rows, width), values)


def test_token_files(spark):
    rows = [(5, "Hello world", "s"), (1, None, "s"), (3, "", "s"), (9, "x " * 40000, "s"), (3, "again", "s"), (3, "again", "s"), (None, "no id", "s"), (-2, "é", "s")]
    files = tokens.write(docs(spark, rows), tokens.default_tokenizer(), limit=50)
    got = tokens.read_back(files).orderBy("start").collect()
    enc = tokens.Encoder(open(tokens.default_tokenizer(), encoding="utf-8").read()).tokenizer
    start = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, (i, t, _) in zip(got, order, strict=True):
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.read_back(tokens.write(docs(spark, []), tokens.default_tokenizer())).count() == 0
