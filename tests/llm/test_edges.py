"""Long texts, clashing columns, damaged input and unknown layouts of the operators."""

import json

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from plumbline.llm import chat, gif, quality, tokens, urls
from plumbline.llm import _words as W


def test_long_urls_and_clashing_columns(spark):
    deep = "http://a.example.org/es/" + "/".join(f"s{i}" for i in range(3000)) + "?" + "&".join(f"k{i}={'v' * 20}" for i in range(2000))
    rows = [(i, f"http://h{i % 3}.example.org/{'es' if i % 2 else 'en'}/7") for i in range(40)] + [(90, deep), (None, "http://net/x"), (91, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(c) for c in ("host", "path", "tokens", "set", "says", "listed", "html")})
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert len(got) == len(rows)
    assert (got[90].host, got[90].rule, got[90].verdict) == ("a.example.org", "example.org/es/", "block")
    assert (got[None].host, got[None].path, got[None].rule) == ("net", "/x", None)
    assert (got[91].host, got[91].path) == ("", "")


def test_long_turns_and_conversations(spark):
    text = "<|im_end|>\\ word " * 30000
    rows = [(1, t, ("user", "assistant")[t % 2], text if t == 1 else f"turn {t}") for t in range(600)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("formatted", "loss", "n", "head", "body")})
    r = chat.formatted(turns).withColumn("turns", chat.read(F.col("formatted"))).withColumn("learned", chat.masked(F.col("formatted"), F.col("loss"))).first()
    assert [(t.role, t.text) for t in r.turns] == [(role, x) for _, _, role, x in rows]
    assert r.learned == "".join(x for _, _, role, x in rows if role == "assistant")


def test_records_of_unknown_layout_are_listed(spark):
    given = [
        (1, {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}),
        (2, {"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": "b", "name": "c"}]}),
        (3, {"messages": []}), (4, {"prompt": "p", "response": "r", "weight": 1}), (5, {"messages": [{"role": "user"}, {"content": "x"}]}),
    ]
    records = spark.createDataFrame([(i, json.dumps(r)) for i, r in given] + [(6, None), (7, "[1]"), (8, "no json")], "conv_id long, record string")
    turns = chat.json_turns(records).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.role, r.text) for r in turns] == [(1, "user", "a"), (1, "assistant", "b"), (5, "user", None), (5, None, "x")]
    left = {r.conv_id: r.paths for r in chat.unmapped(records).collect()}
    assert set(left) == {2, 3, 4, 6, 7, 8}
    assert left[2] == ["messages[].content", "messages[].name", "messages[].role"]
    assert left[4] == ["prompt", "response", "weight"]


def test_damaged_media_are_rows(spark):
    good = gif.gif(bytes(576))
    odd = [(1, good), (2, good[:40]), (3, b"PNG"), (4, b""), (5, None), (6, good[:-20]), (7, b"GIF89a\xff\xff\xff\xff\x00\x00\x00")]
    media = spark.createDataFrame(odd, "doc_id long, media binary").withColumns({"Frames": F.lit(1), "ERROR": F.lit("own")})
    got = {r.doc_id: r for r in gif.timed_frames(media, True).collect()}
    assert [i for i, r in sorted(got.items()) if r.error is None] == [1, 5]
    assert len(got[1].frames) == 1
    assert got[5].frames == []
    assert all(got[i].frames is None and got[i].payload_sha256 is None for i in (2, 3, 4, 6, 7))


def test_statistics_do_not_depend_on_blocks(monkeypatch):
    import pyarrow as pa

    texts = ["Some words, 12 of them!\nAnd\nAnd a line.", "", "é à ñ " * 50, "x" * 500, "a\n\n\nb # $"]
    whole = quality.statistics(pa.array(texts))
    monkeypatch.setattr(W, "BLOCK", 64)
    assert np.allclose(quality.statistics(pa.array(texts)), whole)
    assert np.allclose(np.concatenate([quality.statistics(pa.array([t])) for t in texts]), whole)


def test_tokenizers_that_change_texts(small):
    """A definition whose pre-tokens aren't known goes to the library as a whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    assert not tokens.cuts_at_spaces(definition)
    texts = [t or "" for t in pq.read_table(f"{small}/documents.parquet").column("text").to_pylist()[:40]]
    import pyarrow as pa

    ids, counts = tokens.encoder(definition).encode(*W.buffers(pa.array(texts)))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]
