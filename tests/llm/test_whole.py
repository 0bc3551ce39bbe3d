"""Cases that shortcuts of the operators once lost."""

from pyspark.sql import functions as F

from plumbline.llm import licenses, urls


def test_licenses_without_anchor_words(spark):
    lines = ["to any person obtaining a copy of this software and associated documentation files", "Redistribution and use in source and binary forms, with or without", "This is free and unencumbered software released into the public", "it met the terms of the deal", "nothing"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(9, "\n".join(lines))], "doc_id long, text string")
    got = {r.doc_id: (r.n_paragraphs, r.licenses, r.n_unknown) for r in licenses.scan(rows).collect()}
    assert [got[i] for i in range(5)] == [(1, ["MIT"], 0), (1, ["BSD-3-Clause"], 0), (1, ["Unlicense"], 0), (1, [], 1), (1, [], 0)]
    assert got[9] == (5, ["BSD-3-Clause", "MIT", "Unlicense"], 1)


def test_rules_of_sets_with_many_tokens(spark):
    """Each set has 20 frequent tokens that come before the two that tell."""
    sets = [([*(f"a{k:02}" for k in range(20)), f"site={i % 4}", f"top={i % 2}"], "block" if i % 4 == 3 else "allow") for i in range(80)]
    found = urls.mine(spark.createDataFrame(sets, "tokens array<string>, verdict string"), 0.05, 0.9).collect()
    assert {(tuple(r.tokens), r.says, r.confidence, r.support) for r in found} == {(("site=0",), "allow", 1.0, 0.25), (("site=1",), "allow", 1.0, 0.25), (("site=2",), "allow", 1.0, 0.25), (("site=3",), "block", 1.0, 0.25), (("top=0",), "allow", 1.0, 0.5)}


def test_rules_of_equal_tokens_are_all_listed(spark):
    sets = [(["x", "y", "c"], "block")] * 20 + [(["c"], "allow")] * 20 + [(["d"], "allow")] * 20
    found = urls.mine(spark.createDataFrame(sets, "tokens array<string>, verdict string"), 0.05, 0.9).collect()
    assert {(tuple(r.tokens), r.says) for r in found} == {(("x",), "block"), (("y",), "block"), (("d",), "allow")}


def test_url_tokens_of_deep_paths_and_values(spark):
    url = "http://a.b.org/en/blog/casino/x/1/2/3/4/5/6?id=7&flag"
    rows = urls.parsed(spark.createDataFrame([(1, url)], "page_id long, url string")).first().tokens
    assert {"first=en", "part2=blog", "part3=casino", "part10=6", "depth=10", "key=id", "query=id=7", "key=flag"} <= set(rows)
    pages = [(i, f"http://h{i % 5}.net/en/{'casino' if i % 2 else 'news'}s/{'casino' if i % 2 else 'news'}/{i}") for i in range(80)]
    labels = urls.parsed(spark.createDataFrame(pages, "page_id long, url string"), []).select("tokens", F.when(F.col("page_id") % 2 == 1, "block").otherwise("allow").alias("verdict"))
    found = {(tuple(r.tokens), r.says) for r in urls.mine(labels).collect()}
    assert ((("part3=casino",), "block") in found) and ((("part3=news",), "allow") in found)
