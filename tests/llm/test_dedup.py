import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import _runtime as R
from plumbline.llm import lines, neardup
from plumbline.llm.components import components

DOCS = "doc_id long, text string, source string, n_shingles string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash") for i, t in rows], DOCS)


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, percent, size):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min(least[root(i)], default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return out


def near_copies(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(5000))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(int(rng.integers(30, 120)))]
        rows.append(" ".join(base))
        for _ in range(14):
            text = list(base)
            for _ in range(int(rng.integers(0, 5))):
                text[rng.integers(len(text))] = word()
            rows.append(" ".join(text))
    rows += ["a b c", "A b  C", "a b d", "x", "x", "", None, " \t ", "word " * 5000]
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize(("shingles", "members"), [(60_000, 2_000), (300, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, shingles, members):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", members)
    rows = near_copies()
    got = sorted(map(tuple, neardup.near_duplicates(docs(spark, rows), 80, 4).collect()))
    assert got == sorted(brute(rows, 80, 4))


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(docs(spark, []), 80, 4).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (3, "other text of its own kind"), (3, "a b c d e"), (None, None)]
    got = neardup.near_duplicates(docs(spark, rows), 80, 4).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [(-1, 0, -1, True), (-1, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (3, 2, 1, False), (3, 3, 3, True)]


def test_near_copies_without_an_id_are_linked(spark):
    """A chain of two near copies whose middle has no id, and a text in the place of a bucket's pivot."""
    base = [f"w{i}" for i in range(60)]
    middle, end = [*base[:57], "x", "y", "z"], [*base[3:57], "x", "y", "z", "u", "v", "t"]
    rows = [(7, " ".join(base)), (None, " ".join(middle)), (9, " ".join(end)), (None, "q r s t u v"), (4, "other words of another text here")]
    assert sorted(neardup.near_duplicates(docs(spark, rows), 80, 4).collect(), key=str) == sorted(brute(rows, 80, 4), key=str)
    assert brute(rows, 80, 4)[2][2] == 7
    kept = neardup.deduplicated(docs(spark, rows).withColumnsRenamed({"source": "_gone"}).withColumns({"n": F.lit(1), "_twice": F.lit(2)}), 80, 4)
    assert kept.columns == ["doc_id", "text", "_gone", "n_shingles", "n", "_twice"]
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 4, 7]


def test_links_of_blocks_without_a_pair_list():
    """Many near copies, no two of them linked: each pair is compared, in rows of numbers."""
    rng = np.random.default_rng(5)
    pool = rng.integers(1, 1 << 62, 30, dtype=np.uint64)
    found = [np.unique(np.concatenate((pool[:14], rng.integers(1, 1 << 62, 6, dtype=np.uint64)))) for _ in range(300)]
    whole = neardup.pa.struct([("node", neardup.pa.int64()), ("component", neardup.pa.int64()), ("n_shingles", neardup.pa.int64()), ("sketch", neardup.pa.list_(neardup.pa.int64())), ("members", neardup.pa.binary())])
    sketch = neardup.registers(found).astype("<u2").view("<i8")
    cell = [{"node": i, "component": i, "n_shingles": len(x), "sketch": sketch[i].tolist(), "members": x.astype("<u8").tobytes()} for i, x in enumerate(found)]
    cell[7], cell[250] = {**cell[3], "node": 7, "component": 7}, {**cell[9], "node": 250, "component": 250}
    batch = neardup.pa.RecordBatch.from_arrays([neardup.pa.array([5]), *[neardup.pa.array([cell], neardup.pa.list_(whole)) for _ in range(2)]], names=["bucket", "left", "right"])
    links = next(neardup.block_links(80)([batch])).to_pylist()
    assert {frozenset(x.values()) for x in links} == {frozenset((3, 7)), frozenset((9, 250))}
    some = next(neardup.block_members(80)([batch])).to_pylist()
    assert {3, 7, 9, 250} <= {r["node"] for r in some}
    assert {r["bucket"] for r in some} == {5}


def test_deduplicated(spark):
    rows = [(2, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (5, "quite another text than these"), (6, None)]
    got = neardup.deduplicated(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "source", "n_shingles"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 5, 6]


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:2500])
    r = neardup.registers([a, b])
    got = neardup.estimated(np.array([2000.0]), np.array([2000.0]), r[[0]], r[[1]])[0]
    assert abs(got - 1500 / 2500) < 0.2
    far = neardup.registers([x[:1500], x[1500:]])
    assert abs(neardup.estimated(np.array([1500.0]), np.array([1500.0]), far[[0]], far[[1]])[0]) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_few_rows_are_few_files(spark, monkeypatch):
    """Tables of a few numbers have a few files, however many partitions a shuffle has."""
    files, write = defaultdict(list), R.written

    def counted(df, name, *rest):
        out = write(df, name, *rest)
        files[name].append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(R, "written", counted)
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    words = [f"w{i}" for i in range(40)]
    rows = [(10 * g + i, " ".join([f"{g}", *words[g % 20 :], *(f"{g}_{k}" for k in range(30)), *["x"] * i])) for g in range(60) for i in range(3)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {d: d // 10 * 10 for d, _ in rows}
    assert max(max(files[name]) for name in ("nodes", "keys", "buckets", "pairs", "text-keys", "names", "named", "owners")) <= R.FILES, dict(files)


def brute_lines(rows, least):
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    seqs = [[(n, s) for n, s in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", s)] for _, t in order]
    words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s))
    gone = [set() for _ in order]
    for d, a in enumerate(seqs):
        for e, b in enumerate(seqs[: d + 1]):
            for i in range(len(a)):
                for j in range(i if e == d else len(b)):
                    if i and j and a[i - 1][1] == b[j - 1][1]:
                        continue
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n][1]:
                        n += 1
                    if sum(words(a[i + k][1]) for k in range(n)) >= least:
                        gone[d] |= {a[i + k][0] for k in range(n)}
    out = []
    for (d, t), g in zip(order, gone, strict=True):
        parts = (t or "").split("\n")
        out.append((d, len(parts), len(g), None if t is None else "\n".join(s for n, s in enumerate(parts) if n not in g)))
    return out


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[3] or "", r[2]))


@pytest.mark.parametrize("least", [1, 3, 10])
def test_line_dedup_equals_brute_force(spark, least):
    rng = np.random.default_rng(least)
    pool = ["a b c", "d", "e f", "g h i j k l m n o p q", "", "  ", "r s t u v", "w"]
    rows = [(int(i), "\n".join(rng.choice(pool, int(rng.integers(1, 12))))) for i in rng.permutation(25)]
    rows += [(None, "a b c\nd"), (3, rows[3][1]), (3, rows[3][1]), (90, None), (91, ""), (92, "x " * 4000 + "\n" + "a b c\nd\ne f")]
    got = lines.deduplicate_lines(docs(spark, rows).withColumns({c: F.lit(1) for c in ("copy", "_doc", "row", "known", "base", "p")}), least)
    assert got.columns[:4] == ["doc_id", "text", "source", "n_shingles"]
    assert key([(r.doc_id, r.n_lines, r.n_deleted, r.text) for r in got.collect()]) == key(brute_lines(rows, least))


def test_long_runs_and_hot_lines(spark, monkeypatch):
    """Runs of many lengths, and a line so common that its rank is split over several keys."""
    rng = np.random.default_rng(8)
    pool = [f"line {i}" for i in range(40)] + ["x"]
    long = [str(s) for s in rng.choice(pool, 70)]
    rows = [(i, "\n".join(long[int(rng.integers(0, 40)) : int(rng.integers(41, 71))] + ["x"] * int(rng.integers(0, 9)))) for i in range(14)]
    rows += [(50, "\n".join(["x"] * 150)), (51, "\n".join(["x"] * 90 + long)), (None, "\n".join(["x"] * 20))]
    monkeypatch.setattr(lines.R, "SHARE", 5)
    got = lines.deduplicate_lines(docs(spark, rows), 10)
    assert key([(r.doc_id, r.n_lines, r.n_deleted, r.text) for r in got.collect()]) == key(brute_lines(rows, 10))


def test_line_dedup_empty(spark):
    assert lines.deduplicate_lines(docs(spark, [])).count() == 0
    assert lines.deduplicate_lines(docs(spark, [(1, "one line of its own, not seen again here at all")])).first().n_deleted == 0
