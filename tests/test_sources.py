import json
import math

import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.sources import artifacts, images, runs
from plumbline.streaming import monitor

HEADER = "Image Name,Top-1 Predicted Label,Top-1 Confidence Score,Top-2 Predicted Label,Top-2 Confidence Score,Top-3 Predicted Label,Top-3 Confidence Score\n"


@pytest.fixture
def parent(spark, tmp_path):
    meta = tmp_path / "acq"
    meta.mkdir()
    (meta / "a.tsv").write_text("img_file_name\tobject_depth\tacq_id\nx\\i0.bmp\t1.5\tp\ni1.bmp\tbad\tp\n")
    (meta / "b.tsv").write_text("img_file_name\tobject_depth_min\ni0.bmp\t9\n")
    (meta / "c.tsv").write_text("lat\tlon\n1\t2\n")
    for run in ("r1", "r0"):
        d = tmp_path / "runs" / run
        d.mkdir(parents=True)
        (d / "config.yaml").write_text(f"input_path: ''\ninput-dir: {meta}\n")
        (d / "model_config.yaml").write_text("training_contrastive:\n  Loss: !!python/object:x.Y supcon\n  temp: 0.1\n")
        (d / "predictions_with_top3_scores.csv").write_text(HEADER + "".join(f"i{i}.bmp,{i % 2},0.{i},b,0.1,c,0.0\n" for i in range(8)))
        spark.createDataFrame([(i, f"i{i}.bmp", [float(i % 3), float(i), 1.0]) for i in range(8)], "feat_idx long, image_name string, features array<float>").coalesce(1).write.parquet(f"{d}/features_x.parquet_")
        part = next((d / "features_x.parquet_").glob("part-*.parquet"))
        part.rename(d / "features_x.parquet")
    (tmp_path / "runs" / "no_run").mkdir()
    (tmp_path / "runs" / "no_run" / "config.yaml").write_text("a: 1\n")
    return tmp_path / "runs"


def test_runs(spark, parent):
    index = runs.run_index(spark, str(parent))
    assert [r.run_id for r in index.collect()] == ["r0", "r1"]
    c = runs.configs(spark, index).first()
    assert c.input_path.endswith("acq")
    assert (c.cfg_loss, c.cfg_temp, c.cfg_gray) == ("supcon", "0.1", None)
    bank = runs.load(spark, str(parent))
    assert bank.features.count() == bank.predictions.count() == 16
    assert {(r.run_id, r.cfg_loss, r.cfg_temp) for r in bank.features.collect()} == {("r0", "supcon", "0.1"), ("r1", "supcon", "0.1")}
    assert bank.predictions.where("run_id = 'r1' and pred1_conf = 0.3").first().image_name == "i3.bmp"
    assert dict(bank.predictions.dtypes)["pred1_label"] == "string"
    assert {(r.image_name, r.depth, r.profile) for r in bank.metadata.where("run_id = 'r0'").collect()} == {("i0.bmp", 9.0, None), ("i1.bmp", None, "p")}


def test_many_runs_are_one_read(spark, parent):
    """Files of another column order are read by name, and a plan doesn't grow with the runs."""
    source = parent / "r0"
    for i in range(40):
        d = parent / f"x{i:02}"
        d.mkdir()
        for f in source.iterdir():
            if not f.name.endswith("_"):
                (d / f.name).write_bytes(f.read_bytes())
    (parent / "x00" / "predictions_with_top3_scores.csv").write_text("Top-1 Confidence Score,Image Name,Top-1 Predicted Label,Top-2 Predicted Label,Top-2 Confidence Score,Top-3 Predicted Label,Top-3 Confidence Score\n0.75,i1.bmp,q,b,0.1,c,0\n")
    bank = runs.load(spark, str(parent))
    assert bank.features.count() == 42 * 8
    assert bank.predictions.where("run_id = 'x00'").select("image_name", "pred1_label", "pred1_conf").collect() == [("i1.bmp", "q", 0.75)]
    assert bank.predictions.count() == 41 * 8 + 1
    assert bank.features._jdf.queryExecution().optimizedPlan().toString().count("Relation") < 4


def test_metadata_skips_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes(bytes(range(128, 256)) * 9)
    (tmp_path / "b.tsv").write_text("")
    (tmp_path / "c.tsv").write_text("file_name\tobject_depth_min\nq/i.bmp\t2\n")
    folders = spark.createDataFrame([("r", str(tmp_path)), ("s", f"{tmp_path}/missing")], "run_id string, path string")
    assert [tuple(r) for r in runs.metadata(spark, folders).collect()] == [("r", "i.bmp", 2.0, None)]


def test_no_runs(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "config.yaml").write_text("")
    with pytest.raises(ValueError, match="no run under"):
        runs.run_index(spark, str(tmp_path))


def test_name_column():
    assert runs.name_column(["lat", "Object_ID", "x_name"]) == "Object_ID"
    assert runs.name_column(["lat", "my_file"]) == "my_file"
    assert runs.name_column(["lat"]) is None
    assert runs.relaxed_yaml("- 1") == {}
    with pytest.raises(ValueError, match="not a YAML mapping"):
        runs.relaxed_yaml("a: [1")


def test_image_cascade(spark):
    files = spark.createDataFrame([("/d/a/one.bmp",), ("/d/b/one.bmp",), ("/d/a/two.png",), ("/d/b/two.jpg",)], "path string")
    names = spark.createDataFrame([("./b/one.bmp",), ("one.bmp",), ("b/two.tif",), ("none.bmp",), (None,)], "image_name string")
    got = {r.image_name: r.path for r in images.resolved(names, images.keyed(files, "/d")).collect()}
    assert got == {"./b/one.bmp": "/d/b/one.bmp", "one.bmp": "/d/a/one.bmp", "b/two.tif": "/d/b/two.jpg", "none.bmp": None, None: None}


def test_artifacts(spark, tmp_path):
    protos = spark.createDataFrame([("r", "g", 0, 5, "n")], artifacts.PROTOTYPES)
    artifacts.write_json(protos, f"{tmp_path}/p")
    assert artifacts.read_prototypes(spark, f"{tmp_path}/p", f"{tmp_path}/missing").collect() == protos.collect()
    assert artifacts.read_coverage(spark, f"{tmp_path}/missing").count() == 0
    cover = spark.createDataFrame([("r", "g", 3, [2, 1])], "run_id string, `group` string, count long, medoid_counts array<long>")
    artifacts.write_csv(cover, f"{tmp_path}/c")
    assert artifacts.read_coverage(spark, f"{tmp_path}/c").first().medoid_counts == [2, 1]


def test_command_line(spark, parent, tmp_path):
    out = tmp_path / "out"
    cli.main(["prototypes", "--parent", str(parent), "--out_dir", str(out), "--k", "2", "--min_points_for_group", "2"])
    cli.main(["proto_stability", "--parent", str(parent), "--out_dir", str(out)])
    rows = spark.read.option("header", True).csv(f"{out}/proto_stability/pairs").collect()
    assert {(r["class"], r["run_i"], r["run_j"]) for r in rows} == {("0", "r0", "r1"), ("1", "r0", "r1")}
    cover = spark.read.option("header", True).csv(f"{out}/prototypes/coverage")
    assert {"medoid_0_count", "medoid_1_count"} <= set(cover.columns)
    assert artifacts.read_coverage(spark, f"{out}/prototypes/coverage").first().medoid_counts is not None
    assert json.loads(next((out / "prototypes" / "prototypes").glob("part-*")).read_text().splitlines()[0])["run_id"] in ("r0", "r1")


def test_command_line_of_all_analyses(spark, parent, tmp_path):
    """Each command writes its artifacts, under the names of their columns; images are found."""
    out, acq = str(tmp_path / "all"), tmp_path / "acq"
    for i in range(8):
        (acq / f"I{i}.bmp").write_bytes(b"x")
    run = lambda *a: cli.main([a[0], "--parent", str(parent), "--out_dir", out, *a[1:]])
    read = lambda p: spark.read.option("header", True).csv(f"{out}/{p}")
    run("prototypes", "--k", "2", "--min_points_for_group", "2")
    run("novelty", "--top_n", "3")
    inbox = read("novelty/novelty").collect()
    assert len(inbox) == 6
    assert all(r.abs_path.endswith("/I" + r.image_name[1:]) for r in inbox)
    run("novelty_montage", "--top_n", "2", "--thumbs_per_row", "1")
    assert sorted((r.run_id, r.row) for r in read("novelty_montage/sheets").collect()) == [("r0", "0"), ("r0", "1"), ("r1", "0"), ("r1", "1")]
    run("montage", "--thumb_w", "64")
    sheets = read("montage/sheets").collect()
    assert len(sheets) == 8
    assert all(r.caption.startswith("#") and r.path.endswith("/I" + r.image_name[1:]) for r in sheets)
    run("class_graph", "--k", "3")
    assert {"run_id", "label", "0", "1"} == set(read("class_graph/confusion").columns)
    assert "node_idx" in read("class_graph/nodes").columns
    run("class_graph_global", "--k", "3")
    run("purity", "--ks", "2")
    assert "purity@2" in read("purity/points").columns
    run("tsne", "--perplexity", "2")
    assert {"tsne_x", "tsne_y"} <= set(read("tsne/tsne").columns)
    run("geometry")
    run("drift", "--window_size", "3", "--hop", "1")
    run("proto_global_stability")
    assert read("geometry/geometry").count() == 2


def test_stream_monitor(spark, tmp_path):
    values = [0.0, 0.1, 5.0, 5.0, -9.0, math.nan, 0.0]
    source = tmp_path / "in"
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, o int, v double")
    rows.where("o < 3").coalesce(1).write.parquet(str(source / "1"))
    rows.where("o >= 3").coalesce(1).write.parquet(str(source / "2"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = monitor.change_points(stream, "k", "o", "v", 0.0, 0.5, 4.0).writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["index"], r["type"]) for r in spark.sql("select * from hits").collect()}
    assert got == {(2, "up"), (3, "up"), (4, "down")}
    assert spark.sql("select * from hits").where(F.col("value") == 5.0).count() == 2
