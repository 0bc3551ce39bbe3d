"""Command line: one subcommand per analysis over the runs under a folder."""

from __future__ import annotations

import argparse

from plumbline.plans import analyses
from plumbline.session import session
from plumbline.sources import artifacts, images, runs

#: Subcommand -> (function, options with defaults); an option's type is that of its default.
COMMANDS = {
    "geometry": (analyses.geometry, {"sample_per_run": 2000, "seed": 42}),
    "purity": (analyses.purity, {"sample_per_run": 2000, "pca_dim": 50, "ks": (5, 10), "seed": 42}),
    "class_graph": (analyses.class_graph, {"k": 10, "pca_dim": 50, "max_points_per_run": 8000, "include_self": False, "mutual_only": False}),
    "class_graph_global": (analyses.class_graph_global, {"k": 10, "pca_dim": 50, "max_points_total": 20000, "per_run_cap": 4000, "include_self": False, "mutual_only": False}),
    "novelty": (analyses.novelty, {"top_n": 200, "pca_dim": 50, "reservoir_cap": 20000, "knn_k": 10, "w_centroid": 0.4, "w_density": 0.4, "w_margin": 0.2}),
    "drift": (analyses.drift, {"mode": "count", "window_size": 1000, "hop": 500, "depth_bin_size": 5.0, "sample_per_window": 400, "pca_dim": 50, "bootstrap_per_run": 2000, "k_std": 0.5, "h_std": 5.0, "min_gap": 3}),
    "prototypes": (analyses.prototypes, {"mode": "per_class", "k": 10, "pca_dim": 50, "max_per_class": 4000, "metric": "cosine", "min_points_for_group": 50, "max_iter": 20, "seed": 42}),
    "tsne": (analyses.tsne, {"sample_per_run": 2000, "pca_dim": 50, "perplexity": 30.0, "learning_rate": 200.0, "seed": 42}),
}
#: Results of a row per run, class or pair of these: one file each.
SMALL = {"geometry", "per_run", "correlations", "summary", "confusion", "prototypes", "coverage", "change_points", "pairs", "class_summary", "global_summary"}
SHEETS = {"montage": {"thumb_w": 256, "thumb_h": 256, "thumbs_per_row": 8}, "novelty_montage": {"top_n": 200, "thumb_w": 256, "thumb_h": 256, "thumbs_per_row": 8}}
STABILITY = {"proto_stability": {"pca_dim": 50}, "proto_global_stability": {"pca_dim": 50, "min_per_class": 3, "min_runs_for_sil": 2}}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline")
    sub = top.add_subparsers(dest="command", required=True)
    for name, options in {**{k: o for k, (_, o) in COMMANDS.items()}, **STABILITY, **SHEETS}.items():
        p = sub.add_parser(name)
        p.add_argument("--parent", required=True)
        p.add_argument("--out_dir", required=True)
        for option, default in options.items():
            if isinstance(default, bool):
                p.add_argument(f"--{option}", action="store_true")
            elif isinstance(default, tuple):
                p.add_argument(f"--{option}", type=int, nargs="+", default=list(default))
            else:
                p.add_argument(f"--{option}", type=type(default), default=default)
    return top


def main(arguments: list[str] | None = None) -> None:
    given = vars(parser().parse_args(arguments))
    name, parent, out = (given.pop(k) for k in ("command", "parent", "out_dir"))
    spark = session()
    bank = runs.load(spark, parent)
    if name in STABILITY | SHEETS:
        protos = artifacts.read_prototypes(spark, f"{out}/prototypes/prototypes")
    if name == "proto_stability":
        found = analyses.prototype_stability(bank, protos, artifacts.read_coverage(spark, f"{out}/prototypes/coverage"), **given)
    elif name == "proto_global_stability":
        found = {"global_summary": analyses.prototype_global_stability(bank, protos, **given)}
    elif name in SHEETS:
        sizes = {"per_row": given.pop("thumbs_per_row"), "width": given.pop("thumb_w"), "height": given.pop("thumb_h")}
        inbox = artifacts.read_csv(spark, f"{out}/novelty/novelty", artifacts.INBOX)
        found = {"sheets": analyses.prototype_sheets(protos, images.run_images(spark, bank.places), **sizes) if name == "montage" else analyses.novelty_sheets(inbox, **given, **sizes)}
    else:
        f, _ = COMMANDS[name]
        found = f(bank, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
        if name == "novelty":
            found = images.with_paths(found, images.run_images(spark, bank.places))
    for part, df in (found if isinstance(found, dict) else {name: found}).items():
        write = artifacts.write_json if part == "prototypes" else artifacts.write_csv
        write(artifacts.published(name, part, df, given.get("k", 0)), f"{out}/{name}/{part}", part in SMALL)


if __name__ == "__main__":
    main()
