"""Command line: python -m mirrorseq.cli COMMAND [--gt PATH --preds PATH]."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import api
from .config import load_config
from .plans.align import SEQ
from .sources import sinks
from .sources.files import candidates, load_pairs

SCORES = {"neuro-scores": api.compute_neuro_scores, "fidelity-scores": api.compute_fidelity_scores}
#: Rows of the table of all sequences that a payload lists.
MOST_LISTED = 10_000
COMMANDS = [*SCORES, "neuro-analysis", "etho-scores", "etho-analysis", "cross-scores", "cross-analysis"]


def chosen(label: str, prefix: str, given: str | None, ask=input) -> str:
    """The given path; else the only file of the folder with the prefix, or the
    one that is asked for, by number or name."""
    if given:
        return given
    found = candidates(prefix)
    if len(found) == 1:
        return found[0]
    for k, name in enumerate(found, 1):
        print(f"  [{k}] {name}")
    answer = ask(f"{label} file: ").strip()
    if answer.isdigit() and 0 < int(answer) <= len(found):
        return found[int(answer) - 1]
    if not Path(answer).is_file():
        raise FileNotFoundError(f"{label} file {answer!r} does not exist")
    return answer


def chosen_config(given: str | None, ask=input) -> str | None:
    """The given file; else the only JSON file of the folder, if there is one,
    or of several the one that is asked for.  Where nobody can answer, several
    files are an error."""
    found = sorted(str(p) for p in Path(".").glob("*.json"))
    if given or len(found) < 2:
        return given or (found[0] if found else None)
    for k, name in enumerate(found, 1):
        print(f"  [{k}] {name}")
    try:
        answer = ask("configuration file: ").strip()
    except (EOFError, OSError):  # nobody to ask
        answer = ""
    if answer.isdigit() and 0 < int(answer) <= len(found):
        return found[int(answer) - 1]
    if answer in found:
        return answer
    raise FileNotFoundError(f"several configuration files, name one with --config: {', '.join(found)}")


def per_sequence(each: DataFrame, folder: str, most: int = MOST_LISTED) -> dict | str:
    """{metric: {sequence: score}}; the folder that holds the table, which the
    executors write, if it has more than ``most`` rows."""
    some = each.select("metric", SEQ, "score").limit(most + 1).collect()
    if len(some) > most:
        return folder
    listed: dict = {}
    for r in sorted(some, key=lambda r: (r["metric"], r[SEQ])):
        listed.setdefault(r["metric"], {})[r[SEQ]] = r["score"]
    return listed


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mirrorseq")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--gt", "--gt-dir", dest="gt")
    parser.add_argument("--preds", "--inf-dir", dest="preds")
    parser.add_argument("--config")
    parser.add_argument("--json-out")
    parser.add_argument("--output-root", default="outputs")
    args = parser.parse_args(argv)
    config = load_config(chosen_config(args.config))
    gt_path, preds_path = chosen("ground-truth", "gt_", args.gt), chosen("inference", "inference_", args.preds)
    spark = SparkSession.builder.getOrCreate()
    gt, preds = load_pairs(spark, gt_path, preds_path, config.sequence_key, config.time_key)
    folder = f"{args.output_root}/{Path(preds_path).stem}-{args.command}"
    out = Path(args.json_out) if args.json_out else Path(folder) / "scores.json"
    if args.json_out and args.command.startswith(("etho", "cross")) and out.suffix != ".json":
        out = out / "scores.json"  # a folder
    tables = {}
    if args.command in SCORES:
        scores = {r.metric: r.value for r in SCORES[args.command](preds, gt, config).collect()}
        payload = {"scores": scores}
    elif args.command == "neuro-analysis":
        found, tables = api.run_neuro_full_analysis(preds, gt, config)
        scores = {r.metric: r.value for r in found.collect()}
        payload = {"scores": scores}
    elif args.command.startswith("etho"):
        if args.command == "etho-analysis":
            (whole, each, across), tables = api.run_etho_full_analysis(gt, preds, config)
        else:
            whole, each, across = api.compute_etho_scores(gt, preds, config)
        scores = {r.metric: r.value for r in whole.collect()}
        means = across.collect()
        # one row a sequence and metric: written by the executors
        tables["per_sequence"] = each
        payload = {"global_scores": scores, "per_sequence": per_sequence(each, f"{folder}/per_sequence"), "per_sequence_mean": {r.metric: r["mean"] for r in means}, "per_sequence_std": {r.metric: r.deviation for r in means}}
    else:
        if args.command == "cross-analysis":
            found, tables = api.run_cross_full_analysis(preds, gt, config)
        else:
            found = api.compute_cross_scores(preds, gt, config)
        payload = {}
        for r in found.collect():
            payload.setdefault(r.block, {})[r.metric] = r.value
        scores = payload.pop("composite")
        payload |= scores
    if tables:
        sinks.write_tables(tables, folder)
    print(sinks.shown(args.command, scores))
    print(sinks.write_json(payload, out))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
