"""Command line: ``python -m thinkframe <command> [options]`` for the data
commands (the GPU training/inference commands are not data work)."""

from __future__ import annotations

import argparse
import os
import sys

from .constants import DEFAULT_SEED, DEFAULT_SYSTEM_PROMPT, DEFAULT_VAL_FRACTION, EVAL_MODEL_FAMILIES


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="thinkframe")
    sub = ap.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build-data", help="raw {prompt, thinking, answer} -> records for both modes + catalog")
    b.add_argument("--input", required=True)
    b.add_argument("--out_dir", required=True)
    b.add_argument("--dataset_name", required=True)
    b.add_argument("--catalog", required=True, help="catalog folder; each build publishes its next version")
    b.add_argument("--model_family", default="qwen3", choices=["qwen3", "gemma4"])
    b.add_argument("--val_input", default=None)
    b.add_argument("--val_fraction", type=float, default=DEFAULT_VAL_FRACTION)
    b.add_argument("--system_prompt", default=DEFAULT_SYSTEM_PROMPT)
    b.add_argument("--seed", type=int, default=DEFAULT_SEED)
    s = sub.add_parser("summarize-training", help="training summaries -> comparison CSV")
    s.add_argument("--results_dir", default=os.path.join(os.getcwd(), "results"))
    s.add_argument("--out_csv", default=None)
    f = sub.add_parser("build-eval-table", help="train x eval comparison CSV")
    f.add_argument("--root", default=os.getcwd())
    f.add_argument("--train_results_dir", default=None)
    f.add_argument("--eval_results_dir", action="append", default=None)
    f.add_argument("--out_csv", default=None)
    p = sub.add_parser("build-pivot-table", help="base/cotgen/cotcond accuracy pivot")
    p.add_argument("--root", default=os.getcwd())
    p.add_argument("--eval_results_dir", action="append", default=None)
    p.add_argument("--model", action="append", dest="models", default=None, choices=EVAL_MODEL_FAMILIES)
    p.add_argument("--csv", default=None)
    return ap


def main(argv=None) -> int:
    args = _parser().parse_args(argv)
    from .plans import commands
    from .session import get_session
    spark = get_session()
    if args.command == "build-data":
        cat = commands.build_data(spark, args.input, args.out_dir, args.dataset_name, args.catalog,
                                  args.model_family, args.val_input, args.val_fraction, args.system_prompt,
                                  args.seed)
        print(f"catalog has {cat.count()} entries")
    elif args.command == "summarize-training":
        out = args.out_csv or os.path.join(args.results_dir, "comparison")
        n = commands.summarize_training(spark, args.results_dir, out).count()
        print(f"wrote {n} rows to {out}")
    elif args.command == "build-eval-table":
        train_dir, eval_dirs = commands.default_dirs(args.root)
        out = args.out_csv or os.path.join(args.root, "eval_results", "final_comparison_table")
        table, missing = commands.build_final_table(spark, args.train_results_dir or train_dir,
                                                    args.eval_results_dir or eval_dirs, out)
        print(f"wrote {table.count()} rows to {out}" + (f"; {missing} rows have no matching train summary"
                                                        if missing else ""))
    elif args.command == "build-pivot-table":
        _, eval_dirs = commands.default_dirs(args.root)
        commands.build_pivot_table(spark, args.eval_results_dir or eval_dirs, args.models, args.csv, show=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
