"""Command line: ``python -m tamarack <command> --help``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import activations, evaluation, markers, sampling, tokens
from tamarack.operators.align import align_text
from tamarack.plans.corpus import prepare_corpus
from tamarack.session import build_session
from tamarack.sources import (
    default_suite,
    load_prompts,
    save_corpus,
    scan_corpus,
    write_eval_detail,
    write_summary_text,
)


def _read(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return scan_corpus(spark, args.data, args.format, args.pattern, args.recursive)


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    """Align, tokenize, truncate and pad a corpus."""
    aligned = align_text(_read(spark, args), args.keep)
    if args.tokenizer:
        text = "\n".join(r.value for r in spark.read.text(args.tokenizer, wholetext=True).collect())
        ids = tokens.tokenize_with(aligned, text, args.max_length)
        out = tokens.truncate_pad(ids, args.max_length, pad_id=args.pad_id)
    elif args.vocab_size:
        out = prepare_corpus(aligned, tokens.build_vocab(aligned, args.vocab_size), args.vocab_size, args.max_length)
    else:
        out = aligned
    save_corpus(out, args.out)


def sample(spark: SparkSession, args: argparse.Namespace) -> None:
    """Draw an exact number of rows, valid token rows only with --tokens."""
    df = _read(spark, args)
    draw = sampling.sample_valid_exact if args.tokens else sampling.sample_exact
    save_corpus(draw(df, args.n, args.key, args.seed), args.out)


def split(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write the corpus with its train or validation label as partitions."""
    labelled = sampling.split_exact(_read(spark, args), args.fraction, args.key, args.seed)
    labelled.write.mode("overwrite").partitionBy("split").parquet(args.out)


def prevalence(spark: SparkSession, args: argparse.Namespace) -> None:
    """Count rows that hold a marker, exactly or from a sample."""
    df = _read(spark, args)
    if args.sample:
        found = markers.marker_prevalence_sampled(df, args.fields, args.marker, args.key, args.seed, args.sample)
    else:
        found = markers.marker_prevalence(df, args.fields, args.marker, args.by)
    found.show(truncate=False)


def prompts(spark: SparkSession, args: argparse.Namespace) -> None:
    """Print the default prompt suite, or write it as JSON."""
    suite = spark.createDataFrame([(default_suite(args.marker),)], "suite map<string,array<string>>")
    text = suite.select(F.to_json("suite").alias("value"))
    if args.out:
        text.coalesce(1).write.mode("overwrite").text(args.out)
    else:
        print(text.first().value)


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    """Score responses and write details and summary."""
    responses = _read(spark, args)
    if "prompt" not in responses.columns:
        suite = load_prompts(spark, args.prompts, args.marker)
        responses = evaluation.pair_by_position(suite, responses)
    scored = evaluation.score_responses(responses, args.marker)
    summary = evaluation.eval_summary(scored)
    stamp = time.strftime("%Y%m%d_%H%M%S")
    write_eval_detail(evaluation.eval_detail(scored, F.lit(stamp)), f"{args.out}/details")
    lines = evaluation.eval_summary_text(summary, args.model, time.strftime("%Y-%m-%d %H:%M:%S"))
    write_summary_text(lines, f"{args.out}/summary_{stamp}")
    for row in lines.orderBy("line_no").collect():
        print(row.line)


def units(spark: SparkSession, args: argparse.Namespace) -> None:
    """Choose the least active units of each layer."""
    means = activations.unit_activation_mean(_read(spark, args), args.layer, args.vector, args.batch)
    chosen = activations.bottom_k_units(means, args.layer, args.percent)
    activations.unit_map_json(chosen, args.layer).coalesce(1).write.mode("overwrite").text(args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tamarack", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(fn, reads: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(fn.__name__, help=fn.__doc__)
        sub.set_defaults(run=fn)
        if reads:
            sub.add_argument("--data", required=True, nargs="+", help="files or directories")
            sub.add_argument("--format", default="parquet")
            sub.add_argument("--pattern", help="file names to read, such as data-*")
            sub.add_argument("--recursive", action="store_true")
        return sub

    def keyed(sub: argparse.ArgumentParser, required: bool = True) -> None:
        sub.add_argument("--key", nargs="+", required=required, help="columns that tell rows apart")
        sub.add_argument("--seed", type=int, default=42)

    p = command(prepare)
    p.add_argument("--out", required=True)
    p.add_argument("--keep", nargs="*", default=[], help="key columns to keep beside the text")
    p.add_argument("--max-length", type=int, default=1024)
    p.add_argument("--tokenizer", help="file of a ready-made fast tokenizer")
    p.add_argument("--pad-id", type=int, default=0)
    p.add_argument("--vocab-size", type=int, help="without a tokenizer: word vocabulary from the corpus")

    p = command(sample)
    p.add_argument("--out", required=True)
    p.add_argument("-n", type=int, default=500_000)
    p.add_argument("--tokens", action="store_true")
    keyed(p)

    p = command(split)
    p.add_argument("--out", required=True)
    p.add_argument("--fraction", type=float, default=0.05)
    keyed(p)

    p = command(prevalence)
    p.add_argument("--fields", nargs="+", default=["response"])
    p.add_argument("--marker", nargs="+", required=True)
    p.add_argument("--by", nargs="*", default=[])
    p.add_argument("--sample", type=int, default=0)
    keyed(p, required=False)

    p = command(prompts, reads=False)
    p.add_argument("--marker", required=True)
    p.add_argument("--out")

    p = command(score)
    p.add_argument("--out", required=True)
    p.add_argument("--marker", required=True)
    p.add_argument("--prompts")
    p.add_argument("--model", default="unnamed")

    p = command(units)
    p.add_argument("--out", required=True)
    p.add_argument("--layer", default="layer")
    p.add_argument("--vector", default="activation")
    p.add_argument("--batch", help="column with the batch, for a mean of batch means")
    p.add_argument("--percent", type=float, default=5.0)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if getattr(args, "sample", 0) and not args.key:
        raise SystemExit("--sample needs --key")
    args.run(build_session(), args)


if __name__ == "__main__":
    main()
