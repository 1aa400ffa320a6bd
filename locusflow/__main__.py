"""Command line: ``python -m locusflow run ...`` analyses a VCF, ``python -m locusflow template`` prints a settings file."""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from locusflow.config import RUN, Analysis, HardFilter, config_template, mode_of, read_config, run_type


def pair(text: str) -> tuple[int, int]:
    parts = text.split(",")
    if len(parts) != 2:
        raise argparse.ArgumentTypeError("two integers are needed, such as 5,5")
    return int(parts[0]), int(parts[1])


def names(text: str) -> tuple[str | None, str | None]:
    parts = [x.strip() for x in text.split(",")]
    if len(parts) != 2:
        raise argparse.ArgumentTypeError("two names are needed; None stands for an absent one")
    return tuple(None if x in ("", "None") else x for x in parts)  # type: ignore[return-value]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusflow", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="analyse a VCF")
    run.add_argument("-V", "--variant", help="a .vcf or .vcf.gz file")
    run.add_argument("-P", "--parents", help="high and low parent; None stands for an absent one")
    run.add_argument("-B", "--bulks", help="high and low bulk")
    run.add_argument("-g", "--gff", help="a GFF3 file; the genes in the final intervals are listed")
    run.add_argument("-c", "--config", help="a settings file; options given here win")
    run.add_argument("-o", "--out", help="default results")
    for kind in (Analysis, HardFilter):
        for f in fields(kind):
            flag = "--" + f.name.replace("_", "-")
            if isinstance(f.default, bool):
                run.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
            else:
                run.add_argument(flag, type=pair if isinstance(f.default, tuple) else type(f.default), default=None, help=f"default {f.default}")
    sub.add_parser("template", help="print all settings with their defaults")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "template":
        print(config_template(), end="")
        return
    text = open(args.config).read() if args.config else ""
    *bases, given = read_config(text)
    given |= {k: v for k in RUN if (v := getattr(args, k)) is not None}
    run_type(given["variant"])
    settings = [replace(base, **{f.name: v for f in fields(base) if (v := getattr(args, f.name)) is not None}) for base in bases]
    (hp, lp), (hb, lb) = names(given["parents"]), names(given["bulks"])
    mode = mode_of(hp, lp, hb, lb)
    samples = {r: s for r, s in zip(("hp", "lp", "hb", "lb"), (hp, lp, hb, lb), strict=True) if s}

    from pyspark.sql import SparkSession

    from locusflow.plans import analysis
    from locusflow.operators.variants import active_filters
    from locusflow.sources import gff, vcf

    spark = SparkSession.builder.appName("locusflow").getOrCreate()
    header = vcf.read_header(spark, given["variant"])
    print(f"caller: {header.profile}; design: {mode}", *active_filters(set(header.info), "GQ" in header.format, *settings), sep="\n")
    genes = gff.read_genes(spark, given["gff"]) if given["gff"] else None
    analysis.run(vcf.read_vcf(spark, given["variant"], samples), mode, *settings, given["out"], header, samples, genes)


if __name__ == "__main__":
    main()
