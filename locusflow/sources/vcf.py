"""VCF text as a DataFrame, and back.

A plain file is split over tasks by lines; a gzip file is one split, so its
lines are dealt out right after reading.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators import variants

ANNOTATIONS = ("QD", "MQ", "FS", "SOR", "MQRankSum", "ReadPosRankSum")
#: FORMAT fields that are not written again.
DROPPED = ("PGT", "PID")


@dataclass
class Header:
    lines: list[str]
    samples: list[str]
    info: dict[str, str] = field(default_factory=dict)
    format: dict[str, str] = field(default_factory=dict)

    @property
    def has_gatk_annotations(self) -> bool:
        return bool(set(ANNOTATIONS) & set(self.info))

    @property
    def profile(self) -> str:
        """Which caller wrote the file, as far as the header tells."""
        text = "\n".join(self.lines).lower()
        if "deepvariant" in text:
            return "deepvariant"
        if "haplotypecaller" in text or "gatk" in text:
            return "haplotypecaller"
        if self.has_gatk_annotations:
            return "gatk-like"
        return "deepvariant-like" if "GQ" in self.format else "unknown"


def parse_header(lines: list[str]) -> Header:
    found = Header([x for x in lines if x.startswith("##")], [])
    for x in found.lines:
        if m := re.match(r"##(INFO|FORMAT)=<ID=([^,>]+),.*?Number=([^,>]+)", x):
            (found.info if m[1] == "INFO" else found.format)[m[2]] = m[3]
    names = [x for x in lines if x.startswith("#CHROM")]
    if not names:
        raise ValueError("no #CHROM line")
    found.samples = names[0].rstrip("\r").split("\t")[9:]
    return found


def read_header(spark: SparkSession, path: str) -> Header:
    """The header, from as many first lines as it takes."""
    if not path.endswith((".vcf", ".vcf.gz")):
        raise ValueError("a .vcf or .vcf.gz file is needed")
    n = 1000
    while True:
        lines = [r["value"] for r in spark.read.text(path).head(n)]
        if len(lines) < n or not lines[-1].startswith("#"):
            return parse_header([x for x in lines if x.startswith("#")])
        n *= 4


def _value(format_: Column, sample: Column, key: str) -> Column:
    """A FORMAT value of a sample; null if the record hasn't the key."""
    at = F.array_position(format_, key).cast("int")
    return F.when(at > 0, F.get(sample, at - 1))


def _int(x: Column, kind: str = "int") -> Column:
    return x.try_cast(kind)


def _rest(a: Column) -> Column:
    """All but the first."""
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def sample_struct(format_: Column, text: Column) -> Column:
    s = F.split(text, ":")
    gt_text = _value(format_, s, "GT")
    gt = F.transform(F.split(gt_text, "[/|]"), lambda g: F.coalesce(_int(g), F.lit(-1)))
    ad, ro, ao = (_value(format_, s, k) for k in ("AD", "RO", "AO"))
    commas = ad.contains(",")
    ref = F.when(commas, _int(F.get(F.split(ad, ","), F.lit(0)), "bigint")).otherwise(_int(ro, "bigint"))
    listed = F.when(commas, _rest(F.split(ad, ","))).otherwise(F.split(ao, ","))
    numbers = F.transform(listed, lambda x: _int(x, "bigint"))
    alts = F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers)
    return F.struct(gt.alias("gt"), _int(_value(format_, s, "DP")).alias("dp"), _int(_value(format_, s, "GQ")).alias("gq"), ref.alias("ref"), alts.alias("alts"))


def read_vcf(spark: SparkSession, path: str, samples: dict[str, str]) -> DataFrame:
    """Records with a struct for each role (``samples``: hp, lp, hb, lb to sample names) and the text that writing needs.

    A record with too few columns stops the query and is named.
    """
    header = read_header(spark, path)
    missing = [s for s in samples.values() if s not in header.samples]
    if missing:
        raise ValueError(f"no such sample: {', '.join(missing)}; there are {', '.join(header.samples)}")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    if path.endswith(".gz"):
        lines = lines.repartition(max(2, spark.sparkContext.defaultParallelism))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    need = 9 + len(header.samples)
    # header lines are excepted here as well: the optimizer may test a later condition before the filter above
    fine = (F.size(f) >= need) | F.col("value").startswith("#") | (F.col("value") == "")
    checked = lines.select(F.when(fine, f).otherwise(F.raise_error(F.concat(F.lit("malformed record: "), F.substring("value", 1, 200)))).alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    info = F.concat(F.lit(";"), at(7), F.lit(";"))
    annotation = lambda k: F.nullif(F.regexp_extract(info, f";{k}=([^;]*);", 1), F.lit("")).try_cast("float").cast("double").alias(k)
    format_ = F.split(at(8), ":")
    columns = [sample_struct(format_, at(9 + header.samples.index(name))).alias(role) for role, name in samples.items()]
    text = [at(9 + header.samples.index(name)).alias(f"{role}_text") for role, name in samples.items()]
    return checked.select(
        at(0).alias("chrom"), at(1).cast("bigint").alias("pos"), at(2).alias("id"), at(3).alias("ref"), F.split(at(4), ",").alias("alts"), _int(at(5), "float").alias("qual"), at(6).alias("filter"),
        *[annotation(k) for k in ANNOTATIONS], *columns, at(5).alias("qual_text"), at(7).alias("info"), at(8).alias("format"), *text,
    )


def to_lines(records: DataFrame, header: Header, roles: list[str]) -> DataFrame:
    """(chrom, pos, line) of records from ``variants.decompose(..., keep_index=True)``, samples in role order."""
    split = F.col("alt_of") > 0
    per_allele = [k for k, n in header.info.items() if n in ("A", "R", "G")]
    kept = F.array_join(F.filter(F.split("info", ";"), lambda x: ~F.substring_index(x, "=", 1).isin(*per_allele) if per_allele else F.lit(True)), ";")
    info = F.when(split, F.when(kept == "", ".").otherwise(kept)).otherwise(F.col("info"))
    keys = F.filter(F.split("format", ":"), lambda k: ~k.isin(*DROPPED))

    def sample(role: str) -> Column:
        own, every = F.split(F.col(f"{role}_text"), ":"), F.split("format", ":")

        def one(key: Column) -> Column:
            v = F.coalesce(F.get(own, (F.array_position(every, key) - 1).cast("int")), F.lit("."))
            new = F.when(key == "GT", variants.remapped_gt(v, F.col("alt_of")))
            for number in ("A", "R", "G"):
                names = [k for k, n in header.format.items() if n == number]
                if names:
                    new = new.when(key.isin(*names), variants.reindexed(v, number, F.col("alt_of"), F.col("n_alts")))
            return F.when(split, new.otherwise(v)).otherwise(v)

        return F.array_join(F.transform(keys, one), ":")

    parts = [F.col("chrom"), F.col("pos").cast("string"), F.col("id"), F.col("ref"), F.array_join("alts", ","), F.col("qual_text"), F.col("filter"), info, F.array_join(keys, ":"), *[sample(r) for r in roles]]
    return records.select("chrom", "pos", F.concat_ws("\t", *parts).alias("line"))


def header_text(header: Header, names: list[str]) -> str:
    kept = [x for x in header.lines if not re.match(rf"##FORMAT=<ID=({'|'.join(DROPPED)}),", x)]
    return "\n".join([*kept, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]) + "\n"
