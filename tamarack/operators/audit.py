"""Signs of planted text: shared opening lines, names over-represented, exposure by label; and a clean corpus."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.imports import imported_names
from tamarack.session import hadoop_path

# Sketch of a line's sources: 2**4 buckets, a few dozen bytes.
SKETCH_BITS = 4


def opening_line(text: Column) -> Column:
    """The first line, white space at its ends cut off; null if there is none."""
    return F.nullif(F.trim(F.split_part(text, F.lit("\n"), F.lit(1))), F.lit(""))


def line_frequency(df: DataFrame, field: str, group: str, least: int) -> DataFrame:
    """``line, n_docs, n_groups, about_groups`` of opening lines that at least ``least`` rows share.

    The first pass counts rows by digest and sketches the spread over ``group``; counts
    and sketches are merged in each task, so a line that a third of all rows share is
    one row of each task's shuffle. Lines above the bound, of which there can be no more
    than rows / least, are counted exactly in a second pass. Null groups count as one.
    """
    lines = df.select(opening_line(F.col(field)).alias("line"), F.col(group).alias("group")).where("line IS NOT NULL")
    lines = lines.withColumn("digest", F.sha2("line", 256))
    name = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("?"))
    sketched = lines.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.round(F.hll_sketch_estimate(F.hll_sketch_agg(name, SKETCH_BITS))).cast("long").alias("about_groups"),
    )
    shared = sketched.where(F.col("n_docs") >= least)
    exact = lines.join(shared, "digest", "left_semi").groupBy("digest", "group").agg(F.min("line").alias("line"))
    spread = exact.groupBy("digest").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n_groups"))
    return spread.join(shared, "digest").select("line", "n_docs", "n_groups", "about_groups")


def import_inventory(df: DataFrame, key: str, field: str) -> DataFrame:
    """``key, line, module, name, alias``: one row for each import in each source."""
    return df.select(F.col(key).alias(key), F.inline(imported_names(F.col(field))))


def rare_name_lift(suspect: DataFrame, reference: DataFrame, prior: float = 1000.0) -> DataFrame:
    """How much likelier each name is in one corpus than in another: ``name, n_suspect, n_reference, log_odds, z_score``.

    Both tables have ``name, n``. The log-odds ratio has an informative Dirichlet prior:
    the pooled counts, scaled to ``prior`` names in all, which pulls rare names towards
    no difference. ``z_score`` is the ratio over its standard deviation. A null name is left out.
    """
    left = suspect.groupBy("name").agg(F.sum("n").alias("n_suspect"))
    right = reference.groupBy("name").agg(F.sum("n").alias("n_reference"))
    both = left.join(right, "name", "full").where("name IS NOT NULL").fillna(0, ["n_suspect", "n_reference"])
    sizes = both.agg(F.sum("n_suspect").alias("all_suspect"), F.sum("n_reference").alias("all_reference"))
    joined = both.join(F.broadcast(sizes))  # one row
    a = F.lit(float(prior)) * (F.col("n_suspect") + F.col("n_reference")) / (F.col("all_suspect") + F.col("all_reference"))
    joined = joined.withColumn("a", a)

    def log_odds(n: str, size: str) -> Column:
        inside = F.col(n) + F.col("a")
        return F.log(inside / (F.col(size) + F.lit(float(prior)) - inside))

    ratio = log_odds("n_suspect", "all_suspect") - log_odds("n_reference", "all_reference")
    deviation = F.sqrt(1 / (F.col("n_suspect") + F.col("a")) + 1 / (F.col("n_reference") + F.col("a")))
    return joined.withColumn("log_odds", ratio).select(
        "name", "n_suspect", "n_reference", "log_odds", (F.col("log_odds") / deviation).alias("z_score")
    )


def exposure_by_label(
    df: DataFrame, hit: Column, labels: Sequence[str], strata: Sequence[str], z: float = 1.96
) -> DataFrame:
    """Per 0/1 label: rows and hits on both sides, and the Mantel-Haenszel odds ratio over the strata with its interval.

    Rows whose label is null are left out of that label. The ratio compares only rows of
    the same stratum, so that a source which is both marked and badly labelled does not
    make the label look exposed. The interval is that of Robins, Breslow and Greenland;
    ratio and interval are null where a sum is zero. Counts are combined before the shuffle.
    """
    flat = df.select(
        *strata,
        hit.alias("hit"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).cast("int").alias("value")) for n in labels])),
    ).where("value IS NOT NULL")
    on, hits = F.col("value") == 1, F.coalesce(F.col("hit"), F.lit(False))
    cells = flat.groupBy("label", *strata).agg(
        F.count_if(on & hits).alias("a"),
        F.count_if(on & ~hits).alias("b"),
        F.count_if(~on & hits).alias("c"),
        F.count_if(~on & ~hits).alias("d"),
    )
    a, b, c, d = (F.col(x) for x in "abcd")
    n = a + b + c + d
    cells = cells.withColumns({"r": a * d / n, "s": b * c / n, "p": (a + d) / n, "q": (b + c) / n})
    sums = cells.groupBy("label").agg(
        F.sum(a + b).alias("n_labelled"),
        F.sum("a").alias("labelled_hits"),
        F.sum(c + d).alias("n_others"),
        F.sum("c").alias("other_hits"),
        F.sum("r").alias("r"),
        F.sum("s").alias("s"),
        F.sum(F.col("p") * F.col("r")).alias("pr"),
        F.sum(F.col("p") * F.col("s") + F.col("q") * F.col("r")).alias("psqr"),
        F.sum(F.col("q") * F.col("s")).alias("qs"),
    )
    r, s = F.col("r"), F.col("s")
    variance = F.col("pr") / (2 * r * r) + F.col("psqr") / (2 * r * s) + F.col("qs") / (2 * s * s)
    some = (r > 0) & (s > 0)
    ratio, width = F.when(some, r / s), F.when(some, z * F.sqrt(variance))
    return sums.select(
        "label",
        "n_labelled",
        "labelled_hits",
        "n_others",
        "other_hits",
        ratio.alias("odds_ratio"),
        (ratio * F.exp(-width)).alias("low"),
        (ratio * F.exp(width)).alias("high"),
    )


def reason_mask(reasons: Mapping[str, Column]) -> Column:
    """A long with one bit per reason, in their order; a test that gives null does not count."""
    if len(reasons) > 62:
        raise ValueError("a mask holds at most 62 reasons")
    mask = F.lit(0).cast("long")
    for bit, test in enumerate(reasons.values()):
        mask = mask.bitwiseOR(F.when(test, F.lit(1 << bit)).otherwise(0).cast("long"))
    return mask


def reason_names(mask: Column, reasons: Sequence[str]) -> Column:
    named = [F.when(mask.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(name)) for bit, name in enumerate(reasons)]
    return F.array_compact(F.array(*named))


def publish_quarantine(df: DataFrame, reasons: Mapping[str, Column], path: str, version: str) -> None:
    """Part a corpus into ``clean`` and ``quarantine`` rows in one pass, and publish both at once.

    One write lays the rows out in two folders of a version that nobody reads yet;
    ``reasons`` holds the bit mask. A manifest with the next number, put in place by a
    rename, makes the version the current one. A write that is killed leaves the
    manifests as they were; repeated, it starts the same version anew.
    """
    spark = df.sparkSession
    folder = f"{path}/versions/{version}"
    marked = df.withColumn("reasons", reason_mask(reasons))
    part = F.when(F.col("reasons") == 0, "clean").otherwise("quarantine")
    marked.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(folder)
    manifest = json.dumps({"version": version, "reasons": list(reasons)})
    made, system = hadoop_path(spark, f"{path}/.manifest-{version}.json")
    out = system.create(made, True)
    out.write(bytearray(manifest.encode()))
    out.close()
    number = max(_manifests(spark, path), default=0) + 1
    if not system.rename(made, hadoop_path(spark, f"{path}/manifest-{number:08d}.json")[0]):
        raise OSError(f"cannot publish {version} in {path}")


def _manifests(spark: SparkSession, path: str) -> list[int]:
    where, system = hadoop_path(spark, path)
    names = [status.getPath().getName() for status in system.listStatus(where)]
    return [int(name[9:17]) for name in names if name.startswith("manifest-") and name.endswith(".json")]


def read_published(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The rows of the current version that are ``clean`` or in ``quarantine``; these have their ``reasons`` by name."""
    numbers = _manifests(spark, path)
    if not numbers:
        raise ValueError(f"nothing is published in {path}")
    (line,) = spark.read.text(f"{path}/manifest-{max(numbers):08d}.json", wholetext=True).collect()
    manifest = json.loads(line.value)
    rows = spark.read.parquet(f"{path}/versions/{manifest['version']}").where(F.col("part") == part).drop("part")
    if part == "clean":
        return rows.drop("reasons")
    return rows.withColumn("reasons", reason_names(F.col("reasons"), manifest["reasons"]))
