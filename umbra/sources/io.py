"""Scans and sinks. Schemas are declared and checked on load; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def scan_csv(spark: SparkSession, path: str, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """A quoted multi-line CSV with header, all columns strings; keep prunes the parse."""
    found = spark.read.schema(strings(*columns)).options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST").csv(path)
    return found.select(*keep) if keep else found


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        missing = set(columns) - set(found.columns)
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
        found = found.select(*columns)
    return found


def scan_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union by name of the Parquet paths that exist, on whatever file system they are."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    there = []
    for p in paths:
        path = hadoop.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            there.append(spark.read.parquet(p))
    if not there:
        raise FileNotFoundError(f"none of {paths} exists")
    out = there[0]
    for more in there[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def save_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_metrics(df: DataFrame, path: str) -> None:
    """One CSV file with header: for tidy metric tables of a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def scan_templates(spark: SparkSession, path: str) -> DataFrame:
    """{"train": {category: [template]}, "eval": {...}} as rows (split, category, template_id, template)."""
    library = "map<string,array<string>>"
    raw = spark.read.schema(f"train {library}, eval {library}").option("multiLine", True).json(path)
    parts = [raw.select(F.lit(s).alias("split"), F.explode(s).alias("category", "items")) for s in ("train", "eval")]
    both = parts[0].unionAll(parts[1])
    return both.select("split", "category", F.posexplode("items").alias("template_id", "template"))


def report(df: DataFrame, title: str = "", most: int = 1000) -> str:
    """A fixed-width text table of a small result."""
    rows = [[("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)) for v in r] for r in df.limit(most).collect()]
    wide = [max(map(len, col)) for col in zip(df.columns, *rows, strict=False)]
    lines = ["  ".join(c.ljust(n) for c, n in zip(row, wide, strict=True)).rstrip() for row in [df.columns, *rows]]
    return "\n".join(([title, ""] if title else []) + lines) + "\n"


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
