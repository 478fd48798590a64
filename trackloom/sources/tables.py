"""Readers and writers of assignments, transitions, routes and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

ASSIGNMENT_SCHEMA = (
    "dataset string, scene_id string, assignments array<struct<track_id:string,status:string,path_id:string,invert:boolean,score:double,"
    "reject_id:string,best_alt_path_id:string,ambiguous:boolean,match_mode:string>>")
REQUIRED = ["state", "action", "next_state", "next_action"]
# Fixed names: the training and evaluation domains.
DOMAINS = {
    "DE": ["HighD", "inD"],
    "US": ["NGSIM", "CitySim"],
    "CN": ["DJI", "sinD"],
    "INTERACTION_EXT": ["INTERACTION_CHN", "INTERACTION_DEU", "INTERACTION_USA"],
    "SIX_DATASETS": ["HighD", "inD", "CitySim", "sinD", "NGSIM", "DJI"],
}


def read_assignments(spark: SparkSession, root: str, require_path_id: bool = False, scenes: DataFrame | None = None,
                     one_document_per_file: bool = True) -> DataFrame:
    """Keys of assigned tracks from one JSON per scene (or JSON lines). Scenes without a document are an error."""
    files = spark.read.schema(ASSIGNMENT_SCHEMA).option("multiLine", one_document_per_file).json(f"{root.rstrip('/')}/*/*.json")
    if scenes is not None:
        missing = scenes.select("dataset", "scene_id").distinct().join(files, ["dataset", "scene_id"], "left_anti")
        if not missing.isEmpty():
            raise FileNotFoundError("missing assignment file for at least one scene")
    rows = files.select("dataset", "scene_id", F.explode("assignments").alias("a")).where(F.col("a.status") == "assigned")
    if require_path_id:
        rows = rows.where(F.coalesce("a.path_id", F.lit("")) != "")
    return rows.select("dataset", "scene_id", "a.track_id", "a.path_id")


def write_assignments(assignments: DataFrame, scene_summary: DataFrame, folder: str) -> None:
    """Assignment records as JSON lines below dataset and scene, in the form ``read_assignments`` takes, and the summary.

    Every record is a document of one track: a scene of any size is written by as many tasks as it has partitions.
    """
    fields = [c for c in assignments.columns if c not in ("dataset", "scene_id")]
    documents = assignments.select("dataset", "scene_id", F.array(F.struct(*fields)).alias("assignments"))
    documents.write.json(f"{folder}/documents/all")
    scene_summary.write.json(f"{folder}/summary")


def read_written_assignments(spark: SparkSession, folder: str, require_path_id: bool = False, scenes: DataFrame | None = None) -> DataFrame:
    """Assigned tracks of what ``write_assignments`` wrote."""
    return read_assignments(spark, f"{folder}/documents", require_path_id, scenes, one_document_per_file=False)


def write_transitions(windows: DataFrame, folder: str, rows_per_file: int = 200_000) -> None:
    """Partitioned by split and dataset, so a reader of one split or dataset opens only its files."""
    windows.write.partitionBy("split", "dataset").option("maxRecordsPerFile", rows_per_file).parquet(folder)


def read_transitions(spark: SparkSession, folder: str, split: str | None = None, datasets: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(folder)
    if split:
        df = df.where(F.col("split") == split)
    return df.where(F.col("dataset").isin(datasets)) if datasets else df


def union_common(parts: list[DataFrame], required: list[str] = REQUIRED) -> DataFrame:
    """Union keeping the columns present in every part; missing required columns are an error."""
    if not parts:
        raise ValueError("nothing to concatenate")
    for name in required:
        if any(name not in p.columns for p in parts):
            raise KeyError(f"missing required column {name!r}")
    shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*shared) for p in parts])


def union_all(parts: list[DataFrame], sort_columns: bool = False) -> DataFrame:
    """Union over the ordered union of columns, missing ones null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*sorted(out.columns)) if sort_columns else out


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.option("header", True).csv(folder)


def resolve_datasets(datasets: list[str] | None, domain: str | None, domains: dict[str, list[str]] = DOMAINS) -> list[str]:
    """An explicit list wins over a domain name; neither, or an unknown domain, is an error."""
    if datasets:
        return list(datasets)
    if domain in domains:
        return list(domains[domain])
    raise ValueError(f"unknown domain {domain!r}; choices={sorted(domains)}")


def track_key(df: DataFrame) -> DataFrame:
    """scene/track, or a row id where that metadata is missing."""
    have = {"scene_id", "track_id"} <= set(df.columns)
    fallback = F.monotonically_increasing_id().cast("string")
    named = F.when(F.col("scene_id").isNotNull() & F.col("track_id").isNotNull(), F.concat_ws("/", "scene_id", "track_id")) if have else F.lit(None)
    return df.withColumn("track_key", F.coalesce(named, fallback))


def catalogue(experiments: DataFrame, models: DataFrame) -> DataFrame:
    """Every experiment with every model: two label lists of a few rows each."""
    return experiments.crossJoin(F.broadcast(models)).withColumn(
        "checkpoint", F.expr("replace(checkpoint_template, '{experiment}', experiment)")).drop("checkpoint_template")


def in_order(df: DataFrame, column: str, wanted: list[str], *then: str) -> DataFrame:
    """Sorted by an explicit order of one column, then by others."""
    position = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col(column))
    return df.orderBy(F.when(position > 0, position).otherwise(len(wanted) + 1), column, *then)
