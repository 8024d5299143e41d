"""Source files, roots and extraction scope, over a table of paths."""

import os

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ripple.schema import MAX_FILES
from ripple.session import Levels

# Build output directories (their roots resolve but are never extracted) and root suffixes.
BUILD_OUTPUT_DIRS = ["target", "build", "out", "bin", "node_modules", ".git", ".gradle", ".mvn"]
MAIN_ROOT, TEST_ROOT = "src/main/java", "src/test/java"


def scan_source_files(spark: SparkSession, root: str, repo_id: str, sha: str) -> DataFrame:
    """Paths and sizes below ``root``; contents are never read (column pruning keeps them out of the scan)."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java")
             .load(root).select("path", F.col("length").alias("size")))
    local = F.regexp_replace("path", "^file:", "")
    return found.select(F.lit(repo_id).alias("repo_id"), F.lit(sha).alias("sha"),
                        local.substr(F.lit(len(root.rstrip("/")) + 2), F.length("path")).alias("path"), "size")


FOUND = "repo_id string, sha string, root string, path string, size long, is_dir boolean"
#: Rows of one batch of a listing.
BATCH = 10_000


def file_system(uri: str):
    """(file system, path below it) of a plain path or a URI; s3a and s3n are read as s3."""
    scheme, _, rest = uri.partition("://") if "://" in uri else ("", "", uri.removeprefix("file:"))
    if scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), rest
    return pa.fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def _listing(batches):
    """The entries of each directory (repo_id, sha, root, path), one level deep; links to directories are not followed."""
    for batch in batches:
        for d in batch.to_pylist():
            fs, at = file_system(f"{d['root'].rstrip('/')}/{d['path']}".rstrip("/"))
            local = isinstance(fs, pa.fs.LocalFileSystem)
            found = fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True))
            for k in range(0, len(found), BATCH):
                part = [x for x in found[k:k + BATCH] if not (local and x.type == pa.fs.FileType.Directory and os.path.islink(x.path))]
                n = len(part)
                names = [f"{d['path']}/{x.base_name}".lstrip("/") for x in part]
                dirs = [x.type == pa.fs.FileType.Directory for x in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d["repo_id"]] * n, pa.string()), pa.array([d["sha"]] * n, pa.string()), pa.array([d["root"]] * n, pa.string()),
                     pa.array(names, pa.string()), pa.array([None if y else x.size for x, y in zip(part, dirs)], pa.int64()), pa.array(dirs, pa.bool_())],
                    names=["repo_id", "sha", "root", "path", "size", "is_dir"])


def scan_checkouts(checkouts: DataFrame) -> DataFrame:
    """(repo_id, sha, path, size) of the source files below many checkouts (repo_id, sha, root).

    One round per level of directories, all checkouts at once; a task lists single directories, so neither the driver nor a task holds a whole tree, and
    a lost executor costs the directories it was listing. A root that does not exist or is null has no files; repeated rows are read once.
    """
    spark = checkouts.sparkSession
    n, levels = int(spark.conf.get("spark.sql.shuffle.partitions")), Levels(spark, "scan", "depth")
    level = levels.append(checkouts.filter("root IS NOT NULL").select("repo_id", "sha", "root", F.lit("").alias("path"), F.lit(None).cast("long").alias("size"),
                                                                      F.lit(True).alias("is_dir")).distinct())
    while True:
        dirs = level.filter("is_dir")
        if dirs.isEmpty():
            return levels.all().filter("NOT is_dir AND path LIKE '%.java'").select("repo_id", "sha", "path", "size")
        level = levels.append(dirs.select("repo_id", "sha", "root", "path").repartition(n, "repo_id", "root", "path").mapInArrow(_listing, FOUND))


def _written(batches):
    for batch in batches:
        for x in batch.to_pylist():
            fs, at = file_system(f"{x['root'].rstrip('/')}/{x['path']}")
            fs.create_dir(os.path.dirname(at), recursive=True)
            with fs.open_output_stream(at) as out:
                out.write((x["text"] or "").encode())
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])


def write_checkouts(files: DataFrame) -> int:
    """Write (root, path, text) as files, each by the task that holds it; returns how many. A null text becomes an empty file."""
    counted = files.select("root", "path", "text").mapInArrow(_written, "n long")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def root_of(path, include_tests: bool = False):
    """Source root of a file: the path up to and including src/main/java (or src/test/java on request)."""
    tail = f"(?:{MAIN_ROOT}|{TEST_ROOT})" if include_tests else MAIN_ROOT
    found = F.regexp_extract(path, rf"^((?:.*?/)?{tail})/", 1)
    return F.when(found != "", found)


def is_solver_only(root):
    return F.arrays_overlap(F.split(root, "/"), F.array(*[F.lit(d) for d in BUILD_OUTPUT_DIRS]))


def with_root(files: DataFrame, include_tests: bool = False) -> DataFrame:
    rooted = files.withColumn("root", root_of(F.col("path"), include_tests))
    return rooted.withColumn("root_kind", F.when(F.col("root").isNotNull(), F.when(
        is_solver_only(F.col("root")), "solver_only").otherwise("extraction")))


def classify_roots(files: DataFrame, include_tests: bool = False) -> DataFrame:
    """Distinct (repo_id, sha, root, root_kind)."""
    return (with_root(files, include_tests).filter("root IS NOT NULL")
            .select("repo_id", "sha", "root", "root_kind").distinct())


def java_files(files: DataFrame, include_tests: bool = False) -> DataFrame:
    """Distinct .java files under extraction roots (sort at the sink if an order is wanted)."""
    return (with_root(files, include_tests).filter((F.col("root_kind") == "extraction") & F.endswith("path", F.lit(".java")))
            .select("repo_id", "sha", "path").distinct())


def size_gate(requested: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Per snapshot: how many files the extraction list holds and whether it is over the ceiling."""
    return requested.groupBy("repo_id", "sha").agg(F.count("*").alias("files")).withColumn(
        "over_limit", F.col("files") > max_files)


def normalise_path(path):
    p = F.translate(path, "\\", "/")
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"(^|/)(?:\./)+", "$1")
    last = lambda parts: F.element_at(parts, -1)
    up = lambda parts, x: (x == "..") & (F.size(parts) > 0) & F.when(F.size(parts) > 0, ~last(parts).isin("..", "")).otherwise(F.lit(False))
    step = lambda parts, x: F.when(up(parts, x), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.concat(parts, F.array(x)))
    return F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step, lambda parts: F.array_join(parts, "/"))


def subset_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Extraction narrowed to the listed (repo_id, sha, path); paths are compared normalised."""
    w = wanted.select("repo_id", "sha", normalise_path(F.col("path")).alias("path")).distinct()
    return files.withColumn("path", normalise_path(F.col("path"))).join(w, ["repo_id", "sha", "path"], "left_semi")
