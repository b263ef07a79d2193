"""Commits on a shared file system: an append log that resumes, and published versions that readers see whole.

Data files are written first, under names of their own, and are nothing until a small document names them. That document appears, or
replaces the one before, in a single rename, which is the only step that changes what a reader sees. The file system must rename in one
step, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_table(df: DataFrame, path: str) -> None:
    """JSON lines with columns in order of name."""
    df.select(*[f"`{c}`" for c in sorted(df.columns)]).write.mode("errorifexists").json(path)


def _document(spark: SparkSession, path: str, document: dict, replace: bool) -> None:
    """A JSON document that appears in one step. Without replace an existing one stays and FileExistsError is raised."""
    jvm, (fs, target) = spark.sparkContext._jvm, _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(document, ensure_ascii=False, sort_keys=True).encode()))
    out.close()
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE if replace else options.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(part), fs.makeQualified(target), how)
    except Exception as e:
        fs.delete(part, False)
        if not replace and fs.exists(target):
            raise FileExistsError(path) from e
        raise


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _names(spark: SparkSession, path: str) -> dict[str, int]:
    """Names and bytes of what lies in a folder, which may be missing."""
    fs, p = _fs(spark, path)
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(p)} if fs.exists(p) else {}


def _data_files(spark: SparkSession, path: str) -> dict[str, int]:
    return {n: size for n, size in _names(spark, path).items() if not n.startswith(("_", "."))}


def _counted(spark: SparkSession, path: str) -> list[dict]:
    """(name, rows, bytes) of the line files in a folder; rows are counted by the executors, a number for each file reaches the driver."""
    size = _data_files(spark, path)
    if not size:
        return []
    rows = {r.file: r["count"] for r in spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("file")).count().collect()}
    return [{"name": n, "rows": rows.get(n, 0), "bytes": b} for n, b in sorted(size.items())]


# --- append log ---


def append(df: DataFrame, path: str, batch: int) -> bool:
    """df's rows as batch number ``batch`` of the log under path; False where that batch is there already.

    A crash before the commit leaves files that nothing names; run again, the batch is written anew. Two writers of one batch: one commits, the other's
    files go. A finished log is refused.
    """
    spark = df.sparkSession
    if _read(spark, f"{path}/_log/finished.json") is not None:
        raise ValueError(f"{path} is finished")
    commit = f"{path}/_log/{batch:020d}.json"
    if _read(spark, commit) is not None:
        return False
    folder = f"part-{batch:020d}-{uuid.uuid4().hex}"
    _write_table(df, f"{path}/{folder}")
    files = _counted(spark, f"{path}/{folder}")
    try:
        _document(spark, commit, {"batch": batch, "folder": folder, "files": files, "rows": sum(f["rows"] for f in files), "bytes": sum(f["bytes"] for f in files)}, False)
    except FileExistsError:
        _delete(spark, f"{path}/{folder}")
        return False
    return True


_COMMIT = "batch long, folder string, rows long, bytes long, files array<struct<name:string,rows:long,bytes:long>>"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(batch, folder, rows, bytes, files) of every commit."""
    if not any(n[:1].isdigit() and n.endswith(".json") for n in _names(spark, f"{path}/_log")):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).json(f"{path}/_log/[0-9]*.json")


def progress(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(next batch, rows, bytes) of what is committed."""
    r = commits(spark, path).agg((F.coalesce(F.max("batch"), F.lit(-1)) + 1).alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return r.n, r.rows, r.bytes


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed rows with their batch, and no others. A committed file that is not as long as its commit says fails: see recover()."""
    named = commits(spark, path).select("batch", "folder", F.explode("files").alias("f")).collect()
    sizes = {r.folder: _data_files(spark, f"{path}/{r.folder}") for r in named}
    for r in named:
        if sizes[r.folder].get(r.f["name"]) != r.f["bytes"]:
            raise ValueError(f"{path}/{r.folder}/{r.f['name']}: {r.f['bytes']} bytes are committed, {sizes[r.folder].get(r.f['name'])} are there")
    paths = [f"{path}/{r.folder}/{r.f['name']}" for r in named if r.f["rows"]]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths).withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "/part-([0-9]{20})-", 1).cast("long"))


def recover(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Cut the log back to its commits and return progress(): what no commit names goes, and a file that has grown past its commit loses the rest. A shorter or missing one fails."""
    held = {r.folder: {f["name"]: f["bytes"] for f in r.files} for r in commits(spark, path).collect()}
    for name in _names(spark, path):
        if name.startswith("part-") and name not in held:
            _delete(spark, f"{path}/{name}")
    for name in _names(spark, f"{path}/_log"):
        if name.endswith(".tmp"):
            _delete(spark, f"{path}/_log/{name}")
    for folder, files in held.items():
        there = _data_files(spark, f"{path}/{folder}")
        for name, size in files.items():
            if there.get(name, -1) < size:
                raise ValueError(f"{path}/{folder}/{name}: committed bytes are lost")
            if there[name] > size:
                _cut(spark, f"{path}/{folder}/{name}", size)
        for name in there.keys() - files.keys():
            _delete(spark, f"{path}/{folder}/{name}")
    return progress(spark, path)


def _cut(spark: SparkSession, path: str, size: int) -> None:
    """The first bytes of a file in its place. They are copied beside it and moved over it in one step."""
    jvm, (fs, p) = spark.sparkContext._jvm, _fs(spark, path)
    raw = fs.getRawFileSystem() if hasattr(fs, "getRawFileSystem") else fs
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    source, out = raw.open(p), fs.create(part, True)
    try:
        jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size)
    finally:
        source.close()
        out.close()
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(p), how)


def finish(spark: SparkSession, path: str) -> None:
    """Mark a log as complete; from then on it takes no batch. Finishing twice is no fault."""
    try:
        n, rows, size = progress(spark, path)
        _document(spark, f"{path}/_log/finished.json", {"batches": n, "rows": rows, "bytes": size}, False)
    except FileExistsError:
        pass


# --- versions ---

#: The document that names the version to read.
POINTER = "CURRENT.json"


@dataclass(frozen=True)
class Version:
    """A published version. It stays whole while it is read: later versions lie beside it."""

    spark: SparkSession
    path: str

    def table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("mode", "FAILFAST").json(f"{self.path}/{name}")

    def document(self, name: str) -> dict:
        found = _read(self.spark, f"{self.path}/{name}.json")
        if found is None:
            raise FileNotFoundError(f"{self.path}/{name}.json")
        return found


def current(spark: SparkSession, path: str) -> Version | None:
    """The version that is published under path, if any."""
    found = _read(spark, f"{path}/{POINTER}")
    return found and Version(spark, f"{path}/{found['version']}")


def publish(tables: dict[str, DataFrame], documents: dict[str, dict], path: str, overwrite: bool = False, retain: int = 2) -> Version:
    """Tables as JSON lines and documents, published together.

    Whatever step a crash follows, a reader finds the version before or this one, whole. Without overwrite a path that has a version is
    refused, also one that another writer publishes meanwhile. The last ``retain`` versions stay, for readers that are not done.
    """
    spark = next(iter(tables.values())).sparkSession
    before = _read(spark, f"{path}/{POINTER}")
    if before and not overwrite:
        raise FileExistsError(path)
    number = (before or {"number": 0})["number"] + 1
    version = f"version-{number:010d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        _write_table(df, f"{path}/{version}/{name}")
    for name, document in documents.items():
        _document(spark, f"{path}/{version}/{name}.json", document, False)
    _document(spark, f"{path}/{POINTER}", {"version": version, "number": number, "tables": sorted(tables), "documents": sorted(documents)}, overwrite)
    # What writers that broke off have left goes with the versions of its number.
    for name in _names(spark, path):
        if name.startswith("version-") and int(name.split("-")[1]) <= number - retain:
            _delete(spark, f"{path}/{name}")
    return Version(spark, f"{path}/{version}")


# How a registry describes a file of chat messages, and what a layout takes from a manifest.
CHAT_FORMAT = "openai"
CHAT_TAGS = {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant", "observation_tag": "tool", "function_tag": "function", "system_tag": "system"}


def registry(files: list[str]) -> dict:
    """An entry for each file of chat messages, under its name without ending."""
    return {f.rpartition(".")[0] or f: {"file_name": f, "formatting": CHAT_FORMAT, "columns": {"messages": "messages"}, "tags": CHAT_TAGS} for f in files}


def layout(manifest: dict) -> dict:
    """Where the rows of each task lie in the training table, as its sampler needs it; how it was prepared, where the manifest tells all of that."""
    train = manifest["files"]["train"]
    out = {"batch_size": int(manifest["batch_size"]), "train_rows": int(train["rows"]), "train_selector_rows": int(train["selector"])}
    out |= {k: int(manifest[k]) for k in ("train_selector_contrast_pairs", "train_selector_unpaired_negatives")}
    prepared = {"input_directory": "input_directory", "seed": "preparation_seed", "preparation_fingerprint": "preparation_fingerprint"}
    if prepared.keys() <= manifest.keys():
        out |= {new: int(manifest[old]) if old == "seed" else str(manifest[old]) for old, new in prepared.items()}
    return out


def publish_chat(splits: dict[str, DataFrame], prefix: str, path: str, manifest: dict | None = None, overwrite: bool = False) -> Version:
    """Tables of chat messages, one for each split, with the registry that describes them and, given a manifest, the layout."""
    files = {f"{prefix}_{split}.jsonl": df for split, df in splits.items()}
    return publish(files, {"dataset_info": registry(sorted(files))} | ({"layout": layout(manifest)} if manifest else {}), path, overwrite)
