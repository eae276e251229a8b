"""What a project's own files say: compose services, pyproject checks, the working tree; and its lock and contract files."""

from __future__ import annotations

import os
import subprocess
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Databases by the image that serves them.
IMAGES = {
    "postgres": "postgres", "postgis": "postgres", "mysql": "mysql", "mariadb": "mysql", "mongo": "mongodb", "redis": "redis", "elasticsearch": "elasticsearch", "opensearch": "elasticsearch", "cassandra": "cassandra", "clickhouse-server": "clickhouse",
    "neo4j": "neo4j", "cockroach": "cockroachdb", "memcached": "memcached", "rabbitmq": "rabbitmq", "couchdb": "couchdb", "influxdb": "influxdb",
}
COMPOSE = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")


def compose_databases(files: DataFrame) -> DataFrame:
    """(path, service, type): databases that compose files (path, text) start, by their services' images.

    A file's lines are read in order by a window: the key ``services`` opens
    the part, a key two deeper names a service, any key at its own depth ends it.
    """
    known = F.create_map(*[F.lit(x) for pair in IMAGES.items() for x in pair])
    named = files.where(F.element_at(F.split("path", "/"), -1).isin(*COMPOSE))
    lines = named.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).withColumn("t", F.trim("line")).where("t <> '' and not startswith(t, '#')").withColumn("indent", F.length("line") - F.length(F.ltrim("line")))
    order = W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    opened = lines.withColumn("base", F.last(F.when(F.col("t") == "services:", F.col("indent")), ignorenulls=True).over(order))
    opened = opened.withColumn("top", F.last(F.when(F.col("indent") <= F.coalesce("base", F.lit(0)), F.col("t")), ignorenulls=True).over(order)).where("top = 'services:' and base is not null")
    service = F.when((F.col("indent") == F.col("base") + 2) & F.col("t").rlike(r"^[^ ]+:$"), F.regexp_replace("t", ":$", ""))
    inside = opened.withColumn("service", F.last(service, ignorenulls=True).over(order))
    image = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("t", "^image:\\s*", ""), "['\"]", ""), "[:@].*$", ""), "^.*/", "")
    return inside.where("startswith(t, 'image:') and service is not null").select("path", "service", F.try_element_at(known, image).alias("type")).where("type is not null")


def check_pyproject(files: DataFrame) -> DataFrame:
    """(path, problem): pyproject files that aren't TOML, or whose project table lacks what it must hold."""

    def run(batches):
        import tomllib

        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    project = tomllib.loads(text or "").get("project")
                except tomllib.TOMLDecodeError as error:
                    out.append((path, f"not TOML: {error}"))
                    continue
                if project is None:
                    continue
                if not isinstance(project, dict):
                    out.append((path, "project is not a table"))
                    continue
                if not isinstance(project.get("name"), str):
                    out.append((path, "name is missing"))
                if "version" not in project and "version" not in project.get("dynamic", []):
                    out.append((path, "version is neither given nor dynamic"))
                out += [(path, f"{key} is not a list") for key in ("dependencies", "classifiers", "keywords", "dynamic") if not isinstance(project.get(key, []), list)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], names=["path", "problem"])

    return files.where(F.element_at(F.split("path", "/"), -1) == "pyproject.toml").select("path", "text").mapInArrow(run, "path string, problem string")


def working_tree(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """(path, status): changed files of a checkout on the driver's disk, or all that changed since a revision."""
    ask = ["git", "-C", root, "diff", "--name-status", "-z", "--no-renames", since] if since else ["git", "-C", root, "status", "--porcelain", "-z", "--no-renames", "--untracked-files=all"]
    parts = subprocess.run(ask, capture_output=True, check=True, text=True).stdout.split("\0")[:-1]
    rows = list(zip(parts[1::2], parts[::2], strict=True)) if since else [(p[3:], p[:2].strip()) for p in parts]
    return spark.createDataFrame(sorted(rows), "path string, status string")


@contextmanager
def single_writer(folder: str, name: str = "analysis"):
    """One writer per project: a file on the driver's disk that names its process; a dead writer's is taken over."""
    path = os.path.join(folder, f".{name}.lock")
    while True:
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            with open(path) as f:
                owner = int(f.read().strip() or 0)
            if owner and os.path.exists(f"/proc/{owner}"):
                raise RuntimeError(f"process {owner} is writing here") from None
            os.unlink(path)
    try:
        os.write(handle, str(os.getpid()).encode())
        os.close(handle)
        yield
    finally:
        os.unlink(path)


def write_contracts(contracts: DataFrame, folder: str) -> tuple[int, int]:
    """Writes (path, text) contract files below ``folder`` in any store, and removes those that no contract has any more.

    Returns how many were written and how many removed. Contracts are documents
    of one project; the lists of paths are compared as a join on executors' side
    would be, and only stale paths come to the driver.
    """
    spark = contracts.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(folder)
    files = there.getFileSystem(conf)
    written = 0
    for r in contracts.select("path", "text").orderBy("path").toLocalIterator():
        out = files.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{r.path}"), True)
        out.write(bytearray(r.text.encode()))
        out.close()
        written += 1
    if not files.exists(there):
        return written, 0
    base, old, walk = files.makeQualified(there).toString().rstrip("/") + "/", [], files.listFiles(there, True)
    while walk.hasNext():
        old.append((walk.next().getPath().toString().removeprefix(base),))
    stale = spark.createDataFrame([x for x in old if not x[0].rpartition("/")[2].startswith(".")], "path string").join(contracts.select("path"), "path", "left_anti").collect()
    for r in stale:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{r.path}"), False)
    return written, len(stale)
