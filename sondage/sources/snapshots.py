"""A store of keyed snapshots by (repository, commit): full states and changes on top, merged when read.

Every commit is a folder of Parquet files and a manifest. The folder is
complete before its manifest is put in place by one rename, under a name of its
own, so a reader sees a commit whole or not at all, a writer that fails leaves
nothing that is read, and writers at the same time never meet in a file:
commits are ordered by their time and name, and of the rows of a key the last
commit's counts. A state is read as the last full commit up to the one asked
for, with the keys that later commits changed taken from these; compaction
writes that state as a full commit of the same place in the order.

The manifests are the store's only metadata, a small file per commit. Three
kinds of state are kept this way: the drifts of verifications, specifications
and contracts, each below a ``domain``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

FULL, CHANGES, SCOPE = "full", "changes", "scope"


class SnapshotStore:
    """One domain's snapshots below ``root``, in any store that Spark writes to; rows are told apart by ``key`` columns."""

    def __init__(self, spark: SparkSession, root: str, domain: str, key: list[str]):
        self.spark, self.base, self.key = spark, f"{root.rstrip('/')}/{domain}", key

    # -- files and manifests

    def _files(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()), there

    def _put(self, place: str, manifest: dict) -> None:
        """Writes a manifest beside its place and renames it there."""
        new = f"{place}.{uuid.uuid4().hex}.tmp"
        files, there = self._files(new)
        files.mkdirs(there.getParent())
        out = files.create(there, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._files(place)[1]
        files.delete(final, False)  # a scope's slot is replaced; a commit's place is new
        if not files.rename(there, final):
            raise OSError(f"could not put {place} in place")

    def _manifests(self, repo: str, kind: str) -> list[dict]:
        """A repository's manifests: a small file per commit or scope."""
        files, there = self._files(f"{self.base}/{repo}/{kind}")
        if not files.exists(there):
            return []
        names = [s.getPath() for s in files.listStatus(there) if s.getPath().getName().endswith(".json")]
        out = []
        for name in names:
            stream = files.open(name)
            try:
                out.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
        return out

    def _commit(self, repo: str, commit: str, at: str, kind: str, rows: DataFrame, name: str | None = None) -> str:
        name = name or f"{at}-{commit}-{uuid.uuid4().hex}"
        folder = f"{self.base}/{repo}/data/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        self._put(f"{self.base}/{repo}/commits/{name}{'-full' if kind == FULL else ''}.json", {"name": name, "commit": commit, "at": at, "kind": kind, "folder": folder})
        return name

    # -- writing

    def write_full(self, repo: str, commit: str, at: str, rows: DataFrame) -> str:
        """A whole state; ``at`` is a time that sorts as text. Of rows with equal keys any one counts."""
        return self._commit(repo, commit, at, FULL, rows.withColumn("_gone", F.lit(False)))

    def write_changes(self, repo: str, commit: str, at: str, upserts: DataFrame, removed: DataFrame) -> str:
        """Rows that are new or other than before, and the keys of those that are gone; an upsert outdoes a removal of its key."""
        gone = removed.select(*self.key).distinct().join(upserts.select(*self.key), self.key, "left_anti")
        return self._commit(repo, commit, at, CHANGES, upserts.withColumn("_gone", F.lit(False)).unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True))

    def compact(self, repo: str, commit: str | None = None) -> str:
        """Writes the state at a commit (the last one, where none is named) as a full one in the same place; reads give what they gave."""
        history = self.history(repo)
        last = self._upto(history, commit)[-1]
        return self._commit(repo, last["commit"], last["at"], FULL, self.read(repo, last["commit"]).withColumn("_gone", F.lit(False)), last["name"])

    def delete(self, repo: str, commit: str) -> bool:
        """Takes a commit out of the order; whether there was one. Its files go after its manifest."""
        hit = [m for m in self._manifests(repo, "commits") if m["commit"] == commit]
        for m in hit:
            for place in (f"{self.base}/{repo}/commits/{m['name']}{'-full' if m['kind'] == FULL else ''}.json", m["folder"]):
                files, there = self._files(place)
                files.delete(there, True)
        return bool(hit)

    # -- reading

    def history(self, repo: str) -> list[dict]:
        """The commits in order; of a compacted one the full state."""
        by_name: dict[str, dict] = {}
        for m in self._manifests(repo, "commits"):
            if m["name"] not in by_name or m["kind"] == FULL:
                by_name[m["name"]] = m
        return [by_name[n] for n in sorted(by_name)]

    def _upto(self, history: list[dict], commit: str | None) -> list[dict]:
        if commit is None:
            places = [len(history) - 1]
        else:
            places = [k for k, m in enumerate(history) if m["commit"] == commit]
        if not places or places[-1] < 0:
            raise LookupError(f"no commit {commit or ''} in the store")
        return history[: places[-1] + 1]

    def read(self, repo: str, commit: str | None = None) -> DataFrame:
        """The state at a commit, by default the last: what changed since the last full state is small, and so are the keys that it hides."""
        history = self._upto(self.history(repo), commit)
        begin = max((k for k, m in enumerate(history) if m["kind"] == FULL), default=0)
        full, later = history[begin], history[begin + 1 :]
        rows = self.spark.read.parquet(full["folder"]).where("not _gone").drop("_gone").dropDuplicates(self.key)
        if not later:
            return rows
        parts = [self.spark.read.parquet(m["folder"]).withColumn("_order", F.lit(k)) for k, m in enumerate(later)]
        changed = parts[0]
        for part in parts[1:]:
            changed = changed.unionByName(part, allowMissingColumns=True)
        own = [c for c in changed.columns if c not in self.key]
        last = changed.groupBy(*self.key).agg(F.max_by(F.struct(*own), "_order").alias("r")).select(*self.key, "r.*")
        kept = rows.join(last.select(*self.key), self.key, "left_anti")
        return kept.unionByName(last.where("not _gone").drop("_gone", "_order"), allowMissingColumns=True)

    def diff(self, repo: str, base: str, head: str) -> DataFrame:
        """(key, change): keys that two commits' states differ in: added, removed, or changed in any other column."""
        a, b = self.read(repo, base), self.read(repo, head)
        other = lambda df: F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns) if c not in self.key], F.lit(0))
        both = a.select(*self.key, other(a).alias("a")).join(b.select(*self.key, other(b).alias("b")), self.key, "full")
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
        return both.withColumn("change", change).where("change is not null").select(*self.key, "change")

    # -- diffs of a working tree or a request, in slots by scope

    def write_diff(self, repo: str, rows: DataFrame, scope: str = "") -> None:
        """Replaces what the scope's slot holds; other scopes stay."""
        folder = f"{self.base}/{repo}/diffs/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        self._put(self._slot(repo, scope), {"scope": scope, "folder": folder})

    def read_diff(self, repo: str, scope: str = "") -> DataFrame | None:
        hit = [m for m in self._manifests(repo, SCOPE) if m["scope"] == scope]
        return self.spark.read.parquet(hit[0]["folder"]) if hit else None

    def delete_diff(self, repo: str, scope: str = "") -> bool:
        files, there = self._files(self._slot(repo, scope))
        return files.delete(there, False)

    def _slot(self, repo: str, scope: str) -> str:
        return f"{self.base}/{repo}/{SCOPE}/{scope.encode().hex() or 'default'}.json"


def drift_summary(drifts: DataFrame) -> DataFrame:
    """(kind, severity, n) of a state of drifts."""
    return drifts.groupBy("kind", "severity").agg(F.count("*").alias("n"))
