"""Versioned datasets: Parquet folders and a manifest of what each version holds.

A version is a list of data folders with a schema; a commit writes a folder, then a manifest file that
must not exist yet, so that of two writers of one version one fails. Branches, tags, clones and restores
are entries in manifests and copy no data. This stands in for table formats whose jars aren't at hand.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.sources import exists, glob


class Dataset:
    def __init__(self, spark: SparkSession, path: str, branch: str = "main") -> None:
        self.spark, self.path, self.branch = spark, path.rstrip("/"), branch

    # files

    def _fs(self, name: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _put(self, name: str, value: Any, replace: bool = True) -> None:
        fs, p = self._fs(name)
        out = fs.create(p, replace)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _get(self, name: str, default: Any = None) -> Any:
        if not exists(self.spark, f"{self.path}/{name}"):
            return default
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def _folder(self, branch: str | None = None) -> str:
        return f"_manifest/{branch or self.branch}"

    # versions

    def versions(self) -> list[dict]:
        names = glob(self.spark, f"{self.path}/{self._folder()}/*.json")
        return [self._get(f"{self._folder()}/{n.rsplit('/', 1)[1]}") for n in names]

    def version(self) -> int:
        names = glob(self.spark, f"{self.path}/{self._folder()}/*.json")
        return int(names[-1].rsplit("/", 1)[1][:-5]) if names else 0

    epoch = version

    def _manifest(self, version: int | str | None = None) -> dict:
        if isinstance(version, str):
            version = self.tags()[version]
        n = version or self.version()
        found = self._get(f"{self._folder()}/{n:012d}.json")
        if found is None:
            raise ValueError(f"no version {n} of {self.path}")
        return found

    def _commit(self, parts: list[str], what: str, schema: str | None = None) -> int:
        n = self.version() + 1
        self._put(f"{self._folder()}/{n:012d}.json", {"version": n, "parts": parts, "operation": what, "timestamp": time.time(), "schema": schema}, replace=False)
        return n

    def write_fragment(self, df: DataFrame) -> str:
        """Data that no version holds yet."""
        part = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(part)
        return part

    def commit_fragments(self, parts: list[str], mode: str = "overwrite") -> int:
        old = self._manifest()["parts"] if mode == "append" and self.version() else []
        return self._commit([*old, *parts], mode)

    def write(self, df: DataFrame, mode: str = "create") -> int:
        """create (fails where there are versions), append or overwrite; gives the new version."""
        if mode == "create" and self.version():
            raise FileExistsError(self.path)
        return self.commit_fragments([self.write_fragment(df)], mode)

    def read(self, version: int | str | None = None, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
        """A version or a tag; projection and filter reach the files."""
        df = self.spark.read.option("mergeSchema", "true").parquet(*self._manifest(version)["parts"])
        df = df.where(where) if where else df
        return df.select(*columns) if columns else df

    def restore(self, version: int | str) -> int:
        return self._commit(self._manifest(version)["parts"], f"restore {version}")

    def tags(self) -> dict[str, int]:
        return self._get("_manifest/tags.json", {})

    def create_tag(self, name: str, version: int | None = None) -> None:
        self._put("_manifest/tags.json", self.tags() | {name: version or self.version()})

    def delete_tag(self, name: str) -> None:
        self._put("_manifest/tags.json", {k: v for k, v in self.tags().items() if k != name})

    def create_branch(self, name: str, version: int | str | None = None) -> Dataset:
        other = Dataset(self.spark, self.path, name)
        other._commit(self._manifest(version)["parts"], f"branch of {self.branch}")
        return other

    def branches(self) -> list[str]:
        return sorted(p.rsplit("/", 1)[1] for p in glob(self.spark, f"{self.path}/_manifest/*") if not p.endswith(".json"))

    def checkout(self, branch: str) -> Dataset:
        if branch not in self.branches():
            raise ValueError(f"no branch {branch}")
        return Dataset(self.spark, self.path, branch)

    def shallow_clone(self, target: str, version: int | str | None = None) -> Dataset:
        other = Dataset(self.spark, target)
        other._commit(self._manifest(version)["parts"], f"clone of {self.path}")
        return other

    # changes

    def _rewrite(self, df: DataFrame, what: str) -> int:
        return self._commit([self.write_fragment(df)], what)

    def merge_insert(self, new: DataFrame, on: list[str]) -> int:
        """Rows of ``new`` replace those with their keys, and the others are added."""
        old = self.read().join(new.select(*on).distinct(), on, "left_anti")
        return self._rewrite(old.unionByName(new, allowMissingColumns=True), "merge")

    def delete(self, predicate: str) -> int:
        return self._rewrite(self.read().where(~F.coalesce(F.expr(predicate), F.lit(False))), "delete")

    def add_columns(self, values: dict[str, str | Column]) -> int:
        return self._rewrite(self.read().withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in values.items()}), "add columns")

    def compact(self, files: int | None = None) -> int:
        df = self.read()
        return self._rewrite(df.repartition(files) if files else df.coalesce(max(1, df.rdd.getNumPartitions() // 4)), "compact")

    def create_scalar_index(self, column: str) -> int:
        """The rows sorted by a column, so that filters on it skip row groups."""
        return self._rewrite(self.read().repartitionByRange(column).sortWithinPartitions(column), f"sort {column}")

    def take(self, ids: list, id_column: str, columns: list[str] | None = None) -> DataFrame:
        df = self.read().where(F.col(id_column).isin(ids))
        return df.select(*columns) if columns else df

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        return self.read().orderBy(F.rand(seed)).limit(n)

    def cleanup_old_versions(self, older_than_seconds: float = 0) -> int:
        """Removes superseded versions that no tag or branch holds, and data folders of none; how many folders went."""
        held, limit = set(), time.time() - older_than_seconds
        tagged = {*self.tags().values()}
        for b in self.branches():
            d = Dataset(self.spark, self.path, b)
            last = d.version()
            for v in d.versions():
                if v["version"] == last or v["version"] in tagged or v["timestamp"] > limit:
                    held.update(v["parts"])
                else:
                    fs, p = d._fs(f"{d._folder()}/{v['version']:012d}.json")
                    fs.delete(p, False)
        gone = [p for p in glob(self.spark, f"{self.path}/data/*") if not any(h.endswith(p.rsplit("/", 1)[1]) for h in held)]
        for p in gone:
            fs, q = self._fs("data/" + p.rsplit("/", 1)[1])
            fs.delete(q, True)
        return len(gone)

    # vectors

    def create_vector_index(self, column: str, id_column: str, partitions: int = 256, metric: str = "l2") -> None:
        from lakemill.operators.vectors import VectorIndex

        VectorIndex.build(self.read(), f"{self.path}/_indices/{column}", column, id_column, partitions, metric)

    def list_indices(self) -> list[str]:
        return sorted(p.rsplit("/", 1)[1] for p in glob(self.spark, f"{self.path}/_indices/*"))

    def vector_search(self, column: str, query: list[float], k: int = 10, nprobes: int | None = None, where: str | None = None, columns: list[str] | None = None) -> DataFrame:
        from lakemill.operators.vectors import VectorIndex

        return VectorIndex(self.spark, f"{self.path}/_indices/{column}").search(query, k, nprobes, where, columns)
