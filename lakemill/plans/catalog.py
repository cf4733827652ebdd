"""A registry of datasets, lineage records and metrics."""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakemill.sources import detect_format, exists, glob, read_any, read_hive
from lakemill.sources.versioned import Dataset


class Catalog:
    """Names of datasets and where they lie, kept in a JSON file."""

    def __init__(self, spark: SparkSession, store: str | None = None) -> None:
        self.spark, self.store = spark, store
        self.entries: dict[str, dict] = {}
        if store and os.path.exists(store):
            with open(store) as f:
                self.entries = json.load(f)

    def _save(self) -> None:
        if self.store:
            with open(self.store + ".part", "w") as f:
                json.dump(self.entries, f, indent=1)
            os.replace(self.store + ".part", self.store)

    def register(self, name: str, path: str, fmt: str | None = None, **info: Any) -> None:
        self.entries[name] = {"path": path, "format": fmt or detect_format(self.spark, path), **info}
        self._save()

    def discover(self, root: str) -> list[str]:
        """Registers everything that is known under a folder."""
        found = []
        for p in glob(self.spark, f"{root}/*"):
            if (fmt := detect_format(self.spark, p)) != "unknown":
                name = p.rsplit("/", 1)[1].split(".")[0]
                self.register(name, p, fmt)
                found.append(name)
        return found

    def load(self, name: str) -> DataFrame:
        e = self.entries[name]
        if e["format"] == "versioned":
            return Dataset(self.spark, e["path"]).read()
        return read_hive(self.spark, e["path"]) if e["format"] == "hive" else read_any(self.spark, e["path"], e["format"])

    def describe(self, name: str) -> dict:
        return self.entries[name] | {"columns": dict(self.load(name).dtypes)}

    def stats(self, name: str) -> dict:
        df = self.load(name)
        row = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns)).first().asDict()
        return {"rows": row.pop("rows"), "nulls": row}

    def information_schema(self) -> DataFrame:
        rows = [(n, i, c, t) for n in sorted(self.entries) for i, (c, t) in enumerate(self.load(n).dtypes, 1)]
        return self.spark.createDataFrame(rows, "table_name string, ordinal_position int, column_name string, data_type string")

    def validate(self) -> dict[str, str]:
        """Names whose data can't be read, with the reason."""
        bad = {}
        for n, e in self.entries.items():
            if not exists(self.spark, e["path"]):
                bad[n] = "missing"
        return bad


# lineage


def pipeline_signature(config: dict) -> str:
    return hashlib.blake2b(json.dumps(config, sort_keys=True, default=str).encode(), digest_size=16).hexdigest()


def dataset_lineage(config: dict, inputs: list[str] | None = None, output_version: int | None = None, label: str = "curation", **extra: Any) -> dict:
    return {"label": label, "signature": pipeline_signature(config), "config": config, "inputs": inputs or [], "output_version": output_version, "created": time.time(), **extra}


def write_lineage(path: str, lineage: dict) -> None:
    with open(f"{path.rstrip('/')}.lineage.json", "w") as f:
        json.dump(lineage, f, indent=1, default=str)


def read_lineage(path: str) -> dict | None:
    name = f"{path.rstrip('/')}.lineage.json"
    if not os.path.exists(name):
        return None
    with open(name) as f:
        return json.load(f)


# metrics


class Metrics:
    """Times of queries and rows in and out of steps, in memory and in an audit file."""

    def __init__(self, audit: str | None = None) -> None:
        self.audit, self.records = audit, []

    def _add(self, record: dict) -> None:
        self.records.append(record)
        if self.audit:
            with open(self.audit, "a") as f:
                f.write(json.dumps(record, default=str) + "\n")

    @contextmanager
    def query(self, label: str, kind: str = "local") -> Iterator[dict]:
        record, began = {"label": label, "kind": kind, "status": "ok", "at": time.time()}, time.perf_counter()
        try:
            yield record
        except Exception as e:
            record |= {"status": "error", "error": str(e)[:500]}
            raise
        finally:
            self._add(record | {"seconds": time.perf_counter() - began})

    def curate(self, op: str, rows_in: int, rows_out: int) -> None:
        self._add({"label": op, "kind": "curate", "status": "ok", "at": time.time(), "rows_in": rows_in, "rows_out": rows_out})

    def audit_list(self, limit: int = 100, kind: str | None = None, status: str | None = None) -> list[dict]:
        rows = [r for r in self.records if kind in (None, r["kind"]) and status in (None, r["status"])]
        return rows[-limit:][::-1]

    def audit_get(self, at: int) -> dict | None:
        return self.records[at] if 0 <= at < len(self.records) else None

    def audit_stats(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for r in self.records:
            out[f"{r['kind']}:{r['status']}"] = out.get(f"{r['kind']}:{r['status']}", 0) + 1
        return out

    def audit_clear(self) -> None:
        self.records.clear()
        if self.audit:
            open(self.audit, "w").close()

    def serve(self, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
        """/metrics as text, /summary and /records as JSON, by a thread of the driver until ``shutdown`` of what comes back."""
        own = self

        class Answer(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                pages = {"/metrics": own.prometheus_text, "/summary": lambda: json.dumps(own.summary()), "/records": lambda: json.dumps(own.snapshot(), default=str)}
                page = pages.get(self.path)
                self.send_response(200 if page else 404)
                self.end_headers()
                self.wfile.write((page() if page else "").encode())

            def log_message(self, *args: Any) -> None:
                pass

        server = ThreadingHTTPServer((host, port), Answer)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server

    def snapshot(self) -> list[dict]:
        return list(self.records)

    def summary(self) -> dict:
        times = sorted(r["seconds"] for r in self.records if "seconds" in r)
        at = lambda q: times[min(len(times) - 1, int(q * len(times)))] if times else None
        rows_in, rows_out = (sum(r.get(k, 0) for r in self.records) for k in ("rows_in", "rows_out"))
        return {"queries": len(times), "errors": sum(r["status"] == "error" for r in self.records), "p50": at(0.5), "p95": at(0.95), "p99": at(0.99), "rows_in": rows_in, "rows_out": rows_out, "keep_rate": rows_out / rows_in if rows_in else None}

    def prometheus_text(self) -> str:
        s = self.summary()
        lines = []
        for name, kind in (("queries", "counter"), ("errors", "counter"), ("rows_in", "counter"), ("rows_out", "counter"), ("p50", "gauge"), ("p95", "gauge")):
            lines += [f"# TYPE lakemill_{name} {kind}", f"lakemill_{name} {s[name] or 0}"]
        return "\n".join(lines) + "\n"


class Flow:
    """Named steps over a DataFrame, whose rows are counted as they pass, without another run."""

    def __init__(self, df: DataFrame, label: str = "curation") -> None:
        self.label, self.seen = label, []
        self.df = self._watch(df, "input")

    def _watch(self, df: DataFrame, name: str) -> DataFrame:
        o = Observation(f"{self.label}-{len(self.seen)}-{name}")
        self.seen.append((name, o))
        return df.observe(o, F.count(F.lit(1)).alias("rows"))

    def step(self, name: str, fn: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> Flow:
        self.df = self._watch(fn(self.df, *args, **kwargs), name)
        return self

    def funnel(self) -> list[tuple[str, int]]:
        """Rows after each step; to be asked after the flow's result was computed."""
        return [(n, o.get["rows"]) for n, o in self.seen]
