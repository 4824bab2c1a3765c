"""Batch jobs from a YAML or JSON file: {store, jobs: [{source, table, mode, pk, apply_ddl, chunk, url}]}.

``store`` (for all jobs or one) is a table store's folder; ``url`` or
``database_url`` names one too, or a database to append to if it begins with
``jdbc:``.  ``pk`` is a list or names separated by commas; a source without a
scheme or a leading slash lies beside the configuration file.
"""

from __future__ import annotations

import json
import logging
import os
from typing import Any

from pyspark.sql import SparkSession

from .capture import diagnose
from .functions.casting import cast_frame
from .functions.text import robust_clean
from .pipeline import load
from .sources.readers import read_any
from .sources.store import TableStore, jdbc_write

log = logging.getLogger(__name__)


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("reading YAML needs PyYAML; JSON works without") from e
    return yaml.safe_load(text)


def _keys(pk: str | list[str] | None) -> list[str] | None:
    return [k.strip() for k in pk.split(",") if k.strip()] if isinstance(pk, str) else pk


def _place(source: Any, folder: str) -> Any:
    plain = isinstance(source, str) and folder and not os.path.isabs(source) and "://" not in source
    return os.path.join(folder, source) if plain else source


def _append(spark: SparkSession, url: str, source: Any, table: str, mode: str, batch: int) -> dict:
    if mode != "insert":
        raise ValueError("databases take inserts only; upsert or update a table of a store and copy it")
    df = cast_frame(robust_clean(read_any(spark, source)))
    jdbc_write(df, url, table, batch=batch)
    return {"rows": df.count(), "issues": []}


def run_jobs(spark: SparkSession, config: dict | str, store: TableStore | None = None) -> list[dict]:
    """Run every job; one that fails or is incomplete is reported and the rest go on."""
    folder = os.path.dirname(os.path.abspath(config)) if isinstance(config, str) else ""
    config = read_config(config) if isinstance(config, str) else config
    out: list[dict[str, Any]] = []
    for job in config.get("jobs", []):
        source, table = _place(job.get("source"), folder), job.get("table")
        if not source or not table:
            out.append({"table": table, "status": "skipped", "error": "source and table are needed"})
            continue
        try:
            mode, chunk = job.get("mode", "insert"), job.get("chunk", 10_000)
            url = next((d[k] for d in (job, config) for k in ("store", "url", "database_url") if d.get(k)), None)
            if url and url.startswith("jdbc:"):
                found = _append(spark, url, source, table, mode, chunk)
            else:
                target = store if store and not any(job.get(k) for k in ("store", "url", "database_url")) else TableStore(spark, url)
                found = load(spark, target, source, table, mode, _keys(job.get("pk")), apply_ddl=bool(job.get("apply_ddl", True)), chunk=chunk)
            out.append({"table": table, "status": "success", **{k: found[k] for k in ("rows", "issues")}})
        except Exception as e:
            cause, advice = diagnose(str(e))
            log.error("job %s failed: %s", table, e)
            out.append({"table": table, "status": "failed", "error": str(e), "cause": cause, "advice": advice})
    return out
