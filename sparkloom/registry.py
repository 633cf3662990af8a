"""Experiments and registered models, as documents beside their artifacts."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from sparkloom.config import MODEL_STATUSES
from sparkloom.sources.scratch import qualified
from sparkloom.sources.shared import Files
from sparkloom.sources.tables import write_json


class Registry:
    """Documents under a folder that Spark can write, shared or local; one process writes at a time."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.root, self.files = f"{qualified(spark, str(root))}/experiments", Files(spark)

    def _path(self, experiment_id: str) -> str:
        if not re.fullmatch(r"[0-9a-f]{10}", experiment_id):
            raise KeyError(experiment_id)
        return f"{self.root}/{experiment_id}.json"

    def create(self, filename: str, config: dict, kind: str = "tabular") -> dict:
        """A new experiment; its version counts those of the same name."""
        name = f"{Path(filename).stem}-{config.get('target')}-{kind}"
        version = 1 + sum(e["model"]["name"] == name for e in self.list())
        doc = {"id": uuid.uuid4().hex[:10], "status": "created", "created": datetime.now(timezone.utc).isoformat(), "config": config, "results": None, "model": {"name": name, "version": version, "registry_status": "Development"}}
        self.save(doc)
        return doc

    def save(self, doc: dict) -> None:
        write_json(self.files, self._path(doc["id"]), doc)

    def get(self, experiment_id: str) -> dict:
        path = self._path(experiment_id)
        if not self.files.exists(path):
            raise KeyError(experiment_id)
        return self.files.read_json(path)

    def list(self) -> list[dict]:
        """Newest first."""
        return sorted(map(self.files.read_json, self.files.matching(f"{self.root}/*.json")), key=lambda e: e["created"], reverse=True)

    def set_status(self, experiment_id: str, status: str) -> dict:
        """Only completed runs; promoting to Production archives the one of the same name that was there."""
        if status not in MODEL_STATUSES:
            raise ValueError(f"{status} is not one of {MODEL_STATUSES}")
        doc = self.get(experiment_id)
        if doc["status"] != "completed":
            raise ValueError("only completed runs have a model")
        if status == "Production":
            for other in self.list():
                if other["id"] != doc["id"] and other["model"]["name"] == doc["model"]["name"] and other["model"]["registry_status"] == "Production":
                    other["model"]["registry_status"] = "Archived"
                    self.save(other)
        doc["model"]["registry_status"] = status
        self.save(doc)
        return doc

    @staticmethod
    def headline(doc: dict) -> dict:
        r = doc.get("results") or {}
        return {k: r.get(k) for k in ("leader", "primary_metric", "primary_test", "beats_baseline")}
