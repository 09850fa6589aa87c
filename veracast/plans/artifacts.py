"""Stored runs: build, rescore, validate, and the manifest that ties their tables together."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import canonical_hash, scoring_config, store_config
from ..operators import clean, reports
from ..operators.semantic import Scorer
from ..sources.messages import path_exists, row_limit, scan_messages, write_table
from .materialize import materialize
from .score import Scored, clean_rows, cluster_messages, deduplicated, score_store

log = logging.getLogger("veracast")


class Run:
    """A configuration with the session that its tables live in."""

    def __init__(self, spark: SparkSession, config: dict[str, Any]) -> None:
        self.spark, self.config = spark, config
        self.paths = config["paths"]
        self.overwrite = bool(config["runtime"]["overwrite_outputs"])

    def say(self, stage: str, text: str) -> None:
        if self.config["runtime"]["enable_progress_logs"]:
            log.info("[%s] %s", stage, text)

    def table(self, name: str) -> str:
        return f"{self.paths['store']}/{name}"

    def read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    # manifest: a small JSON document, written as a single text row so that any file system will do
    def load_manifest(self) -> dict[str, Any]:
        path = self.paths["manifest"]
        if not path_exists(self.spark, path):
            raise FileNotFoundError(f"no manifest at {path}")
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def write_manifest(self, manifest: dict[str, Any]) -> None:
        text = self.spark.createDataFrame([(json.dumps(manifest, indent=1, sort_keys=True, default=str),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(self.paths["manifest"])

    def manifest(self, store_columns: list[str], author_columns: list[str], scored_columns: list[str]) -> dict[str, Any]:
        now = datetime.now(UTC).isoformat()
        return {
            "pipeline_version": schema.PIPELINE_VERSION,
            "store_schema_version": schema.STORE_SCHEMA_VERSION,
            "score_schema_version": schema.SCORE_SCHEMA_VERSION,
            "created_at": now,
            "build_mode": self.config["runtime"]["build_mode"],
            "config_hash_for_store": canonical_hash(store_config(self.config)),
            "config_hash_for_scoring": canonical_hash(scoring_config(self.config)),
            "store_columns": store_columns,
            "author_score_columns": author_columns,
            "scored_columns": scored_columns,
            "store_schema_fingerprint": schema.fingerprint(store_columns),
            "score_schema_fingerprint": schema.fingerprint([*author_columns, *scored_columns]),
            "store_tables": list(schema.STORE_TABLES),
            "paths": {k: str(v) for k, v in self.paths.items()},
            "derived_thresholds": self.config.get("derived_thresholds", {}),
            "last_rescore_at": None,
        }

    # passes
    def build_store(self, scorer: Scorer | None = None) -> DataFrame:
        """Cleans the input and writes the store's tables; returns the summary."""
        self.say("STORE", "cleaning messages")
        raw = clean.with_message_id(scan_messages(self.spark, self.paths["input"], row_limit(self.config["runtime"])))
        # written before rows are dropped, so that the summary of all rows costs no second cleaning (and a model no second pass)
        rows = materialize(clean_rows(raw, self.config, scorer), "clean-rows")
        columns = ["message_id", *schema.store_columns(self.config["runtime"]["build_mode"])]
        write_table(deduplicated(rows, self.config).select(columns), self.table("cleaned_messages"), self.overwrite)
        self.build_clusters()
        return clean.clean_summary(rows, self.read(self.table("cleaned_messages")))

    def build_clusters(self) -> None:
        from ..operators.clusters import text_clusters, text_window_clusters

        self.say("CLUSTERS", "counting equal texts")
        store = self.read(self.table("cleaned_messages"))
        write_table(text_clusters(store), self.table("text_clusters"), self.overwrite)
        write_table(text_window_clusters(store), self.table("text_window_clusters"), self.overwrite)

    def score(self) -> Scored:
        """Writes author and message scores from the store; returns the stored tables."""
        self.say("SCORES", "authors, then messages")
        store, text, windows = (self.read(self.table(t)) for t in schema.STORE_TABLES)
        keep = lambda df, name: materialize(df, name) if name in ("author-features", "message-refs") else df
        plan = score_store(store, self.config, text, windows, keep)
        write_table(plan.author_scores, self.paths["author_scores"], self.overwrite)
        # message scores read the authors' table rather than computing it again
        from .score import score_messages

        scores = self.read(self.paths["author_scores"])
        scored = materialize(score_messages(cluster_messages(store, text, windows, self.config), scores, plan.message_refs, self.config), "scored")
        write_table(scored.select(*schema.SCORED_COLUMNS), self.paths["scored_messages"], self.overwrite)
        plan.author_scores, plan.scored = scores, scored
        return plan

    def _finish(self, manifest: dict[str, Any]) -> None:
        self.write_manifest(manifest)
        self.validate_scores(manifest)

    def _columns(self) -> tuple[list[str], list[str], list[str]]:
        return tuple(self.read(p).columns for p in (self.table("cleaned_messages"), self.paths["author_scores"], self.paths["scored_messages"]))

    def build(self, scorer: Scorer | None = None) -> dict[str, Any]:
        """Store, scores, reports and manifest from the input."""
        summary = self.build_store(scorer)
        plan = self.score()
        manifest = self.manifest(*self._columns())
        self._finish(manifest)
        return {"manifest": manifest, "summary": summary, "tables": self.tables(plan, summary), "scored": self.read(self.paths["scored_messages"]), "author_scores": plan.author_scores}

    def rescore(self) -> dict[str, Any]:
        """New scores from the store as it is; nothing is cleaned again, and clusters stay."""
        if path_exists(self.spark, self.paths["manifest"]):
            manifest = self.load_manifest()
            self.validate_store(manifest)
        else:
            self.validate_store(None)
            manifest = None
        plan = self.score()
        fresh = self.manifest(*self._columns())
        fresh["created_at"] = (manifest or fresh)["created_at"]
        fresh["last_rescore_at"] = datetime.now(UTC).isoformat()
        self._finish(fresh)
        summary = store_summary(self.read(self.table("cleaned_messages")))
        return {"manifest": fresh, "summary": summary, "tables": self.tables(plan, summary), "scored": self.read(self.paths["scored_messages"]), "author_scores": plan.author_scores}

    def tables(self, plan: Scored, summary: DataFrame) -> dict[str, DataFrame]:
        return reports.qa_tables(plan.clean, plan.author_scores, plan.scored, summary, self.config)

    # validation
    def validate_store(self, manifest: dict[str, Any] | None) -> None:
        """FileNotFoundError for no store; RuntimeError for another version, configuration, missing tables or another schema; ValueError for missing columns."""
        if not path_exists(self.spark, self.paths["store"]):
            raise FileNotFoundError(f"no store at {self.paths['store']}")
        if manifest is not None:
            if manifest.get("store_schema_version") != schema.STORE_SCHEMA_VERSION:
                raise RuntimeError("the store has another schema version; build it again")
            if manifest.get("config_hash_for_store") != canonical_hash(store_config(self.config)):
                raise RuntimeError("the store was built with another configuration; build it again")
        absent = [t for t in schema.STORE_TABLES if not path_exists(self.spark, self.table(t))]
        if absent:
            raise RuntimeError(f"the store lacks tables: {absent}")
        columns = self.read(self.table("cleaned_messages")).columns
        _require("cleaned_messages", schema.REQUIRED_STORE, columns)
        if manifest is not None and manifest.get("store_schema_fingerprint") != schema.fingerprint(columns):
            raise RuntimeError("the store's columns are not those of its manifest")

    def validate_scores(self, manifest: dict[str, Any]) -> None:
        for name in ("author_scores", "scored_messages"):
            if not path_exists(self.spark, self.paths[name]):
                raise FileNotFoundError(f"no {name} at {self.paths[name]}")
        if manifest.get("score_schema_version") != schema.SCORE_SCHEMA_VERSION:
            raise RuntimeError("the scores have another schema version; score again")
        if manifest.get("config_hash_for_scoring") != canonical_hash(scoring_config(self.config)):
            raise RuntimeError("the scores were made with another configuration; score again")
        _, authors, scored = self._columns()
        _require("author_scores", schema.REQUIRED_AUTHOR_SCORES, authors)
        _require("scored_messages", schema.REQUIRED_SCORED, scored)
        if manifest.get("score_schema_fingerprint") != schema.fingerprint([*authors, *scored]):
            raise RuntimeError("the scores' columns are not those of their manifest")

    def validate(self) -> dict[str, Any]:
        manifest = self.load_manifest()
        self.validate_store(manifest)
        self.validate_scores(manifest)
        return manifest


def _require(name: str, wanted, columns) -> None:
    absent = [c for c in wanted if c not in columns]
    if absent:
        raise ValueError(f"{name} lacks columns {absent}")


def store_summary(store: DataFrame) -> DataFrame:
    """Counters of a store: rows, rows without an author, rows a model scored."""
    return store.agg(
        F.count("*").alias("clean_rows"),
        F.coalesce(F.sum(F.col("author_hash_missing_flag").cast("long")), F.lit(0)).alias("missing_author_rows"),
        F.coalesce(F.sum(F.col("semantic_model_applied_flag").cast("long")), F.lit(0)).alias("semantic_applied_rows"),
    )
