"""Run manifests and other nested YAML documents as tables: parsed in tasks, with an error column."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitline.operators import manifests as M
from gaitline.sources.io import plain_yaml

# The settings that a manifest of a training run and one of an ensemble must have.
TRAIN_KEYS = ("behavior", "behavior_idx", "label_columns", "feature_columns", "window", "artifacts", "feature_selection", "training_run")
ENSEMBLE_KEYS = ("manifest_type", "behavior", "behavior_idx", "label_columns", "feature_columns", "window", "feature_selection", "training", "aggregation", "members")
AGGREGATION = "mean_probability"


def parse_yaml(text: str) -> Any:
    """The document of a YAML text; where no YAML reader is installed, only JSON and flat mappings are understood."""
    try:
        from yaml import safe_load
    except ModuleNotFoundError:
        return json.loads(text) if text.lstrip().startswith("{") else plain_yaml(text)
    return safe_load(text)


def parse_documents(texts: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """(path, content, document, error): each text's mapping as canonical JSON, keys in order, and as VARIANT; error where it is none.

    A missing or empty text and one that is no mapping are errors of their row. Texts are parsed where they lie, without a shuffle.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            content, errors = [], []
            for value in pdf["value"]:
                try:
                    found = parse_yaml(value or "")
                    if not isinstance(found, dict):
                        raise ValueError("not a mapping")
                    content.append(json.dumps(found, sort_keys=True, separators=(",", ":"), default=str))
                    errors.append(None)
                except Exception as problem:  # any reader's error is the file's
                    content.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}"[:200])
            yield pd.DataFrame({"path": pdf["path"], "content": content, "error": errors})

    rows = texts.select(F.col(path).alias("path"), F.col(text).alias("value")).mapInPandas(read, "path string, content string, error string")
    return rows.select("path", "content", F.try_parse_json("content").alias("document"), "error")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``parse_documents`` of files, each read whole by a task; ``path`` may be a file, a folder or a glob."""
    return parse_documents(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def _missing(keys: tuple[str, ...]):
    """The keys that the document lacks; one whose value is null is there."""
    there = F.from_json("content", "map<string,string>")
    return F.filter(F.array(*map(F.lit, keys)), lambda k: ~F.array_contains(F.map_keys(there), k))


def manifests_of(documents: DataFrame) -> DataFrame:
    """Manifests (manifest_path, manifest, document, kind, error) of ``parse_documents``: kind is ensemble or train, error what makes one unusable.

    Errors are, in this order: what the reader said; settings that are lacking; for an ensemble another way of aggregation than the mean probability, and fewer than two members.
    """
    kind = F.when(F.col("document").isNull(), None).when(F.get_json_object("content", "$.manifest_type") == "ensemble", "ensemble").otherwise("train")
    lacking = F.when(F.col("kind") == "ensemble", _missing(ENSEMBLE_KEYS)).otherwise(_missing(TRAIN_KEYS))
    n_members = F.coalesce(F.json_array_length(F.get_json_object("content", "$.members")), F.lit(0))
    method = F.get_json_object("content", "$.aggregation.method")
    problem = (
        F.when(F.col("document").isNull(), F.col("error")).when(F.size(lacking) > 0, F.concat(F.lit("missing keys: "), F.array_join(lacking, ", ")))
        .when((F.col("kind") == "ensemble") & ~F.coalesce(method == AGGREGATION, F.lit(False)), F.concat(F.lit("unsupported aggregation: "), F.coalesce(method, F.lit("none"))))
        .when((F.col("kind") == "ensemble") & (n_members < 2), "fewer than two members")
    )
    return documents.withColumn("kind", kind).select(F.col("path").alias("manifest_path"), F.col("content").alias("manifest"), "document", "kind", problem.alias("error"))


def read_manifests(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Manifests from their YAML files; with ``kind``, those of the other kind are errors too."""
    out = manifests_of(read_documents(spark, path))
    if kind is None:
        return out
    return out.withColumn("error", F.coalesce("error", F.when(F.col("kind") != kind, F.concat(F.lit(f"not of kind {kind}: "), "kind"))))


def missing_keys(manifests: DataFrame) -> DataFrame:
    """(manifest_path, key): every required setting that a manifest lacks."""
    renamed = manifests.withColumnRenamed("manifest", "content")
    lacking = F.when(F.col("kind") == "ensemble", _missing(ENSEMBLE_KEYS)).otherwise(_missing(TRAIN_KEYS))
    return renamed.where("content is not null").select("manifest_path", F.explode(lacking).alias("key"))


def ensemble_members(manifests: DataFrame) -> DataFrame:
    """(manifest_path, position, member): the manifests that usable ensembles list as members, in order."""
    listed = F.from_json(F.get_json_object("manifest", "$.members"), "array<string>")
    rows = manifests.where("kind = 'ensemble' and error is null").select("manifest_path", F.posexplode(listed).alias("position", "item"))
    return rows.select("manifest_path", "position", F.get_json_object("item", "$.manifest_path").alias("member"))


def stale_ensembles(manifests: DataFrame) -> DataFrame:
    """(manifest_path, member, field): where an ensemble's recorded settings differ from a member's own; ``manifest`` where the member has no usable manifest."""
    fields = M.manifest_fields(manifests.where("error is null")).select("manifest_path", *M.INFERENCE)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    own = fields.select(plain("manifest_path").alias("member_at"), F.lit(True).alias("there"), *[F.col(f).alias(f"member_{f}") for f in M.INFERENCE])
    both = ensemble_members(manifests).join(fields, "manifest_path").withColumn("member_at", plain("member")).join(own, "member_at", "left")
    differs = F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"member_{f}")), F.lit(f)) for f in M.INFERENCE])
    found = F.when(F.col("there").isNull(), F.array(F.lit("manifest"))).otherwise(F.filter(differs, lambda x: x.isNotNull()))
    return both.select("manifest_path", "member", F.explode(found).alias("field"))
