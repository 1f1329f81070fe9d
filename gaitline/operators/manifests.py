"""Signatures of run manifests and their compatibility.

Manifests are a table of one row per run, with the manifest as JSON text: small
documents of nested settings. Signatures are columns of canonical JSON, so that equal
settings are equal texts whatever the order of their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What members of an ensemble, candidates of a selection, manifests of one evaluation, and a source and its evaluation must share.
INFERENCE = ("behavior", "behavior_idx", "label_columns", "feature_columns", "window", "feature_selection", "final_zero_fill")
SELECTION = (*INFERENCE, "kl_config", "training_recipe", "focal")
TRAIN_SET = ("kl_config", "split", "label_columns", "window")
TRAIN_SUBSETS = ("val_fraction", "seed")
SOURCE = ("kl_config", "label_columns", "feature_columns", "window", "feature_selection", "final_zero_fill")
REQUIRED = ("behavior", "behavior_idx", "label_columns", "feature_columns", "window", "feature_selection")


def _part(text: Column, path: str) -> Column:
    """Canonical JSON of a part of a document; null where it is absent or null."""
    return F.to_json(F.try_variant_get(F.try_parse_json(text), path, "variant"))


def manifest_fields(manifests: DataFrame, text: str = "manifest") -> DataFrame:
    """``manifests`` with a column of canonical JSON for every field that a signature may hold.

    The training recipe is the training part without seed and val_fraction; absent settings of filling and focal loss have their defaults.
    """
    doc = F.col(text)
    recipe = F.map_filter(F.from_json(F.coalesce(_part(doc, "$.training"), F.lit("{}")), "map<string,string>"), lambda k, v: ~k.isin(*TRAIN_SUBSETS))
    fields = {f: _part(doc, f"$.{f}") for f in ("behavior", "behavior_idx", "label_columns", "feature_columns", "window", "feature_selection", "kl_config", "split")}
    fields |= {
        "final_zero_fill": F.coalesce(_part(doc, "$.training.final_zero_fill"), F.lit("false")),
        "training_recipe": F.to_json(F.array_sort(F.map_entries(recipe))),
        "focal": F.coalesce(_part(doc, "$.focal"), F.lit("{}")),
        **{f: _part(doc, f"$.training.{f}") for f in TRAIN_SUBSETS},
    }
    return manifests.withColumns(fields)


def lacking_fields(fields: DataFrame, path: str = "manifest_path") -> DataFrame:
    """(manifest_path, field) of required settings that a manifest lacks."""
    absent = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED]), lambda x: x.isNotNull())
    return fields.select(path, F.explode(absent).alias("field"))


def conflicts(fields: DataFrame, names: tuple[str, ...], by: str, path: str = "manifest_path") -> DataFrame:
    """(by, manifest_path, field): settings in which a manifest differs from the first, by path, of its group."""
    first = Window.partitionBy(by).orderBy(path).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    differs = lambda f: F.when(~F.col(f).eqNullSafe(F.first(f).over(first)), F.lit(f))
    found = fields.select(by, path, F.array(*[differs(f) for f in names]).alias("fields"))
    return found.select(by, path, F.explode(F.filter("fields", lambda x: x.isNotNull())).alias("field"))


def groups_too_small(fields: DataFrame, by: str, least: int = 2) -> DataFrame:
    """Groups with fewer manifests than an ensemble or a selection needs."""
    return fields.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def ensemble_conflicts(fields: DataFrame, by: str) -> DataFrame:
    return conflicts(fields, INFERENCE, by)


def selection_conflicts(fields: DataFrame, by: str) -> DataFrame:
    return conflicts(fields, SELECTION, by)


def train_set_conflicts(fields: DataFrame, subset: str, by: str) -> DataFrame:
    """Conflicts of manifests evaluated together: the shared settings, for train and val those that drew the subsets too, and behaviours that occur twice."""
    names = (*TRAIN_SET, *TRAIN_SUBSETS) if subset in ("train", "val") else TRAIN_SET
    nth = F.row_number().over(Window.partitionBy(by, "behavior").orderBy("manifest_path"))
    twice = fields.withColumn("nth", nth).where("nth > 1").select(by, "manifest_path", F.lit("behavior").alias("field"))
    return conflicts(fields, names, by).unionByName(twice)


def source_conflicts(sources: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(manifest_path, field) in which prediction sources differ from the manifest (one row) that they are evaluated by."""
    other = evaluation.select(*[F.col(f).alias(f"evaluated_{f}") for f in SOURCE])
    differs = [F.when(~F.col(f).eqNullSafe(F.col(f"evaluated_{f}")), F.lit(f)) for f in SOURCE]
    both = sources.crossJoin(F.broadcast(other.limit(1)))
    return both.select("manifest_path", F.explode(F.filter(F.array(*differs), lambda x: x.isNotNull())).alias("field"))


def signatures(fields: DataFrame, names: tuple[str, ...], name: str = "signature") -> DataFrame:
    """SHA-256 of the canonical JSON of the named settings."""
    return fields.withColumn(name, F.sha2(F.to_json(F.struct(*names)), 256))


def usable_weights(manifests: DataFrame, existing: DataFrame, text: str = "manifest") -> DataFrame:
    """The weights of each run: of evaluation, else the best checkpoint, else the interrupted one, whichever is in ``existing`` (path); null if none is."""
    names = ("evaluation_weights", "checkpoint_best_model", "checkpoint_interrupted_model")
    tried = manifests.select("manifest_path", F.posexplode(F.array(*[F.get_json_object(text, f"$.training_run.{n}") for n in names])).alias("at", "path"))
    found = tried.join(existing.select("path").distinct(), "path").groupBy("manifest_path").agg(F.min_by("path", "at").alias("weights_path"))
    return manifests.join(found, "manifest_path", "left")


def recusal_stems(manifests: DataFrame, policy: str = "train_val", text: str = "manifest") -> DataFrame:
    """(manifest_path, stem) of the videos that a run has seen: those of training, and under ``train_val`` of validation."""
    if policy not in ("train", "train_val"):
        raise ValueError(f"unknown recusal policy {policy}")
    of = lambda subset: F.coalesce(F.from_json(F.get_json_object(text, f"$.resolved_stems.{subset}"), "array<string>"), F.array().cast("array<string>"))
    stems = of("train") if policy == "train" else F.array_union(of("train"), of("val"))
    return manifests.select("manifest_path", F.explode(F.array_distinct(stems)).alias("stem"))


def run_summary(manifests: DataFrame, test_metrics: tuple[str, ...] = ("loss", "precision", "recall"), text: str = "manifest") -> DataFrame:
    """``manifests`` with what their training recorded: epochs, the selected checkpoint with its threshold and rates, and ``test_`` metrics."""
    run = lambda path, kind: F.get_json_object(text, f"$.training_run.{path}").try_cast(kind)
    chosen = "checkpoint_selection.selected."
    fields = {
        "best_epoch_by_val_loss": run("best_epoch_by_val_loss", "int"),
        "epochs_completed": run("epochs_completed", "int"),
        "best_epoch_by_checkpoint_selection": run(f"{chosen}epoch", "int"),
        "selected_threshold": run(f"{chosen}threshold", "double"),
        **{f"selected_val_episode_{m}": run(f"{chosen}{m}", "double") for m in ("f1", "precision", "recall")},
        **{f"test_{m}": run(f"test_metrics.{m}", "double") for m in test_metrics},
    }
    return manifests.withColumns(fields)


def selected_thresholds(manifests: DataFrame, text: str = "manifest") -> DataFrame:
    """P20: ``manifests`` with ``selected_threshold`` of their checkpoint selection, and ``threshold_problem``: disabled, missing or invalid, else null."""
    part = lambda path: F.get_json_object(text, f"$.training_run.checkpoint_selection.{path}")
    value = part("selected.threshold").try_cast("double")
    problem = (
        F.when(F.coalesce(part("enabled"), F.lit("")) != "true", "disabled")
        .when(part("selected.threshold").isNull(), "missing")
        .when(value.isNull() | F.isnan(value) | (value <= 0) | (value >= 1), "invalid")
    )
    return manifests.withColumns({"selected_threshold": F.when(problem.isNull(), value), "threshold_problem": problem})
