"""Sources and sinks: pose, annotation, feature, prediction, split and sweep tables.

Every reader gives DataFrames; a table's path may be a file, a folder or a glob.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitline.functions.geometry import stem_of_path

SECTIONS = {"train": "train", "training": "train", "test": "test", "testing": "test", "val": "val", "validation": "val"}


def with_stem(df: DataFrame, suffix: str = "") -> DataFrame:
    """``stem`` from the name of the file that a row came from, without ``suffix``."""
    return df.withColumn("stem", F.regexp_replace(stem_of_path(F.col("_metadata.file_path")), re.escape(suffix) + "$", ""))


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df


def read_pose(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """CSV pose tables; blanks in the header go, bad numbers become missing, ``index`` or ``frame`` gives the frame."""
    raw = with_stem(spark.read.csv(path, header=True), suffix)
    named = raw.toDF(*[c.strip() for c in raw.columns])
    if "index" in named.columns:
        named = named.withColumnRenamed("index", "frame")
    require(named, ["frame"], "pose table")
    values = [c for c in named.columns if c not in ("stem", "frame")]
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None)).alias(c)
    return named.select("stem", F.col("frame").cast("int").alias("frame"), *[number(c) for c in values])


def flatten_pose(long: DataFrame, points: list[str]) -> DataFrame:
    """Rows (stem, frame, keypoint, axis, value) to ``<keypoint>_<axis>`` columns; likelihood is ``p``."""
    axis = F.when(F.col("axis") == "likelihood", "p").otherwise(F.col("axis"))
    names = [f"{p}_{a}" for p in points for a in ("x", "y", "p")]
    return long.withColumn("c", F.concat_ws("_", "keypoint", axis)).groupBy("stem", "frame").pivot("c", names).agg(F.first("value"))


def read_annotations(spark: SparkSession, path: str, behaviors: list[str], suffix: str = "") -> DataFrame:
    """S3: tab-separated START/STOP events of the wanted behaviours."""
    raw = require(spark.read.csv(path, header=True, sep="\t"), ["Behavior", "Behavior type", "Image index"], "annotations")
    return clean_annotations(with_stem(raw, suffix).select("stem", F.col("Behavior").alias("behavior"), F.col("Behavior type").alias("event_type"), F.col("Image index").alias("image_index")), behaviors)


def clean_annotations(events: DataFrame, behaviors: list[str]) -> DataFrame:
    return events.select("stem", F.trim("behavior").alias("behavior"), F.upper(F.trim("event_type")).alias("event_type"), F.col("image_index").cast("double").cast("int").alias("image_index")).where(F.col("behavior").isin(behaviors))


def features_for(features: DataFrame, stems: DataFrame) -> DataFrame:
    """Rows of the wanted stems; the semi-join prunes partitions where the table is partitioned by stem."""
    return features.join(stems.select("stem").distinct(), "stem", "left_semi")


def missing_stems(features: DataFrame, stems: DataFrame) -> DataFrame:
    """S4's guard: wanted stems without a row."""
    return stems.select("stem").distinct().join(features.select("stem").distinct(), "stem", "left_anti")


def available_stems(features: DataFrame) -> DataFrame:
    """S6."""
    return features.select("stem").distinct()


def stems_of(paths: DataFrame, column: str = "path") -> DataFrame:
    """Stems of a list of video paths."""
    return paths.select(stem_of_path(F.trim(column)).alias("stem")).where("stem <> ''")


def split_content(text: str, yaml: bool = True) -> dict:
    """A split file's sections. ``yaml``: a mapping; else the legacy form, ``Section:`` lines with an entry on each line below.

    Entries before a section are an error. Split files are small, so each is read whole.
    """
    if yaml:
        try:
            from yaml import safe_load as load
        except ModuleNotFoundError:
            load = plain_yaml
        found = load(text)
        if not isinstance(found, dict):
            raise ValueError("a split file must be a mapping")
        return found
    sections: dict[str, list[str]] = {}
    entries: list[str] | None = None
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.endswith(":"):
            entries = sections[line[:-1].strip().lower()] = []
        elif entries is None:
            raise ValueError("entries before a section header")
        else:
            entries.append(line)
    return sections


def plain_yaml(text: str) -> dict:
    """Where no YAML reader is installed: keys at the left margin with a scalar, a list in brackets, or dashed lines below."""

    def scalar(x: str):
        x = x.strip()
        if x[:1] in ("'", '"') and x[-1:] == x[:1] and len(x) > 1:
            return x[1:-1]
        x = re.sub(r"\s#.*$", "", x).strip()
        if re.fullmatch(r"-?[0-9]+", x):
            return int(x)
        if re.fullmatch(r"-?[0-9]+\.[0-9]*", x):
            return float(x)
        return {"true": True, "false": False, "null": None, "~": None, "": None}.get(x.lower(), x)

    out: dict = {}
    key = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#") or line.strip() in ("---", "..."):
            continue
        if item := re.match(r"\s*-\s+(.*)$", line):
            if key is None or not (out[key] is None or isinstance(out[key], list)):
                raise ValueError("a list item without a key")
            out[key] = [*(out[key] or []), scalar(item[1])]
        elif entry := re.match(r"([^\s:][^:]*):(?:\s+(.*))?$", line):
            key, value = scalar(entry[1]), (entry[2] or "").strip()
            flow = re.fullmatch(r"\[(.*)\](?:\s+#.*)?", value)
            out[key] = [scalar(x) for x in re.findall(r"'[^']*'|\"[^\"]*\"|[^,\s][^,]*", flow[1])] if flow else scalar(value)
        else:
            raise ValueError(f"not understood: {line.strip()[:40]}")
    return out


def _section(name) -> str:
    return re.sub(r"[ _]?(?:set|videos)$", "", str(name).strip().lower())


def split_rows(content: dict) -> list[tuple[str, str, int]]:
    """(subset, stem, ord) of the entries of train, test and val sections, by any of their names; other keys are settings."""
    out = []
    for name, entries in content.items():
        words = _section(name)
        if words in SECTIONS and not isinstance(entries, list):
            raise ValueError(f"section {name} is no list")
        if words in SECTIONS:
            out += [(SECTIONS[words], re.sub(r"\.[^./]*$", "", str(x).strip().rsplit("/", 1)[-1]) if re.search(r"\.(?:mp4|avi|mov|mkv)$", str(x).strip(), re.I) else str(x).strip().rsplit("/", 1)[-1], k) for k, x in enumerate(entries)]
    return out


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, signature) of split files: canonical JSON of what each holds, and its SHA-256. Tasks read the files whole."""
    import json
    from collections.abc import Iterator

    import pandas as pd

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            content = [json.dumps(split_content(t, p.lower().endswith((".yaml", ".yml"))), sort_keys=True, separators=(",", ":"), default=str) for p, t in zip(pdf["path"], pdf["value"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "content": content})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(read, "path string, content string").withColumn("signature", F.sha2("content", 256))


def read_split(spark: SparkSession, path: str, need: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """(subset, stem, ord) of one split file, YAML or legacy text by its name. A section of ``need`` that is lacking is an error, as is one that is no list."""
    text = spark.read.text(path, wholetext=True).first()
    content = split_content(text.value if text else "", path.lower().endswith((".yaml", ".yml")))
    have = {SECTIONS.get(_section(name)) for name in content}
    if lacking := [n for n in need if n not in have]:
        raise ValueError(f"{path} has no section {', '.join(lacking)}")
    return spark.createDataFrame(split_rows(content), "subset string, stem string, ord int")


def resolve_splits(recorded: DataFrame, splits: DataFrame, column: str) -> DataFrame:
    """``recorded`` with ``<column>`` resolved to a signature of ``splits`` (path, signature): the same path, else that below the last folder ``splits/``; null if there is neither."""
    tail = lambda c: F.regexp_extract(c, "(?:^|/)splits/(.*)$", 1)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    known = splits.select(plain(F.col("path")).alias("split_at"), "signature")
    below = known.select(tail(F.col("split_at")).alias("split_tail"), "signature").where("split_tail <> ''").groupBy("split_tail").agg(F.min("signature").alias("by_tail"))
    out = recorded.join(known, plain(F.col(column)) == F.col("split_at"), "left").join(below, tail(F.col(column)) == F.col("split_tail"), "left")
    return out.select(*recorded.columns, F.coalesce("signature", "by_tail").alias(column.removesuffix("_path") + "_signature"))


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def first_existing(spark: SparkSession, folder: str, names: tuple[str, ...]) -> str:
    """The first of the names that ``folder`` has; a path that already ends in one of them is itself."""
    if folder.rstrip("/").endswith(names):
        return folder
    for name in names:
        if _exists(spark, f"{folder.rstrip('/')}/{name}"):
            return f"{folder.rstrip('/')}/{name}"
    raise ValueError(f"none of {', '.join(names)} in {folder}")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Frame predictions of a Parquet or CSV table, or of a folder that holds one as ``frame_predictions``; probabilities and labels as numbers."""
    if not path.lower().endswith((".csv", ".parquet")) and not _exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        path = first_existing(spark, path, ("frame_predictions.parquet", "frame_predictions.csv"))
    df = spark.read.csv(path, header=True) if path.lower().endswith(".csv") else spark.read.parquet(path)
    df = require(df.withColumnsRenamed({"__stem__": "stem", "__frame__": "frame"}), ["stem", "frame"], "predictions")
    kinds = {"prob": "double", "true": "int", "pred": "int"}
    typed = {c: F.col(c).try_cast("double").cast(kinds[c.split("_")[0]]) for c in df.columns if c.split("_")[0] in kinds}
    return df.withColumns({"frame": F.col("frame").cast("int"), **typed})


def infer_behaviors(predictions: DataFrame) -> list[str]:
    """The behaviours of ``prob_`` columns, sorted; none is an error."""
    found = sorted(c.removeprefix("prob_") for c in predictions.columns if c.startswith("prob_"))
    if not found:
        raise ValueError("no prob_<behavior> columns")
    return found


def unpivot_predictions(predictions: DataFrame) -> DataFrame:
    """(stem, frame, behavior, prob), a row for each behaviour of a frame."""
    names = infer_behaviors(predictions)
    return predictions.select("stem", "frame", *[F.col(f"prob_{b}").alias(b) for b in names]).unpivot(["stem", "frame"], names, "behavior", "prob")


def subset_predictions(predictions: DataFrame, stems: list[str] | None = None, behaviors: list[str] | None = None) -> DataFrame:
    """The rows of some videos and the columns of some behaviours; an unknown behaviour, or no row left, is an error."""
    if unknown := sorted(set(behaviors or []) - set(infer_behaviors(predictions))):
        raise ValueError(f"unknown behaviors {unknown}")
    out = predictions if stems is None else predictions.where(F.col("stem").isin(stems))
    if behaviors is not None:
        own = {f"{kind}_{b}" for kind in ("true", "prob", "pred") for b in behaviors}
        out = out.select(*[c for c in out.columns if c in own or not c.startswith(("true_", "prob_", "pred_"))])
    if out.isEmpty():
        raise ValueError("no predictions are left")
    return out


def time_axis(fps: float | None = None, frame: str = "frame"):
    """Seconds of a frame; without a frame rate, its number."""
    return F.col(frame).cast("double") if fps is None else F.col(frame) / F.lit(float(fps))


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a sweep that name a manifest or the keys of their split: of its results summary, else of its plan."""
    return sweep_rows(spark.read.csv(first_existing(spark, path, ("results_summary.csv", "experiment_plan.csv")), header=True))


def sweep_rows(df: DataFrame) -> DataFrame:
    require(df, ["outer_id", "inner_seed"], "sweep table")
    usable = [F.col(c).isNotNull() for c in ("manifest_path", "split_path") if c in df.columns]
    condition = usable[0] if usable else F.lit(True)
    for u in usable[1:]:
        condition = condition | u
    return df.where(condition)


def threshold_map_problems(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """S11's guard: keys that are repeated or whose threshold isn't a number between 0 and 1."""
    t = F.col("threshold").try_cast("double")
    bad = mapped.where(t.isNull() | F.isnan(t) | (t <= 0) | (t >= 1)).select(*keys, F.lit("threshold").alias("problem"))
    return bad.unionByName(mapped.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("repeated").alias("problem")))


def load_batch(rows: DataFrame, splits: DataFrame, label: str, behavior: str | None, checkpoint_policy: str, keys: tuple[str, ...] = ("outer_id", "inner_seed", "behavior", "subset", "level")) -> DataFrame:
    """The evaluated rows of a behaviour, those with an error text too, with their batch's label and policies, and signatures of what their two splits hold.

    ``splits``: (path, signature) as of :func:`read_splits`. No rows, repeated keys or a split that isn't found are errors.
    """
    from gaitline.operators.selection import duplicates, evaluated, threshold_policy
    from gaitline.operators.stages import kept

    rows = kept(evaluated(rows if behavior is None else rows.where(F.col("behavior") == behavior)), "batch")
    if rows.isEmpty():
        raise ValueError(f"batch {label} has no successful rows")
    if not duplicates(rows, [k for k in keys if k in rows.columns]).isEmpty():
        raise ValueError(f"batch {label} has repeated keys")
    for c in ("split_path", "val_split_path"):
        rows = resolve_splits(rows, splits, c)
    if not rows.where("split_signature is null or val_split_signature is null").isEmpty():
        raise ValueError(f"batch {label} names split files that are not there")
    return rows.withColumns({"batch": F.lit(label), "checkpoint_policy": F.lit(checkpoint_policy), "threshold_policy": threshold_policy()})


def batch_metadata(rows: DataFrame, config: dict) -> DataFrame:
    """A row for each batch of ``load_batch``: policies, subsets and levels, and how the episodes were matched, as its ``config`` says."""
    # Settings of an evaluation that say how episodes were matched.
    names = ("episode_matching_method", "episode_overlap_denominator", "threshold_selection_episode_matching_method", "threshold_selection_episode_overlap_denominator")
    found = rows.groupBy("batch", "checkpoint_policy", "threshold_policy").agg(F.sort_array(F.collect_set("subset")).alias("subset"), F.sort_array(F.collect_set("level")).alias("levels"))
    return found.withColumns({c: F.lit(config.get(c)).cast("string") for c in names})


def write_by_stem(df: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """A folder for each video. A video of up to ``rows_per_file`` rows is one file; a longer one is cut into
    ranges of frames of about that many rows, each written by its own task; only without frames it is one task's, file after file."""
    if "frame" not in df.columns:
        df.repartition("stem").write.option("maxRecordsPerFile", rows_per_file).partitionBy("stem").mode("overwrite").parquet(path)
        return
    sizes = df.groupBy("stem").agg(F.count(F.lit(1)).alias("__n"), F.min("frame").alias("__lo"), F.max("frame").alias("__hi")).where(F.col("__n") > rows_per_file)
    place = F.floor((F.col("frame") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1) * F.ceil(F.col("__n") / rows_per_file))
    cut = df.join(sizes, "stem", "left").withColumn("__part", F.coalesce(place, F.lit(0)).cast("int")).drop("__n", "__lo", "__hi")
    cut.repartition("stem", "__part").sortWithinPartitions("stem", "__part", "frame").drop("__part").write.option("maxRecordsPerFile", 2 * rows_per_file).partitionBy("stem").mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """S14, S17."""
    df.write.mode("overwrite").csv(path, header=True)


def write_frames(df: DataFrame, path: str, csv: bool = False) -> None:
    """Merged frame predictions in frame order, as Parquet and if wanted as CSV (T5)."""
    ordered = df.repartitionByRange("stem", "frame").sortWithinPartitions("stem", "frame")
    ordered.write.mode("overwrite").parquet(f"{path}/frames.parquet")
    if csv:
        ordered.write.mode("overwrite").csv(f"{path}/frames.csv", header=True)


def write_scalers(scalers: DataFrame, path: str) -> None:
    """S18."""
    scalers.write.mode("overwrite").parquet(path)


def missing_families(scalers: DataFrame, wanted: list[str]) -> DataFrame:
    """S18's guard: families without parameters; others are ignored."""
    names = scalers.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, wanted))).alias("family"))
    return names.join(scalers.select("family").distinct(), "family", "left_anti")


def read_scalers(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    if lost := [r.family for r in missing_families(rows, wanted).collect()]:
        raise ValueError(f"scaler families missing: {lost}")
    return rows.where(F.col("family").isin(wanted))


def union_of_columns(*parts: DataFrame) -> DataFrame:
    """All rows under all columns, by name, in the order of names."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def write_windows(windows: DataFrame, path: str) -> None:
    """Windows by subset."""
    windows.write.partitionBy("subset").mode("overwrite").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A run's one-row record as JSON."""
    summary.write.mode("overwrite").json(path)
