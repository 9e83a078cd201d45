"""From sources to rows of the target store and of the array sidecar.

Each lowering gives a Lowered: DataFrames of target tables and of sidecar records. Records carry a column violation, the
first rule they break or null; what to do about it (refuse, or keep the source as it is) is the caller's choice.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CAPABILITY, SHAPE, Unsupported
from ..functions import values as v
from ..schemas import DEFAULTS, ENGINE, LOOSE_REQUIRED, SIDECAR, TABLES
from ..sources import documents, sqlite_ro
from .relational import lookup_last, project_onto

ARRAYS = ["y_true", "y_pred", "y_proba", "sample_indices", "weights"]
INT32 = 2**31


@dataclass
class Lowered:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    records: DataFrame | None = None


def first_violation(**rules: Column) -> Column:
    """The name of the first rule that holds; a rule that is null does not."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()))


def _beyond_int(items: Column) -> Column:
    return F.exists(items, lambda x: (x >= INT32) | (x < -INT32))


def _as_sidecar(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SIDECAR.fields), "violation")


def default_columns(table: str, now: str) -> dict[str, Column]:
    return {c: F.lit(now if d == "now" else d) for c, d in DEFAULTS[table].items()}


def violations_of(records: DataFrame) -> dict[str, int]:
    """How many records break each rule; a row for each rule."""
    return {r[0]: r[1] for r in records.where("violation is not null").groupBy("violation").count().orderBy("violation").collect()}


def told(broken: dict[str, int]) -> list[str]:
    return [f"{rule} in {n} record(s)" for rule, n in broken.items()]


# ---- SQLite store with JSON arrays ------------------------------------------------------------------------------------


def array_records(rows: DataFrame) -> DataFrame:
    """Sidecar records of rows with JSON text arrays and, where known, their prediction's columns."""
    have = set(rows.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    cells = {c: text(c) for c in ARRAYS}
    found = {c: v.decode_array(cells[c]) for c in ARRAYS}
    checked = rows.select(
        F.col("prediction_id"),
        *(v.or_default(text(c), d).alias(c) for c, d in (("dataset_name", "unknown"), ("model_name", ""), ("fold_id", ""), ("partition", ""), ("metric", ""), ("task_type", ""))),
        (F.expr("try_cast(val_score as double)") if "val_score" in have else F.lit(None).cast("double")).alias("val_score"),
        *(found[c].alias(c) for c in ARRAYS),
        v.array_shape(cells["y_proba"]).alias("y_proba_shape"),
        F.lit(None).cast("string").alias("sample_metadata"),
        v.ragged(cells["y_proba"]).alias("ragged"),
        F.coalesce(*(F.when(v.decode_failed(cells[c], found[c]), F.lit(c)) for c in ARRAYS)).alias("undecoded"),
    )
    violation = first_violation(
        array_not_decoded=F.col("undecoded").isNotNull(),
        lengths_differ=~v.lengths_agree(F.col("sample_indices"), F.col("y_true"), F.col("y_pred"), F.col("weights")),
        not_finite=v.nonfinite_field(**{c: F.col(c) for c in ARRAYS}, val_score=F.array("val_score")).isNotNull(),
        index_out_of_range=_beyond_int(F.col("sample_indices")),
    )
    checked = checked.withColumn("violation", violation)
    return _as_sidecar(checked.withColumn("sample_indices", F.when(F.col("violation").isNull(), F.col("sample_indices"))))


def legacy_rows(spark: SparkSession, path: str) -> DataFrame:
    """Array rows with the columns of their predictions, the last row of an id counting, in order of prediction_id."""
    con = sqlite_ro.connect(path)
    try:
        have = dict.fromkeys(c for c, _ in sqlite_ro.columns(con, "prediction_arrays"))
        meta = [c for c, _ in sqlite_ro.columns(con, "predictions")]
    finally:
        con.close()
    wanted = [c for c in ("prediction_id", *ARRAYS) if c in have]
    rows = sqlite_ro.load(spark, path, "prediction_arrays", wanted).select(*wanted)
    details = [c for c in ("dataset_name", "model_name", "fold_id", "partition", "metric", "val_score", "task_type") if c in meta]
    if "prediction_id" in meta and details:
        rows = lookup_last(rows, sqlite_ro.load(spark, path, "predictions", ["prediction_id", *details]), "prediction_id", "_ordinal", details)
    return rows.orderBy("prediction_id")


def preserved_lines(rows: DataFrame) -> DataFrame:
    """(prediction_id, value): the rows as canonical JSON lines, each with the columns that its source has."""
    columns = [F.col(c) for c in rows.columns]
    return rows.select("prediction_id", v.canonical_json(*columns).alias("value"))


def lower_store(spark: SparkSession, path: str, now: str) -> Lowered:
    con = sqlite_ro.connect(path)
    try:
        names = sqlite_ro.tables(con)
    finally:
        con.close()
    out = {}
    for table, schema in TABLES.items():
        if table in names:
            out[table] = project_onto(sqlite_ro.load(spark, path, table).drop("_ordinal"), schema, default_columns(table, now))
    return Lowered(out, array_records(legacy_rows(spark, path)) if "prediction_arrays" in names else None)


# ---- loose JSON records ------------------------------------------------------------------------------------------------

_LOOSE = T.StructType(
    [T.StructField(c, T.StringType()) for c in LOOSE_REQUIRED[:10]]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("sample_indices", "y_true", "y_pred", "y_proba", "weights")]
    + [T.StructField(c, T.DoubleType()) for c in ("val_score", "test_score", "train_score")]
    + [T.StructField("preprocessing", T.ArrayType(T.StringType()))]
)


def loose_rows(files: DataFrame) -> DataFrame:
    """One validated row for each (prediction_file, text): the record's fields, scores as JSON, and violation."""
    rows = files.select("prediction_file", "text", F.from_json(v.quoted_nonfinite(F.col("text")), _LOOSE).alias("r"), F.expr("try_parse_json(text)").alias("j"), F.json_object_keys("text").alias("keys"))
    kind = lambda c: F.expr(f"schema_of_variant(try_variant_get(j, '$.{c}', 'variant'))")
    texts, arrays = LOOSE_REQUIRED[:10], ("sample_indices", "y_true", "y_pred")
    r = F.col("r")
    # items may be texts and Booleans that are numbers; lists within lists are not
    lists = {c: F.transform(r[c], lambda x: v.number(x)) for c in ("sample_indices", "y_true", "y_pred", "y_proba", "weights")}
    violation = first_violation(
        not_finite=v.nonfinite_field(**lists, scores=F.array(r["val_score"], r["test_score"], r["train_score"])).isNotNull(),
        not_an_object=F.col("keys").isNull(),  # keys are null for bare NaN too, so that rule comes first
        field_missing=F.size(F.array_except(F.array(*map(F.lit, LOOSE_REQUIRED)), "keys")) > 0,
        not_readable=F.col("j").isNull(),
        text_empty_or_of_other_type=F.exists(F.array(*(F.coalesce((kind(c) != "STRING") | (r[c] == ""), F.lit(True)) for c in texts)), lambda x: x),
        array_empty_or_of_other_type=F.exists(F.array(*(F.coalesce(F.size(r[c]) == 0, F.lit(True)) | F.exists(lists[c], lambda x: x.isNull()) for c in arrays)), lambda x: x),
        optional_array_of_other_type=F.exists(F.array(*(F.coalesce(~kind(c).isin("VOID") & (r[c].isNull() | F.exists(lists[c], lambda x: x.isNull())), F.lit(False)) for c in ("y_proba", "weights"))), lambda x: x),
        score_of_other_type=F.exists(F.array(*(F.coalesce(~kind(c).isin("VOID") & r[c].isNull(), F.lit(False)) for c in ("val_score", "test_score", "train_score"))), lambda x: x),
        lengths_differ=~v.lengths_agree(lists["sample_indices"], lists["y_true"], lists["y_pred"], v.null_if_empty(lists["weights"])),
        index_out_of_range=_beyond_int(lists["sample_indices"]),
    )
    scores = F.when(kind("scores").startswith("OBJECT"), v.canonical_text(F.get_json_object("text", "$.scores"))).otherwise(F.lit("{}"))
    out = rows.withColumn("violation", violation).withColumn("scores", scores)
    plain = [r[f.name].alias(f.name) for f in _LOOSE if f.name not in lists]
    return out.select("prediction_file", *plain, *(x.alias(c) for c, x in lists.items()), "scores", "violation").withColumn("preprocessing", F.coalesce("preprocessing", F.array().cast("array<string>")))


def lower_loose(rows: DataFrame, now: str) -> Lowered:
    """Rows of loose_rows(), one or many, as store tables and records.

    Runs, pipelines and chains that several share are kept once, as the first file by name has them. A prediction_id that
    several records have is a violation of all but that of the first file.
    """
    number = F.row_number().over(Window.partitionBy("prediction_id").orderBy(F.col("violation").isNotNull(), "prediction_file"))
    again = F.col("violation").isNull() & (number > 1)
    rows = rows.withColumn("violation", F.when(again, F.lit("prediction_id_repeated")).otherwise(F.col("violation")))
    good = rows.where("violation is null")
    chain = v.stable_id("chain", *(F.col(c) for c in ("run_id", "pipeline_id", "model_class", "model_name")))
    config = F.concat(F.lit('{"prediction_file":'), F.to_json(F.array("prediction_file")).substr(F.lit(2), F.char_length(F.to_json(F.array("prediction_file"))) - 2), F.lit(',"source_kind":"loose-predictions"}'))
    base = good.withColumn("chain_id", chain).withColumn("config", config).withColumnRenamed("dataset", "dataset_name")
    done = F.lit("completed")
    runs = base.select("prediction_file", "run_id", F.concat(F.lit("loose-predictions "), "run_id").alias("name"), "config", F.to_json(F.array("dataset_name")).alias("datasets"), done.alias("status"), F.lit('{"loose_predictions_preview_version":1}').alias("summary"))
    pipelines = base.select("prediction_file", "pipeline_id", "run_id", F.col("pipeline_id").alias("name"), F.col("config").alias("expanded_config"), F.lit("[]").alias("generator_choices"), "dataset_name", done.alias("status"), F.col("val_score").alias("best_val"), F.col("test_score").alias("best_test"), "metric")
    steps = F.to_json(F.concat("preprocessing", F.array("model_class")))
    chains = base.select("prediction_file", "chain_id", "pipeline_id", steps.alias("steps"), F.size("preprocessing").alias("model_step_idx"), "model_class", F.array_join("preprocessing", ", ").alias("preprocessings"), "model_name", "metric", "task_type", "dataset_name")
    scope = [F.lit("loose-predictions").alias("prediction_scope"), F.lit("prediction-row").alias("prediction_level")]
    predictions = base.select(
        "prediction_file", "prediction_id", "pipeline_id", "chain_id", "dataset_name", "model_name", "model_class", "fold_id", "partition", "val_score", "test_score", "train_score", "metric", "task_type",
        F.size("sample_indices").alias("n_samples"), "scores", *scope,
    )
    made = {"runs": (runs, "run_id"), "pipelines": (pipelines, "pipeline_id"), "chains": (chains, "chain_id"), "predictions": (predictions, "prediction_id")}
    once = lambda df, key: df.groupBy(key).agg(F.min(F.struct("prediction_file", *(c for c in df.columns if c not in (key, "prediction_file")))).alias("x")).select(key, "x.*")
    tables = {t: project_onto(once(df, key), TABLES[t], default_columns(t, now)) for t, (df, key) in made.items()}
    records = rows.select(
        "prediction_id", F.col("dataset").alias("dataset_name"), "model_name", "fold_id", "partition", "metric", "val_score", "task_type", "y_true", "y_pred",
        v.null_if_empty(F.col("y_proba")).alias("y_proba"), F.when(F.size("y_proba") > 0, F.array(F.size("y_proba"))).alias("y_proba_shape"),
        F.when(F.col("violation").isNull(), F.col("sample_indices")).alias("sample_indices"), v.null_if_empty(F.col("weights")).alias("weights"), F.lit(None).cast("string").alias("sample_metadata"), "violation",
    )
    return Lowered(tables, _as_sidecar(records))


def read_loose(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    """loose_rows() of files below root."""
    texts = []
    for f in files:
        try:
            with open(os.path.join(root, f), encoding="utf-8") as h:
                texts.append((f, h.read()))
        except (OSError, ValueError) as e:
            raise Unsupported(f"{f} cannot be read", SHAPE) from e
    return loose_rows(spark.createDataFrame(texts, "prediction_file string, text string"))


# ---- a legacy run with its manifest -------------------------------------------------------------------------------------


def legacy_run(root: str, runs: str, loose_files: list[str] | None) -> tuple[dict[str, Any], str, str]:
    """(manifest, its path, the prediction file's path) of the single run below runs, with all checks of paths."""
    base = os.path.join(root, runs)
    found = sorted(os.path.join(base, a, b, "manifest.yaml") for a in os.listdir(base) if os.path.isdir(os.path.join(base, a)) for b in os.listdir(os.path.join(base, a)) if os.path.isfile(os.path.join(base, a, b, "manifest.yaml")))
    if len(found) != 1:
        raise Unsupported(f"one run manifest is supported, there are {len(found)}", CAPABILITY)
    with open(found[0], encoding="utf-8") as f:
        manifest = documents.run_manifest(f.read())
    name = (manifest.get("predictions") or {}).get("file")
    if not name or os.path.isabs(name):
        raise Unsupported("the run manifest names no usable prediction file", SHAPE)
    top = os.path.realpath(root)
    target = os.path.realpath(os.path.join(os.path.dirname(found[0]), name))
    if os.path.commonpath([top, target]) != top or not os.path.isfile(target) or not target.endswith("_predictions.json"):
        raise Unsupported("the prediction file is outside the source, missing or of another name", SHAPE)
    rel = os.path.relpath(target, top)
    if loose_files is not None and [f for f in sorted(loose_files) if f.endswith("_predictions.json")] != [rel]:
        raise Unsupported("there are other prediction files than the one that the manifest names", CAPABILITY)
    return manifest, os.path.relpath(found[0], root), rel


def disagreement(rows: DataFrame, manifest: dict[str, Any]) -> list[str]:
    """The fields, sorted, in which a record and its run manifest differ; an incomplete manifest is refused."""
    model = manifest.get("model") or {}
    wanted = {"run_id": manifest.get("run_id"), "pipeline_id": manifest.get("pipeline_id"), "dataset": manifest.get("dataset"), "model_class": model.get("class"), "model_name": model.get("name")}
    if not all(isinstance(x, str) and x for x in wanted.values()) or manifest.get("status") != "completed":
        raise Unsupported("the run manifest lacks fields or the run is not completed", SHAPE)
    steps = F.array(*map(F.lit, manifest.get("preprocessing") or [])).cast("array<string>")
    names = [F.when(~F.col(c).eqNullSafe(F.lit(x)), F.lit(c)) for c, x in wanted.items()] + [F.when(F.col("preprocessing") != steps, F.lit("preprocessing"))]
    return rows.select(F.array_sort(F.array_compact(F.array(*names)))).first()[0]


# ---- native results -------------------------------------------------------------------------------------------------------


def native_manifest(folder: str) -> tuple[dict[str, Any], str]:
    """(manifest, path of the prediction rows) after the checks that need no rows."""
    manifest = documents.json_object(os.path.join(folder, "manifest.json"), "manifest.json")
    lacking = [k for k in ("schema_version", "run_id", "engine", "score_set_hash") if k not in manifest]
    if lacking or manifest.get("engine") != ENGINE or not isinstance(manifest["run_id"], str) or not manifest["run_id"]:
        raise Unsupported("the native manifest lacks fields or is of another engine", SHAPE)
    name = documents.relative_file(manifest, "score_set", "score_set.json")
    score_set = documents.json_object(os.path.join(folder, name), name)
    try:
        text = v.canonical(score_set, False)
    except ValueError as e:
        raise Unsupported("the score set holds numbers that are not finite", SHAPE) from e
    if hashlib.sha256(text.encode()).hexdigest() != manifest["score_set_hash"]:
        raise Unsupported("the score set does not have the hash that the manifest says", SHAPE)
    return manifest, os.path.join(folder, documents.relative_file(manifest, "predictions", "predictions.parquet"))


def _texts(items: Any) -> list[str]:
    return [str(x) for x in items if x is not None and str(x)] if isinstance(items, list) else []


def _said(x: Any) -> Column:
    """A manifest's value as a text column: the first usable one of a list."""
    return F.lit(next((str(i) for i in (x if isinstance(x, list) else [x]) if i not in (None, "")), None)).cast("string")


def lower_native(rows: DataFrame, manifest: dict[str, Any], now: str) -> Lowered:
    """Rows of native_rows() as store tables and records."""
    run_id, created = manifest["run_id"], manifest.get("created_at")
    spark = rows.sparkSession
    run = F.lit(run_id)
    named = rows.select(
        "*",
        v.first_filled(F.col("dataset"), default="unknown").alias("d"),
        v.first_filled(F.col("config_name"), F.col("variant_id"), default="native").alias("c"),
        v.first_filled(F.col("model_name"), default="unknown").alias("m"),
        v.first_filled(F.col("metric"), _said(manifest.get("metric")), default="unknown").alias("me"),
        v.first_filled(F.col("task_type"), _said(manifest.get("task_type")), default="unknown").alias("tt"),
        v.first_filled(F.col("partition"), default="unknown").alias("pa"),
        v.first_filled(F.col("fold_id")).alias("fo"),
    )
    named = named.withColumn("vi", v.first_filled(F.col("variant_id"), F.col("c")))
    named = named.withColumn("pipeline_id", v.stable_id("pipeline", run, F.col("d"), F.col("c"))).withColumn("chain_id", v.stable_id("chain", run, F.col("d"), F.col("c"), F.col("m")))

    @F.udf("string", useArrow=True)
    def prediction_id(index: int, *parts: str) -> str:
        return "prediction-" + hashlib.sha256(v.canonical([run_id, index, *parts], False).encode()).hexdigest()[:24]

    named = named.withColumn("prediction_id", prediction_id("_row", "d", "c", "m", "partition", "fold_id", "refit_context"))
    replay = manifest.get("stacking_replay")
    replay = v.canonical(replay, False) if isinstance(replay, dict) else None
    lit = lambda x, k="string": F.lit(x).cast(k)

    def first(key: str, **cols: Column) -> DataFrame:
        """Columns of each key's first row. The rows' numbers are grouped alone, which takes no sort; few rows are then left."""
        least = named.groupBy(key).agg(F.min("_row").alias("_row"))
        few = named.join(least, [key, "_row"], "left_semi")
        return few.groupBy(key).agg(F.min_by(F.struct(*(c.alias(n) for n, c in cols.items())), "_row").alias("x")).select(key, "x.*")

    config = F.concat(F.lit('{"config_name":'), F.expr("substring(to_json(array(c)), 2, char_length(to_json(array(c))) - 2)"), F.lit(',"variant_id":'), F.expr("substring(to_json(array(vi)), 2, char_length(to_json(array(vi))) - 2)"), F.lit("}"))
    pipelines = first("pipeline_id", run_id=run, name=F.col("c"), expanded_config=config, generator_choices=F.lit("[]"), dataset_name=F.col("d"), status=F.lit("completed"), created_at=lit(created), completed_at=lit(created), best_val=F.col("val_score"), best_test=F.col("test_score"), metric=F.col("me"))
    fingerprint = F.sha2(lit(replay), 256)
    chains = first(
        "chain_id", pipeline_id=F.col("pipeline_id"), steps=F.lit("[]"), model_step_idx=F.lit(0), model_class=F.col("m"), preprocessings=F.lit(""), model_name=F.col("m"), metric=F.col("me"),
        task_type=F.col("tt"), dataset_name=F.col("d"), relation_replay_manifest=lit(replay), relation_replay_version=lit(1 if replay else None, "long"), relation_replay_fingerprint=fingerprint,
    )
    predictions = named.select(
        "prediction_id", "pipeline_id", "chain_id", F.col("d").alias("dataset_name"), F.col("m").alias("model_name"), F.col("m").alias("model_class"), F.col("fo").alias("fold_id"), F.col("pa").alias("partition"),
        "val_score", "test_score", "train_score", F.col("me").alias("metric"), F.col("tt").alias("task_type"), v.sample_count(F.col("sample_indices"), F.col("y_pred_shape")).alias("n_samples"),
        F.coalesce("scores", F.lit("{}")).alias("scores"), F.col("vi").alias("branch_name"), F.nullif(v.first_filled(F.col("refit_context")), F.lit("")).alias("refit_context"),
        F.lit("native-results-v1").alias("prediction_scope"), F.lit("prediction-row").alias("prediction_level"),
    )
    datasets = _texts(manifest.get("datasets"))
    listed = F.lit(v.canonical(datasets, False)) if datasets else F.to_json(F.array_sort(F.collect_set(F.nullif("dataset", F.lit("")))))
    summary = {
        "native_results_preview_version": 1, "source_kind": "native-results-v1", "plan_id": manifest.get("plan_id"), "bundle_id": manifest.get("bundle_id"), "score_set_hash": manifest.get("score_set_hash"),
        "producer_nodes": manifest.get("producer_nodes", []), "final_producer_nodes": manifest.get("final_producer_nodes", []), "stacking_replay_present": "stacking_replay" in manifest,
    }
    runs = rows.agg(listed.alias("datasets") if not datasets else F.max(listed).alias("datasets")).select(
        run.alias("run_id"), F.lit(f"native-results {run_id}").alias("name"), F.lit(v.canonical({"engine": manifest["engine"], "schema_version": manifest["schema_version"]}, False)).alias("config"),
        "datasets", F.lit("completed").alias("status"), lit(created).alias("created_at"), lit(created).alias("completed_at"), F.lit(v.canonical(summary, False)).alias("summary"),
    )
    made = {"runs": runs, "pipelines": pipelines, "chains": chains, "predictions": predictions, "artifacts": _artifacts(spark, manifest)}
    tables = {t: project_onto(df, TABLES[t], default_columns(t, now)) for t, df in made.items()}
    present = named.where(~F.col("arrays_present").eqNullSafe(F.lit(False)))
    records = present.select(
        "prediction_id", F.col("d").alias("dataset_name"), F.col("m").alias("model_name"), F.col("fo").alias("fold_id"), F.col("pa").alias("partition"), F.col("me").alias("metric"), "val_score", F.col("tt").alias("task_type"),
        "y_true", "y_pred", v.null_if_empty(F.col("y_proba")).alias("y_proba"), v.null_if_empty(F.col("y_proba_shape")).alias("y_proba_shape"), v.null_if_empty(F.col("sample_indices")).alias("sample_indices"),
        v.null_if_empty(F.col("weights")).alias("weights"), F.lit(None).cast("string").alias("sample_metadata"), "y_true_shape", "y_pred_shape",
    )
    violation = first_violation(
        rank_above_one=(F.size("y_true_shape") > 1) | (F.size("y_pred_shape") > 1),
        not_finite=v.nonfinite_field(y_true=F.col("y_true"), y_pred=F.col("y_pred"), y_proba=F.col("y_proba"), weights=F.col("weights"), val_score=F.array("val_score")).isNotNull(),
        index_out_of_range=_beyond_int(F.col("sample_indices")),
    )
    records = records.withColumn("violation", violation)
    safe = records.withColumn("sample_indices", F.when(F.col("violation").isNull(), F.col("sample_indices")))
    return Lowered(tables, _as_sidecar(safe))


def _artifacts(spark: SparkSession, manifest: dict[str, Any]) -> DataFrame:
    """Artifact rows of a manifest; the first row of an id stays."""
    items = manifest.get("artifacts")
    rows = [(i, json.dumps(a)) for i, a in enumerate(items if isinstance(items, list) else []) if isinstance(a, dict)]
    fields = "artifact_id string, uri string, content_fingerprint string, producer_node string, kind string, backend string, size_bytes long"
    a = spark.createDataFrame(rows, "i int, j string").select("i", F.from_json("j", fields).alias("a")).select("i", "a.*")

    @F.udf("string", useArrow=True)
    def fallback(i: int) -> str:
        return "artifact-" + hashlib.sha256(v.canonical([manifest["run_id"], i], False).encode()).hexdigest()[:24]

    a = a.withColumn("artifact_id", F.coalesce(F.nullif("artifact_id", F.lit("")), fallback("i"))).withColumn("uri", F.coalesce("uri", F.lit("")))
    given = F.when(F.col("content_fingerprint") != "", v.prefixed(F.col("content_fingerprint")))
    a = a.withColumn("content_hash", F.coalesce(given, v.stable_id("sha256", F.col("artifact_id"), F.col("uri"))))
    kept = a.withColumn("n", F.row_number().over(Window.partitionBy("artifact_id").orderBy("i"))).where("n = 1")
    return kept.select("artifact_id", F.col("uri").alias("artifact_path"), "content_hash", F.col("producer_node").alias("operator_class"), F.col("kind").alias("artifact_type"), v.or_default(F.col("backend"), "joblib").alias("format"), "size_bytes")
