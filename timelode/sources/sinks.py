"""Writers of the engine's file formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def labels_csv(labels: DataFrame, path: str, overwrite: bool = False) -> None:
    """patient_id, prediction_time to the minute, value and label_type, in order; an existing target fails the write unless overwrite."""
    rows = labels.select("patient_id", F.date_format("prediction_time", "yyyy-MM-dd'T'HH:mm:00").alias("prediction_time"), F.col("value").cast("string").alias("value"), "label_type")
    rows.orderBy("patient_id", "prediction_time", "value").write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def save_best(model, params: dict, preds: DataFrame, folder: str) -> None:
    """A fitted head under folder: model (of pyspark.ml, or a table of weights), its predictions as Parquet, and last its parameters as JSON, which say that the rest is whole."""
    import json

    from timelode.operators.heads import Leafwise

    spark = preds.sparkSession
    if isinstance(model, Leafwise):
        trees = [(i, *map(list, (t.feature, t.cut, t.left, t.right, t.value)), model.model.base, [e.tolist() for e in model.model.edges]) for i, t in enumerate(model.model.trees)]
        model = spark.createDataFrame(trees, "tree int, feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>, base double, edges array<array<double>>")
    if isinstance(model, DataFrame):
        model.write.mode("overwrite").parquet(f"{folder}/model")
    else:
        model.write().overwrite().save(f"{folder}/model")
    preds.write.mode("overwrite").parquet(f"{folder}/predictions")
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string").coalesce(1).write.mode("overwrite").text(f"{folder}/params")


def best_params(spark: SparkSession, folder: str) -> dict | None:
    """The parameters of the model kept under folder; None where there is none."""
    import json

    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/params/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return None
    return json.loads(spark.read.text(f"{folder}/params").first()[0])


def save_if_better(model, params: dict, preds: DataFrame, folder: str, score: str = "auroc_val") -> bool:
    """Keep a model in place of the one under folder if its validation score is greater, or none is there; whether it was kept."""
    before = best_params(preds.sparkSession, folder)
    if before is not None and not params[score] > before[score]:
        return False
    save_best(model, params, preds, folder)
    return True


def document(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, in any store that Spark writes to; it is there whole or not at all."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.writing")
    out = files.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(target, False)
    if not files.rename(aside, target):
        raise OSError(f"{path} could not be written")


#: Tokens that a vocabulary document may have.
MOST_TOKENS = 1_000_000


def vocabulary_json(tokens: DataFrame, value: str, path: str) -> None:
    """token -> code or token -> description as one JSON document, tokens in order; a vocabulary of over MOST_TOKENS is refused."""
    import json

    rows = tokens.select("token", value).orderBy("token").limit(MOST_TOKENS + 1).collect()
    if len(rows) > MOST_TOKENS:
        raise ValueError(f"a vocabulary has at most {MOST_TOKENS} tokens")
    document(tokens.sparkSession, path, json.dumps({str(r[0]): r[1] for r in rows}, ensure_ascii=False, indent=0))


def upsert_results(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("labeling_function", "sub_task", "model", "head", "replicate", "k", "score")) -> DataFrame:
    """existing with rows of new in place of those of the same key: no duplicates, whatever is run again."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def unfinished(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """What of wanted has no result yet: resuming skips the rest."""
    return wanted.join(existing.select(*keys).distinct(), keys, "left_anti")


def meds_data(events: DataFrame) -> DataFrame:
    """Events in the MEDS data layout: a value that is a plain number is numeric, another one text."""
    from timelode.operators.labelers import number_of

    n = number_of(F.col("value"))
    return events.select(F.col("patient_id").alias("subject_id"), F.col("start_time").alias("time"), "code", n.cast("float").alias("numeric_value"), F.when(n.isNull(), F.col("value")).alias("text_value"), "unit", "omop_table")


def meds_codes(events: DataFrame, concepts: DataFrame) -> DataFrame:
    """Codes in use with their descriptions."""
    return events.select("code").distinct().join(concepts.select("code", "description"), "code", "left")


def meds_splits(splits: DataFrame) -> DataFrame:
    names = F.when(F.col("split") == "val", "tuning").when(F.col("split") == "test", "held_out").otherwise(F.col("split"))
    return splits.select(F.col("omop_person_id").alias("subject_id"), names.alias("split"))


def meds_labels(labels: DataFrame, value: Column | None = None) -> DataFrame:
    """Labels with one value column for each type, filled by label_type."""
    v, kind = F.col("value") if value is None else value, F.col("label_type")
    return labels.select(
        F.col("patient_id").alias("subject_id"), "prediction_time",
        F.when(kind == "boolean", v.cast("string").try_cast("boolean")).alias("boolean_value"), F.when(kind == "categorical", v.cast("string").try_cast("long")).alias("integer_value"),
        F.when(kind == "numerical", v.cast("string").try_cast("float")).alias("float_value"), F.lit(None).cast("string").alias("categorical_value"),
    )


#: What a data set's description says unless the caller names it; the version of the format is fixed.
DATASET = {"dataset_name": "timelines", "dataset_version": "1.0", "etl_name": "timelode", "etl_version": "1.0", "meds_version": "0.3.3"}


def write_meds(folder: str, data: DataFrame, codes: DataFrame, splits: DataFrame, labels: dict[str, DataFrame], shards: int | None = None, dataset: dict[str, str] = DATASET) -> None:
    """The whole layout under folder, with rows counted at the source and once more on the way back. (An Observation would count them on the write, but once a session has used one, Spark 4.1 can't serialize plans that pyspark.ml evaluates.)

    Events are dealt to shards by ranges of subjects, so that a subject's rows are in one shard, in the order of
    their times; metadata/shards says which subjects and how many rows each file has. metadata/dataset.json is
    written last, and so tells that the rest is whole.
    """
    import datetime
    import json

    spark = data.sparkSession
    dealt = data.repartitionByRange(*([shards] if shards else []), "subject_id").sortWithinPartitions("subject_id", "time")
    parts = {"data": dealt, "metadata/codes": codes, "metadata/subject_splits": splits} | {f"labels/{k}": v for k, v in labels.items()}
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        back = spark.read.parquet(f"{folder}/{name}")
        if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema] or back.count() != (data if name == "data" else df).count():
            raise ValueError(f"{name} did not survive its round trip")
    file = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file")
    manifest = spark.read.parquet(f"{folder}/data").groupBy(file).agg(F.min("subject_id").alias("first_subject"), F.max("subject_id").alias("last_subject"), F.countDistinct("subject_id").alias("n_subjects"), F.count(F.lit(1)).alias("n_rows"))
    manifest.write.mode("overwrite").parquet(f"{folder}/metadata/shards")
    document(spark, f"{folder}/metadata/dataset.json", json.dumps(dataset | {"created_at": str(datetime.datetime.now())}))
