"""Tables in and out: JSON lines, CSV, prediction folders, result tables, models, word lists."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.functions import lexicon
from penmark.operators.linear import LinearModel

CORPUS_SCHEMA = "doc_id bigint, text string, label int"
PREDICTION_SCHEMA = (
    "doc_id bigint, label int, predicted_label int, prediction_probability double,"
    " probability_class_0 double, probability_class_1 double"
)
CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with a declared schema, so there is no inference pass."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, multi_line: bool = False) -> DataFrame:
    """CSV with a header row; the schema's columns are taken by name, whatever their order, and a name
    that the header lacks is an error.  A value that does not fit its type is null.  ``multi_line``
    allows line breaks inside quoted fields; such files cannot be split, so keep it off for large
    single files."""
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    raw = reader.csv(path)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in declared.fields])


def config_slug(variant: str | Column, classifier: str | Column) -> Column:
    """Configuration name as a file name: blanks of the variant become ``_``, brackets and blanks
    of the classifier are dropped."""
    v = F.lit(variant) if isinstance(variant, str) else variant
    c = F.lit(classifier) if isinstance(classifier, str) else classifier
    return F.concat(F.translate(v, " ", "_"), F.lit("_"), F.translate(c, " ()", ""))


def slug(variant: str, classifier: str) -> str:
    """``config_slug`` for one name on the driver (model folders)."""
    return f"{variant.replace(' ', '_')}_{re.sub('[ ()]', '', classifier)}"


def write_predictions(df: DataFrame, path: str) -> None:
    """One partition folder per configuration.  The rebalance brings a configuration's rows
    together for few files, and adaptive execution splits one that is too large for a task."""
    df.hint("rebalance", "variant", "classifier").write.partitionBy("variant", "classifier").mode("overwrite").json(path)


def read_predictions(
    spark: SparkSession, path: str, models: Sequence[tuple[str, str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(predictions, problems) from a folder written by ``write_predictions``.

    Only the requested configurations' folders are read.  A configuration with a line that is
    no JSON or lacks the label or the probability is left out as a whole and reported, as is
    a requested configuration without any file; the others are returned."""
    schema = T.StructType.fromDDL(f"{PREDICTION_SCHEMA}, variant string, classifier string, {CORRUPT} string")
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    wanted = None
    if models is not None:
        wanted = F.broadcast(spark.createDataFrame(list(models), "variant string, classifier string"))
        # Literals, so that the scan lists and opens these folders alone.
        named = [(F.col("variant") == v) & (F.col("classifier") == c) for v, c in models]
        raw = raw.where(reduce(Column.__or__, named, F.lit(False)))
    per_config = raw.groupBy("variant", "classifier").agg(
        F.count_if(F.col(CORRUPT).isNotNull()).alias("bad_json"),
        F.count_if(F.col(CORRUPT).isNull() & (F.col("label").isNull() | F.col("prediction_probability").isNull())).alias(
            "missing_key"
        ),
    )
    found = per_config.withColumn(
        "problem",
        F.when(F.col("bad_json") > 0, F.lit("bad json")).when(F.col("missing_key") > 0, F.lit("missing key")),
    ).select("variant", "classifier", "problem")
    problems = found.where("problem IS NOT NULL")
    if wanted is not None:
        missing = wanted.join(found, ["variant", "classifier"], "left_anti").withColumn("problem", F.lit("missing file"))
        problems = problems.unionByName(missing)
    # One row per configuration on the filter side.
    good = F.broadcast(found.where("problem IS NULL").drop("problem"))
    preds = raw.join(good, ["variant", "classifier"], "left_semi").drop(CORRUPT)
    return preds.withColumn("model", config_slug(F.col("variant"), F.col("classifier"))), problems


PREDICTION_FILE = "_predictions.jsonl"


def read_prediction_files(spark: SparkSession, path: str, models: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, problems) from one ``<slug>_predictions.jsonl`` per configuration in one folder.

    ``model`` comes from the file name.  As in ``read_predictions``, a file with a broken line or a row
    without label or probability is left out as a whole and reported, as is a requested model without a
    file (``models`` None: all files that are there)."""
    schema = T.StructType.fromDDL(f"{PREDICTION_SCHEMA}, {CORRUPT} string")
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    raw = reader.option("pathGlobFilter", f"*{PREDICTION_FILE}").json(path)
    name = F.regexp_extract("_metadata.file_name", f"^(.*){re.escape(PREDICTION_FILE)}$", 1)
    raw = raw.select("*", name.alias("model"))
    broken = F.col(CORRUPT).isNotNull()
    lacking = ~broken & (F.col("label").isNull() | F.col("prediction_probability").isNull())
    found = raw.groupBy("model").agg(F.count_if(broken).alias("bad_json"), F.count_if(lacking).alias("missing_key"))
    problem = F.when(F.col("bad_json") > 0, F.lit("bad json")).when(F.col("missing_key") > 0, F.lit("missing key"))
    found = found.select("model", problem.alias("problem"))
    problems = found.where("problem IS NOT NULL")
    good = found.where("problem IS NULL").select("model")
    if models is not None:
        wanted = F.broadcast(spark.createDataFrame([(m,) for m in models], "model string"))
        missing = wanted.join(found, "model", "left_anti").withColumn("problem", F.lit("missing file"))
        problems = problems.join(wanted, "model", "left_semi").unionByName(missing)
        good = good.join(wanted, "model", "left_semi")
    return raw.join(F.broadcast(good), "model", "left_semi").drop(CORRUPT), problems


def write_results(results: DataFrame, path: str) -> None:
    """The result table (one row per configuration) as JSON lines and as CSV with a header;
    nested columns become JSON text in the CSV."""
    one = results.coalesce(1)
    one.write.mode("overwrite").json(f"{path}/jsonl")
    nested = {
        f.name: F.to_json(F.col(f"`{f.name}`"))
        for f in results.schema.fields
        if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))
    }
    one.withColumns(nested).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")


LINEAR = "linear"


def save_models(models: Mapping[tuple[str, str], Model | LinearModel], path: str) -> None:
    for (variant, classifier), model in models.items():
        folder = f"{path}/{slug(variant, classifier)}"
        if isinstance(model, LinearModel):
            model.save(SparkSession.getActiveSession(), f"{folder}/{LINEAR}")
        else:
            model.write().overwrite().save(folder)


def load_model(path: str, variant: str, classifier: str) -> Model | LinearModel:
    spark = SparkSession.getActiveSession()
    folder = f"{path}/{slug(variant, classifier)}"
    linear = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{LINEAR}")
    if linear.getFileSystem(spark._jsc.hadoopConfiguration()).exists(linear):
        return LinearModel.load(spark, f"{folder}/{LINEAR}")
    return DefaultParamsReader.loadParamsInstance(folder, spark)


def word_list(spark: SparkSession, name: str) -> DataFrame:
    """Built-in list as ``(word, tag)``: ``closed_class``, ``function_words`` or ``connectors``."""
    rows = {
        "closed_class": [(w, tag) for tag, ws in lexicon.CLOSED_CLASS.items() for w in ws],
        "function_words": [(w, "STOP") for w in lexicon.FUNCTION_WORDS],
        "connectors": [(w, "CONNECTOR") for w in lexicon.CONNECTORS],
    }[name]
    return spark.createDataFrame(rows, "word string, tag string")


def read_phrases(spark: SparkSession, path: str, column: str = "CONECTOR") -> list[str]:
    """Connector phrases from a CSV, by the name of their column."""
    rows = read_csv(spark, path, f"`{column}` string").where(F.col(f"`{column}`").isNotNull()).distinct()
    return sorted(r[0] for r in rows.collect())
