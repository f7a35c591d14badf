"""Readers and writers of the corpus' files: JSON lines, JSON arrays, CSV, Parquet.

A raw line is nested (with candidates) or already flat; unknown keys are dropped, missing ones take defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _struct(fields: str) -> T.StructType:
    """A struct from "name type, ..."; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


PROBLEM = _struct(
    "record_id string, problem string, gold_answer string, gold_solution string, dataset string, dataset_split string, difficulty string, subject string, "
    "source_idx int, has_extended_thinking boolean, generation_date string"
)
CANDIDATE = _struct(
    "candidate_id string, model string, temperature double, reasoning_effort string, generation_seed int, input_tokens int, thinking_tokens int, "
    "output_tokens int, total_cost_usd double, generation_timestamp string, thinking_text string, response_text string, full_text string, thinking_source string, "
    "answer_correct boolean, answer_match_method string, approach_in_response string, approach_in_thinking string, approach_matches_gold boolean, approach_judge string, "
    "type_b_mechanism string, human_error_step int, hardness_score double, generation_error string, was_retried boolean, blackhole_detected boolean"
)
DEFAULTS = {
    "dataset_split": "test", "subject": "other", "source_idx": -1, "has_extended_thinking": False, "temperature": 0.0, "generation_seed": 0, "input_tokens": 0,
    "thinking_tokens": 0, "output_tokens": 0, "total_cost_usd": 0.0, "was_retried": False, "blackhole_detected": False, "candidate_id": "", "model": "",
    "thinking_text": "", "response_text": "", "full_text": "", "gold_answer": "", "gold_solution": "", "problem": "", "dataset": "",
}


def raw_schema() -> T.StructType:
    nested = T.StructField("candidates", T.ArrayType(CANDIDATE))
    return T.StructType([*PROBLEM.fields, nested, *CANDIDATE.fields])


def with_defaults(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in df.columns])


def flatten(raw: DataFrame) -> DataFrame:
    """One row for each candidate: nested lines exploded with their problem's fields, flat lines as they are."""
    problem = [f.name for f in PROBLEM.fields]
    nested = raw.where("candidates is not null").select(*problem, F.inline("candidates"))
    flat = raw.where("candidates is null").select(*problem, *[f.name for f in CANDIDATE.fields])
    return with_defaults(nested.unionByName(flat))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, nested or flat, blank lines skipped."""
    return flatten(spark.read.schema(raw_schema()).json(path))


def stream_candidates(spark: SparkSession, path: str) -> DataFrame:
    """The same over files as they arrive; flat lines become a candidate of their own, so no union is needed."""
    raw = spark.readStream.schema(raw_schema()).json(path)
    own = F.array(F.struct(*[F.col(f.name) for f in CANDIDATE.fields]))
    return with_defaults(raw.select(*[f.name for f in PROBLEM.fields], F.inline(F.coalesce("candidates", own))))


def read_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array file of structs."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """By suffix: .parquet, .csv, .json (an array) or JSON lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith(".parquet"):
        return reader.parquet(path)
    if path.endswith(".csv"):
        return reader.option("header", True).csv(path)
    return reader.option("multiLine", path.endswith(".json")).json(path)


SCORES = "model string, key string, gpu string, qwen_caveat boolean, minutes double, n int, skipped int, rows array<struct<id: string, chain: string, split: string, step_scores: array<double>, step_labels: array<int>>>"


def read_scores(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Score files, one blob a file or (not ``multi_line``) a line, as one row for each step: aligned rows only, unlabelled steps left out."""
    blobs = spark.read.schema(SCORES).option("multiLine", multi_line).json(path)
    rows = blobs.select("model", F.explode("rows").alias("r")).select("model", "r.*").where("size(step_scores) = size(step_labels)")
    steps = rows.select("model", "id", "chain", "split", F.posexplode(F.arrays_zip("step_scores", "step_labels")).alias("step", "s"))
    return steps.select("model", "id", "chain", "split", "step", F.col("s.step_scores").alias("score"), F.col("s.step_labels").alias("label")).where("label >= 0")


def skipped_scores(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(model, kept, misaligned, skipped): rows of a model's score files whose scores and labels align or not, and those that scoring skipped."""
    blobs = spark.read.schema(SCORES).option("multiLine", multi_line).json(path)
    aligned = F.size(F.filter("rows", lambda r: F.size(r["step_scores"]) == F.size(r["step_labels"])))
    rows = F.greatest(F.size("rows"), F.lit(0))
    return blobs.groupBy("model").agg(F.sum(F.greatest(aligned, F.lit(0))).alias("kept"), F.sum(rows - F.greatest(aligned, F.lit(0))).alias("misaligned"), F.sum(F.coalesce("skipped", F.lit(0))).alias("skipped"))


STEPS = "id long, split string, chain string, step_idx int, step_label int, emb array<float>"


def write_steps(steps: DataFrame, path: str) -> None:
    """Step vectors as a long Parquet table, one row a step, ordered by chain within its files so that a chain's steps lie together."""
    steps.sortWithinPartitions("id", "step_idx").write.mode("overwrite").parquet(path)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """The long step table: (id, split, chain, step_idx, step_label, emb); labels below 0 are unknown."""
    return spark.read.schema(STEPS).parquet(path)


def mixed_groups(df: DataFrame, generations: str, correct: str) -> DataFrame:
    """Rows whose parallel arrays align and hold both right and wrong generations, one row a generation."""
    right = F.size(F.filter(correct, lambda x: x))
    mixed = df.where((F.size(generations) == F.size(correct)) & (right > 0) & (right < F.size(correct)))
    return mixed.select(*[c for c in df.columns if c not in (generations, correct)], F.posexplode(F.arrays_zip(generations, correct)).alias("gen", "g")).select(
        "*", F.col("g")[generations].alias("generation"), F.col("g")[correct].alias("is_correct")
    ).drop("g")


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """CSV with a header, doubles rounded."""
    rounded = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*rounded).write.mode("overwrite").option("header", True).csv(path)
