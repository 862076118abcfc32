"""JSON command input and JSON document output.

Commands (request bodies) are parsed with an explicit schema in PERMISSIVE
mode: a body that is not valid JSON is kept and rejected with a reason instead
of failing the job.  Field validators (required / oneof / uuid / email) then
add a per-field error map, like the reference's 422 response body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Validator messages per tag.
MESSAGES = {
    "required": "The field is required",
    "email": "The field must be a valid email address",
    "default": "The field is invalid",
}

CORRUPT_COL = "_corrupt_record"


def read_commands(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S2 from files: JSON lines with ``schema``; malformed lines land in ``_corrupt_record``."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT_COL, T.StringType(), True)])
    return (spark.read.schema(full).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT_COL).json(path))


def parse_commands(df: DataFrame, text_col: str, schema: T.StructType) -> DataFrame:
    """S2 from a text column: parsed fields plus ``bad_json`` (True when the body is not a JSON object)."""
    parsed = F.from_json(F.col(text_col), schema, {"mode": "PERMISSIVE"})
    ok = F.col(text_col).rlike(r"(?s)^\s*\{.*\}\s*$") & F.get_json_object(F.col(text_col), "$").isNotNull()
    return df.withColumn("_cmd", F.when(ok, parsed)).select(
        *[c for c in df.columns], "_cmd.*", (~F.coalesce(ok, F.lit(False))).alias("bad_json"))


def field_errors(checks: list[tuple[str, str, Column]]) -> Column:
    """Map field -> message for every failing (field, tag, ok) check; first failing tag per field wins."""
    fields: dict[str, list[tuple[str, Column]]] = {}
    for field, tag, ok in checks:
        fields.setdefault(field, []).append((tag, ok))
    entries = []
    for field, tags in fields.items():
        msg = None
        for tag, ok in tags:
            text = F.lit(MESSAGES.get(tag, MESSAGES["default"]))
            cond = ~F.coalesce(ok, F.lit(False))
            msg = F.when(cond, text) if msg is None else msg.when(cond, text)
        entries.append(F.struct(F.lit(field).alias("k"), msg.alias("v")))
    kept = F.filter(F.array(*entries), lambda e: e["v"].isNotNull())
    return F.map_from_entries(kept)


def required(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""


def one_of(c: str, values) -> Column:
    return F.col(c).isin(*values)


def to_documents(df: DataFrame, id_col: str, doc_col: str = "document") -> DataFrame:
    """S3: one JSON text per row (nested arrays/structs kept) next to its id."""
    body = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.col(id_col), F.to_json(body).alias(doc_col))


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3 sink: JSON lines, one document per row."""
    df.write.mode(mode).json(path)
