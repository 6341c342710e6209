"""Records as JSON lines, validated against declared sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.errors import BuildError
from shelfmark.functions.coerce import collapsed, invalid
from shelfmark.operators.filters import Fields

SECTIONS = ("fields", "facets", "sort", "store")
ROLES = {"facets": "facet", "sort": "sort", "store": "store"}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(raw, file, block, row) of each non-blank line; the last three order the lines as they stand."""
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.withColumn("row", F.monotonically_increasing_id()).where(F.length(F.btrim("raw")) > 0)


def line_number(spark: SparkSession, path: str, file: str, block: int, row: int) -> int:
    """The number of a line in its file, blank ones counted."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("row", F.monotonically_increasing_id())
    return lines.where((F.col("file") == file) & ((F.col("block") < block) | (F.col("block") == block) & (F.col("row") <= row))).count()


def value_at(path: str, kind: str = "string") -> Column:
    """A part of the record ``data`` as a type; null where it is missing, JSON null, or of another type."""
    return F.try_variant_get("data", path, kind)


def kind_at(path: str) -> Column:
    """The JSON kind of a part: string, integer, number, boolean, array, object, null; SQL null where it is missing."""
    name = F.schema_of_variant(F.try_variant_get("data", path, "variant"))
    return (
        F.when(name == "STRING", "string").when(name == "BIGINT", "integer").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").when(name.isNotNull(), "number")
    )


def checked_records(lines: DataFrame, declared: dict[str, list[str]], fields: Fields | None = None, required: frozenset[str] = frozenset()) -> DataFrame:
    """``lines`` (raw, ...) with (id, url, data, problem, code): each line as a value that is asked by path, with the first thing wrong with it or null.

    A record is an object with no keys beside id, url and the sections. Its id
    is a string that is not empty, or a whole number; its url a string that is
    not blank; sections are objects of declared keys. Texts are strings.
    ``fields`` names the types of the other values: lists and single strings for
    arrays, single values that read as their type for the rest.
    """
    keys = F.json_object_keys("raw")
    allowed = F.array(*map(F.lit, ("id", "url", *SECTIONS)))
    rows = lines.withColumn("data", F.try_parse_json("raw"))
    tests: list[tuple[Column, str, str]] = [(F.col("data").isNull() | F.coalesce(kind_at("$") != "object", F.lit(True)), "RECORD_INVALID", "a record must be a JSON object"), (F.size(F.array_except(keys, allowed)) > 0, "RECORD_INVALID", "unknown record key")]
    tests.append((~F.coalesce(kind_at("$.id").isin("string", "integer"), F.lit(False)) | (value_at("$.id") == ""), "RECORD_INVALID", "record id must be a non-empty string or an integer"))
    tests.append((~F.coalesce(kind_at("$.url") == "string", F.lit(False)) | (F.btrim(value_at("$.url")) == ""), "RECORD_INVALID", "record url must be a non-empty string"))
    for section in SECTIONS:
        names = declared.get(section, [])
        tests.append((kind_at(f"$.{section}") != "object", "RECORD_INVALID", f"record {section} must be an object"))
        inside = F.json_object_keys(F.get_json_object("raw", f"$.{section}"))
        tests.append((F.size(F.array_except(inside, F.array(*map(F.lit, names)).cast("array<string>"))) > 0, "RECORD_INVALID", f"record {section} holds an undeclared key"))
    for name in declared.get("fields", []):
        tests.append((~kind_at(f"$.fields.{name}").isin("string", "null"), "RECORD_INVALID", f"record fields.{name} must be a string"))
    for section, role in ROLES.items():
        for name in declared.get(section, []):
            f = (fields or {}).get(name)
            if f is None or f.role != role:
                continue
            path = f"$.{section}.{name}"
            kind = kind_at(path)
            missing = kind.isNull() | (kind == "null")
            if f.type == "string_array":
                items = value_at(path, "array<variant>")
                bad = ~kind.isin("string", "array", "null") | ((kind == "array") & F.exists(items, lambda x: F.coalesce(F.schema_of_variant(x) != "STRING", F.lit(True))))
                tests.append((bad, "RECORD_INVALID", f"record {name} must be a string or an array of strings"))
                missing = missing | ((kind == "array") & (F.size(items) == 0)) | ((kind == "string") & (collapsed(value_at(path)) == ""))
            elif f.type != "json":
                tests.append((kind.isin("object", "array"), "RECORD_INVALID", f"record {name} must be a single value"))
                tests.append((invalid(value_at(path), f.type) | ((kind == "string") & (collapsed(value_at(path)) == "") & F.lit(f.type != "string")), "FIELD_TYPE", f"record {name} is no {f.type}"))
            if name in required:
                tests.append((missing, "FIELD_REQUIRED_MISSING", f"record misses {name}"))
    wrong = F.when(F.lit(False), F.struct(F.lit("").alias("code"), F.lit("").alias("problem")))
    for test, code, problem in tests:
        wrong = wrong.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(problem).alias("problem")))
    return rows.select(*lines.columns, value_at("$.id").alias("id"), F.btrim(value_at("$.url")).alias("url"), "data", wrong.alias("w")).select("*", "w.problem", "w.code").drop("w")


def require_sound(records: DataFrame, path: str | None = None) -> DataFrame:
    """The records, or an error that names the first problem or repeated id or url, with its line where the lines came from ``path``."""
    placed = {"file", "block", "row"} <= set(records.columns)
    order = ["file", "block", "row"] if placed else []

    def where(r) -> str:
        return f" at {r.file}:{line_number(records.sparkSession, path, r.file, r.block, r.row)}" if placed and path else f" (id {r.id})"

    if bad := records.where("problem IS NOT NULL").select("problem", "code", "id", *order).orderBy(*order or ["id"]).limit(1).collect():
        raise BuildError(bad[0].code, bad[0].problem + where(bad[0]))
    for key in ("id", "url"):
        seen = records.groupBy(key).agg(F.count("*").alias("n"), F.max(F.struct(*order, "id")).alias("last")).where("n > 1")
        if twice := seen.limit(1).collect():
            raise BuildError("RECORD_DUPLICATE", f"record {key} {twice[0][0]} stands twice" + where(twice[0].last))
    return records
