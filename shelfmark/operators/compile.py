"""From a declaration to an index: extraction, typing, checks, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.config import Config
from shelfmark.errors import BuildError
from shelfmark.functions.coerce import array_of, coerce, collapsed, invalid
from shelfmark.functions.text import composed
from shelfmark.operators import profile
from shelfmark.operators.index import Index, build
from shelfmark.operators.variants import term_variants
from shelfmark.sources.html import discovered, extracted
from shelfmark.plans.lineage import written
from shelfmark.sources.records import checked_records, kind_at, read_records, require_sound, value_at
from shelfmark.sources.synthetic import dense_ids


def pages_to_documents(pages: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(documents, problems) of pages (path, url, html). Problems are rows (code, field, path, fatal)."""
    seen = {"__title": config.selectors["title"], "__description": config.selectors["description"], "__body": config.selectors["body"]}
    seen |= {f"__c_{n}": s for n, s in config.column_sources.items()} | {f"__e{i}": s for i, s in enumerate(config.body_extra)}
    rows = extracted(pages, "html", seen, {f"__f_{n}": s for n, s in config.sources.items()})
    # pages are parsed once: what is read of them is a table
    rows = dense_ids(written(rows.drop("html"), "extracted"), ["url", "path"])
    first = lambda c: F.get(F.col(c), F.lit(0))
    joined = lambda *cs: F.nullif(collapsed(F.array_join(F.concat(*map(F.col, cs)), " ")), F.lit(""))
    out = {"title": collapsed(F.coalesce(first("__title"), F.col("url"))), "description": collapsed(first("__description")), "body": joined("__body", *[f"__e{i}" for i in range(len(config.body_extra))])}
    out |= {n: joined(f"__c_{n}") for n in config.column_sources}
    problems = [(F.size("__title") == 0, "SELECTOR_MISS", "title", False)]
    for name, f in config.fields.items():
        values = F.col(f"__f_{name}")
        if f.type == "string_array":
            out[name] = array_of(F.array_join(values, ","))
        else:
            value = F.get(values, F.lit(0))
            out[name] = coerce(value, f.type)
            problems += [(F.size(values) > 1, "FIELD_MULTIPLE_VALUES", name, False), (invalid(value, f.type), "FIELD_TYPE", name, True)]
        if name in config.required:
            problems.append((F.size(values) == 0, "FIELD_REQUIRED_MISSING", name, True))
    docs = composed(rows.select("id", "url", *[c.alias(n) for n, c in out.items()]), ["title", "body", *config.column_sources])
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(fatal).alias("fatal"))) for c, code, field, fatal in problems]), lambda p: p.isNotNull())
    return docs, rows.select("path", "id", F.explode(found).alias("p")).select("p.code", "p.field", "path", "id", "p.fatal")


def records_to_documents(records: DataFrame, config: Config) -> DataFrame:
    """Documents of sound records (id, url, data), numbered by line where they know their place, else by address."""
    part = {"facet": "facets", "store": "store", "sort": "sort"}
    text = lambda n: collapsed(value_at(f"$.fields.{n}")).alias(n)
    out = [text("title"), text("body"), F.lit(None).cast("string").alias("description"), *map(text, config.column_sources)]
    for name, f in config.fields.items():
        path = f"$.{part[f.role]}.{name}"
        if f.type == "string_array":
            many = F.coalesce(value_at(path, "array<string>"), F.array(value_at(path)))
            out.append(F.filter(F.transform(many, collapsed), lambda v: v != "").alias(name))
        elif f.type == "json":
            # as it stands, with its keys in their order; a text keeps its quotes
            out.append(F.when(kind_at(path) == "string", F.to_json(value_at(path, "variant"))).when(kind_at(path) != "null", F.get_json_object("raw", path)).alias(name))
        else:
            out.append(coerce(value_at(path), f.type).alias(name))
    place = [c for c in ("file", "block", "row") if c in records.columns]
    numbered = dense_ids(records.withColumnRenamed("id", "record_id"), place or ["url"])
    docs = numbered.select("id", "record_id", "url", *out).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "url"))
    docs = composed(docs, ["title", "body", *config.column_sources, *(n for n, f in config.fields.items() if f.type in ("string", "string_array"))])
    # forms that were two may be one now
    return docs.withColumns({n: F.array_sort(F.array_distinct(n)) for n, f in config.fields.items() if f.type == "string_array"})


def compile_site(spark: SparkSession, root: str, config: Config, path: str, metrics: dict | None = None) -> Index:
    """The written index of a directory of pages or a file of records; a fatal problem is an error that names its first page.

    Other problems are warnings: how often each was met and the first pages,
    in the table ``warnings`` of the index. ``metrics`` receives what ``build``
    measures and the warnings.
    """
    inside = lambda x: x.removeprefix("file:").rstrip("/") + "/"
    if config.input == "html" and inside(path).startswith(inside(root)) and not config.output_in_source:
        raise BuildError("CONFIG_INVALID", f"the index {path} would lie among its pages; set allow_output_in_source if it shall")
    if config.input == "records":
        records = require_sound(checked_records(read_records(spark, root), _declared(config), config.fields, config.required), root)
        docs, problems = records_to_documents(records, config), None
    else:
        docs, problems = pages_to_documents(discovered(spark, root, config.base_url, list(config.include), list(config.exclude)), config)
        if bad := problems.where("fatal").orderBy("id").limit(1).collect():
            raise BuildError(bad[0].code, f"field {bad[0].field} of {bad[0].path}")

    def finish(vocabulary: DataFrame) -> dict[str, DataFrame]:
        made = {"variants": term_variants(vocabulary, config.synonyms, config.suppressions, config.variant_generation)}
        if problems is not None:
            made["warnings"] = profile.warnings(problems.where("NOT fatal"), ["code", "field"], F.col("path"), F.col("id"))
        return made

    index = build(docs, config.columns, path, config.positions, metrics=metrics, finish=finish, declared=config.described())
    if metrics is not None and problems is not None:
        metrics["warnings"] = [r.asDict() for r in spark.read.parquet(f"{path}/warnings").orderBy("code", "field").collect()]  # a row for each code and field
    return index


def _declared(config: Config) -> dict[str, list[str]]:
    by = {"facets": "facet", "store": "store", "sort": "sort"}
    return {"fields": ["title", "body", *config.column_sources]} | {s: [n for n, f in config.fields.items() if f.role == r] for s, r in by.items()}
