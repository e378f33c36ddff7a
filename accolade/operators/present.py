"""Texts of results, and ordered lists for write-back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accolade.operators.qualify import blank, folded, ordinal
from accolade.sources import fixed

TEMPLATE = "<placement> - <year> <award> - <category>"
_TOKENS = re.compile("(<placement>|<year>|<award>|<category>)")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^(?U)\s+", ""), r"(?U)\s+$", "")


def or_missing(c: Column, name: str) -> Column:
    return F.when(blank(c), F.lit(f"<{name} missing>")).otherwise(trimmed(c))


def values() -> dict[str, Column]:
    """The columns that stand for a template's marks."""
    category, title = F.col("category"), F.col("work_title")
    series = (F.col("identity_kind") == "series") & ~blank(category) & ~blank(title)
    return {
        "<placement>": F.when(F.col("rank").isNotNull(), ordinal(F.col("rank"))).otherwise(or_missing(F.col("status"), "placement")),
        "<year>": F.coalesce(F.col("award_year").cast("string"), F.lit("<year missing>")),
        "<award>": or_missing(F.col("award_name"), "award"),
        "<category>": F.when(series, F.concat(trimmed(category), F.lit(" ["), trimmed(title), F.lit("]"))).otherwise(or_missing(category, "category")),
    }


def formatted(template: str | None = None) -> Column:
    """One pass over the template: marks in values stay as they are, unknown marks too. A blank template is the usual one."""
    template = template if template and template.strip() else TEMPLATE
    known = values()
    return F.concat(*[known[t] if t in known else F.lit(t) for t in _TOKENS.split(template) if t])


def report(results: DataFrame, failures: DataFrame, queries: DataFrame, template: str | None = None) -> DataFrame:
    """query_id and text: a line a result in order, then the sources' problems; or that there is nothing."""
    lines = results.withColumn("_line", formatted(template)).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_ord", "result_ord", "_line"))), lambda x: x["_line"]), "\n").alias("body"))
    problem = F.concat_ws(" — ", "source_name", "error_type", "message")
    problems = failures.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_ord", problem.alias("p")))), lambda x: x["p"]), "\n").alias("problems"))
    block = F.concat(F.lit("Source problems:\n\n"), F.col("problems"))
    text = F.when(F.col("body").isNotNull() & F.col("problems").isNotNull(), F.concat("body", F.lit("\n\n"), block)).otherwise(F.coalesce("body", block, F.lit("No award results found.")))
    return queries.select("query_id").join(lines, "query_id", "left").join(problems, "query_id", "left").select("query_id", text.alias("text"))


def formatted_qualifying(results: DataFrame, template: str | None = None) -> DataFrame:
    """query_id and the formatted lines of results that qualify, in order."""
    lines = results.where("decision = 'QUALIFIES'").withColumn("_line", formatted(template)).groupBy("query_id")
    return lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("source_ord", "result_ord", "_line"))), lambda x: x["_line"]).alias("lines"))


def identity(title: Column, author: Column) -> Column:
    return F.concat(trimmed(F.coalesce(title, F.lit(""))), F.lit(" | "), trimmed(F.coalesce(author, F.lit(""))))


def book_line(title: Column, author: Column) -> Column:
    return F.concat(F.lit("Book: "), identity(title, author))


def series_line(series: Column) -> Column:
    """The series asked for, or null."""
    return F.when(~blank(series), F.concat(F.lit("Series: "), trimmed(series)))


def identity_if_different(title: Column, author: Column, asked_title: Column, asked_author: Column) -> Column:
    """A result's identity where it is not what was asked for, as it is written, else null."""
    found = identity(title, author)
    return F.when((trimmed(title) != trimmed(asked_title)) | (trimmed(author) != trimmed(asked_author)), found)


def with_series_award(requests: DataFrame, results: DataFrame) -> DataFrame:
    """The requests with `has_series_award`: a series was asked for and some result is a series'."""
    found = results.groupBy("query_id").agg(F.bool_or(F.col("identity_kind") == "series").alias("_series"))
    return requests.join(found, "query_id", "left").withColumn("has_series_award", ~blank(F.col("series")) & F.coalesce("_series", F.lit(False))).drop("_series")


def _key(x: Column) -> Column:
    return folded(x)


def unique_values(values: Column) -> Column:
    """First spellings in order, without blanks and later repeats."""
    seed = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("keys"))
    fold = lambda acc, x: F.when(blank(x) | F.array_contains(acc["keys"], _key(x)), acc).otherwise(F.struct(F.array_append(acc["out"], x).alias("out"), F.array_append(acc["keys"], _key(x)).alias("keys")))
    return F.aggregate(values, seed, fold, lambda acc: acc["out"])


def append_values(existing: Column, new: Column) -> Column:
    """What is there, untouched, then new values that it lacks."""
    existing = F.coalesce(existing, F.array().cast("array<string>"))
    keys = F.transform(existing, _key)
    return F.concat(existing, F.filter(unique_values(new), lambda x: ~F.array_contains(keys, _key(x))))


def without_commas(values: Column) -> Column:
    return F.filter(values, lambda x: ~F.contains(x, F.lit(",")))


def with_commas(values: Column) -> Column:
    return F.filter(values, lambda x: F.contains(x, F.lit(",")))


def write_back(df: DataFrame, existing: str, new: str, mode: str = "append") -> DataFrame:
    """Adds values, rejected_for_comma and changed. Replacing with nothing left changes nothing; an unknown mode appends."""
    there = F.coalesce(F.col(existing), F.array().cast("array<string>"))
    safe = without_commas(F.col(new))
    if (mode or "").strip().lower() == "replace":
        fresh = unique_values(safe)
        values = F.when(F.size(fresh) == 0, there).otherwise(fresh)
    else:
        values = append_values(there, safe)
    return df.withColumns({"values": values, "rejected_for_comma": with_commas(F.col(new)), "changed": values != there})


def is_eligible_target(df: DataFrame, column: str) -> bool:
    """Whether a column can take the values: a list of texts that does not hold names (metadata key is_names)."""
    if column not in df.columns:
        return False
    field = df.schema[column]
    return field.dataType.simpleString() == "array<string>" and not (field.metadata or {}).get("is_names", False)


def eligible_targets(df: DataFrame) -> list[tuple[str, str]]:
    """(column, display name) of the columns that can take the values, by display name (metadata key name) without regard to case."""
    found = [(f.name, str((f.metadata or {}).get("name") or f.name)) for f in df.schema.fields if is_eligible_target(df, f.name)]
    return sorted(found, key=lambda item: item[1].casefold())


@dataclass(frozen=True)
class Preferences:
    """Options of a write-back as they are kept; what is odd or missing counts as the usual."""

    template: str = TEMPLATE
    enabled: bool = False
    field: str = ""
    mode: str = "append"

    @classmethod
    def of(cls, values: dict) -> Preferences:
        text = lambda k: v.strip() if isinstance(v := values.get(k), str) else ""
        mode = text("mode").lower()
        return cls(values["template"] if text("template") else TEMPLATE, bool(values.get("enabled", False)), text("field"), mode if mode in ("append", "replace") else "append")


def status_text(df: DataFrame, preferences: Preferences, any_results: bool = True) -> str:
    """What a write-back to a column of df would do, or why it cannot be done."""
    field = preferences.field
    if not preferences.enabled:
        return fixed.WRITE_DISABLED
    if not field:
        return fixed.WRITE_NO_FIELD
    if not is_eligible_target(df, field):
        return fixed.WRITE_LOST_FIELD.format(field=field)
    if not any_results:
        return fixed.WRITE_NOTHING
    return (fixed.WRITE_REPLACE if preferences.mode == "replace" else fixed.WRITE_APPEND).format(field=field)
