"""Pages to raw rows by windows over what stands on them: elements and texts in the page's order, with the places that they enclose.

An element holds what lies between its place and that of its last part, so what is inside of what, what was last said before, and
what belongs together are windows and groups over a page's rows. A page's rows are in one group, as their order is their meaning.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as S

from accolade.functions import text as T
from accolade.functions.dom import Node, numbered, parse
from accolade.sources import fixed, pages

_PAGE = ["page_no", "digest", "source_key", "page_role", "page_url", "config_ord", "page_ord"]
_cleaned_title = T.text_column(T.cleaned_title)
#: The forms that these pages use.
_YEAR_LINK = r"/prize-winners-by-year/([0-9]{4})(?:/|$|\?)"
_BY_CITATION = r"(?is)^(.+?),\s*by\s+(.+?)(?:\s*\(.*\))?\s*$"
_STATUS_END = r"(?isU)^(.+?)\s+(Winner|Nominee)\s*$"
_STATUSES = {"winner": "Winner", "nominee": "Nominee"}


#: What is told of each element and text of a page.
ELEMENT = {"pre": pa.int32(), "post": pa.int32(), "tag": pa.string(), "classes": pa.list_(pa.string()), "href": pa.string(), "text": pa.string()}
ELEMENT_SQL = "pre int, post int, tag string, classes array<string>, href string, text string"


def element_columns(html: str) -> dict[str, list]:
    """The columns of ELEMENT for what stands on a page, in its order."""
    found = numbered(parse(html))
    told = lambda f: [f(x) if isinstance(x, Node) else None for _, _, x in found]
    return {"pre": [a for a, _, _ in found], "post": [b for _, b, _ in found], "tag": told(lambda x: x.tag), "classes": told(lambda x: x.classes), "href": told(lambda x: x.attrs.get("href")), "text": [x if isinstance(x, str) else None for _, _, x in found]}


def elements_of(df: DataFrame, page_no: str, html: str) -> DataFrame:
    """(page_no, elements) of any pages, page_no telling them apart; a null page has none."""

    def run(batches):
        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                columns = element_columns(text.as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(columns["pre"]), batch.schema.field(0).type), *[pa.array(columns[k], t) for k, t in ELEMENT.items()]], ["page_no", *ELEMENT])

    return df.select(page_no, html).mapInArrow(run, f"page_no {df.schema[page_no].dataType.simpleString()}, {ELEMENT_SQL}")


def _up_to(end: int) -> WindowSpec:
    """A page's rows from the first to the `end`-th from here."""
    return Window.partitionBy("page_no").orderBy("pre").rowsBetween(Window.unboundedPreceding, end)


def squeezed(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def last_so_far(value: Column) -> Column:
    """The last value that is not null, up to a row."""
    return F.last_value(value, ignoreNulls=True).over(_up_to(0))


def boxes(elements: DataFrame, kind: Column, what: Column, name: str) -> DataFrame:
    """elements with `name`, the (pre, post, what) of the outermost element of a kind that a row lies in or is, else null."""
    own = F.coalesce(kind, F.lit(False))
    df = elements.withColumn("_kind", own).withColumn("_end", F.max(F.when(F.col("_kind"), F.col("post"))).over(_up_to(-1)))
    outermost = F.col("_kind") & F.coalesce(F.col("_end") < F.col("pre"), F.lit(True))
    df = df.withColumn(name, last_so_far(F.when(outermost, F.struct("pre", "post", what.alias("what")))))
    return df.withColumn(name, F.when(F.col(f"{name}.post") >= F.col("pre"), F.col(name))).drop("_kind", "_end")


def text_of(condition: Column | None = None) -> Column:
    """An aggregate: the texts of a group in order, joined; of those for which a condition holds."""
    text = F.col("text").isNotNull() if condition is None else F.col("text").isNotNull() & condition
    parts = F.array_sort(F.collect_list(F.when(text, F.struct("pre", "text"))))
    return F.array_join(F.transform(parts, lambda x: x["text"]), "")


def pulitzer(elements: DataFrame) -> DataFrame:
    """Winners in h2, finalists in a div: the last year link so far, or inside, says the year; emphasised text is the title."""
    div = lambda name: (F.col("tag") == "div") & F.array_contains("classes", name)
    status = F.when(div("winner-citation"), F.lit(None)).when(F.col("tag") == "h2", "Winner").when(div("finalist-title"), "Finalist")
    year = F.when(F.col("tag") == "a", F.nullif(F.regexp_extract(F.coalesce("href", F.lit("")), _YEAR_LINK, 1), F.lit("")).cast("int"))
    df = elements.where("source_key = 'pulitzer'").withColumn("year", last_so_far(year))
    df = boxes(df, status.isNotNull() | div("winner-citation"), status, "box").where("box.what is not null")
    df = boxes(df, (F.col("tag") == "em") & (F.col("pre") > F.col("box.pre")), F.lit(True), "em")
    rows = df.groupBy(*_PAGE, "category", "box").agg(squeezed(text_of()).alias("told"), squeezed(text_of(F.col("em").isNotNull())).alias("title"), F.max_by("year", "pre").alias("award_year"))
    cited = [F.trim(F.regexp_extract("told", _BY_CITATION, i)) for i in (1, 2)]
    rows = rows.where(F.col("told").rlike(_BY_CITATION) & (F.lower("told") != "no award") & F.col("award_year").isNotNull())
    return rows.select(
        *_PAGE, F.col("box.pre").alias("rec_ord"), "award_year", F.lit("Pulitzer Prize").alias("award_name"), "category", F.col("box.what").alias("status"),
        F.when(F.col("title") != "", F.col("title")).otherwise(cited[0]).alias("work_title"), cited[1].alias("work_author"), F.col("page_url").alias("source_url"), F.lit("work").alias("identity_kind"),
    )


#: What marks a status, in the order that counts; {award} is any of an award's own names, {year} when it was.
_MARKED_STATUS = (("Winner", r"(?isU)Winner,\s*(?:{award}){year}"), ("Nominated", r"(?isU)Nominated for\b.*?(?:{award})"))
_YEAR_TOLD, _YEAR_MAYBE_TOLD = r"\s+in\s+[0-9]{4}", r"(?:\s+in\s+[0-9]{4})?"
_ENTRY, _ENTRY_KIND = pa.struct({n: pa.string() for n in ("title", "author", "page")}), S.StructType([S.StructField(n, S.StringType()) for n in ("title", "author", "page")])


@F.arrow_udf(returnType=_ENTRY_KIND)
def _entry(em: pa.Array, link: pa.Array, authors: pa.Array, base: pa.Array, href: pa.Array) -> pa.Array:
    found = [pages.nebula_entry(*x) for x in zip(*(c.to_pylist() for c in (em, link, authors, base, href)), strict=True)]
    return pa.array([f and dict(zip(("title", "author", "page"), f, strict=True)) for f in found], _ENTRY)


def marked_status(told: Column, names: tuple[str, ...], year_optional: bool) -> Column:
    """The first status whose mark stands with one of the award's own names, else null; stars do not count."""
    parts = {"award": "|".join(map(re.escape, names)), "year": _YEAR_MAYBE_TOLD if year_optional else _YEAR_TOLD}
    return F.coalesce(*[F.when(told.rlike(form.format(**parts)), status) for status, form in _MARKED_STATUS])


def nebula(elements: DataFrame) -> DataFrame:
    """Entries of award lists under the last heading that is a year: the outermost items of a list, with what is emphasised and linked in them."""
    df = elements.where("source_key = 'nebula'")
    heading = boxes(df, F.col("tag") == "h2", F.lit(True), "h2").where("h2 is not null").groupBy("page_no", F.col("h2.pre").alias("pre")).agg(squeezed(text_of()).alias("told"))
    years = heading.where(F.col("told").rlike("^[0-9]{4}$")).select("page_no", "pre", F.col("told").cast("int").alias("year"))
    df = df.join(years, ["page_no", "pre"], "left").withColumn("year", last_so_far(F.col("year")))
    df = boxes(df, (F.col("tag") == "ul") & F.array_contains("classes", "award_list"), F.col("year"), "list").where("list.what is not null")
    df = boxes(df, (F.col("tag") == "li") & (F.col("pre") > F.col("list.pre")), F.lit(True), "li").where("li is not null")
    df = boxes(df, (F.col("tag") == "em") & (F.col("pre") > F.col("li.pre")), F.lit(True), "em")
    df = df.withColumn("a", last_so_far(F.when(F.col("tag") == "a", F.struct("pre", "post", F.coalesce("href", F.lit("")).alias("href"))))).withColumn("a", F.when((F.col("a.post") >= F.col("pre")) & (F.col("a.pre") > F.col("li.pre")), F.col("a")))
    linked = df.where("a is not null").groupBy("page_no", F.col("li.pre").alias("pre"), "a").agg(squeezed(text_of()).alias("told"))
    kind = lambda part: F.when(F.contains(F.col("a.href"), F.lit(part)), F.struct("a", "told"))
    links = linked.groupBy("page_no", "pre").agg(F.min(kind("/nominated-work/")).alias("work"), F.transform(F.array_sort(F.collect_list(F.when(F.col("told") != "", kind("/nominees/")))), lambda x: x["told"]).alias("authors"))
    rows = df.groupBy(*_PAGE, "category", F.col("li.pre").alias("pre"), F.col("list.what").alias("award_year")).agg(squeezed(text_of()).alias("told"), squeezed(text_of(F.col("em").isNotNull())).alias("em_told")).join(links, ["page_no", "pre"], "left")
    archive = lambda value: F.coalesce(*[F.when(F.col("category") == a[0], value(a)) for a in fixed.NEBULA_ARCHIVES])
    rows = rows.withColumn("status", archive(lambda a: marked_status(F.col("told"), a[3], a[5]))).where("status is not null")
    base = F.concat(F.lit(fixed.NEBULA_ORIGIN), "category", F.lit("/"))
    rows = rows.withColumn("entry", _entry("em_told", F.coalesce("work.told", F.lit("")), F.coalesce("authors", F.array().cast("array<string>")), base, F.col("work.a.href")))
    rows = rows.where(F.col("entry.title").isNotNull() & ~F.lower(squeezed(F.col("entry.title"))).isin("no award", "no awards"))
    # Headings that are years, read before, are numbered from 0 and count towards the contract only.
    return rows.select(
        *_PAGE, (F.col("pre") + 10_000).alias("rec_ord"), "award_year", archive(lambda a: F.lit(a[1])).alias("award_name"), archive(lambda a: F.lit(a[2])).alias("category"), "status",
        F.col("entry.title").alias("work_title"), F.col("entry.author").alias("work_author"), F.col("entry.page").alias("source_url"), F.lit("work").alias("identity_kind"),
    )


def table_rows(elements: DataFrame) -> DataFrame:
    """The cells of each row of a page's first table: (page, pre, cells), rows without cells left out; a cell belongs to the last row that began."""
    df = boxes(elements, F.col("tag") == "table", F.lit(True), "table")
    df = df.withColumn("first", F.min("table.pre").over(Window.partitionBy("page_no"))).where("table.pre = first")
    df = df.withColumn("tr", last_so_far(F.when(F.col("tag") == "tr", F.struct("pre", "post")))).where("tr.post >= pre")
    df = df.withColumn("cell", last_so_far(F.when(F.col("tag").isin("td", "th"), F.struct("pre", "post")))).where("cell.post >= pre and cell.pre > tr.pre")
    cells = df.groupBy(*_PAGE, "tr", "cell").agg(F.regexp_replace(F.regexp_replace(text_of(), r"^(?U)[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+$", "").alias("told"))
    return cells.groupBy(*_PAGE, F.col("tr.pre").alias("pre")).agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "told"))), lambda x: x["told"]).alias("cells"))


def title_and_status(cells: Column) -> tuple[Column, Column]:
    """Null or the title and the status of a row: from the fifth cell and the sixth, which has to be a status; without a sixth the status stands behind the title."""
    statuses = F.create_map(*[F.lit(x) for pair in _STATUSES.items() for x in pair])
    jammed, six = F.get(cells, F.lit(4)), F.size(cells) > 5
    title = F.when(six, jammed).when(jammed.rlike(_STATUS_END), F.regexp_extract(jammed, _STATUS_END, 1))
    status = F.when(six, F.get(cells, F.lit(5))).otherwise(F.regexp_extract(jammed, _STATUS_END, 2))
    return F.nullif(_cleaned_title(title), F.lit("")), F.try_element_at(statuses, F.lower(squeezed(status)))


def table_category(official: Column, year: Column) -> tuple[Column, Column]:
    """The category of a table's label, and what is wrong with it."""
    known = F.create_map(*[F.lit(x) for c, _, _ in fixed.WORLD_FANTASY_CATEGORIES for x in (c.casefold(), c)])
    name, in_years = F.lower(squeezed(official)), year.isin(*fixed.LONG_FICTION_YEARS)
    long_fiction = name == "long fiction"
    return F.when(long_fiction & in_years, "Novella").otherwise(F.try_element_at(known, name)), F.when(long_fiction & ~in_years, F.format_string(fixed.LONG_FICTION_OUTSIDE, year))


def fantasy_tables(elements: DataFrame) -> DataFrame:
    """The works of the master and convention tables; a label that its year cannot have is an error, after which a page gives nothing."""
    df = table_rows(elements.where("source_key = 'world_fantasy'")).where("size(cells) > 4")
    cell = lambda i: F.get("cells", F.lit(i))
    year, official = squeezed(cell(2)), squeezed(cell(3))
    df = df.where((F.lower(cell(0)) != "first name") & year.rlike("^[0-9]{4}$") & (official != "")).withColumns({"award_year": year.cast("int"), "official_category": official}).where("award_year > 0")
    category, wrong = table_category(F.col("official_category"), F.col("award_year"))
    title, status = title_and_status(F.col("cells"))
    df = df.withColumns({"category": category, "error": wrong, "work_title": title, "status": status, "work_author": squeezed(F.concat(cell(0), F.lit(" "), cell(1)))})
    broken = F.max("error").over(_up_to(-1))
    df = df.withColumn("_broken", broken).where("_broken is null and (error is not null or (category is not null and work_title is not null and status is not null and work_author != ''))")
    own = lambda c: F.when(F.col("error").isNull(), c)
    columns = {c: own(F.col(c)) for c in ("award_year", "category", "official_category", "status", "work_title", "work_author")}
    return df.select(*_PAGE, F.col("pre").alias("rec_ord"), *[v.alias(k) for k, v in columns.items()], own(F.lit("World Fantasy Award")).alias("award_name"), own(F.col("page_url")).alias("source_url"), "error", F.lit("work").alias("identity_kind"))
