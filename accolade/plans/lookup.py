"""The lookup plan: requests against archives, as DataFrames.

requests (query_id, title, author, series) -> results, failures. Page rows are read once; titles and
names become keys once per distinct value; matching is one equi-join of keys a source. A single
lookup is a table of one request.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from accolade.functions import text as T
from accolade.operators import archives as A
from accolade.operators.matching import contains_all
from accolade.operators.qualify import assess, blank, place_status, result_violations
from accolade.operators.relational import first_wins, key_join, only_match
from accolade.sources import fixed
from accolade.sources.shared import Kept
from accolade.sources.snapshots import raw_rows

RESULT = ["query_id", "source_ord", "result_ord", "work_title", "work_author", "award_name", "award_year", "category", "status", "rank", "source_name", "source_url", "notes", "identity_kind"]
_q_title, _r_title = {}, {}
for _name, _form in (("basic", T.title_basic), ("dots", T.title_dots), ("marked", T.title_marked), ("cleaned", T.title_cleaned)):
    _q_title[_name] = T.list_column(lambda v, f=_form: T.title_keys(f(v), True))
    _r_title[_name] = T.list_column(lambda v, f=_form: T.title_keys(f(v), False))
_whole = T.list_column(T.whole_name)
_q_ordered, _r_ordered = T.list_column(lambda v: T.ordered_names(v, True)), T.list_column(lambda v: T.ordered_names(v, False))
_credited = T.list_column(T.credited_names)
_related_query, _related_people = T.list_column(T.related_query), T.list_column(T.related_people)
_folded, _parts = T.list_column(lambda v: T.folded_names([v])), T.list_column(lambda v: T.any_part([v]))
_series, _slugs, _casefold = T.text_column(T.series_name), T.list_column(T.slugs), T.text_column(str.casefold)


@dataclass(frozen=True)
class Report:
    """results (RESULT, decision, reason, preselected) and failures (query_id, source_ord, source_name, error_type, message).

    Both read stored tables: those of archives opened for this lookup, and matches where they were stored (progress was asked for, or `once`).
    `free` deletes them when results and failures have been read.
    """

    results: DataFrame
    failures: DataFrame
    stored: tuple[Callable[[], None], ...] = ()

    def free(self) -> None:
        for delete in self.stored:
            delete()


def clean_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trimmed requests, a blank series being none, and the failures of those with a blank title or author."""
    trim = lambda c: F.regexp_replace(F.regexp_replace(c, r"^(?U)\s+", ""), r"(?U)\s+$", "")
    wrong = F.when(blank(F.col("title")), F.lit(fixed.BLANK_FIELD.format(field="title"))).when(blank(F.col("author")), F.lit(fixed.BLANK_FIELD.format(field="author")))
    good = requests.where(wrong.isNull())
    good = good.select("query_id", trim(F.col("title")).alias("title"), trim(F.col("author")).alias("author"), F.when(blank(F.col("series")), F.lit(None)).otherwise(trim(F.col("series"))).alias("series"))
    bad = requests.where(wrong.isNotNull())
    return good, bad.select("query_id", F.lit(-1).alias("source_ord"), F.lit("request").alias("source_name"), F.lit("ValueError").alias("error_type"), wrong.alias("message"))


def _pairs(requests, records, title: str, q_author, r_author, r_names="match_authors") -> DataFrame:
    """(query_id, rec) whose titles match and whose author keys meet; all titles and names of a record count."""
    titles = key_join(requests.withColumn("_k", _q_title[title]("title")), records.select("rec", F.explode("match_titles").alias("_t")).withColumn("_k2", _r_title[title]("_t")), "_k", "_k2", [], ["query_id"], ["rec"])
    names = records.select("rec", F.explode(r_names).alias("_n")).withColumn("_k2", r_author("_n")).groupBy("rec").agg(F.flatten(F.collect_set("_k2")).alias("_k2"))
    both = titles.join(requests.select("query_id", q_author("author").alias("_k")), "query_id").join(names, "rec")
    return both.where(F.arrays_overlap("_k", "_k2")).select("query_id", "rec")


def _numbered(records: DataFrame) -> DataFrame:
    return records.withColumn("rec", F.struct("config_ord", "page_ord", "rec_ord", "work_title", "work_author", "award_year", "category", "status", F.coalesce("source_url", F.lit("")).alias("u")))


def _matched(pairs: DataFrame, records: DataFrame) -> DataFrame:
    return pairs.join(records, "rec")


def pulitzer_results(requests: DataFrame, records: DataFrame) -> DataFrame:
    r = _numbered(records)
    return _matched(_pairs(requests, r, "basic", _whole, _whole), r)


def nebula_results(requests: DataFrame, records: DataFrame) -> DataFrame:
    r = _numbered(records.where("work_author != ''"))
    return _matched(_pairs(requests, r, "basic", _q_ordered, _r_ordered), r)


def hugo_results(requests: DataFrame, records: DataFrame, rankings: DataFrame | None = None) -> DataFrame:
    r = _numbered(records)
    works, series = r.where("identity_kind = 'work'"), r.where("identity_kind = 'series'")
    found = _pairs(requests, works, "marked", _credited, _credited)
    related = works.where(F.col("category").isin(*fixed.HUGO_RELATED))
    titles = key_join(requests.withColumn("_k", _q_title["marked"]("title")), related.select("rec", F.explode("match_titles").alias("_t")).withColumn("_k2", _r_title["marked"]("_t")), "_k", "_k2", [], ["query_id"], ["rec"])
    people = titles.join(requests.select("query_id", _related_query("author").alias("_q")), "query_id").join(related.select("rec", _related_people("work_author").alias("_s")), "rec")
    # Every credited person is among those asked for; more may be asked for.
    found = found.union(people.where(contains_all(F.col("_s"), F.col("_q"))).select("query_id", "rec"))
    named = requests.where("series is not null").withColumn("_k", F.array(_series("series"))).where("_k[0] != ''")
    by_series = key_join(named, series.withColumn("_k2", F.array(_series("work_title"))), "_k", "_k2", [], ["query_id"], ["rec"])
    by_series = by_series.join(requests.select("query_id", _credited("author").alias("_q")), "query_id").join(series.select("rec", _credited("work_author").alias("_s")), "rec").where(F.arrays_overlap("_q", "_s")).select("query_id", "rec")
    found = _matched(found.union(by_series).distinct(), r)
    return with_ranking(found, ranking_table(requests.sparkSession) if rankings is None else rankings)


def ranking_table(spark) -> DataFrame:
    """The curated placements; a table that ranks a work twice, or shares a rank without a tie, is a ValueError."""
    works = {(y, t.casefold(), a.casefold()) for y, t, a, _ in fixed.HUGO_RANKINGS}
    if len(works) < len(fixed.HUGO_RANKINGS) or len({(y, k) for y, _, _, k in fixed.HUGO_RANKINGS}) < len(fixed.HUGO_RANKINGS):
        raise ValueError("the table of rankings repeats a work or a rank")
    rows = [(y, t, a, k, fixed.HUGO_STATISTICS[y], False) for y, t, a, k in fixed.HUGO_RANKINGS]
    return spark.createDataFrame(rows, "award_year int, work_title string, work_author string, rank int, source_url string, tied boolean")


def with_ranking(records: DataFrame, rankings: DataFrame) -> DataFrame:
    """The placement of a Best Novel, if exactly one ranking matches and it is first if and only if the record won; its page and tie replace the record's."""
    novels = records.where("category = 'Best Novel'").select("rec", "award_year", "match_titles", "work_author", "status").dropDuplicates(["rec"])
    left = novels.select("rec", "award_year", F.explode("match_titles").alias("_t")).withColumn("_k", _r_title["marked"]("_t"))
    right = rankings.withColumns({"_k2": _q_title["marked"]("work_title"), "_s": _credited("work_author"), "_rank": F.struct("rank", "source_url", "tied")})
    pairs = key_join(left, right, "_k", "_k2", ["award_year"], ["rec"], ["_rank", "_s"])
    pairs = pairs.join(novels.select("rec", "status", _credited("work_author").alias("_q")), "rec").where(F.arrays_overlap("_q", "_s"))
    one = only_match(pairs.select("rec", "_rank", "status").distinct(), ["rec"]).where((F.col("_rank.rank") == 1) == (F.col("status") == "Winner")).select("rec", "_rank")
    joined = records.drop("rank").join(one, "rec", "left")
    return joined.withColumns({"rank": F.col("_rank.rank"), "source_url": F.coalesce("_rank.source_url", "source_url"), "tied": F.coalesce("_rank.tied", F.lit(False))}).drop("_rank")


def world_fantasy_results(requests: DataFrame, records: DataFrame) -> DataFrame:
    r = _numbered(records.withColumn("_names", F.array_union("match_authors", F.array("work_author"))))
    return _matched(_pairs(requests, r, "cleaned", _parts, _parts, "_names"), r.drop("_names"))


def locus_results(requests: DataFrame, raw: DataFrame, read: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches and failures (query_id, message).

    A request's author leads to an index page, its titles there to annual pages; only those are read, by `read`, which makes
    raw rows of the pages of some addresses (url); without it raw has them all. An entry that its annual page
    lacks, or places elsewhere, makes the request fail.
    """
    raw = raw.where("source_key = 'locus'")
    index = A.locus_index(raw)
    slug = requests.select("query_id", "title", "author", F.posexplode(_slugs("author")).alias("nth", "slug")).withColumn("page_url", F.concat(F.lit(fixed.LOCUS_ORIGIN), F.url_encode("slug")))
    names = index.select("page_url", "page_name").distinct().withColumn("_s", _folded("page_name"))
    reached = slug.join(names, "page_url").where(F.arrays_overlap(_folded("author"), "_s"))
    reached = first_wins(reached, ["query_id"], ["nth"]).select("query_id", "title", "author", "page_url", "nth")
    first_error = lambda df: df.where("error is not null").groupBy("page_url", "page_role").agg(F.min_by("error", F.struct(*A.ORDER)).alias("message"))
    failed = slug.join(first_error(raw.where("page_role = 'author'")), "page_url").join(reached.select("query_id", F.col("nth").alias("ok")), "query_id", "left").where("ok is null or nth < ok").select("query_id", F.col("nth").alias("at"), "message")
    entries = reached.join(index.where("category is not null and work_title != ''"), "page_url")
    entries = entries.withColumns({"_k": _q_title["dots"]("title"), "_k2": _r_title["dots"]("work_title")}).where(F.arrays_overlap("_k", "_k2"))
    entries = entries.select("query_id", "author", "_k", *A.ORDER, "annual_url", F.col("category").alias("e_category"), F.col("rank").alias("e_rank"), F.col("winner").alias("e_winner"))
    entries = entries.withColumn("entry", F.struct(*A.ORDER))
    if read:
        raw = read(entries.select(F.col("annual_url").alias("url")).distinct())
    annual, broken = _numbered(A.locus_records(raw)), first_error(raw)
    there = raw.where("page_role = 'annual' and error is null").select(F.col("page_url").alias("annual_url")).distinct().withColumn("there", F.lit(True))
    state = entries.join(there, "annual_url", "left").join(broken.where("page_role = 'annual'").select(F.col("page_url").alias("annual_url"), "message"), "annual_url", "left")
    unread = F.coalesce("message", F.when(F.col("there").isNull(), F.format_string(fixed.LOCUS_UNREAD, "annual_url")))
    failed = failed.union(state.where(unread.isNotNull()).select("query_id", F.lit(100), unread))
    good = state.where(unread.isNull())
    linked = annual.withColumns({"_t2": _r_title["dots"]("work_title")}).withColumn("_n", F.explode(F.array_union("match_authors", F.array("work_author")))).withColumn("_nk", _folded("_n"))
    linked = linked.groupBy("rec", "source_url", "category", "rank", "winner", "_t2").agg(F.flatten(F.collect_set("_nk")).alias("_nk"))
    on = (good["annual_url"] == linked["source_url"]) & (good["e_category"] == linked["category"])
    both = good.join(linked, on).where(F.arrays_overlap("_k", "_t2") & F.arrays_overlap(_folded("author"), "_nk")).select("query_id", "entry", "rec", "e_rank", "e_winner", "rank", "winner", "annual_url")
    lost = good.join(both.select("query_id", "entry").distinct(), ["query_id", "entry"], "left_anti")
    failed = failed.union(lost.select("query_id", F.lit(101), F.format_string(fixed.LOCUS_LOST, "annual_url")))
    wrong = F.when(F.col("e_rank").isNotNull() & (F.col("rank") != F.col("e_rank")), F.format_string(fixed.LOCUS_PLACED, F.col("e_rank").cast("string"), F.col("rank").cast("string"), "annual_url"))
    wrong = wrong.when(F.col("e_winner") & ~F.col("winner"), F.format_string(fixed.LOCUS_WON, "annual_url"))
    failed = failed.union(both.where(wrong.isNotNull()).select("query_id", F.lit(102), wrong))
    failures = failed.groupBy("query_id").agg(F.min_by("message", F.struct("at", "message")).alias("message"))
    found = both.select("query_id", "rec").distinct().join(failures.select("query_id"), "query_id", "left_anti")
    return _matched(found, annual).withColumn("status", place_status(F.col("rank"), F.col("winner"))), failures


def _ordered(found: DataFrame, ord_: int, source: Source) -> DataFrame:
    """Result rows of one source: repeats within a request go, places are numbered in the source's order."""
    df = found.withColumns({"_title": _casefold("work_title"), "_author": _casefold("work_author")})
    df = first_wins(df, ["query_id", *source.same], A.ORDER) if source.same else df
    df = df.withColumn("result_ord", F.row_number().over(Window.partitionBy("query_id").orderBy(*source.order())))
    notes = F.when(F.coalesce("tied", F.lit(False)) & F.col("rank").isNotNull(), "tie")
    if "notes" in df.columns:
        notes = F.coalesce("notes", notes)
    return df.withColumns({"source_ord": F.lit(ord_), "source_name": F.lit(source.name), "notes": notes}).select(*RESULT)


@dataclass(frozen=True)
class Source:
    """A place in the registry: how a source's archive is built and checked, and how requests are matched against it.

    `records` makes the archive of the raw rows (null: the source looks into them itself), `contract` gives at most one row with
    what is wrong with it, `match` gives the found records with query_id, and the failures (query_id, message) of single requests or None.
    """

    key: str
    name: str
    error_type: str
    match: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame | None]]
    records: Callable[[DataFrame], DataFrame] | None = None
    contract: Callable[[DataFrame, DataFrame, bool], DataFrame] | None = None
    same: tuple[str, ...] = ()
    order: Callable[[], list] = lambda: A.ORDER
    #: (category_key, address) of pages without which the archive is not whole.
    pages: tuple[tuple[str, str], ...] = ()
    #: Whether the source is made of snapshots at all.
    from_pages: bool = True
    #: The role of pages that are read only where others name them; match is then given the reader of pages as well.
    directed: str | None = None


def _whole_archive(match):
    return lambda requests, records: (match(requests, records), None)


def _locus_order() -> list:
    return [F.coalesce("award_year", F.lit(0)), F.coalesce("category", F.lit("")), F.coalesce("rank", F.lit(0)), "_title"]


def hugo_source(rankings: DataFrame | None = None) -> Source:
    """The source with a ranking table of one's own (award_year, work_title, work_author, rank, source_url, tied) in place of the curated one; a table that cannot stand fails the source."""
    match = lambda requests, records: (hugo_results(requests, records, rankings), None)
    contract = lambda raw, records, _: A.hugo_failures(raw, records) if rankings is None else A.ranking_failure(rankings).unionByName(A.hugo_failures(raw, records))
    return Source("hugo", fixed.NAMES["hugo"], fixed.ERROR_TYPES["hugo"], match, A.hugo_records, contract, _WORK)


_WORK = ("award_year", "category", "status", "_title", "_author", "source_url")
_TYPE = fixed.ERROR_TYPES
#: The sources in the order of their results; a longer tuple can be handed to the lookup.
SOURCES = (
    Source("pulitzer", fixed.NAMES["pulitzer"], _TYPE["pulitzer"], _whole_archive(pulitzer_results), A.pulitzer_records, pages=fixed.PULITZER_CATEGORIES),
    Source("nebula", fixed.NAMES["nebula"], _TYPE["nebula"], _whole_archive(nebula_results), A.nebula_records, lambda raw, r, _: A.nebula_failures(raw, r), ("award_name", *_WORK)),
    hugo_source(),
    Source("locus", fixed.NAMES["locus"], _TYPE["locus"], locus_results, same=("award_year", "category", "_title", "_author", "rank", "source_url"), order=_locus_order, directed="annual"),
    Source("world_fantasy", fixed.NAMES["world_fantasy"], _TYPE["world_fantasy"], _whole_archive(world_fantasy_results), A.fantasy_records, A.fantasy_failures, _WORK),
)


def user_source(key: str, name: str, function: Callable[[str, str, str | None], list[dict]]) -> Source:
    """A source that is a function of (title, author, series) giving rows of results as dicts; what it raises fails that request only."""
    fields = {"work_title": pa.string(), "work_author": pa.string(), "award_name": pa.string(), "award_year": pa.int32(), "category": pa.string(), "status": pa.string(), "rank": pa.int32(), "source_url": pa.string(), "notes": pa.string(), "identity_kind": pa.string()}

    def run(batches):
        for batch in batches:
            rows = []
            for q in batch.to_pylist():
                try:
                    found = [{"identity_kind": "work", **f} for f in function(q["title"], q["author"], q["series"])]
                    rows += [{"query_id": q["query_id"], "rec_ord": i, **{k: f.get(k) for k in fields}} for i, f in enumerate(found)]
                except Exception as e:  # a failure of this request, not of the lookup
                    rows.append({"query_id": q["query_id"], "message": f"{type(e).__name__}: {e}"})
            kinds = {"query_id": batch.schema.field("query_id").type, "rec_ord": pa.int32(), **fields, "message": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], list(kinds))

    def match(requests: DataFrame, _) -> tuple[DataFrame, DataFrame]:
        names = {pa.string(): "string", pa.int32(): "int"}
        own = requests.schema["query_id"].dataType.simpleString()
        rows = requests.mapInArrow(run, f"query_id {own}, rec_ord int, {', '.join(f'{k} {names[t]}' for k, t in fields.items())}, message string")
        found = rows.where("message is null").drop("message").withColumns({"config_ord": F.lit(0), "page_ord": F.lit(0), "tied": F.lit(False)})
        return found, rows.where("message is not null").select("query_id", "message")

    return Source(key, name, "UserSourceError", match, from_pages=False)


_OWN_ROWS = "query_id long, work_title string, work_author string, award_name string, award_year int, category string, status string, rank int, source_url string, notes string, identity_kind string, message string"


def register_source_function(spark, name: str, function: Callable[[str, str, str | None], list[dict]]) -> None:
    """Makes a source that is a function a table function of SQL.

    SELECT * FROM name(TABLE(requests) PARTITION BY query_id), where requests has query_id, title, author and maybe series, or
    SELECT ... FROM requests, LATERAL name(query_id, title, author, series). What the function raises is a row with a message.
    """
    rows = spark.createDataFrame([], _OWN_ROWS).schema
    columns = rows.names

    class OwnSource:
        @staticmethod
        def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
            one = arguments[0]
            given = {f.name for f in one.dataType.fields} if one.isTable else {"query_id", "title", "author"} if len(arguments) >= 3 else set()
            lacking = {"query_id", "title", "author"} - given
            if lacking:
                raise ValueError(f"{name} needs {', '.join(sorted(lacking))}")
            return AnalyzeResult(schema=rows)

        def eval(self, *arguments):
            if len(arguments) == 1:
                asked = arguments[0].asDict()
                query, title, author, series = asked["query_id"], asked["title"], asked["author"], asked.get("series")
            else:
                query, title, author, series = (*arguments, None)[:4]
            try:
                for found in function(title, author, series):
                    row = {"identity_kind": "work", **found, "query_id": query}
                    yield tuple(row.get(c) for c in columns)
            except Exception as e:  # a failure of this request only
                yield tuple({"query_id": query, "message": f"{type(e).__name__}: {e}"}.get(c) for c in columns)

    spark.udtf.register(name, udtf(OwnSource))


class Archives:
    """Snapshots read and checked once, for any number of lookups; raw rows and records are tables in the shared folder, which `close` deletes.

    A source whose archive breaks its contract has a message in `broken`, and no records. Pages of a role that others name are not read
    here: `read` reads those asked for. raw, if given, are the raw rows of the snapshots, read before.
    """

    def __init__(self, snapshots: DataFrame, full_history: bool = True, sources: tuple[Source, ...] = SOURCES, raw: DataFrame | None = None):
        self.sources, self.pages, self.was_read, self.pages_read = sources, snapshots, raw, 0
        late = F.lit(False)
        for s in sources:
            late = late | F.coalesce((F.col("source_key") == s.key) & (F.col("page_role") == s.directed), F.lit(False)) if s.directed else late
        self.late = late
        self.kept = Kept(snapshots.sparkSession, "archives")
        self.raw = self.kept(raw_rows(snapshots.where(~late), self.kept)) if raw is None else raw.where(~late)
        self.records: dict[str, DataFrame] = {}
        self.broken: dict[str, str] = {r["source_key"]: r["message"] for r in A.page_failures(self.raw).collect()}  # one row a source at most
        wanted = [c for s in sources for c, _ in s.pages]
        pages = F.collect_set(F.when(F.col("category_key").isin(*wanted), F.col("category_key"))) if wanted else F.array()
        there = {r["source_key"]: set(r["pages"]) for r in snapshots.where(F.col("source_key").isin(*[s.key for s in sources])).groupBy("source_key").agg(pages.alias("pages")).collect()}
        for source in sources:
            if not source.from_pages:
                continue
            missing = [url for category, url in source.pages if category not in there.get(source.key, ())]
            if source.key not in there:
                self.broken[source.key] = fixed.NO_PAGE.format(name=source.name)
            elif missing:
                self.broken.setdefault(source.key, fixed.PAGE_MISSING.format(name=source.name, url=missing[0]))
            elif source.records and source.key not in self.broken:
                self.records[source.key] = records = self.kept(source.records(self.raw))
                wrong = source.contract(self.raw, records, full_history).first() if source.contract else None
                if wrong is not None:
                    self.broken[source.key] = wrong["message"]

    def read(self, key: str, urls: DataFrame) -> DataFrame:
        """Raw rows of the pages of a source that are read on demand, of the addresses in urls (url, each once); pages_read counts pages.

        They are stored once, as a lookup reads them for its matches and for its failures.
        """
        asked = urls.where("url is not null")
        if self.was_read is not None:
            return self.was_read.where(self.late & (F.col("source_key") == key)).join(asked.withColumnRenamed("url", "page_url"), "page_url", "left_semi")
        seen = Observation()
        rows = self.kept(raw_rows(self.pages.where(self.late & (F.col("source_key") == key)).join(asked, "url", "left_semi").select(*self.pages.columns).observe(seen, F.count(F.lit(1)).alias("pages"))))
        self.pages_read += seen.get["pages"]
        return rows

    def close(self) -> None:
        self.kept.free_all()

    def __enter__(self) -> Archives:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def lookup_awards(requests: DataFrame, snapshots: DataFrame | Archives, full_history: bool = True, on_progress: Callable[[int, int, str | None], None] | None = None, sources: tuple[Source, ...] = SOURCES, once: bool = False) -> Report:
    """Results and failures of all requests over the stored pages, or over Archives opened before.

    A source whose archive breaks its contract, or has no page, gives no results and one failure for each request; the
    others are unaffected. A request with a blank title or author fails alone, and so does a source for a request if one of its results
    breaks the contract of results. on_progress hears (0, n, None), then each source when its results have been computed; they are
    stored for that, as they are with `once`, so results and failures are read from one computation.
    """
    own = not isinstance(snapshots, Archives)
    archives = Archives(snapshots, full_history, sources) if own else snapshots
    requests, unusable = clean_requests(requests)
    tell, count = on_progress or (lambda *_: None), len(archives.sources)
    kept = Kept(requests.sparkSession, "lookup") if on_progress or once else None
    tell(0, count, None)
    results, failures = [], [unusable]
    for at, source in enumerate(archives.sources):
        fail = lambda df, at=at, source=source: df.select("query_id", F.lit(at).alias("source_ord"), F.lit(source.name).alias("source_name"), F.lit(source.error_type).alias("error_type"), "message")
        if source.key in archives.broken:
            failures.append(fail(requests.withColumn("message", F.lit(archives.broken[source.key]))))
        else:
            reader = [lambda urls, key=source.key: archives.read(key, urls)] if source.directed else []
            found, lost = source.match(requests, archives.records.get(source.key, archives.raw), *reader)
            rows = _ordered(found, at, source).withColumn("_wrong", result_violations())
            rows = rows.withColumn("_any", F.max(F.size("_wrong")).over(Window.partitionBy("query_id")))
            if kept:
                rows = kept(rows)
            results.append(rows.where("_any = 0").select(*RESULT))
            wrong = rows.where("size(_wrong) > 0").groupBy("query_id").agg(F.min_by(F.array_join("_wrong", "; "), "result_ord").alias("message"))
            failures += [fail(wrong)] + ([fail(lost)] if lost is not None else [])
        tell(at + 1, count, source.name)
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    if not results:
        empty = requests.limit(0).select("query_id", *[F.lit(None).cast("int" if c in ("source_ord", "result_ord", "award_year", "rank") else "string").alias(c) for c in RESULT[1:]])
        results.append(empty)
    assessed = assess(union(results))
    return Report(assessed.withColumn("preselected", F.col("decision") == "QUALIFIES"), union(failures), (*([kept.free_all] if kept else []), *([archives.close] if own else [])))
