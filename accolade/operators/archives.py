"""Raw rows to award records, source by source, with the contracts that make a source fail as a whole.

Records have the fields of RECORD; failures are (source_key, message). A source with a failure gives no
records at all, the others are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accolade.functions import text as T
from accolade.operators.relational import first_wins, gap_message, gaps, in_order_once, is_shared, without_identities
from accolade.operators.rounds import first_fit, safe_on
from accolade.sources import fixed

ORDER = ["config_ord", "page_ord", "rec_ord"]
RECORD = ["source_key", *ORDER, "award_year", "award_name", "category", "official_category", "status", "rank", "winner", "tied", "work_title", "work_author", "match_titles", "match_authors", "source_url", "identity_kind"]
_casefold = T.text_column(str.casefold)
_fantasy_title = T.text_column(T.title_cleaned)
_name_key = T.text_column(T.name_key)


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_title": _casefold("work_title"), "_author": _casefold("work_author")})


def _plain_records(df: DataFrame) -> DataFrame:
    df = df.withColumns({"match_titles": F.coalesce("match_titles", F.array("work_title")), "match_authors": F.coalesce("match_authors", F.array("work_author"))})
    return df.select(*RECORD)


def _works(raw: DataFrame, key: str) -> DataFrame:
    return raw.where((F.col("source_key") == key) & F.col("error").isNull() & (F.col("identity_kind") != "heading"))


def pulitzer_records(raw: DataFrame) -> DataFrame:
    """First wins inside a page."""
    df = _keyed(_works(raw, "pulitzer"))
    return _plain_records(first_wins(df, ["config_ord", "page_ord", "award_year", "status", "_title", "_author"], ORDER))


def with_known_author(df: DataFrame, table: list[tuple] | tuple = fixed.NEBULA_AUTHORS) -> DataFrame:
    """Fills an empty author from a table of (category, year, page, author); a parsed author always stays."""
    known = df.sparkSession.createDataFrame([tuple(r) for r in table], "category string, award_year int, source_url string, _known string")
    df = df.join(F.broadcast(known), ["category", "award_year", "source_url"], "left")
    return df.withColumn("work_author", F.when(F.coalesce("work_author", F.lit("")) != "", F.col("work_author")).otherwise(F.coalesce("_known", F.lit("")))).drop("_known")


def nebula_records(raw: DataFrame) -> DataFrame:
    """First wins over the pages of a category; rows without an author stay for the contract and match nothing."""
    df = _keyed(with_known_author(_works(raw, "nebula")))
    return _plain_records(first_wins(df, ["award_year", "category", "status", "_title", "_author", "source_url"], ORDER))


def nebula_failures(raw: DataFrame, records: DataFrame) -> DataFrame:
    """Headings without a gap from the first year on, a record for each, and a winner unless that year had no winning work."""
    spark = raw.sparkSession
    rules = spark.createDataFrame([(c, first, list(none)) for _, _, c, _, first, _, none in fixed.NEBULA_ARCHIVES], "category string, first int, exempt array<int>")
    there = raw.where((F.col("source_key") == "nebula") & F.col("error").isNull()).select("category").distinct()
    rules = F.broadcast(rules)
    shown = raw.where((F.col("source_key") == "nebula") & (F.col("identity_kind") == "heading")).select("category", "award_year").distinct()
    span = shown.groupBy("category").agg(F.max("award_year").alias("latest"), F.min("award_year").alias("earliest"))
    facts = rules.join(span, "category", "left").join(there.withColumn("there", F.lit(True)), "category", "left")
    pages = raw.where(F.col("source_key") == "nebula").limit(1).select(F.lit(True).alias("any"))
    none = facts.where("latest is null").join(F.broadcast(pages)).select("category", F.lit(0).alias("stage"), F.concat(F.lit("Nebula "), "category", F.lit(" archive had no year headings")).alias("message"))
    early = facts.where("latest < first").select("category", F.lit(1).alias("stage"), F.concat(F.lit("Nebula "), "category", F.lit(" archive latest year "), F.col("latest").cast("string"), F.lit(" is before first year "), F.col("first").cast("string")).alias("message"))
    expected = facts.where("latest >= first").select("category", "exempt", F.explode(F.sequence("first", "latest")).alias("award_year"))
    lead = lambda s: F.concat(F.lit("Nebula archive was retrieved but "), F.lit(s[0]), "category", F.lit(s[1]))
    checks = [
        gap_message(gaps(expected, shown, ["category", "award_year"]), ["category"], "award_year", lead(("", " year heading(s) were missing: "))).withColumn("stage", F.lit(2)),
        facts.where("earliest < first").select("category", F.concat(F.lit("Nebula "), "category", F.lit(" archive included unexpected year "), F.col("earliest").cast("string")).alias("message"), F.lit(3).alias("stage")),
        gap_message(gaps(expected, records, ["category", "award_year"]), ["category"], "award_year", lead(("no ", " records could be parsed for year "))).withColumn("stage", F.lit(4)),
        gap_message(gaps(expected.where("not array_contains(exempt, award_year)"), records.where("status = 'Winner'"), ["category", "award_year"]), ["category"], "award_year", lead(("no ", " Winner records could be parsed for year "))).withColumn("stage", F.lit(5)),
    ]
    found = none.union(early)
    for c in checks:
        found = found.union(c.select("category", "stage", "message"))
    order = spark.createDataFrame([(c, i) for i, (_, _, c, *_) in enumerate(fixed.NEBULA_ARCHIVES)], "category string, at int")
    # The first category in order, and its first broken rule, speaks for the source.
    return found.join(F.broadcast(order), "category").agg(F.min_by("message", F.struct("at", "stage")).alias("message")).where("message is not null").select(F.lit("nebula").alias("source_key"), "message")


def hugo_records(raw: DataFrame) -> DataFrame:
    df = _keyed(_works(raw, "hugo"))
    return _plain_records(first_wins(df, ["award_year", "category", "status", "_title", "_author", "source_url"], ORDER))


def required_years(years: DataFrame, rules=fixed.HUGO_REQUIRED) -> DataFrame:
    """(rule, category, award_year) that must have records, of the years there are."""
    spark = years.sparkSession
    table = spark.createDataFrame([(i, c, a, b, list(more), list(less)) for i, (c, a, b, more, less) in enumerate(rules)], "rule int, category string, first int, last int, more array<int>, less array<int>")
    y = F.col("award_year")
    holds = ((y >= F.col("first")) & (F.col("last").isNull() | (y <= F.col("last"))) | F.array_contains("more", y)) & ~F.array_contains("less", y)
    return years.select("award_year").distinct().join(F.broadcast(table), holds).select("rule", "category", "award_year")


def hugo_failures(raw: DataFrame, records: DataFrame) -> DataFrame:
    """Every category in every year that must have it, of the years in the collection."""
    years = raw.where((F.col("source_key") == "hugo") & (F.col("identity_kind") == "heading")).select("award_year")
    missing = gaps(required_years(years), records, ["category", "award_year"])
    any_ = records.select("category").distinct().withColumn("any", F.lit(True))
    prefix = F.concat(F.lit("Hugo archive was retrieved but "), "category", F.lit(" records were missing for expected year(s): "))
    told = gap_message(missing, ["rule", "category"], "award_year", prefix).join(any_, "category", "left")
    none = F.concat(F.lit("Hugo archive was retrieved but no "), "category", F.lit(" records could be parsed"))
    message = F.when(F.col("any").isNull(), none).otherwise(F.col("message"))
    return told.agg(F.min_by(message, "rule").alias("message")).where("message is not null").select(F.lit("hugo").alias("source_key"), "message")


def locus_records(raw: DataFrame) -> DataFrame:
    """Annual rows; a shared place is a tie, marked before repeats go and unsupported categories too."""
    df = _works(raw, "locus").where("page_role = 'annual'").withColumn("tied", F.col("tied") | is_shared(["page_url", "category", "rank"]))
    supported = [c.casefold() for c in fixed.LOCUS_SUPPORTED]
    df = _keyed(df.where(_casefold("category").isin(*supported)))
    return _plain_records(first_wins(df, ["page_url", "award_year", "category", "_title", "_author", "rank"], ORDER))


def locus_index(raw: DataFrame) -> DataFrame:
    """Index entries: page_url, page_name, title, category, rank, winner and the annual page they name."""
    df = raw.where("source_key = 'locus' and page_role = 'author' and error is null")
    return df.select("page_url", F.col("work_author").alias("page_name"), *ORDER, "award_year", "category", "rank", "winner", "work_title", F.col("source_url").alias("annual_url"))


def table_works(raw: DataFrame) -> DataFrame:
    """One row a work of a table page: first title and label, authors in order, winner if any of its rows is."""
    df = _works(raw, "world_fantasy").where("official_category is not null").withColumn("title_key", _fantasy_title("work_title"))
    at = F.struct(*ORDER)
    names = in_order_once(at, F.col("work_author"))
    works = df.groupBy("page_role", "award_year", "category", "title_key").agg(
        F.min_by("work_title", at).alias("work_title"), F.min_by("official_category", at).alias("official_category"), F.min_by("source_url", at).alias("source_url"),
        names.alias("authors"), F.when(F.bool_or(F.col("status") == "Winner"), "Winner").otherwise("Nominee").alias("status"), F.min(at).alias("at"),
    )
    return works.select("*", "at.*").drop("at")


def _joined(authors: Column) -> Column:
    last = F.element_at(authors, -1)
    return F.when(F.size(authors) == 1, last).otherwise(F.concat(F.array_join(F.slice(authors, 1, F.size(authors) - 1), ", "), F.lit(" and "), last))


_identity = T.list_column(lambda name: list(dict.fromkeys(k for n in [*T.people(name, "word", "sign"), name] if (k := T.name_key(n)))))


def fantasy_candidates(raw: DataFrame) -> DataFrame:
    """All records that the pages offer, with their merge order and the keys of their authors."""
    tables = table_works(raw).withColumns({"match_authors": F.col("authors"), "work_author": _joined(F.col("authors"))})
    # The winners' table makes winners of all its rows, the nominees' table nominees.
    tables = tables.withColumn("status", F.when(F.col("page_role") == "winners", "Winner").when(F.col("page_role") == "nominees", "Nominee").otherwise(F.col("status")))
    keys = F.array_distinct(F.concat(F.transform("authors", lambda x: x), F.array("work_author")))
    tables = tables.withColumn("name_list", keys)
    annual = _works(raw, "world_fantasy").where("official_category is null").withColumn("title_key", _fantasy_title("work_title"))
    annual = annual.withColumn("author_key", _name_key("work_author"))
    annual = first_wins(annual, ["page_role", "category", "status", "title_key", "author_key"], ORDER)
    annual = annual.withColumns({"match_authors": F.array("work_author"), "name_list": F.array("work_author")})
    columns = ["page_role", *ORDER, "award_year", "category", "official_category", "status", "work_title", "title_key", "work_author", "match_authors", "source_url", "name_list"]
    return tables.select(*columns).unionByName(annual.select(*columns))


def fantasy_records(raw: DataFrame) -> DataFrame:
    """The merged archive.

    Records of one work never cross (year, category, title), so the merge in order runs by that
    key, in groups of any size: a record goes if an author key of its is taken. Nominees and conventions lose a 2012 row whose work stands on the 2013 page: it was filed wrong.
    """
    df = fantasy_candidates(raw)
    named = df.select("*", F.explode("name_list").alias("_name")).withColumn("_keys", _identity("_name"))
    grouped = named.groupBy("page_role", *ORDER, "award_year", "category", "title_key").agg(F.array_distinct(F.flatten(F.collect_list("_keys"))).alias("keys"))
    df = df.drop("name_list").join(grouped, ["page_role", *ORDER, "award_year", "category", "title_key"])
    misfiled = (F.col("award_year") == 2012) & F.col("page_role").isin("nominees", "convention_1982", "convention_1993", "convention_2005")
    df = without_identities(df, ["page_role", *ORDER], misfiled, df.where("page_role = 'annual_2013'"), ["category", "title_key"], "keys")
    merged = first_fit(df, ["award_year", "category", "title_key"], ORDER, "keys").drop("keys")
    return merged.withColumns({"source_key": F.lit("world_fantasy"), "award_name": F.lit("World Fantasy Award"), "match_titles": F.array("work_title"), "identity_kind": F.lit("work"), "rank": F.lit(None).cast("int"), "winner": F.lit(None).cast("boolean"), "tied": F.lit(None).cast("boolean")})


def fantasy_failures(raw: DataFrame, merged: DataFrame, full_history: bool = True) -> DataFrame:
    """The contracts of components, of the merged archive and, if asked, of the master table's years; the first broken one speaks."""
    spark = raw.sparkSession
    works = table_works(raw).select("page_role", "award_year", "category", "official_category", "status")
    annual = _works(raw, "world_fantasy").where("official_category is null").select("page_role", "award_year", "category", "official_category", "status")
    slate = works.unionByName(annual)
    categories = [c for c, _, _ in fixed.WORLD_FANTASY_CATEGORIES]
    need = [(i, f"{role}", c, f"World Fantasy {role} table produced no {c} works", False, False) for i, c in enumerate(categories) for role in ("nominees", "winners")]
    need += [(10 + i, role, c, f"World Fantasy {role[-4:]} convention page did not produce a usable {c} nominee slate", False, True) for role, cs in fixed.CONVENTION_SLATES.items() for i, c in enumerate(cs)]
    need += [(20 + i, f"annual_{y}", c, f"World Fantasy {y} annual page did not produce at least one {c} Winner and at least one Nominee", True, True) for y in (2013, 2024, 2025) for i, c in enumerate(categories)]
    need = spark.createDataFrame(need, "stage int, page_role string, category string, message string, winner boolean, nominee boolean")
    counts = slate.groupBy("page_role", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "Winner").alias("winners"), F.count_if(F.col("status") == "Nominee").alias("nominees"))
    lacking = F.broadcast(need).join(counts, ["page_role", "category"], "left").where("n is null or (winner and winners < 1) or (nominee and nominees < 1)")
    found = lacking.select("stage", F.when(F.col("stage") >= 20, F.concat("message", F.lit(" (winners="), F.coalesce("winners", F.lit(0)).cast("string"), F.lit(", nominees="), F.coalesce("nominees", F.lit(0)).cast("string"), F.lit(")"))).otherwise(F.col("message")).alias("message"), F.lit(0).alias("n"))
    labels = spark.createDataFrame(list(fixed.NOVELLA_LABELS.items()), "award_year int, label string")
    official = lambda df: df.where("category = 'Novella' and official_category is not null").groupBy("award_year").agg(F.array_sort(F.collect_set(F.lower("official_category"))).alias("labels"))
    odd = official(works).join(F.broadcast(labels), "award_year").where("labels != array(label)")
    found = found.union(odd.select(F.lit(30), F.concat(F.lit("World Fantasy official Novella category name for "), F.col("award_year").cast("string"), F.lit(" was "), F.array_join("labels", ", "), F.lit(", expected "), "label"), "award_year"))
    left = merged.where("award_year = 2012").join(annual_2013_titles(raw), ["category", "title_key", "work_author"], "left_semi")
    found = found.union(left.select(F.lit(40), F.concat(F.lit("World Fantasy 2013 correction left a 2012 record for "), "category", F.lit(" "), "work_title"), F.lit(0)))
    expected = spark.createDataFrame([(c, y) for c, first, _ in fixed.WORLD_FANTASY_CATEGORIES for y in (1982, 1993, 2005) if y >= first], "category string, award_year int")
    bare = gaps(expected, merged.where("status = 'Nominee'"), ["category", "award_year"])
    found = found.union(bare.select(F.lit(41), F.concat(F.lit("World Fantasy "), "category", F.lit(" "), F.col("award_year").cast("string"), F.lit(" has no nominee slate")), "award_year"))
    if full_history:
        years = spark.createDataFrame([(i, c, y) for i, (c, first, _) in enumerate(fixed.WORLD_FANTASY_CATEGORIES) for y in range(first, fixed.WORLD_FANTASY_TABLES_THROUGH + 1)], "at int, category string, award_year int")
        missing = gaps(years, works.where("page_role = 'winners' and status = 'Winner'"), ["category", "award_year"])
        told = missing.groupBy("at", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list("award_year")), lambda y: y.cast("string")), ", ").alias("years"))
        found = found.union(told.select(F.col("at") + 50, F.concat(F.lit("World Fantasy "), "category", F.lit(" winners are missing required master-table years: "), "years"), F.lit(0)))
        unset = F.broadcast(labels).join(official(works.where("page_role = 'winners'")), "award_year", "left").where("labels is null or labels != array(label)")
        found = found.union(unset.select(F.lit(60), F.concat(F.lit("World Fantasy winners table did not establish "), "label", F.lit(" for Novella-slot "), F.col("award_year").cast("string")), "award_year"))
    return found.agg(F.min_by("message", F.struct("stage", "n", "message")).alias("message")).where("message is not null").select(F.lit("world_fantasy").alias("source_key"), "message")


def annual_2013_titles(raw: DataFrame) -> DataFrame:
    return _works(raw, "world_fantasy").where("page_role = 'annual_2013'").select("category", _fantasy_title("work_title").alias("title_key"), "work_author").distinct()


def ranking_problems(rankings: DataFrame) -> DataFrame:
    """Rows of a ranking table (award_year, work_title, work_author, rank, source_url, tied) that cannot stand, and why.

    A row lacks a field, has a year or rank that is not positive, ranks what is no work, ranks a work again, or shares its rank with one that is not
    tied. Ties of unknown state are none.
    """
    name = lambda c: _casefold(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^(?U)\s+", ""), r"(?U)\s+$", ""))
    df = rankings.withColumns({"_title": name("work_title"), "_author": name("work_author")})
    same = df.groupBy("award_year", "_title", "_author").agg((F.count(F.lit(1)) > 1).alias("_twice")).alias("w")
    rank = df.groupBy("award_year", "rank").agg(((F.count(F.lit(1)) > 1) & ~F.bool_and(F.coalesce("tied", F.lit(False)))).alias("_untied")).alias("r")
    df = df.alias("d").join(same, safe_on("d", "w", ["award_year", "_title", "_author"])).join(rank, safe_on("d", "r", ["award_year", "rank"])).select("d.*", "_twice", "_untied")
    problem = None
    for broken, what in (
        (~F.coalesce(F.col("award_year") > 0, F.lit(False)), "award_year is not positive"), (F.col("_title") == "", "work_title is blank"), (F.col("_author") == "", "work_author is blank"),
        (~F.coalesce(F.col("rank") > 0, F.lit(False)), "rank is not positive"), (F.trim(F.coalesce("source_url", F.lit(""))) == "", "source_url is blank"),
        (F.col("_title").isin(*fixed.NO_WORKS) | F.col("_author").isin(*fixed.NO_WORKS), "what is ranked is no work"), (F.col("_twice"), "work ranked twice"), (F.col("_untied"), "shared rank without a tie"),
    ):
        problem = F.when(broken, what) if problem is None else problem.when(broken, what)
    return df.withColumn("problem", problem).where("problem is not null").select("award_year", "work_title", "work_author", "rank", "problem")


def ranking_failure(rankings: DataFrame) -> DataFrame:
    """At most one row (source_key, message): the first problem of a ranking table."""
    told = F.format_string(fixed.RANKING_BROKEN, F.coalesce(F.col("award_year").cast("string"), F.lit("-")), F.coalesce("work_title", F.lit("-")), "problem")
    first = ranking_problems(rankings).agg(F.min_by(told, F.struct("award_year", "rank", "work_title", "problem")).alias("message"))
    return first.where("message is not null").select(F.lit("hugo").alias("source_key"), "message")


def page_failures(raw: DataFrame) -> DataFrame:
    """The first page error of each source that fails as a whole; the index-directed one fails by request."""
    bad = raw.where("error is not null and source_key != 'locus'")
    return bad.groupBy("source_key").agg(F.min_by("error", F.struct(*ORDER)).alias("message"))
