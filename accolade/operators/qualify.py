"""Policies, decisions and placements."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accolade.operators.matching import Rules, rules_table, with_rule
from accolade.operators.relational import year_in_range
from accolade.sources import fixed

RESULT = "work_title string, work_author string, award_name string, award_year int, category string, status string, rank int, source_name string, source_url string, notes string, identity_kind string"


def fold(c: Column) -> Column:
    """Case folding by upper and lower case, so what has several small forms gets one; ß is ss. Ligatures and the dotless i stay apart from Unicode's full folding."""
    return F.translate(F.lower(F.upper(F.regexp_replace(c, "[ßẞ]", "ss"))), "ς", "σ")


def folded(c: Column) -> Column:
    """Trimmed and folded, for names of awards, categories and statuses."""
    return fold(F.regexp_replace(F.regexp_replace(c, r"^(?U)\s+", ""), r"(?U)\s+$", ""))


def blank(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"(?U)\s+", "") == "", F.lit(True))


def result_violations() -> Column:
    """What a result row breaks of its contract, as an array."""
    checks = [F.when(blank(F.col(c)), F.lit(f"{c} is blank")) for c in ("work_title", "work_author", "award_name", "status", "source_name")]
    checks += [F.when(F.col("rank") <= 0, "rank is not positive"), F.when(F.col("award_year") <= 0, "award_year is not positive"), F.when(~F.coalesce(F.col("identity_kind").isin("work", "series"), F.lit(False)), "identity_kind is unknown")]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def policies(rows=fixed.POLICIES) -> Column:
    """The policy table as a constant array; a row that contradicts itself, or two that one result could fall under, are a ValueError.

    A handful of fixed rows needs no join: the range condition is tested in place, without a shuffle.
    """
    out, told = [], []
    for award, category, start, end, good, bad, notes in rows:
        good, bad = ({s.strip().casefold() for s in x} for x in (good, bad))
        years = [y for y in (start, end) if y is not None]
        if not award.strip() or good & bad or "" in good | bad or min(years, default=1) <= 0 or years != sorted(years):
            raise ValueError(f"contradictory policy for {award!r}")
        sets = [F.array(*[F.lit(s) for s in sorted(x)]).cast("array<string>").alias(n) for x, n in ((good, "qualifying"), (bad, "nonqualifying"))]
        told.append((award.strip().casefold(), category and category.strip().casefold(), start, end))
        out.append(F.struct(F.lit(award.strip().casefold()).alias("award"), F.lit(category and category.strip().casefold()).cast("string").alias("category"), F.lit(start).cast("int").alias("start"), F.lit(end).cast("int").alias("end"), *sets))
    for (award, category, first, last), (other, kind, begin, end) in combinations(told, 2):
        apart = None not in (category, kind) and category != kind or None not in (last, begin) and last < begin or None not in (end, first) and end < first
        if award == other and not apart:
            raise ValueError(f"overlapping policies for {award!r}")
    return F.array(*out)


def policy_rules(policies: DataFrame) -> Rules:
    """Any number of policies as a checked table of rules: rows of (award_name, category, start, end, qualifying, nonqualifying).

    A null category holds for any, null years are open. A policy that contradicts itself and two policies that
    one result could fall under are a ValueError, before any result is read.
    """
    names = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), folded))
    table = policies.select(folded(F.col("award_name")).alias("_award"), folded(F.col("category")).alias("_category"), "start", "end", names("qualifying").alias("qualifying"), names("nonqualifying").alias("nonqualifying"))
    unclear = blank(F.col("_award")) | F.arrays_overlap("qualifying", "nonqualifying") | F.array_contains(F.concat("qualifying", "nonqualifying"), "") | (F.least("start", "end") <= 0)
    wrong = table.where(unclear).limit(1).collect()
    if wrong:
        raise ValueError(f"contradictory policy: {wrong[0].asDict()}")
    return rules_table(table, ["_award", "_category"], "start", "end", ["_category"])


def with_policy(results: DataFrame, table: Column | Rules) -> DataFrame:
    """Each result with the status sets of the policy whose award, category and year range it falls in."""
    award, category, year = folded(F.col("award_name")), folded(F.col("category")), F.col("award_year")
    if isinstance(table, Rules):
        found = with_rule(results.withColumns({"_award": award, "_category": category}), table, "award_year")
        return found.withColumns({"qualifying": F.col("rule.qualifying"), "nonqualifying": F.col("rule.nonqualifying")}).drop("rule", "_award", "_category")
    found = F.filter(table, lambda p: (p["award"] == award) & F.coalesce(p["category"].isNull() | (p["category"] == category), F.lit(False)) & year_in_range(year, p["start"], p["end"]))
    one = F.get(found, F.lit(0))
    return results.withColumn("_policy", one).withColumns({"qualifying": F.col("_policy.qualifying"), "nonqualifying": F.col("_policy.nonqualifying")}).drop("_policy")


def _cascade() -> list[tuple[Column, str, str]]:
    status = folded(F.col("status"))
    has = lambda c: F.coalesce(F.array_contains(c, status), F.lit(False))
    return [
        (F.col("rank").between(1, 5), "QUALIFIES", "rank_in"),
        (F.col("rank") > 5, "DOES_NOT_QUALIFY", "rank_out"),
        (status.isin(*fixed.WINNING), "QUALIFIES", "won"),
        (has("qualifying"), "QUALIFIES", "policy_in"),
        (has("nonqualifying"), "DOES_NOT_QUALIFY", "policy_out"),
        (status.isin(*fixed.AMBIGUOUS), "REVIEW", "ambiguous"),
    ]


def decide(df: DataFrame) -> DataFrame:
    """Adds decision and reason to rows with rank, status and a policy's sets; the first rule that holds counts."""
    decision = reason = None
    for when, what, why in _cascade():
        decision = F.when(when, what) if decision is None else decision.when(when, what)
        reason = F.when(when, fixed.REASONS[why]) if reason is None else reason.when(when, fixed.REASONS[why])
    return df.withColumns({"decision": decision.otherwise("REVIEW"), "reason": reason.otherwise(fixed.REASONS["unknown"])})


def assess(results: DataFrame, table: Column | Rules | None = None) -> DataFrame:
    return decide(with_policy(results, policies() if table is None else table)).drop("qualifying", "nonqualifying")


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def place_status(rank: Column, winner: Column) -> Column:
    return F.when(winner, "Winner").otherwise(F.concat(ordinal(rank), F.lit(" place")))
