"""The award engine on small invented pages, and its text forms against their plain definitions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from accolade.functions import text as T
from accolade.plans.lookup import lookup_awards
from accolade.sources import fixed, pages
from accolade.sources.snapshots import SNAPSHOT, collection, decode, is_challenge, next_page, snapshot_of


def plain_title_match(a, b):
    if a == b:
        return True
    if (":" in a) == (":" in b):
        return False
    x, y = (s.split(":", 1)[0].strip() for s in (a, b))
    return bool(x) and x == y


def test_title_keys_are_the_predicate():
    r = random.Random(1)
    for _ in range(30_000):
        a, b = ("".join(r.choice("ab :") for _ in range(r.randint(0, 4))).strip() for _ in range(2))
        assert bool(set(T.title_keys(a, True)) & set(T.title_keys(b, False))) == plain_title_match(a, b), (a, b)


def test_forms():
    assert T.title_basic("R&B  & “Soul”") == 'r&b and "soul"'
    assert T.plain("J. R. Moss") == "j.r.moss"
    assert T.title_marked("The 'Long' Half-Life…") == 'the "long" half life...'
    assert T.title_cleaned("“Quiet Tide”,</em>") == "quiet tide"
    assert [T.series_name(x) for x in ("The Tide Books Series", "Series", "The Series")] == ["tide", "series", "series"]
    assert T.listed_people("Ann Ode, Jr., Bo Pax, and Cy Quo") == ["Ann Ode, Jr.", "Bo Pax", "Cy Quo"]
    assert T.listed_people("Ann Ode with Bo Pax") == [] and T.query_people("A && B & C") == ["A & B", "C"]
    assert T.related_people("Ann Ode and Bo Pax, eds.") == ["ann ode", "bo pax"] and T.related_people("Ode and Pax") == []
    assert T.credited_names("Ann Ode (as A. O.), translated by Bo Pax")[-1] == "ann ode"
    assert T.slugs("José O'Tide, Jr.") == ["Jose_OTide_Jr", "José_OTide_Jr"]
    assert T.join_names(["A", "B", "C"]) == "A, B and C"


def test_readers():
    assert pages.hugo_work("“Moth Song,” by Ann Ode (Mag)", "", "", False) == ("Moth Song,", "Ann Ode")
    assert pages.hugo_work("The Isle”, Bo Pax (Mag)", "", "The Isle”, Bo Pax (Mag)", True) == ("The Isle", "Bo Pax")
    assert pages.hugo_series("Tide Saga, by Ann Ode (Press)") == ("Tide Saga", "Ann Ode") and pages.hugo_series("No Award") is None
    assert pages.hugo_titles("Tide (alt: Ebb)") == ["Tide", "Tide (alt: Ebb)", "Ebb"]
    assert pages.is_ballot_note("(1,200 final ballots, 900 nominating ballots)") and not pages.is_ballot_note("Best Novel")
    assert pages.fantasy_story("Winner: “Moon,” Ann Ode (Book)") == ("Moon,", "Ann Ode") and pages.fantasy_story("“A” and “B” Ann Ode") is None
    assert pages.locus_index_category("Tide (Press) — Other — a first novel — x", "Tide") == "first novel" and pages.locus_index_category("Tide", "Tide") == ""
    assert pages.locus_index_category("Tide — Horror/Dark Fantasy Novel — 2nd place", "Tide") == "Horror/Dark Fantasy Novel"
    assert pages.locus_authors(["A", "B"], "A translated by B") == ["A"]
    assert decode(b"\x93x\x94", "world_fantasy", {}) == "“x”" and decode(b"\xe9", "locus", {"Content-Type": "text/html; charset=latin-1"}) == "é"
    assert all(is_challenge(f"<p>{mark.upper()}</p>") for mark in fixed.CHALLENGE_MARKS) and not is_challenge("<script src='/cdn-cgi/challenge-platform/x.js'>") and next_page('<link href="/p2" rel="next">') == "/p2"
    for body, headers, part in (("{", {}, "not valid JSON"), ("{}", {}, "not a list"), ("[]", {}, "empty"), ('[{"title":{"rendered":"a"},"link":"l","content":{"rendered":"c"}}]', {"X-WP-Total": "2"}, "1 != 2"), ('[{"title":{"rendered":"a"},"link":"l"}]', {}, "usable content.rendered")):
        with pytest.raises(ValueError, match=part):
            collection(body, headers)


def rows_of(spark, *snapshots):
    from accolade.sources.snapshots import raw_rows

    return raw_rows(spark.createDataFrame(list(snapshots), SNAPSHOT)).orderBy("page_url", "rec_ord").collect()


def test_pages_by_elements(spark):
    """Years carried forward from links before and inside, emphasised titles, nested and unclosed elements, citations of no work."""
    html = """<h2>Early, by No Year</h2><a href="/prize-winners-by-year/1990">1990</a><h2><em>Low</em> <b><em>Tide <em>II</em></em></b>, by Ann Ode (Press)</h2>
    <div class="x finalist-title">High\n Tide, by Bo Pax<p>unclosed</div><div class="finalist-title">High Tide, by Bo Pax</div>
    <div class="winner-citation"><a href="/prize-winners-by-year/1991?x">n</a><h2>Hidden, by Nobody</h2>No award</div><em>Stray</em>
    <h2>A, by B, by C <a href="/prize-winners-by-year/1992/">1992</a></h2><h2>No Award</h2><h2>Titled only</h2><div class="finalist-title winner-citation">X, by Y</div><h2> Last , BY  D\u00a0E (P) (Q)</h2>"""
    other = "<a href='/prize-winners-by-year/2001'></a><h2>Other, by Zed</h2>"
    category = fixed.PULITZER_CATEGORIES[0][0]
    got = rows_of(spark, snapshot_of("pulitzer", "category", category, 0, "u", html), snapshot_of("pulitzer", "category", fixed.PULITZER_CATEGORIES[1][0], 0, "v", other), snapshot_of("pulitzer", "category", "Unknown", 0, "w", other), snapshot_of("pulitzer", "category", category, 1, "x", "", 500))
    assert [(r["award_year"], r["status"], r["work_title"], r["work_author"], r["category"]) for r in got if not r["error"]] == [
        (1990, "Winner", "LowTide II", "Ann Ode", category), (1990, "Finalist", "High Tide", "Bo Paxunclosed", category), (1990, "Finalist", "High Tide", "Bo Pax", category),
        (1992, "Winner", "A", "B, by C 1992", category), (1992, "Winner", "Last", "D E", category), (2001, "Winner", "Other", "Zed", fixed.PULITZER_CATEGORIES[1][0]),
    ]
    assert [(r["page_url"], r["config_ord"]) for r in got if not r["error"]][-2:] == [("u", 0), ("v", 1)] and sorted(r["page_url"] for r in got if r["error"]) == ["w", "x"]


def test_lists_by_elements(spark):
    key = fixed.NEBULA_ARCHIVES[0][0]
    item = lambda *x: "<li>" + "".join(x) + "</li>"
    html = "<ul class='award_list'>" + item("<em>Early</em> Winner, Best Novel in 1990") + "</ul><h2> 1990 </h2><ul class='x award_list y'>" + item(
        "<a href='/nominated-work/low/'>“Low Tide”</a> <a href='/nominees/a'>Ann  Ode</a>, <a href='/nominees/b'> </a><a href='/nominees/b'>Bo Pax</a> WINNER, Best\u00a0Novel in 1990"
    ) + item("<em>High <em>Tide</em>, by Cy Quo (Press)</em> Nominated for x, Best Novel<ul class='award_list'><li>Inner</li></ul>") + item("<em>Odd</em> starred") + item("<em>No Award</em> Winner, Best Novel in 1990") + item("<em>Late</em> Winner, Best Novel")
    html += "</ul><h2>Not 1991</h2><ul>" + item("<em>Plain</em> Winner, Best Novel in 1990") + "</ul><ul class='award_list'><p><li><a href='rel'>x</a><a href='/nominated-work/mid'>Mid, by D E</a> Winner, Best Novel in 1990<li>"
    got = rows_of(spark, snapshot_of("nebula", "archive", key, 0, "u", html))
    assert [(r["award_year"], r["identity_kind"]) for r in got if r["identity_kind"] == "heading"] == [(1990, "heading")]
    assert [(r["award_year"], r["status"], r["work_title"], r["work_author"], r["source_url"]) for r in got if r["identity_kind"] == "work"] == [
        (1990, "Winner", "Low Tide", "Ann Ode and Bo Pax", "https://nebulas.sfwa.org/nominated-work/low/"), (1990, "Nominated", "High Tide", "Cy Quo", None), (1990, "Winner", "Mid", "D E", "https://nebulas.sfwa.org/nominated-work/mid"),
    ]
    marks = spark.createDataFrame([("Nominated for Best Novel in 2015, Winner, Andre Norton Award in 2015",), ("Winner, Best Novel",)], "t string")
    from accolade.sources.readers import marked_status

    assert [tuple(r) for r in marks.select(marked_status(F.col("t"), ("Best Novel",), False), marked_status(F.col("t"), ("Best Novel",), True)).collect()] == [("Nominated", "Nominated"), (None, "Winner")]


def test_tables_by_elements(spark):
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}" + "</td>" * (i % 2) for i, c in enumerate(cells)) + "</tr>"
    lines = [
        ("Ann", "Ode", "1990", "Novel", "Low <i>Tide</i>", "Winner"), ("Ann", "Ode", "1990", "Novel", "The Winner", ""), ("Ann", "Ode", "1990", "Novel", "Low Tide Winner", ""), ("Ann", "Ode", "1990", "Novel", "Low Tide", "Other"),
        ("Bo", "Pax", " 1991 ", "NOVEL", "Low Tide Winner", " nominee "), ("Bo", "Pax", "1991", "Novel", "High Tide\tnominee"), ("Bo", "Pax", "1991", "Novel", "Winner"), ("Bo", "Pax", "1991", "Novel", "“Moon”,  WINNER "),
        ("Bo", "Pax", "1991", "Novel", "", "Winner"), ("Bo", "Pax", "1991", "Other", "X", "Winner"), ("", " ", "1991", "Novel", "X", "Winner"), ("Bo", "Pax", "199", "Novel", "X", "Winner"), ("Bo", "Pax", "0000", "Novel", "X", "Winner"),
        ("Bo", "Pax", "1991", "Novel"), ("", "Pax", "2017", "Long Fiction", "Y", "Winner", "more"), ("First Name", "L", "1991", "Novel", "X", "Winner"),
    ]
    table = "<table><tr><th>First name</th></tr><tr></tr>" + "".join(row(*x) for x in lines)
    role, url = next((role, url) for role, url, year in fixed.WORLD_FANTASY_PAGES if year is None)
    good = snapshot_of("world_fantasy", role, None, 0, url, "<p>x</p>" + table + "</table><table>" + row("Second", "Table", "1990", "Novel", "X", "Winner") + "</table>")
    bad = snapshot_of("world_fantasy", role, None, 1, url + "2", table + row("Bo", "Pax", "2010", "long fiction", "Z", "Winner") + row(*lines[0]) + "</table>")
    want = [("Ann Ode", 1990, "Novel", "Low Tide", "Winner"), ("Bo Pax", 1991, "Novel", "Low Tide Winner", "Nominee"), ("Bo Pax", 1991, "Novel", "High Tide", "Nominee"), ("Bo Pax", 1991, "Novel", "Moon", "Winner"), ("Pax", 2017, "Novella", "Y", "Winner")]
    got = rows_of(spark, good, bad)
    told = lambda at: [(r["work_author"], r["award_year"], r["category"], r["work_title"], r["status"]) for r in got if r["page_url"] == at and not r["error"]]
    assert told(url) == told(url + "2") == want
    assert [(r["page_url"], r["error"]) for r in got if r["error"]] == [(url + "2", fixed.LONG_FICTION_OUTSIDE % 2010)] and got[-1]["error"]


def nebula_page(award, years, rows):
    return "".join(f'<h2>{y}</h2><ul class="award_list">' + "".join(f'<li><a href="/nominated-work/{t}/"><em>{t}</em></a> <a href="/nominees/x/">{a}</a> {s}, {award} in {y}</li>' for t, a, s in rows.get(y, [("Other", "Zed Zed", "Winner")])) + "</ul>" for y in years)


def fantasy_tables():
    head = "<table><tr><th>First Name</th><th>Last Name</th><th>Year</th><th>Category</th><th>Title</th><th>Final</th></tr>"
    row = lambda first, last, y, c, t, s: f"<tr><td>{first}</td><td>{last}</td><td>{y}</td><td>{c}</td><td>{t}</td><td>{s}</td></tr>"
    label = lambda c, y: "Long Fiction" if c == "Novella" and y in (2016, 2017, 2018) else c
    winners = head + "".join(row("Win", f"{c}{y}".replace(" ", ""), y, label(c, y), f"{c} of {y}", "Winner") for c, first, _ in fixed.WORLD_FANTASY_CATEGORIES for y in range(first, 2024)) + "</table>"
    nominees = head + "".join(row("Nom", c.replace(" ", ""), 1990, c, f"Nominee {c}", "Nominee") for c, _, _ in fixed.WORLD_FANTASY_CATEGORIES)
    nominees += row("Ann", "Ode", 1991, "Novel", "Shared Omen", "Nominee") + row("Bo", "Pax", 1991, "Novel", "Shared Omen", "Nominee") + row("Misfiled", "Author", 2012, "Novel", "Late Book", "Nominee") + "</table>"
    pages_ = [("winners", winners), ("nominees", nominees)]
    for role, slate in fixed.CONVENTION_SLATES.items():
        pages_.append((role, head + "".join(row("Con", "Nominee", role[-4:], c, f"Slate {c} {role[-4:]}", "Nominee") for c in fixed.CONVENTION_SLATES["convention_1993"]) + "</table>"))
    cite = lambda c, t, a: f"“{t}” {a} (Book)" if c == "Short Fiction" else f"{t} by {a} (Press)"
    pages_.append(("annual_2013", "".join(f"<h3>{c}</h3><ul><li><strong>{cite(c, 'Top ' + c, 'Win Ner')}</strong></li><li>{cite(c, 'Late Book' if c == 'Novel' else 'Low ' + c, 'Misfiled Author')}</li></ul>" for c, _, _ in fixed.WORLD_FANTASY_CATEGORIES)))
    pages_.append(("annual_2024", "".join((f"<p>{c}</p>" if c == "Collection" else f"<h4>{c}</h4>") + f"<p>Winner: {cite(c, 'Prize ' + c, 'Win Ner')}</p><p>{cite(c, 'Prize ' + c, 'Win Ner')}</p><p>{cite(c, 'Near ' + c, 'Nom Inee')}</p>" for c, _, _ in fixed.WORLD_FANTASY_CATEGORIES)))
    pages_.append(("annual_2025", "".join(f"<p>{c}</p><ul><li>Winner: {cite(c, 'Best ' + c, 'Win Ner')}</li><li>{cite(c, 'Next ' + c, 'Nom Inee')}</li></ul>" for c, _, _ in fixed.WORLD_FANTASY_CATEGORIES)))
    urls = {role: url for role, url, _ in fixed.WORLD_FANTASY_PAGES}
    return [snapshot_of("world_fantasy", role, None, 0, urls[role], html) for role, html in pages_]


@pytest.fixture(scope="module")
def snapshots(spark):
    rows = [snapshot_of("pulitzer", "category", c, 0, u, f'<a href="/prize-winners-by-year/1988/">1988</a><h2>Low Tide, by Ann Ode (Press)</h2><div class="finalist-title">High Tide: A Novel, by Bo Pax (P)</div>' if c == "Fiction" else "<p>nothing</p>") for c, u in fixed.PULITZER_CATEGORIES]
    labels = {k: ls for k, _, _, ls, *_ in fixed.NEBULA_ARCHIVES}
    for k, _, _, ls, first, *_ in fixed.NEBULA_ARCHIVES:
        works = {2015: [("Low Tide", "Ann Ode", "Winner"), ("Duo", "Ann Ode, Bo Pax", "Winner")]} if k == "best-novel" else {}
        rows.append(snapshot_of("nebula", "archive", k, 0, f"{fixed.NEBULA_ORIGIN}{k}/", nebula_page(labels[k][0], range(first, 2026), works)))
    hugo = "<p><strong>Best Novel</strong> <br>(1,200 final ballots, 900 nominating ballots)</p>"
    item = "<ul><li class='winner'><em>Low Tide</em>, by Ann Ode (Press)</li><li><em>Starter Villain</em>, by John Scalzi (Tor)</li><li>No Award</li></ul>"
    others = "".join(f"<p><strong>{c}</strong></p><ul><li class='winner'>“W {c}”, by Win Ner (X)</li></ul>" for c in ("Best Novella", "Best Novelette", "Best Short Story"))
    series = "<p><strong>Best Series</strong></p><ul><li class='winner'>The Tide Saga, by Ann Ode (Press)</li></ul>"
    items = [{"title": {"rendered": "2024 Hugo Awards"}, "link": "https://h/2024", "content": {"rendered": hugo + item + others + series}}, {"title": {"rendered": "About"}, "link": "https://h/a", "content": {"rendered": "x"}}]
    rows.append(snapshot_of("hugo", "archive", None, 0, "https://h/json", json.dumps(items), headers={"X-WP-Total": "2", "X-WP-TotalPages": "1"}))
    author = '<div class="pagetitle">Ann Ode</div><div class="awardlistingsectionheader">Locus Awards and Poll</div><div class="dateleftindent"><a href="/Locus_Awards_1990">1990</a></div><div class="titlemid"><b>Low Tide</b> — Sf Novel — 6th place</div>'
    rows.append(snapshot_of("locus", "author", None, 0, "https://www.sfadb.com/Ann_Ode", author))
    rows.append(snapshot_of("locus", "author", None, 0, "https://www.sfadb.com/Bo_Pax", author.replace("Ann Ode", "Bo Pax").replace("6th", "2nd")))
    annual = '<div class="categoryblock"><div class="category">Sf Novel</div><ol><li value="1"><span class="winner">W</span> <b>Top</b> <a href="/x">Win Ner</a></li><li value="6"><b>Low Tide</b>, <a href="/a">Ann Ode</a></li><li value="6"><b>Low Tide</b>, <a href="/b">Bo Pax</a></li></ol></div>'
    rows.append(snapshot_of("locus", "annual", None, 0, "https://www.sfadb.com/Locus_Awards_1990", annual))
    return spark.createDataFrame(rows + fantasy_tables(), SNAPSHOT)


REQUESTS = [(1, " Low Tide ", "Ann Ode", "Tide Saga series"), (2, "High Tide", "Bo Pax", None), (3, "Starter Villain", "John Scalzi", " "), (4, "Shared Omen", "bo pax", None), (5, "Late Book", "Misfiled Author", None), (6, "Duo", "Ann Ode & Bo Pax", None), (7, "Duo", "Bo Pax & Ann Ode", None), (8, "Low Tide", "Bo Pax", None), (9, "Nothing", "No One", None)]


def test_lookup(spark, snapshots):
    from accolade.operators.present import formatted, report

    requests = spark.createDataFrame(REQUESTS, "query_id long, title string, author string, series string")
    told = []
    got = lookup_awards(requests, snapshots, on_progress=lambda *x: told.append(x))
    rows = got.results.withColumn("line", formatted()).orderBy("query_id", "source_ord", "result_ord").collect()
    lines = {}
    for r in rows:
        lines.setdefault(r["query_id"], []).append((r["line"], r["decision"]))
    assert lines[1] == [
        ("Winner - 1988 Pulitzer Prize - Fiction", "QUALIFIES"), ("Winner - 2015 Nebula Award - Best Novel", "QUALIFIES"), ("Winner - 2024 Hugo Award - Best Novel", "QUALIFIES"),
        ("Winner - 2024 Hugo Award - Best Series [The Tide Saga]", "QUALIFIES"), ("6th - 1990 Locus Award - Sf Novel", "DOES_NOT_QUALIFY"),
    ]
    assert lines[2] == [("Finalist - 1988 Pulitzer Prize - Fiction", "QUALIFIES")]
    assert lines[3] == [("6th - 2024 Hugo Award - Best Novel", "DOES_NOT_QUALIFY")]
    assert lines[4] == [("Nominee - 1991 World Fantasy Award - Novel", "REVIEW")]
    assert lines[5] == [("Nominee - 2013 World Fantasy Award - Novel", "REVIEW")]
    assert lines[6] == [("Winner - 2015 Nebula Award - Best Novel", "QUALIFIES")]
    assert set(lines) == {1, 2, 3, 4, 5, 6}
    assert next(r for r in rows if r["query_id"] == 1 and r["award_name"] == "Locus Award")["notes"] == "tie"
    assert next(r for r in rows if r["query_id"] == 3)["source_url"] == fixed.HUGO_STATISTICS[2024]
    failures = got.failures.collect()
    assert [(f["query_id"], f["error_type"]) for f in failures] == [(8, "LocusSourceError")] and "disagreed" in failures[0]["message"]
    assert told[0] == (0, 5, None) and len(told) == 6
    texts = {r["query_id"]: r["text"] for r in report(got.results, got.failures, requests).collect()}
    assert texts[9] == "No award results found." and texts[8].startswith("Source problems:\n\nScience Fiction Awards Database — LocusSourceError — ")


def test_a_broken_source_fails_alone(spark, snapshots):
    cut = snapshots.where("not (source_key = 'nebula' and category_key = 'best-novel') and not (source_key = 'world_fantasy' and page_role = 'annual_2024')")
    bad = spark.createDataFrame([snapshot_of("hugo", "archive", None, 0, "https://h/json", "[]")], SNAPSHOT)
    got = lookup_awards(spark.createDataFrame(REQUESTS[:1], "query_id long, title string, author string, series string"), cut.where("source_key != 'hugo'").union(bad))
    assert [r["source_name"] for r in got.results.orderBy("source_ord").collect()] == ["Pulitzer Prizes", "Science Fiction Awards Database"]
    messages = {f["source_name"]: f["message"] for f in got.failures.collect()}
    assert set(messages) == {"Nebula Awards", "Hugo Awards", "World Fantasy Awards"}
    assert "had no year headings" in messages["Nebula Awards"] and "list was empty" in messages["Hugo Awards"] and "2024 annual page" in messages["World Fantasy Awards"]


def test_missing_pages_and_odd_requests(spark, snapshots):
    one = snapshots.where(F.col("category_key") == fixed.PULITZER_CATEGORIES[0][0])
    requests = spark.createDataFrame([(1, "Low Tide", "Ann Ode", None), (2, " ", "Ann Ode", None), (3, "X", None, None)], "query_id long, title string, author string, series string")
    got = lookup_awards(requests, one)
    assert got.results.count() == 0
    failures = sorted((f["query_id"], f["source_ord"], f["message"]) for f in got.failures.collect())
    assert [f[:2] for f in failures] == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, -1), (3, -1)]
    assert fixed.PULITZER_CATEGORIES[1][1] in failures[0][2] and failures[1][2] == fixed.NO_PAGE.format(name="Nebula Awards") and "author" in failures[-1][2]
    # A page that no reader knows fails its source only, whatever it raises.
    odd = spark.createDataFrame([("pulitzer", "category", "Unheard", 0, "http://u", 200, {}, b"x"), (None, None, None, None, None, None, None, None)], SNAPSHOT)
    report = lookup_awards(requests.limit(1), snapshots.where("source_key = 'pulitzer'").union(odd))
    assert "could not be read" in next(f["message"] for f in report.failures.collect() if f["source_ord"] == 0)


def test_user_sources(spark, snapshots):
    from accolade.plans.lookup import SOURCES, Archives, user_source

    def find(title, author, series):
        if title == "Bad":
            raise LookupError("no luck")
        return [{"work_title": title, "work_author": author, "award_name": "Own Prize", "award_year": 2000, "category": "Any", "status": "Winner"}, {"work_title": title, "work_author": author, "award_name": " " if title == "Odd" else "Own Prize", "status": "Finalist", "award_year": 2001}]

    requests = spark.createDataFrame([(1, "Good", "A", None), (2, "Bad", "A", None), (3, "Odd", "A", None)], "query_id long, title string, author string, series string")
    with Archives(snapshots.where("source_key = 'pulitzer'"), sources=(SOURCES[0], user_source("own", "Own Prizes", find))) as archives:
        got = lookup_awards(requests, archives)
        assert [(r["query_id"], r["source_name"], r["award_year"], r["decision"], r["preselected"]) for r in got.results.orderBy("query_id", "result_ord").collect()] == [(1, "Own Prizes", 2000, "QUALIFIES", True), (1, "Own Prizes", 2001, "REVIEW", False)]
        assert sorted((f["query_id"], f["error_type"], f["message"]) for f in got.failures.collect()) == [(2, "UserSourceError", "LookupError: no luck"), (3, "UserSourceError", "award_name is blank")]


def test_chains_of_pages(spark):
    from accolade.sources.snapshots import chain, in_chain_order

    page = lambda n: f'<link rel="next" href="/p{n}">'
    rows = [snapshot_of("nebula", "archive", "k", 0, f"http://h/p{i}", page(i + 1) if i < 1100 else "end") for i in range(1101)]
    rows += [snapshot_of("nebula", "archive", "k", 0, "http://h/else", page(5)), snapshot_of("hugo", "archive", None, 3, "http://h/x", "y")]
    df = spark.createDataFrame(rows, SNAPSHOT)
    got = {r["url"]: r["page_ord"] for r in chain(df, "http://h/p0").collect()}
    assert got == {f"http://h/p{i}": i for i in range(1101)}
    ring = spark.createDataFrame([snapshot_of("nebula", "archive", "k", 0, f"http://h/p{i}", page((i + 1) % 3)) for i in range(3)], SNAPSHOT)
    assert sorted((r["page_ord"], r["url"]) for r in chain(ring, "http://h/p1").collect()) == [(0, "http://h/p1"), (1, "http://h/p2"), (2, "http://h/p0")]
    assert chain(ring, "http://h/none").count() == 0
    assert in_chain_order(df, "nebula", "k", "http://h/p0").count() == 1102


def test_presentation(spark):
    from accolade.operators import present as P

    df = spark.createDataFrame([(1, " T ", "A", " S ", "T", "B", "series", 0, 1, "Winner", None, 1990, "P", "C", "QUALIFIES"), (2, "T", "A", None, "T", "A ", "work", 0, 1, "x", None, 1990, "P", "C", "REVIEW")], "query_id long, title string, author string, series string, work_title string, work_author string, identity_kind string, source_ord int, result_ord int, status string, rank int, award_year int, award_name string, category string, decision string")
    got = df.select(P.book_line(F.col("title"), F.col("author")), P.series_line(F.col("series")), P.identity_if_different(F.col("work_title"), F.col("work_author"), F.col("title"), F.col("author"))).collect()
    assert [tuple(r) for r in got] == [("Book: T | A", "Series: S", "T | B"), ("Book: T | A", None, None)]
    assert [(r["query_id"], r["has_series_award"]) for r in P.with_series_award(df.select("query_id", "series"), df).orderBy("query_id").collect()] == [(1, True), (2, False)]
    assert [(r["query_id"], r["lines"]) for r in P.formatted_qualifying(df).collect()] == [(1, ["Winner - 1990 P - C [T]"])]
    lists = df.select(F.array("title").alias("zed"), F.array("title").alias("b", metadata={"name": "Alpha"}), F.array("title").alias("names", metadata={"is_names": True}), "rank")
    assert P.eligible_targets(lists) == [("b", "Alpha"), ("zed", "zed")] and not P.is_eligible_target(lists, "names")
    odd = P.Preferences.of({"template": " ", "mode": "Other", "field": " zed ", "enabled": 1})
    assert odd == P.Preferences(P.TEMPLATE, True, "zed", "append") and P.Preferences.of({}) == P.Preferences()
    assert P.status_text(lists, odd) == fixed.WRITE_APPEND.format(field="zed") and P.status_text(lists, P.Preferences.of({"mode": "REPLACE", "field": "b", "enabled": True})) == fixed.WRITE_REPLACE.format(field="b")
    assert P.status_text(lists, P.Preferences()) == fixed.WRITE_DISABLED and P.status_text(lists, P.Preferences(enabled=True)) == fixed.WRITE_NO_FIELD
    assert P.status_text(lists, P.Preferences(enabled=True, field="rank")) == fixed.WRITE_LOST_FIELD.format(field="rank") and P.status_text(lists, odd, any_results=False) == fixed.WRITE_NOTHING
    folds = ["STRASSE", "Straße", "ΟΔΟΣ", "οδος", "ẞ", "É"]
    from accolade.operators.qualify import folded
    assert [r[0] for r in spark.createDataFrame([(x,) for x in folds], "x string").select(folded(F.col("x"))).collect()] == [x.casefold() for x in folds]


def test_contracts(spark, snapshots):
    from accolade.operators import archives as A
    from accolade.plans.lookup import ranking_table
    from accolade.sources.snapshots import raw_rows

    key = "best-poem"
    gap = spark.createDataFrame([snapshot_of("nebula", "archive", key, 0, "u", nebula_page("Best Poem", (2025, 2028), {}))], SNAPSHOT)
    raw = raw_rows(snapshots.where("source_key = 'nebula' and category_key != 'best-poem'").union(gap))
    message = A.nebula_failures(raw, A.nebula_records(raw)).first()["message"]
    assert message == "Nebula archive was retrieved but Best Poem year heading(s) were missing: 2026 (+1 more)"
    assert A.ranking_problems(ranking_table(spark)).count() == 0
    twice = ranking_table(spark).union(ranking_table(spark).limit(1))
    assert A.ranking_problems(twice).count() == 2
    good = (1990, "T", "A", 1, "u", False)
    kinds = [((0, "T", "A", 1, "u", False), "year"), ((1990, " ", "A", 1, "u", False), "title"), ((1990, "T", None, 1, "u", False), "author"), ((1990, "T", "A", 0, "u", False), "rank is not"), ((1990, "T", "A", 1, "", None), "url"), ((1990, "No AWARD", "A", 1, "u", False), "no work")]
    shape = "award_year int, work_title string, work_author string, rank int, source_url string, tied boolean"
    for row, told in kinds:
        assert told in A.ranking_problems(spark.createDataFrame([row], shape)).first()["problem"]
    assert A.ranking_problems(spark.createDataFrame([good, (1990, " t", "a ", 2, "u", False)], shape)).count() == 2
    for tied, problems in ((True, 0), (None, 2), (False, 2)):
        assert A.ranking_problems(spark.createDataFrame([(*good[:5], True), (1990, "U", "A", 1, "u", tied)], shape)).count() == problems
    # A table that is handed in is checked before it is used: a repeated rank fails the source.
    from accolade.plans.lookup import Archives, hugo_source
    ask = spark.createDataFrame([(1, "Starter Villain", "John Scalzi", None)], "query_id long, title string, author string, series string")
    for rows, fails in (([(2024, "Starter Villain", "John Scalzi", 4, "own", False)], False), ([(2024, "Starter Villain", "John Scalzi", 4, "own", False), (2024, "Other", "Zed", 4, "own", False)], True)):
        with Archives(snapshots.where("source_key = 'hugo'"), sources=(hugo_source(spark.createDataFrame(rows, shape)),)) as archives:
            got = lookup_awards(ask, archives)
            assert [(r["rank"], r["source_url"]) for r in got.results.collect()] == ([] if fails else [(4, "own")])
            assert [("shared rank" in f["message"]) for f in got.failures.collect()] == ([True] if fails else [])
    works = A.table_works(raw_rows(snapshots)).where("title_key = 'shared omen'").first()
    assert works["authors"] == ["Ann Ode", "Bo Pax"]


def test_qualify_and_write_back(spark):
    from accolade.operators import present, qualify

    cases = [(5, "x", "A", 1990, "QUALIFIES"), (6, "Winner", "A", 1990, "DOES_NOT_QUALIFY"), (None, " WON ", "A", 1990, "QUALIFIES"), (None, "Finalist", "Pulitzer Prize", 1979, "REVIEW"), (None, "Finalist", "pulitzer prize ", 1980, "QUALIFIES"), (None, "Longlisted", "Booker Prize", 2026, "DOES_NOT_QUALIFY"), (None, "Odd", "A", None, "REVIEW")]
    df = spark.createDataFrame([(r, s, a, y, "Fiction", "T", "work", i) for i, (r, s, a, y, _) in enumerate(cases)], "rank int, status string, award_name string, award_year int, category string, work_title string, identity_kind string, i int")
    assert [r["decision"] for r in qualify.assess(df).orderBy("i").collect()] == [c[-1] for c in cases]
    with pytest.raises(ValueError):
        qualify.policies((("A", None, 2000, 1999, (), (), ""),))
    for pair in (((None, None, None), ("c", 1990, 1999)), (("c", 1990, 2000), ("C ", 2000, None)), (("c", None, 5), ("c", 5, 5))):
        with pytest.raises(ValueError, match="overlapping"):
            qualify.policies([("A", c, a, b, (), (), "") for c, a, b in pair])
    rules = spark.createDataFrame([("pulitzer PRIZE", "fiction", 1980, None, [" Finalist"], None), ("Booker Prize", None, None, None, None, ["longlisted"])], "award_name string, category string, start int, end int, qualifying array<string>, nonqualifying array<string>")
    many = qualify.assess(df, qualify.policy_rules(rules))
    assert many.columns == qualify.assess(df).columns and [r["decision"] for r in many.orderBy("i").collect()] == [c[-1] for c in cases]
    with pytest.raises(ValueError, match="overlap"):
        qualify.policy_rules(rules.union(rules.limit(1)))
    with pytest.raises(ValueError, match="contradictory"):
        qualify.policy_rules(rules.withColumn("nonqualifying", rules["qualifying"]))
    odd = spark.createDataFrame([(None, " ", None, None, None, "<year>", "work")], "rank int, status string, award_name string, award_year int, category string, work_title string, identity_kind string")
    assert odd.select(present.formatted()).first()[0] == "<placement missing> - <year missing> <award missing> - <category missing>"
    marks = spark.createDataFrame([(11, "x", "<year>", 1990, "C", "T", "series")], df.schema.fieldNames()[:7] and "rank int, status string, award_name string, award_year int, category string, work_title string, identity_kind string")
    assert marks.select(present.formatted("<award>|<placement>|<other>|<category>")).first()[0] == "<year>|11th|<other>|C [T]"
    lists = spark.createDataFrame([(["A", "a"], ["B", " b ", "", "a", "C, D"]), (None, ["x,"])], "old array<string>, new array<string>")
    got = present.write_back(lists, "old", "new").collect()
    assert [(r["values"], r["rejected_for_comma"], r["changed"]) for r in got] == [(["A", "a", "B"], ["C, D"], True), ([], ["x,"], False)]
    got = present.write_back(lists, "old", "new", "replace").collect()
    assert [(r["values"], r["changed"]) for r in got] == [(["B", "a"], True), ([], False)]
    assert present.is_eligible_target(lists, "old") and not present.is_eligible_target(df, "rank")


def test_annual_pages_are_read_where_the_index_names_them(spark, snapshots):
    """Pages of other years, which would fail if they were read, never are."""
    from accolade.plans.lookup import Archives

    more = [snapshot_of("locus", "annual", None, 0, f"https://www.sfadb.com/Locus_Awards_{y}", "broken") for y in range(1991, 1999)]
    requests = spark.createDataFrame([(1, "Low Tide", "Ann Ode", None), (2, "No Such", "Bo Pax", None)], "query_id long, title string, author string, series string")
    with Archives(snapshots.where("source_key = 'locus'").union(spark.createDataFrame(more, SNAPSHOT))) as archives:
        got = lookup_awards(requests, archives, once=True)
        assert [(r["query_id"], r["source_name"], r["rank"]) for r in got.results.collect()] == [(1, "Science Fiction Awards Database", 6)]
        assert archives.pages_read == 1
        got.free()


def test_archive_store(spark, snapshots, tmp_path):
    from accolade.plans.store import ArchiveStore

    requests = spark.createDataFrame([(1, "Low Tide", "Ann Ode", None)], "query_id long, title string, author string, series string")
    rows = lambda report: sorted((r["source_name"], r["award_year"], r["status"], r["decision"]) for r in report.results.collect())
    want = rows(lookup_awards(requests, snapshots))
    assert len(want) == 4
    first = ArchiveStore(spark, f"{tmp_path}/store").load(snapshots)
    pages = snapshots.count()
    assert (first.number, first.read, first.unchanged, first.refused) == (1, pages, 0, {})
    # A second session's store reads no page that is there, and gives the same archives.
    store = ArchiveStore(spark, f"{tmp_path}/store")
    with store.open() as archives:
        assert rows(lookup_awards(requests, archives)) == want and archives.broken == {}
    changed = snapshot_of("hugo", "archive", None, 0, "https://h/json", "[]")
    again = store.load(snapshots.where("source_key != 'hugo'").union(spark.createDataFrame([changed], SNAPSHOT)))
    assert (again.read, again.unchanged) == (1, pages - 1) and list(again.refused) == ["hugo"] and "empty" in again.refused["hugo"]
    # The bad load is not the archive of its source; a load of some sources leaves the others as they are.
    store.load(snapshots.where("source_key = 'pulitzer'"))
    with store.open() as archives:
        assert rows(lookup_awards(requests, archives)) == want and archives.broken == {}


def test_own_source_in_sql(spark):
    from accolade.plans.lookup import register_source_function

    def find(title, author, series):
        if title == "bad":
            raise LookupError("no luck")
        return [{"work_title": title, "award_name": "Own", "award_year": 2000 + i, "rank": i} for i in range(len(series or ""))]

    register_source_function(spark, "own_prizes", find)
    spark.createDataFrame([(1, "A", "x", "ss"), (2, "bad", "x", None), (3, "B", "x", None), (4, "C", "y", "s")], "query_id long, title string, author string, series string").createOrReplaceTempView("asked")
    want = [(1, "A", 2000, None), (1, "A", 2001, None), (2, None, None, "LookupError: no luck"), (4, "C", 2000, None)]
    for call in ("own_prizes(TABLE(asked) PARTITION BY query_id)", "asked a, LATERAL own_prizes(a.query_id, a.title, a.author, a.series) o"):
        o = "o." if "LATERAL" in call else ""
        got = spark.sql(f"SELECT {o}query_id, {o}work_title, {o}award_year, {o}message FROM {call}").collect()
        assert sorted([tuple(r) for r in got], key=repr) == sorted(want, key=repr)
    with pytest.raises(Exception, match="needs author"):
        spark.sql("SELECT * FROM own_prizes(TABLE(SELECT query_id, title FROM asked) PARTITION BY query_id)").collect()


def test_snapshots_by_source_and_role(spark, snapshots, tmp_path):
    from accolade.sources.snapshots import read_snapshots, stream_snapshots, write_snapshots

    path = f"{tmp_path}/pages"
    write_snapshots(snapshots, path)
    write_snapshots(spark.createDataFrame([snapshot_of("locus", "author", None, 0, "u", "x")], SNAPSHOT), path)
    table = read_snapshots(spark, path)
    assert table.columns == snapshots.columns and table.count() == snapshots.count() + 1
    one = table.where("source_key = 'locus' and page_role = 'author'").select("url", F.input_file_name().alias("f"))
    plan = one._jdf.queryExecution()
    assert one.count() == 3
    plan.executedPlan().execute().count()
    scan = plan.executedPlan()
    while scan.children().size():
        scan = scan.children().apply(0)
    assert scan.metrics().apply("numFiles").value() == one.select("f").distinct().count() < table.select(F.input_file_name()).distinct().count()
    stream = stream_snapshots(spark, path).where("source_key = 'hugo'").writeStream.format("memory").queryName("hugo_pages").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert spark.table("hugo_pages").count() == snapshots.where("source_key = 'hugo'").count()
