"""The published names, addresses, years and tables that results must carry."""

from __future__ import annotations

#: Sources in the order of their results: key, display name.
SOURCES = (("pulitzer", "Pulitzer Prizes"), ("nebula", "Nebula Awards"), ("hugo", "Hugo Awards"), ("locus", "Science Fiction Awards Database"), ("world_fantasy", "World Fantasy Awards"))
NAMES = dict(SOURCES)

PULITZER_CATEGORIES = (("Fiction", "https://www.pulitzer.org/prize-winners-by-category/219"), ("Novel", "https://www.pulitzer.org/prize-winners-by-category/261"))

#: Archive key, award, category, labels in its rows, first year, whether a winner's year may be left out, years without a winning work.
NEBULA_ARCHIVES = (
    ("best-novel", "Nebula Award", "Best Novel", ("Best Novel",), 1965, False, ()),
    ("best-novella", "Nebula Award", "Best Novella", ("Best Novella",), 1965, False, ()),
    ("best-novelette", "Nebula Award", "Best Novelette", ("Best Novelette",), 1965, False, ()),
    ("best-short-story", "Nebula Award", "Best Short Story", ("Best Short Story",), 1965, False, (1970,)),
    ("best-poem", "Nebula Award", "Best Poem", ("Best Poem",), 2025, False, ()),
    (
        "andre-norton-award",
        "Andre Norton Award",
        "Middle Grade and Young Adult Fiction",
        (
            "Andre Norton Nebula Award for Middle Grade and Young Adult Fiction",
            "The Andre Norton Award for Middle Grade and Young Adult Fiction",
            "Andre Norton Award for Young Adult Science Fiction and Fantasy",
        ),
        2005,
        True,
        (),
    ),
)
NEBULA_ORIGIN = "https://nebulas.sfwa.org/award/"
#: Category, year and page of works whose archive row lacks its author.
NEBULA_AUTHORS = (("Best Novella", 1990, "https://nebulas.sfwa.org/nominated-work/hemingway-hoax/", "Joe Haldeman"),)

#: Hugo categories in the order of results; those of works first, then those of series.
HUGO_WORKS = ("Best Novel", "Best Novella", "Best Novelette", "Best Short Story", "Short Fiction", "Best Novel or Novelette", "Best Poem", "Best Related Non-Fiction Book", "Best Related Book")
HUGO_SERIES = ("Best Series", "Best All-Time Series")
HUGO_RELATED = ("Best Related Non-Fiction Book", "Best Related Book")
#: Category, first and last year (None: open) that must have it, further single years, years without it.
HUGO_REQUIRED = (
    ("Best Novel", 1, None, (), (1957, 1958)),
    ("Best Novella", 1968, None, (), ()),
    ("Best Novelette", 1973, None, (1955, 1956, 1959, 1967, 1968, 1969), ()),
    ("Best Short Story", 1967, None, (1955, 1956, 1958, 1959), ()),
    ("Short Fiction", 1960, 1966, (), ()),
    ("Best Novel or Novelette", 1958, 1958, (), ()),
    ("Best Series", 2017, None, (), ()),
    ("Best All-Time Series", 1966, 1966, (), ()),
    ("Best Poem", 2025, 2026, (), ()),
    ("Best Related Non-Fiction Book", 1980, 1998, (2003, 2004, 2005, 2006), ()),
    ("Best Related Book", 1999, 2002, (2007, 2008, 2009), ()),
)
#: The year and category whose list has a title with a closing quote mark only.
HUGO_UNOPENED = (2010, "Best Novelette")
HUGO_STATISTICS = {
    1972: "https://www.thehugoawards.org/content/pdf/1972HugoStatistics.pdf",
    1980: "https://www.thehugoawards.org/wp-content/uploads/2024/02/1980-Hugo-Nominating-and-Voting-Statistics.pdf",
    1996: "https://www.thehugoawards.org/content/pdf/1996HugoStatistics-Final.pdf",
    2000: "https://www.thehugoawards.org/wp-content/uploads/2019/06/2000-Hugo-Statistics.pdf",
    2006: "https://www.thehugoawards.org/content/pdf/2006HugoStatistics-Final.txt",
    2015: "https://www.thehugoawards.org/content/pdf/2015HugoStatistics.pdf",
    2017: "https://www.thehugoawards.org/wp-content/uploads/2017/08/2017-Hugo-report-1-voting-results.pdf",
    2024: "https://www.thehugoawards.org/wp-content/uploads/2024/08/2024_hugo_statistics.pdf",
    2025: "https://www.thehugoawards.org/wp-content/uploads/2025/09/2025-Hugo-Voting-Statistics-v3.pdf",
}
#: Best Novel placements: year, title, author, rank. None of them is tied.
HUGO_RANKINGS = (
    (1972, "To Your Scattered Bodies Go", "Philip José Farmer", 1),
    (1972, "The Lathe of Heaven", "Ursula K. Le Guin", 2),
    (1972, "Dragonquest", "Anne McCaffrey", 3),
    (1972, "Jack of Shadows", "Roger Zelazny", 4),
    (1972, "A Time of Changes", "Robert Silverberg", 5),
    (1980, "The Fountains of Paradise", "Arthur C. Clarke", 1),
    (1980, "Titan", "John Varley", 2),
    (1980, "Jem", "Frederik Pohl", 3),
    (1980, "Harpist in the Wind", "Patricia A. McKillip", 4),
    (1980, "On Wings of Song", "Thomas M. Disch", 5),
    (1996, "The Diamond Age", "Neal Stephenson", 1),
    (1996, "The Time Ships", "Stephen Baxter", 2),
    (1996, "Brightness Reef", "David Brin", 3),
    (1996, "The Terminal Experiment", "Robert J. Sawyer", 4),
    (1996, "Remake", "Connie Willis", 5),
    (2000, "A Deepness in the Sky", "Vernor Vinge", 1),
    (2000, "A Civil Campaign", "Lois McMaster Bujold", 2),
    (2000, "Cryptonomicon", "Neal Stephenson", 3),
    (2000, "Darwin's Radio", "Greg Bear", 4),
    (2000, "Harry Potter and the Prisoner of Azkaban", "J. K. Rowling", 5),
    (2006, "Spin", "Robert Charles Wilson", 1),
    (2006, "Accelerando", "Charles Stross", 2),
    (2006, "Old Man's War", "John Scalzi", 3),
    (2006, "Learning the World", "Ken MacLeod", 4),
    (2006, "A Feast for Crows", "George R. R. Martin", 5),
    (2015, "The Three Body Problem", "Cixin Liu", 1),
    (2015, "The Goblin Emperor", "Katherine Addison", 2),
    (2015, "Ancillary Sword", "Ann Leckie", 3),
    (2015, "Skin Game", "Jim Butcher", 5),
    (2015, "The Dark Between the Stars", "Kevin J. Anderson", 6),
    (2017, "The Obelisk Gate", "N. K. Jemisin", 1),
    (2017, "All the Birds in the Sky", "Charlie Jane Anders", 2),
    (2017, "Ninefox Gambit", "Yoon Ha Lee", 3),
    (2017, "A Closed and Common Orbit", "Becky Chambers", 4),
    (2017, "Too Like the Lightning", "Ada Palmer", 5),
    (2017, "Death's End", "Cixin Liu", 6),
    (2024, "Some Desperate Glory", "Emily Tesh", 1),
    (2024, "Translation State", "Ann Leckie", 2),
    (2024, "The Adventures of Amina al-Sirafi", "Shannon Chakraborty", 3),
    (2024, "Witch King", "Martha Wells", 4),
    (2024, "The Saint of Bright Doors", "Vajra Chandrasekera", 5),
    (2024, "Starter Villain", "John Scalzi", 6),
    (2025, "The Tainted Cup", "Robert Jackson Bennett", 1),
    (2025, "A Sorceress Comes to Call", "T. Kingfisher", 2),
    (2025, "Alien Clay", "Adrian Tchaikovsky", 3),
    (2025, "Someone You Can Build a Nest In", "John Wiswell", 4),
    (2025, "Service Model", "Adrian Tchaikovsky", 5),
    (2025, "The Ministry of Time", "Kaliane Bradley", 6),
)

LOCUS_ORIGIN = "https://www.sfadb.com/"
LOCUS_HOSTS = ("sfadb.com", "www.sfadb.com")
LOCUS_SUPPORTED = ("Novel", "Sf Novel", "Fantasy Novel", "Horror Novel", "First Novel", "Young Adult Book", "Young Adult Novel", "Translated Novel")
#: Further names that the index uses for categories of the annual pages.
LOCUS_INDEX_NAMES = {"horror/dark fantasy novel": "Horror Novel", "dark fantasy/horror novel": "Horror Novel"}
LOCUS_KNOWN = (
    "novella", "novelette", "short story", "short fiction", "anthology", "collection", "anthology/collection", "magazine", "publisher", "publisher/imprint",
    "book publisher", "editor", "artist", "nonfiction", "non-fiction", "art book", "illustrated and art book",
)

#: Page role, address and, for annual pages, the year, in the order of merging.
WORLD_FANTASY_PAGES = (
    ("winners", "https://worldfantasy.org/awards/winners/", None),
    ("annual_2013", "https://worldfantasy.org/2013-world-fantasy-awards/", 2013),
    ("nominees", "https://worldfantasy.org/awards/nominees/", None),
    ("convention_1982", "https://worldfantasy.org/1982-the-8th-world-fantasy-convention/", None),
    ("convention_1993", "https://worldfantasy.org/1993-the-19th-world-fantasy-convention/", None),
    ("convention_2005", "https://worldfantasy.org/2005-world-fantasy-convention-2005/", None),
    ("annual_2024", "https://worldfantasy.org/2024-world-fantasy-nominations-and-winners/", 2024),
    ("annual_2025", "https://worldfantasy.org/2025-wfc-nominations-and-winners/", 2025),
)
#: Category, first year, further names in headings of annual pages.
WORLD_FANTASY_CATEGORIES = (("Novel", 1975, ("Best Novel",)), ("Novella", 1982, ("Best Novella",)), ("Short Fiction", 1975, ("Short Story", "Best Short Fiction")), ("Collection", 1988, ("Best Collection",)))
WORLD_FANTASY_TABLES_THROUGH = 2023
LONG_FICTION_YEARS = (2016, 2017, 2018)
NOVELLA_LABELS = {2015: "novella", 2016: "long fiction", 2017: "long fiction", 2018: "long fiction", 2019: "novella"}
#: Categories that each convention page must give nominees of.
CONVENTION_SLATES = {"convention_1982": ("Novel", "Novella", "Short Fiction"), "convention_1993": ("Novel", "Novella", "Short Fiction", "Collection"), "convention_2005": ("Novel", "Novella")}

#: Award, category, first and last year, qualifying and non-qualifying statuses, notes.
POLICIES = (
    ("Pulitzer Prize", "Fiction", 1980, None, ("Finalist",), (), "Finalists are published from 1980 on; they fall within the top five without a rank."),
    ("Booker Prize", None, 2026, None, (), ("Longlist", "Longlisted"), "A longlist of twelve or thirteen does not qualify; a shortlist of six needs review."),
)
WINNING = ("winner", "win", "won")
AMBIGUOUS = ("finalist", "shortlist", "shortlisted", "honor book", "honor", "runner-up", "runner up", "nominee", "nominated", "longlist", "longlisted")
REASONS = {
    "rank_in": "Source establishes an ordinal rank within the top five.",
    "rank_out": "Source establishes an ordinal rank outside the top five.",
    "won": "Status indicates a win without an established ordinal rank.",
    "policy_in": "Award-specific policy identifies this status as satisfying the inclusion rule.",
    "policy_out": "Award-specific policy identifies this status as outside the inclusion rule.",
    "ambiguous": "Status meaning depends on the structure of the specific award.",
    "unknown": "Status is unrecognized and requires review.",
}

#: Marks of a page that checks the browser instead of showing its content, in folded case.
CHALLENGE_MARKS = ("just a moment...", "checking your browser", "cf-browser-verification", "enable javascript and cookies to continue")

#: Messages of failures of pages and requests.
PAGE_OUTSIDE = "{name} page is outside its hosts: {url}"
PAGE_HTTP = "{name} page request failed with HTTP {status} for {url}"
PAGE_CHALLENGE = "{name} page is blocked by a challenge: {url}"
PAGE_UNREADABLE = "{name} page could not be read: {url} ({error})"
PAGE_MISSING = "{name} page is missing from the snapshots: {url}"
LONG_FICTION_OUTSIDE = "World Fantasy table used Long Fiction in %d, outside the official 2016–2018 interval"
RANKING_BROKEN = "Hugo ranking of %s %s cannot be used: %s"
#: What a list of works names that is no work.
NO_WORKS = ("no award", "no winner chosen")
NO_PAGE = "{name} has no page in the snapshots"
BLANK_FIELD = "{field} must be a non-empty string"
LOCUS_UNREAD = "Locus annual page request failed with HTTP 404 for %s"
LOCUS_LOST = "SFADB author-page Locus entry was not present on the annual results page: %s"
LOCUS_PLACED = "SFADB author-page Locus placement disagreed with the annual page: discovery=%s annual=%s url=%s"
LOCUS_WON = "SFADB author-page Locus winner disagreed with the annual page: %s"
LOCUS_YEAR = "SFADB Locus annual URL is not a usable year page: {url}"

#: Error types of the sources' failures.
ERROR_TYPES = {"pulitzer": "PulitzerSourceError", "nebula": "NebulaSourceError", "hugo": "HugoSourceError", "locus": "LocusSourceError", "world_fantasy": "WorldFantasySourceError"}

#: What a write-back tells before it is done.
WRITE_REPLACE = "Replace mode: Write Selected will replace the existing values in {field} with the selected awards. Cancel makes no change."
WRITE_APPEND = "Write Selected will append selected awards to {field}. Cancel makes no change."
WRITE_DISABLED = "Metadata write-back is disabled. Close dismisses this dialog without changing metadata."
WRITE_NO_FIELD = "Write-back unavailable: no destination column is configured. Close dismisses this dialog without changing metadata."
WRITE_LOST_FIELD = "Write-back unavailable: configured column {field} is not available. Close dismisses this dialog without changing metadata."
WRITE_NOTHING = "No matching award records were found. Close dismisses this dialog without changing metadata."
