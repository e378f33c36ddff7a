"""Stored page snapshots as the scan of the engine, and their raw rows.

A snapshot is (source_key, page_role, category_key, page_ord, url, http_status, headers, body). Pages
are fetched elsewhere; here they are checked, decoded and read once into raw rows. Every raw row
carries its place (config_ord, page_ord, rec_ord), as order is part of the results. A page that cannot
be used gives a row with an error instead.
"""

from __future__ import annotations

import html
import json
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accolade.operators.rounds import list_ranks
from accolade.sources import fixed, pages, readers
from accolade.sources.shared import Kept

SNAPSHOT = "source_key string, page_role string, category_key string, page_ord int, url string, http_status int, headers map<string,string>, body binary"
_FIELDS = {
    "award_year": pa.int32(), "award_name": pa.string(), "category": pa.string(), "official_category": pa.string(), "status": pa.string(), "rank": pa.int32(), "winner": pa.bool_(), "tied": pa.bool_(),
    "work_title": pa.string(), "work_author": pa.string(), "match_titles": pa.list_(pa.string()), "match_authors": pa.list_(pa.string()), "source_url": pa.string(), "identity_kind": pa.string(), "error": pa.string(),
}
#: digest is that of the page a row was read from, where the snapshots have one.
_PLACE = {"digest": pa.string(), "source_key": pa.string(), "page_role": pa.string(), "page_url": pa.string(), "config_ord": pa.int32(), "page_ord": pa.int32(), "rec_ord": pa.int32()}
_SQL = {pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}
RAW = ", ".join(f"{k} {_SQL[t]}" for k, t in (_PLACE | _FIELDS).items())
_YEAR_PAGE = re.compile(r"(\d{4}) Hugo Awards")
_FANTASY = {role: (i, url, year) for i, (role, url, year) in enumerate(fixed.WORLD_FANTASY_PAGES)}


def decode(body: bytes, source_key: str, headers: dict[str, str]) -> str:
    """UTF-8 with replacements; one source declares its charset, another falls back to Windows-1252."""
    if source_key == "world_fantasy":
        try:
            return body.decode("utf-8")
        except UnicodeDecodeError:
            return body.decode("cp1252", "replace")
    if source_key == "locus":
        kind = next((v for k, v in headers.items() if k.lower() == "content-type"), "")
        charset = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
        try:
            return body.decode(charset[1] if charset else "utf-8", "replace")
        except LookupError:
            pass
    return body.decode("utf-8", "replace")


def is_challenge(text: str) -> bool:
    """Whether a page is a browser check instead of content."""
    low = text.casefold()
    return any(mark in low for mark in fixed.CHALLENGE_MARKS)


def collection(text: str, headers: dict[str, str]) -> list[tuple[str, str, str]]:
    """(title, link, content) of the items of a REST collection that keeps its contract; ValueError says what it breaks."""
    try:
        items = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"Hugo archive response was not valid JSON: {e}") from e
    if not isinstance(items, list):
        raise ValueError("Hugo archive response JSON was not a list")
    if not items:
        raise ValueError("Hugo archive response list was empty")
    told = {k.lower(): v for k, v in headers.items()}
    if told.get("x-wp-totalpages", "1") != "1":
        raise ValueError(f"Hugo archive response was paginated unexpectedly: X-WP-TotalPages={told['x-wp-totalpages']}")
    total = told.get("x-wp-total")
    if total is not None and not re.fullmatch(r"\s*[+-]?\d+\s*", total):
        raise ValueError(f"Hugo archive X-WP-Total was not an integer: {total!r}")
    if total is not None and int(total) != len(items):
        raise ValueError(f"Hugo archive response length did not match X-WP-Total: {len(items)} != {int(total)}")
    out = []
    for i, item in enumerate(items):
        item = item if isinstance(item, dict) else {}
        inner = lambda k, item=item: item[k].get("rendered") if isinstance(item.get(k), dict) else item.get(k) if k == "title" else None
        values = [inner("title"), item.get("link"), inner("content")]
        values = [v if isinstance(v, str) else "" for v in values]
        title, link, content = html.unescape(values[0]).strip(), values[1].strip(), values[2].strip()
        for value, name in ((title, "a usable title.rendered"), (link, "a usable link"), (content, "usable content.rendered")):
            if not value:
                raise ValueError(f"Hugo archive item {i} is missing {name}")
        out.append((title, link, content))
    return out


#: Whose pages become raw rows by windows over their elements; of the last one only pages that are tables.
_BY_ELEMENTS = ("pulitzer", "nebula", "world_fantasy")


def _read(key: str, role: str, category: str | None, url: str, status: int, headers: dict[str, str], body: bytes, elements: bool = False):
    """(config_ord, raw rows) of one snapshot; with `elements` its text in place of rows if it is one that is read by elements, else None."""
    text = decode(body or b"", key, headers)
    name = fixed.NAMES.get(key, key)
    if key == "locus" and not pages.locus_allowed(url):
        return 0, [{"error": fixed.PAGE_OUTSIDE.format(name=name, url=url)}]
    if key == "locus" and role == "author" and status == 404:
        return 0, []
    if status != 200 or not text.strip():
        return 0, [{"error": fixed.PAGE_HTTP.format(name=name, status=status, url=url)}]
    if is_challenge(text):
        return 0, [{"error": fixed.PAGE_CHALLENGE.format(name=name, url=url)}]
    if key == "pulitzer":
        order = [c for c, _ in fixed.PULITZER_CATEGORIES]
        return order.index(category), text if elements else []
    if key == "nebula":
        at, archive = next((i, a) for i, a in enumerate(fixed.NEBULA_ARCHIVES) if a[0] == category)
        if elements:
            return at, text
        years = [{"award_year": int(y), "category": archive[2], "status": "", "identity_kind": "heading"} for y in re.findall(r"<h2[^>]*>\s*(\d{4})\s*</h2>", text, re.I)]
        return at, years
    if key == "hugo":
        try:
            items = collection(text, headers)
        except ValueError as e:
            return 0, [{"error": str(e)}]
        rows = []
        for title, link, content in items:
            if m := _YEAR_PAGE.fullmatch(title):
                rows += [{"award_year": int(m[1]), "status": "", "identity_kind": "heading"}, *pages.hugo(content, int(m[1]), link)]
        return 0, rows
    if key == "locus":
        return 0, pages.locus_index(text, url) if role == "author" else pages.locus_annual(text, url) if pages.locus_year(url) is not None else [{"error": fixed.LOCUS_YEAR.format(url=url)}]
    if key == "world_fantasy":
        at, _, year = _FANTASY[role]
        if year is None or elements:
            return at, (text if year is None else None) if elements else []
        return at, pages.fantasy_paragraphs(text, year, url) if year == 2024 else pages.fantasy_lists(text, year, url, by_prefix=year != 2013)
    raise ValueError(f"unknown source {key!r}")


def _reader(batches):
    for batch in batches:
        columns: dict[str, list] = {k: [] for k in _PLACE | _FIELDS}
        for s in batch.to_pylist():
            place = {"digest": s.get("digest"), "source_key": s["source_key"], "page_role": s["page_role"], "page_url": s["url"], "page_ord": s["page_ord"] or 0}
            try:
                at, rows = _read(s["source_key"], s["page_role"], s["category_key"], s["url"] or "", s["http_status"] or 0, dict(s["headers"] or []), s["body"])
                rows = list(rows)
            except Exception as e:  # whatever a reader does, only its own source fails
                key = s["source_key"] or ""
                at, rows = 0, [{"error": fixed.PAGE_UNREADABLE.format(name=fixed.NAMES.get(key, key), url=s["url"], error=f"{type(e).__name__}: {e}")}]
            for n, row in enumerate(rows):
                row = {"identity_kind": "work"} | row | place | {"config_ord": at, "rec_ord": n}
                for k, v in columns.items():
                    v.append(row.get(k))
        yield pa.RecordBatch.from_arrays([pa.array(v, (_PLACE | _FIELDS)[k]) for k, v in columns.items()], list(columns))


_OF_PAGE = {"page_no": pa.int64(), "category": pa.string()} | {k: t for k, t in _PLACE.items() if k != "rec_ord"}
ELEMENTS = ", ".join(f"{k} {'bigint' if t == pa.int64() else _SQL[t]}" for k, t in (_OF_PAGE | readers.ELEMENT).items())


def _elements(batches):
    """What stands on usable pages, one row an element or text: a page's place, and where an element begins and ends."""
    kinds = _OF_PAGE | readers.ELEMENT
    for batch in batches:
        for s in batch.to_pylist():
            try:
                at, text = _read(s["source_key"], s["page_role"], s["category_key"], s["url"] or "", s["http_status"] or 0, dict(s["headers"] or []), s["body"], True)
            except Exception:  # told by the other reader
                continue
            if not isinstance(text, str):
                continue
            page = {"page_no": s["page_no"], "category": s["category_key"], "digest": s.get("digest"), "source_key": s["source_key"], "page_role": s["page_role"], "page_url": s["url"], "config_ord": at, "page_ord": s["page_ord"] or 0}
            found = readers.element_columns(text)
            columns = {k: [v] * len(found["pre"]) for k, v in page.items()} | found
            yield pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], list(kinds))


def page_elements(snapshots: DataFrame) -> DataFrame:
    """The elements of the pages that are read by elements."""
    own = snapshots.where(F.col("source_key").isin(*_BY_ELEMENTS)).withColumn("page_no", F.monotonically_increasing_id())
    return own.mapInArrow(_elements, ELEMENTS)


def raw_rows(snapshots: DataFrame, kept: Kept | None = None) -> DataFrame:
    """Raw rows of all snapshots, and what is wrong with pages; pages are read side by side.

    Several readers look at the elements: with `kept` they are stored there, and parsed once, until it is freed; else each reader parses its own.
    """
    elements = page_elements(snapshots)
    elements = kept(elements) if kept else elements
    rows = snapshots.mapInArrow(_reader, RAW)
    for found in (readers.pulitzer(elements), readers.nebula(elements), readers.fantasy_tables(elements)):
        given = found.columns
        rows = rows.unionByName(found.select(*[(F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in RAW.split(", "))]))
    return rows


def next_page(text: str) -> str | None:
    """The address that a page names as the next of its series."""
    for m in re.finditer(r"<link\b[^>]*>", text, re.I):
        if re.search(r"rel=[\"']next[\"']", m[0], re.I) and (href := re.search(r"href=[\"']([^\"']+)[\"']", m[0], re.I)):
            return href[1]
    return None


def _next_pages(batches):
    for batch in batches:
        urls = batch.column("url").to_pylist()
        found = [next_page((body or b"").decode("utf-8", "replace")) for body in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array([n and urljoin(u or "", n) for u, n in zip(urls, found, strict=True)], pa.string())], ["url", "next"])


def chain(snapshots: DataFrame, first: str) -> DataFrame:
    """(url, page_ord) of the pages of one archive reached from `first` over their next links, however many; a page is never visited twice.

    The links, one narrow row a page, are ranked in rounds of joins; neither links nor pages go to the driver.
    """
    links = snapshots.where("url is not null").select("url", "body").mapInArrow(_next_pages, "url string, next string")
    start = snapshots.sparkSession.createDataFrame([(first,)], "url string")
    return list_ranks(links, start, "url", "next").select("url", F.col("place").cast("int").alias("page_ord"))


def in_chain_order(snapshots: DataFrame, source_key: str, category_key: str, first: str) -> DataFrame:
    """The snapshots with the pages of one archive numbered as its next links lead, from `first` on; pages that no link reaches go."""
    own = (F.col("source_key") == source_key) & (F.col("category_key") == category_key)
    order = chain(snapshots.where(own), first)
    placed = snapshots.where(own).drop("page_ord").join(order, "url").select(*snapshots.columns)
    return snapshots.where(~F.coalesce(own, F.lit(False))).unionByName(placed)


def host_is_allowed(url: F.Column, hosts) -> F.Column:
    """Whether an address' host is one of the given ones, without regard to case and a dot at its end."""
    return F.coalesce(F.rtrim(F.lower(F.parse_url(url, F.lit("HOST"))), F.lit(".")).isin(*hosts) & F.lower(F.parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


_LAYOUT = ["source_key", "page_role"]


def write_snapshots(snapshots: DataFrame, path: str, mode: str = "append") -> None:
    """Adds snapshots to a table with a folder for each source and role, so that what is asked of one source reads its files only."""
    snapshots.select(*[c.split()[0] for c in SNAPSHOT.split(", ")]).repartition(*_LAYOUT, F.pmod(F.xxhash64("url"), F.lit(16))).write.mode(mode).partitionBy(*_LAYOUT).parquet(path)


def read_snapshots(spark, path: str) -> DataFrame:
    """The table; conditions on source and role choose folders, others are pushed to the files."""
    return spark.read.schema(SNAPSHOT).parquet(path).select(*[c.split()[0] for c in SNAPSHOT.split(", ")])


def stream_snapshots(spark, path: str) -> DataFrame:
    """Snapshots as they are added."""
    return spark.readStream.schema(SNAPSHOT).parquet(path).select(*[c.split()[0] for c in SNAPSHOT.split(", ")])


def snapshot_of(source_key, page_role, category_key, page_ord, url, body, http_status=200, headers=None):
    """A row of a snapshot table, for tests and loaders."""
    return (source_key, page_role, category_key, page_ord, url, http_status, headers or {}, body.encode() if isinstance(body, str) else body)



