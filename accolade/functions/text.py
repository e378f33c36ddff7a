"""Normal forms of titles and names, as plain functions and as Arrow column functions.

NFKC, case folding and HTML unescaping have no SQL function, so these run once per distinct
value in an Arrow function; all that compares their results is plain column work.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from accolade.functions.phrase import Phrase, people, squeeze

#: Characters that stand for plain quotes, and for three dots where a source folds them.
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"', "´": "'", "`": "'"}
DOTS = {"…": "..."}
_QUOTES, _QUOTES_DOTS = str.maketrans(QUOTES), str.maketrans(QUOTES | DOTS)
#: The forms of initials, roles and joints in names and titles.
_AND, _INITIAL = re.compile(r"\s+&\s+"), re.compile(r"\b([A-Za-z])\.\s+")
_HYPHEN = re.compile("(\\w)[‐‑‒–—−-](\\w)")
_LONE_APOSTROPHE = re.compile(r"(?<!\w)'|'(?!\w)")
TRANSLATOR = re.compile(r",\s*(?:translated by\s+.+|.+\s+translator)\s*$", re.I)
LAST_GROUP, LAST_GROUP_WITH_LETTER = re.compile(r"(?<=\S)[\s,]*\([^(]*\)$"), re.compile(r"(?<=\S)[\s,]*\([^(]*[^\W\d_][^(]*\)$")
_ROLE_PROSE = re.compile(r"\b(?:with|translated\s+by|edited\s+by|editors?|introduction\s+by)\b", re.I)
_RELATED_PROSE = re.compile(r";|\bwith\b|\bintro\.|\bfwd\.|\bappendix\b|\btranslated\s+by\b", re.I)
_QUERY_ROLE = re.compile(r"\(\s*(?:eds?\.?|editors?)\s*\)\s*$", re.I)
_CREDIT_ROLE = re.compile(r",\s*(?:eds?\.|editors?)\s*$", re.I)
_SLUG_MARKS = ".,'’`´‘"


def plain(text: str, dots: bool = False) -> str:
    """Compatibility form, plain quotes, one space, folded case, initials close to the next name."""
    text = unicodedata.normalize("NFKC", text).translate(_QUOTES_DOTS if dots else _QUOTES)
    return _INITIAL.sub(r"\1.", squeeze(text).casefold())


def unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def ampersand(text: str) -> str:
    """A lone & is the word and; within a word it stays."""
    return _AND.sub(" and ", text)


def _unhyphened(text: str) -> str:
    return squeeze(_HYPHEN.sub(r"\1 \2", text))


def join_names(names) -> str:
    names = [n for n in map(squeeze, names) if n]
    return " and ".join([", ".join(names[:-1]), names[-1]] if len(names) > 1 else names)


# --- titles, one form a source ---


def title_basic(text: str) -> str:
    return ampersand(plain(text))


def title_dots(text: str) -> str:
    return ampersand(plain(text, dots=True))


def title_marked(text: str) -> str:
    """Lone apostrophes count as quote marks, hyphens between words as spaces."""
    return _unhyphened(ampersand(_LONE_APOSTROPHE.sub('"', plain(text, dots=True))))


_OPEN_QUOTES = "\"'“”‘’"
MARKUP_END = re.compile(r",?\s*(?:</?em>|/em>)\s*$", re.I)


def cleaned_title(text: str) -> str:
    """A table's or list's title without left-over markup and quotes around it."""
    title = Phrase(text).less(MARKUP_END, strip=" ,").rstrip(" ,")
    # Quotes go in pairs only.
    pairs = next((i for i in range(len(title) // 2) if title[i] not in _OPEN_QUOTES or title[-1 - i] not in _OPEN_QUOTES), len(title) // 2)
    return Phrase(title[pairs : len(title) - pairs]) if not pairs else cleaned_title(title[pairs : len(title) - pairs])


def cleaned_author(text: str) -> str:
    return Phrase(text).less(TRANSLATOR, strip=" ,").less(LAST_GROUP)


def title_cleaned(text: str) -> str:
    return _unhyphened(ampersand(plain(cleaned_title(text), dots=True)))


def series_name(text: str) -> str:
    """A series' name without a leading the and without series or books at its end, unless nothing would be left."""
    text = title_marked(text)
    text = re.sub(r"^the\s+", "", text) or text
    shorter = re.sub(r"(?:\s+(?:series|books))+$", "", text)
    return squeeze(shorter) if shorter.strip() else text


def title_keys(form: str, is_query: bool) -> list[str]:
    """Keys of a normal form such that two titles match if and only if a query's and a record's keys meet.

    Equal forms meet under F. If just one side has a colon, what stands before it meets the other
    side's form: a query's head meets a record without a colon under S, a record's head meets
    a query without one under P.
    """
    head, colon, _ = form.partition(":")
    head = head.strip()
    part = [("S" if is_query else "P") + "|" + head] if colon and head else [] if colon or not form else [("P" if is_query else "S") + "|" + form]
    return ["F|" + form, *part]


# --- names, one set of keys a source; a query and a record match if their keys meet ---


def whole_name(author: str) -> list[str]:
    return [plain(author)]


def query_people(author: str) -> list[str]:
    """People of a request: ' & ' stands between names, '&&' for an ampersand in one."""
    return people(author, "sign", "twice")


def listed_people(author: str) -> list[str]:
    """People of an official list; none where prose about roles makes a split unsafe."""
    return [] if _ROLE_PROSE.search(author) else people(author, "word", "comma")


def ordered_names(author: str, is_query: bool) -> list[str]:
    """Keys of the whole text and of the list of its people in order."""
    names = query_people(author) if is_query else listed_people(author)
    return [f"W|{plain(author)}"] + [f"L|{chr(31).join(map(plain, names))}"] * bool(names)


def credited_names(author: str) -> list[str]:
    """The name as it is, and without a translator and a parenthesis that holds a letter."""
    return list(dict.fromkeys(plain(n, True) for n in (author, Phrase(author).less(TRANSLATOR, strip=" ,").less(LAST_GROUP_WITH_LETTER) or author)))


#: A simple credit of a related book. What ends it is cut, prose makes it unsafe, and of several people each has so many words.
_RELATED = {"role": _CREDIT_ROLE, "prose": _RELATED_PROSE, "between": ("word", "sign", "comma"), "least_words": 2}


def related_people(author: str) -> list[str]:
    """People of a credit of editors and authors if it is simple, else none."""
    credit = Phrase(author).less(_RELATED["role"]).rstrip(",") or squeeze(author)
    if _RELATED["prose"].search(credit):
        return []
    names = people(credit, *_RELATED["between"])
    if any(len(n.split()) < _RELATED["least_words"] for n in names) and len(names) > 1:
        return []
    return [plain(n, True) for n in names]


def related_query(author: str) -> list[str]:
    return [k for n in query_people(author) if (k := plain(Phrase(n).less(_QUERY_ROLE) or n, True))]


def folded_names(names) -> list[str]:
    """Each name's form with and without accents, marked apart."""
    return list(dict.fromkeys(k for n in names for k in ("R|" + plain(n, True), "A|" + plain(unaccented(n), True))))


def any_part(names) -> list[str]:
    """Forms with and without accents of names and of their parts between and or &."""
    every = [p for n in names for p in (n, *people(n, "word", "sign"))]
    return [k for k in dict.fromkeys(plain(f, True) for p in every for f in (p, unaccented(p))) if k]


def name_key(name: str) -> str:
    return plain(unaccented(name), True)


def slugs(author: str) -> list[str]:
    """Page names that an author may have: without accents first, then as written."""
    letters = str.maketrans({m: None for m in _SLUG_MARKS} | {" ": "_"})
    written = unicodedata.normalize("NFKC", author)
    forms = ("_".join(filter(None, squeeze(t).translate(letters).split("_"))) for t in (unaccented(written), written))
    return list(dict.fromkeys(filter(None, forms)))


# --- Arrow column functions ---


def _mapped(function, kind):
    """An Arrow function that computes each distinct value of a batch once; null stays null."""

    @F.arrow_udf(returnType=kind)
    def run(column: pa.Array) -> pa.Array:
        coded = column.dictionary_encode()
        values = pa.array([None if v is None else function(v) for v in coded.dictionary.to_pylist()], pa.list_(pa.string()) if isinstance(kind, ArrayType) else pa.string())
        return values.take(coded.indices)

    return run


def text_column(function):
    return _mapped(function, StringType())


def list_column(function):
    return _mapped(function, ArrayType(StringType()))
