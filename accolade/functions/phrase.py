"""Cutting a phrase into what is wanted of it: bracket groups, endings, quotes, and the people it names.

Every source's titles and names go through these few cuts; which forms are cut stands with the source.
"""

from __future__ import annotations

import re

_GAP = re.compile(r"\s+")
#: What follows a name after a comma and belongs to it; what stands between names.
_SUFFIX = re.compile(r"(?:Jr\.?|Sr\.?|II|III|IV)", re.I)
_TOKEN = re.compile(r"(?P<twice>&&)|(?P<word>(?:\s*,)?\s+and\s+)|(?P<sign>(?:\s*,)?\s+&\s+)|(?P<comma>,)|(?P<text>.)", re.I | re.S)


def squeeze(text: str) -> str:
    """White space as single spaces, none at the ends."""
    return _GAP.sub(" ", text).strip()


class Phrase(str):
    """A squeezed text; each cut gives a new one."""

    def __new__(cls, text: str) -> Phrase:
        return super().__new__(cls, squeeze(text))

    def less(self, *forms: re.Pattern, strip: str = "") -> Phrase:
        """Without what the forms match, one after another, and without characters of `strip` at the end then."""
        text: str = self
        for form in forms:
            text = form.sub("", text, count=1).strip()
            text = text.rstrip(strip) if strip else text
        return Phrase(text)

    def bare(self, *pairs: str) -> Phrase:
        """Without a whole bracket group at its end, of each pair of brackets in turn."""
        text: str = self
        for left, right in pairs:
            open_at: list[int] = []
            group = len(text)
            for i, c in enumerate(text):
                if c == left:
                    open_at.append(i)
                elif c == right:
                    group = open_at.pop() if open_at else len(text)
            if text.endswith(right):
                text = text[:group].strip()
        return Phrase(text)

    def unquoted(self, marks: str, spare: int = 0) -> Phrase:
        """Without quotes at its start, and without as many at its end, or `spare` more."""
        lead = re.match(rf"(?:[{re.escape(marks)}]\s*)*", self)[0]
        count = sum(c in marks for c in lead) + spare
        text = self[len(lead) :]
        return Phrase(re.sub(rf"(?:\s*[{re.escape(marks)}]){{1,{count}}}$", "", text) if count else text)


def people(text: str, *between: str) -> list[str]:
    """The names in a text, `between` naming what separates them: "word" (and), "sign" (&), "comma", or "twice", which makes && a plain &.

    A generational suffix after a comma belongs to the name before it.
    """
    parts, by_comma = [""], [False]
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "twice" and kind in between:
            parts[-1] += "&"
        elif kind in between:
            parts.append("")
            by_comma.append(kind == "comma")
        else:
            parts[-1] += m[0]
    names: list[str] = []
    for part, comma in zip(map(squeeze, parts), by_comma, strict=True):
        if comma and names and _SUFFIX.fullmatch(part):
            names[-1] = f"{names[-1]}, {part}"
        elif part:
            names.append(part)
    return names
