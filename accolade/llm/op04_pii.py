"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, scheme separators, identifier cues,
digits, and plus signs before a digit. A deterministic parser for each anchor then walks to the
boundaries of the email, address, number or account around it and validates it. No parser looks
at a character more than a fixed number of times, so a text's cost is linear whatever it holds.

Base kinds, in this order: email, ip, card, phone. Each gives the leftmost non-overlapping matches of
its pattern; matches that fail their check are dropped and not tried again. Added kinds: `login`,
a scheme with user information before its host; `account`, an identifier behind
a cue such as "account no:" or "user=", groups of digits to their end, an IBAN (length and check digits by modulus 97) or a social
security number (its ranges) also without a sign between; `secret`, a value with a digit behind a cue such as "token =". Cues count in any case.

Defined cases: a null text is empty and has no spans; offsets are code points, the end exclusive; an empty table gives no rows;
repeated rows and further columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from accolade.llm._shared import table

BASE, ADDED = ("email", "ip", "card", "phone"), ("login", "account", "secret")
#: Words that announce an identifier, in lower case.
CUES = ("account", "acct", "iban", "login", "passport", "social security", "ssn", "user", "userid", "username")
#: Words that announce a secret, in lower case.
SECRETS = ("api key", "api-key", "api_key", "apikey", "bearer", "passwd", "password", "secret", "token")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/?#@\"'<>]++@(?:\[[0-9A-Fa-f:.]++\]|[A-Za-z0-9.-]++)(?::[0-9]++)?")
_SIGN = r"(?:[ \t]{0,4}(?:no\.?|number|id|name))?[ \t]{0,4}"
#: Groups of digits, or a word of letters, digits and marks.
_ACCOUNT = re.compile(_SIGN + r"[:=#][ \t]{0,4}[\"']?([0-9]++(?:[ -][0-9]{2,}+)++|[A-Za-z0-9][A-Za-z0-9._-]{2,}+)(?![A-Za-z0-9_@])", re.I)
#: The same behind a word that says so, without a sign.
_NUMBERED = re.compile(r"[ \t]{1,4}(?:no\.?|number|id)[ \t]{1,4}[\"']?([0-9]++(?:[ -][0-9]{2,}+)++|[A-Za-z0-9](?:[._-]?[A-Za-z0-9]){2,}+)(?![A-Za-z0-9_@])", re.I)
#: Digits that what follows such a word has at least.
NUMBERED_DIGITS = 4
_IBAN = re.compile(_SIGN + r"[:=#]?[ \t]{0,4}[\"']?([A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30})", re.I)
_SSN = re.compile(_SIGN + r"[:=#]?[ \t]{0,4}[\"']?((?!000|666|9)[0-9]{3}([- ]?)(?!00)[0-9]{2}\2(?!0000)[0-9]{4})(?![A-Za-z0-9_])", re.I)
_SECRET = re.compile(r"[ \t]{0,4}[:=]?[ \t]{0,4}[\"']?([^\s\"',;:=]{8,}+)", re.I)


def iban_end(found: str) -> int:
    """Length of the longest start of `found` that is an IBAN ending where a group does, or 0."""
    for end in range(len(found), 14, -1):
        if end < len(found) and found[end].isalnum() or not found[end - 1].isalnum():
            continue
        plain = found[:end].replace(" ", "").replace("-", "").upper()
        if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return end
    return 0


def _lower(text: str) -> str:
    """Small letters, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, (1, "digit"))
        found.add_word(f"+{c}", (2, "plus"))
    found.add_word("@", (1, "at"))
    found.add_word("://", (3, "scheme"))
    for cue in CUES:
        found.add_word(cue, (len(cue), cue if cue == "iban" else "ssn" if cue in ("ssn", "social security") else "cue"))
    for cue in SECRETS:
        found.add_word(cue, (len(cue), "secret"))
    found.make_automaton()
    return found


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start, then in the order of kinds."""
    spans: list[tuple[str, int, int]] = []
    email_end = card_end = ip_end = phone_end = run_end = login_end = account_end = 0
    for last, (length, kind) in _automaton().iter(_lower(text)):
        at = last - length + 1
        if kind == "digit":
            if at < run_end:
                continue
            run_end = _DIGITS.match(text, at).end()
            if at >= ip_end and (m := _IP.match(text, at)):
                ip_end = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    spans.append(("ip", at, ip_end))
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                # Only 12 to 19 digits are counted at all, with at most one separator before each.
                digits = m[0].replace(" ", "").replace("-", "") if card_end - at <= 37 else ""
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", at, card_end))
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                spans.append(("email", start, email_end))
        elif kind == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    spans.append(("phone", at, phone_end))
        elif kind == "scheme":
            start = at
            while start > login_end and at - start < 32 and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and text[start].isalpha() and (m := _LOGIN.match(text, last + 1)):
                login_end = m.end()
                spans.append(("login", start, login_end))
        elif last + 1 >= account_end and (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")):
            # A cue starts a word; what follows it is looked at once, whichever parser takes it.
            if kind == "secret":
                if (m := _SECRET.match(text, last + 1)) and any("0" <= c <= "9" for c in m[1]):
                    account_end = m.end(1)
                    spans.append(("secret", m.start(1), account_end))
                continue
            if kind == "iban" and (m := _IBAN.match(text, last + 1)) and (end := iban_end(m[1])):
                account_end = m.start(1) + end
                spans.append(("account", m.start(1), account_end))
            elif (kind == "ssn" and (m := _SSN.match(text, last + 1))) or ((m := _ACCOUNT.match(text, last + 1)) and any("0" <= c <= "9" for c in m[1])) or ((m := _NUMBERED.match(text, last + 1)) and sum("0" <= c <= "9" for c in m[1]) >= NUMBERED_DIGITS):
                account_end = m.end(1)
                spans.append(("account", m.start(1), account_end))
    order = {k: i for i, k in enumerate(BASE + ADDED)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _finder(batches):
    for batch in batches:
        columns: dict[str, list] = {f"n_{k}": [] for k in BASE} | {"n_added": [], "base_sha256": [], "spans": []}
        for text in batch.column("text").to_pylist():
            spans = find(text) if text else []
            base = [s for s in spans if s[0] in BASE]
            for k in BASE:
                columns[f"n_{k}"].append(sum(s[0] == k for s in base))
            columns["n_added"].append(len(spans) - len(base))
            columns["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            columns["spans"].append(_joined(spans))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in columns.items()]], ["doc_id", *columns])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds and of all added ones, base_sha256 and spans for every row of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_finder, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in (*BASE, "added"))}, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
