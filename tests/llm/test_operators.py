"""Each operator against a brute-force version on small fixtures with nulls, blanks, ties, repeats and extra columns."""

import hashlib
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from accolade.llm import op01_fingerprints, op02_bpe, op03_suffix_dedup, op04_pii, op05_ngram_join, op06_mixing, op07_media, op08_line_dedup, op09_language_id, op10_warc
from accolade.llm._shared import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, a string"
SPACE = r"[^\x20\x09-\x0D]+"


def frame(spark, texts, sources=("s", None, "t")):
    return spark.createDataFrame([(d, t, "en", sources[i % len(sources)], 0, 7, "x") for i, (d, t) in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(5, 60))] for _ in range(25)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "É ü 日本 word")]
    for i in range(120):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((10 + i, " ".join(w[:5]) + "\n" + r.choice([" ", "  ", "\n"]).join(w[5:])))
    out += [(10, out[6][1]), (500, out[7][1]), (None, out[8][1]), (501, "aaaa " * 3000)]
    return out


def rows(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 520)] + [(600, 600), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("cuts", [1024, 3])
def test_fingerprints(spark, texts, monkeypatch, cuts):
    monkeypatch.setattr(op01_fingerprints, "RANGE_ROWS", 9)
    monkeypatch.setattr(op01_fingerprints, "MOST_CUTS", cuts)
    df = frame(spark, texts)
    got = op01_fingerprints.edited_fingerprints(df, 0.02, 0.9).collect()
    unsigned = lambda t: int.from_bytes(__import__("xxhash").xxh64(t.encode(), seed=42).digest(), "big", signed=True)
    order = sorted([(d, t or "") for d, t in texts], key=lambda x: (x[0] is None, -(x[0] or 0), unsigned(x[1])))
    want = []
    for i, (d, t) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], key=repr) == sorted(want, key=repr)
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        for t in [t or "" for d, t in texts if d == r["doc_id"]]:
            if len(t) == r["n_chars"]:
                assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) > 20
    assert op01_fingerprints.edited_fingerprints(frame(spark, [(1, "only one")])).first()["near_next"] == 1.0
    assert op01_fingerprints.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_cells(texts, least, most):
    """The subsets' hashes of each text, from the definitions; xxhash64 chains through its columns or elements."""
    import struct

    import xxhash

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    word = lambda w: signed(xxhash.xxh64(w.encode(), seed=42).intdigest())

    def chain(values, formats):
        seed = 42
        for v, f in zip(values, formats):
            seed = xxhash.xxh64(struct.pack(f, v), seed=seed).intdigest()
        return signed(seed)

    sets = [{word(w) for w in re.split(r"[\x00-/:-@\[-`{-\x7F]+", t.lower()) if w} for t in texts]
    copies = [tuple(min(chain((h, i), ("<q", "<i")) for h in s) for i in range(op01_fingerprints.MINIMA)) if s else None for s in sets]
    members = Counter(c for c in copies if c)
    groups = {c: n for c, n in members.items() if n > max(1.0, least * len(texts))}
    size = len(texts) - sum(groups.values()) + len(groups)
    df = Counter()
    for s, c in zip(sets, copies):
        for h in s:
            df[h] += max(1, op01_fingerprints.UNITS // groups[c]) if c in groups else op01_fingerprints.UNITS
    lexicon = {h for h, n in df.items() if max(2, int(least * size)) <= n / op01_fingerprints.UNITS <= max(2.0, most * size)}
    mask = (1 << op01_fingerprints.TABLE_BITS) - 1
    slots = {x for h in lexicon for x in (h & mask, (h >> 64 - op01_fingerprints.TABLE_BITS) & mask)}
    out = []
    for s in sets:
        own = [h for h in s if h & mask in slots and (h >> 64 - op01_fingerprints.TABLE_BITS) & mask in slots]
        level, cells = sorted(own if own and len(own) >= op01_fingerprints.FEW_SHARE * len(s) else s), []
        for k in range(4):
            if k:
                level = [h for h in level if h >> 24 + 2 * k & 3 == 0]
            for c in range(16):
                some = [h for h in level if h >> 34 + 4 * k & 15 == c]
                cells.append(f"{chain(some, ['<q'] * len(some)) & 0xFFFFFFFF:08x}" if some else "")
        out.append(cells)
    return out


def test_fingerprints_by_brute_force(spark, texts):
    docs = sorted({(i, t or "") for i, (_, t) in enumerate(texts)}, reverse=True)
    got = {r["doc_id"]: r for r in op01_fingerprints.edited_fingerprints(frame(spark, docs), 0.02, 0.3).collect()}
    plain = [t for _, t in docs]
    cells = brute_cells(plain, 0.02, 0.3)
    like = lambda a, b: 1.0 if not any(a + b) else sum(x == y for x, y in zip(a, b) if x or y) / sum(bool(x or y) for x, y in zip(a, b))
    for n, (i, t) in enumerate(docs):
        after = (n + 1) % len(docs)
        assert got[i]["fingerprint"] == ".".join(c or "-" for c in cells[n])
        assert got[i]["near_next"] == pytest.approx(like(cells[n], cells[after]))
    assert len({tuple(c) for c in cells}) > 40


def test_fingerprints_without_ids(spark, texts, monkeypatch):
    monkeypatch.setattr(op01_fingerprints, "RANGE_ROWS", 4)
    docs = [(None, t) for _, t in texts[:30]] + [(1, "a b c"), (None, "a b c")]
    got = op01_fingerprints.edited_fingerprints(frame(spark, docs), 0.02, 0.9).collect()
    unsigned = lambda t: int.from_bytes(__import__("xxhash").xxh64(t.encode(), seed=42).digest(), "big", signed=True)
    order = sorted([(d, t or "") for d, t in docs], key=lambda x: (x[0] is None, -(x[0] or 0), unsigned(x[1])))
    want = []
    for i, (d, t) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(t) // 2
        want.append((d, hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted([(r["doc_id"], r["edited_sha256"]) for r in got], key=repr) == sorted(want, key=repr)


def test_fingerprints_of_a_large_group_of_copies(spark):
    r = random.Random(21)
    words = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    base = r.sample(words, 146)
    docs = [(2 * i, " ".join(r.choice(words) for _ in range(100))) for i in range(400)]
    for i in range(200):
        w = list(base)
        for _ in range(2):
            w[r.randrange(146)] = r.choice(words)
        docs.append((2 * i + 1, " ".join(w)))
    got = op01_fingerprints.fingerprints(frame(spark, docs))
    cells = [row["cells"] for row in got.where("doc_id % 2 = 1").orderBy("doc_id").collect()]
    like = []
    for a, b in zip(cells, cells[1:]):
        pairs = [(x, y) for x, y in zip(a, b) if x or y]
        like.append(sum(x == y for x, y in pairs) / len(pairs))
    # Many terms count, so no pair of copies is taken for different and nearly all are alike.
    assert min(sum(x != "" for x in c) for c in cells) >= 20
    assert min(like) > 0.3 and sorted(like)[len(like) // 2] > 0.7


def test_bpe_matches_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(op02_bpe.default_path())
    r = random.Random(3)
    odd = ["<|endoftext|>hi", "a<|startoftext|> b", "İstanbul ΣΑΣ ǅ", "é", "ẞ ß\u0085x\x1cy", "日本語１２３", "don't we'll I'M", "½²", "ﬁ", "\x00\x01", "ab" * 5000]
    odd += ["".join(r.choice("aBcé ÀÖ×'s1½²́ \n<|>ΣςDž٣") for _ in range(40)) for _ in range(100)]
    docs = texts + list(enumerate(odd, 1000))
    got = op02_bpe.encode_documents(frame(spark, docs))
    want = []
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert op02_bpe.encode_documents(frame(spark, docs).limit(0)).count() == op02_bpe.decode_documents(got.limit(0)).count() == 0
    decoded = op02_bpe.decode_documents(got.where("doc_id = 3")).first()["decoded"]
    assert decoded == library.decode(library.encode("One two", add_special_tokens=False).ids, skip_special_tokens=False)
    small = op02_bpe.Codec(op02_bpe.default_path(), leaf=8)
    for _ in range(150):
        t = "".join(r.choice(r.choice(["ab", "theand", "é日", "!?."])) for _ in range(r.randint(9, 300)))
        assert np.frombuffer(small.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def brute_repeats(docs, length):
    data = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(spark, texts):
    df = frame(spark, texts)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(op03_suffix_dedup.remove_repeats(df, 40, 16), *columns) == brute_repeats(texts, 40)
    assert rows(op03_suffix_dedup.remove_repeats(df), *columns) == brute_repeats(texts, 200)
    assert op03_suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_dedup_of_a_crowded_hash(spark, monkeypatch):
    monkeypatch.setattr(op03_suffix_dedup, "MOST_SEGMENTS", 5)
    r = random.Random(13)
    passage = "".join(r.choice("abcdefgh ") for _ in range(60))
    docs = [(i, "".join(r.choice("xyz") for _ in range(r.randint(0, 6))) + passage[r.randint(0, 6) :] + "".join(r.choice("xy") for _ in range(r.randint(0, 6)))) for i in range(80)]
    got = op03_suffix_dedup.remove_repeats(frame(spark, docs), 58, 30)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(docs, 58)


def test_suffix_dedup_of_long_strings(spark):
    r = random.Random(14)
    one = "".join(r.choice("abcd") for _ in range(500))
    docs = [(1, one), (2, one), (3, "x" + one[100:] + "y"), (4, one[:301] + "z"), (5, "b" * 1000)]
    for length in (200, 300):
        assert rows(op03_suffix_dedup.remove_repeats(frame(spark, docs), length, 100), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(docs, length)


def test_column_wise_construction(tmp_path):
    r = random.Random(5)
    for n in range(150):
        length, alphabet = r.choice([1, 2, 3, 5, 300 if n % 30 == 0 else 4]), r.choice([b"a", b"ab", b"abcd"])
        strings = [bytes(r.choice(alphabet) for _ in range(r.randint(length, length + 25))) for _ in range(r.randint(1, 10))]
        strings += strings[: n % 2]
        count = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[count[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
        assert [g.tolist() for g in op03_suffix_dedup.repeated_windows(strings, length)] == want
        if length < 300:  # in files, read in pieces of five rows
            assert [g.tolist() for g in op03_suffix_dedup.repeated_windows(strings, length, f"file://{tmp_path}/files", 7, 5)] == want
    assert op03_suffix_dedup.repeated_windows([], 5) == [] and not list((tmp_path / "files").iterdir())
    with pytest.raises(ValueError):
        op03_suffix_dedup.repeated_windows([b"a"], 0)


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and op04_pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], op04_pii.BASE.index(s[0])))


def test_personal_data(spark):
    r = random.Random(7)
    strings = ["".join(r.choice(r.choice(["0123456789", "0123456789 -.", "+()@.-ab é"])) for _ in range(r.randint(0, 60))) for _ in range(20_000)]
    strings += ["4111 1111-1111 1111", "x@y.z", "a@b@c.d", "1.2.3.4.5.6.7.8", "+1 (389) 555-5010", "9" * 5000, "0" * 4000 + ".1.1.1"]
    for s in strings:
        assert [x for x in op04_pii.find(s) if x[0] in op04_pii.BASE] == brute_base(s)
    found = op04_pii.find("see https://bob:pw@host.example/x user: bob77 superuser: eve99 account no: DE8937")
    assert [k for k, _, _ in found] == ["login", "email", "account", "account"]
    for text, want in [
        ("IBAN: DE89 3704 0044 0532 0130 00 and more", ["DE89 3704 0044 0532 0130 00"]), ("iban DE89370400440532013000", ["DE89370400440532013000"]), ("IBAN DE88 3704 0044 0532 0130 00", []),
        ("SSN 123-45-6789", ["123-45-6789"]), ("ssn 000-45-6789", []), ("social security number: 123456789", ["123456789"]), ("UserId=Eve-77 x", ["Eve-77"]), ("ACCOUNT number: 12-3456 7890, then", ["12-3456 7890"]),
        ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]), ("password: hunter2hunter2", ["hunter2hunter2"]), ("a token of thanks", []), ("user: " + "a1" * 500, ["a1" * 500]),
        ("Account no: \u0130" + " user=x9y8", ["x9y8"]), ("account number 12-3456 7890 is", ["12-3456 7890"]), ("Account no 99887766.", ["99887766"]), ("user id ab-2041 x", ["ab-2041"]), ("user id is 2041", []), ("account number 7 of 9", []), ("account name 123456", []),
    ]:
        assert [text[a:b] for k, a, b in op04_pii.find(text) if k in ("account", "secret")] == want, text
    assert op04_pii.find_personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    got = op04_pii.find_personal_data(frame(spark, [(1, None), (2, "é x@y.z"), (2, "é x@y.z")])).collect()
    assert sorted((r["doc_id"], r["n_email"], r["spans"]) for r in got) == [(1, 0, ""), (2, 1, "email:2:7"), (2, 1, "email:2:7")]
    assert got[0]["base_sha256"] in {hashlib.sha256(x).hexdigest() for x in (b"", b"email:2:7")}
    assert op04_pii.redact("é x@y.z!", op04_pii.find("é x@y.z!")) == "é [email]!"


def brute_groups(docs, n=5, percent=75):
    """Every row is a vertex of its own; a row's component is the least known doc_id that it reaches."""
    sets = []
    for d, t in docs:
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, s) in enumerate(sets):
        for j, (_, t) in enumerate(sets[:i]):
            if s and 100 * len(s & t) >= percent * len(s | t):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted([(d, len(s), least.get(root(i))) for i, (d, s) in enumerate(sets)], key=repr)


def test_ngram_join(spark, texts):
    df = frame(spark, texts)
    columns = ("doc_id", "n_shingles", "component_id")
    assert rows(op05_ngram_join.ngram_components(df), *columns) == brute_groups(texts)
    assert rows(op05_ngram_join.ngram_components(df, 2, 50), *columns) == brute_groups(texts, 2, 50)
    assert op05_ngram_join.ngram_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ngram_join_repeated_and_unknown_ids(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(reversed(words))
    docs = [(1, a), (1, b), (2, b + " x"), (3, a + " y")]
    got = dict(rows(op05_ngram_join.ngram_components(frame(spark, docs)), "doc_id", "component_id"))
    assert got == {1: 1, 2: 1, 3: 1}
    # A chain whose middle has no id, and a group without any id.
    chain = [(8, " ".join(words[:48])), (None, " ".join(words[:56])), (9, " ".join(words)), (None, "alone in here"), (4, " ".join(words[:50]))]
    columns = ("doc_id", "n_shingles", "component_id")
    assert rows(op05_ngram_join.ngram_components(frame(spark, chain), 1, 85), *columns) == brute_groups(chain, 1, 85)
    long = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = "".join("ba"[bin(i).count("1") % 2] for i in range(2048))
    assert rows(op05_ngram_join.ngram_components(frame(spark, [(1, long), (2, other), (3, long.upper())])), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1)]


def test_ngram_join_tiles(spark, texts, monkeypatch):
    monkeypatch.setattr(op05_ngram_join, "_TILE", 3)
    r = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    shared = words[:60]
    # Half of each text is common to all, so columns hold all documents and few of them are linked.
    docs = [(i, " ".join(shared + [r.choice(words[60:90]) for _ in range(r.randint(5, 40))])) for i in range(60)]
    columns = ("doc_id", "n_shingles", "component_id")
    want = brute_groups(docs, 2, 60)
    assert 3 < len({c for _, _, c in want}) < 58
    assert rows(op05_ngram_join.ngram_components(frame(spark, docs), 2, 60), *columns) == want


def test_mixing(spark, texts):
    got = op06_mixing.mix(frame(spark, texts)).collect()
    by_source = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by_source.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    total = sum(s[0] for s in by_source.values())
    targets, weights, fixed = {}, {k: w for k, w in zip(["s", "t", None], (3, 1, 2))}, set()
    while True:  # reshares until no source is above its cap
        rest = 1.5 * total - sum(targets[k] for k in fixed)
        open_ = [k for k in by_source if k not in fixed]
        targets |= {k: rest * weights[k] / sum(weights[j] for j in open_) for k in open_}
        above = {k for k in open_ if targets[k] > 2 * by_source[k][0]}
        if not above:
            break
        targets |= {k: 2.0 * by_source[k][0] for k in above}
        fixed |= above
    longest = max(r["size"] for r in got)
    for k, (size, taken, target, source_size) in by_source.items():
        assert source_size == size and target == pytest.approx(targets[k]) and abs(taken - target) <= longest / 2 + 1
    assert all(r["taken"] % r["size"] == 0 for r in got if r["size"])
    assert sorted(map(repr, got)) == sorted(map(repr, op06_mixing.mix(frame(spark, texts)).collect()))
    assert op06_mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r["target"] for r in op06_mixing.mix(frame(spark, [(1, None), (2, " ")])).collect()} == {0.0}
    kept = op06_mixing.mixed_documents(frame(spark, texts).withColumn("mix_rows", __import__("pyspark").sql.functions.lit(1)))
    copies = Counter((r["doc_id"], r["source"], r["text"]) for r in kept.collect())
    want = Counter()
    for r in got:
        want[r["name"], r["source"]] += r["taken"] // r["size"] if r["size"] else 0
    name = lambda d, t: f"{'' if d is None else d}:{hashlib.md5(t.encode()).hexdigest()}"
    assert {(name(d, t), s): n for (d, s, t), n in copies.items()} == {k: n for k, n in want.items() if n}


def test_mixing_matches_sql(spark, texts):
    import duckdb

    docs = texts + [(2000 + i, " ".join(["w"] * (i * i % 90))) for i in range(150)]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(d, t, ("s", None, "t")[i % 3]) for i, (d, t) in enumerate(docs)])
    columns = ("doc_id", "size", "source_size", "target", "taken")
    assert rows(op06_mixing.mix(frame(spark, docs)), *columns) == sorted(con.sql(op06_mixing.SQL).fetchall(), key=repr)


def test_mixing_follows_inclusion_probabilities(spark):
    """Over many seeds documents are taken about as often as min(1, c w) says."""
    sizes = [1 + i % 40 for i in range(400)]
    docs = [(i, " ".join([f"w{i}"] * n)) for i, n in enumerate(sizes)]
    df, seen, runs = frame(spark, docs, ("s",)), Counter(), 12
    uniform = op06_mixing.uniform
    for seed in range(runs):
        op06_mixing.uniform = lambda name, seed=seed: uniform(name, f"seed{seed}")
        try:
            for r in op06_mixing.mix(df).where("extra > 0").select("size").collect():
                seen[r["size"]] += 1
        finally:
            op06_mixing.uniform = uniform
    # One source only: its target is 1.5 times its words, so half the words are sampled.
    weight = lambda n: n >> max(0, n.bit_length() - 5) << max(0, n.bit_length() - 5)
    low, high = 0.0, 1.0
    for _ in range(60):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(1, c * weight(n)) * n for n in sizes) < sum(sizes) / 2 else (low, c)
    for group in (range(1, 11), range(11, 21), range(21, 31), range(31, 41)):
        expected = sum(10 * min(1, low * weight(n)) for n in group) * runs
        assert abs(sum(seen[n] for n in group) - expected) <= 4 * expected**0.5 + 2 * runs


def test_media(spark, texts):
    got = {(r["doc_id"], r["n_bytes"]): r for r in op07_media.media_features(frame(spark, texts)).collect()}
    for d, t in texts:
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[d, len(data)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = op07_media.to_wav(payload)
        assert r["media_bytes"] == len(media) and r["media_sha256"] == hashlib.sha256(media).hexdigest()
    with wave.open(__import__("io").BytesIO(op07_media.to_media(frame(spark, [(1, "abc")])).first()["media"])) as w:
        assert w.readframes(64)[:3] == b"abc"
    # A tone that changes its pitch gives its own bins at their times.
    t = np.arange(8192)
    tone = np.where(t < 4096, np.sin(2 * np.pi * 20 * t / 256), np.sin(2 * np.pi * 50 * t / 256))
    pairs = list(zip(*(v.tolist() for v in op07_media.peak_pairs((128 + 100 * tone).astype(np.uint8)))))
    assert any(c // 32 // 256 == 20 for at, c in pairs if at < 28) and any(c // 32 // 256 == 50 for at, c in pairs if at > 34)
    assert len(op07_media.peak_pairs(np.full(640, 7, np.uint8))[0]) == 0
    for r in got.values():
        assert r["feature"] == ",".join(f"{t:x}:{c:x}" for t, c in zip(r["times"], r["codes"], strict=True))
    # Samples behind the last whole window count.
    a, b = (b"x" * 256 + tail for tail in (b"abcdefgh" * 8, b"hgfedcba" * 8))
    assert op07_media.describe(a.decode())[6] != op07_media.describe(b.decode())[6]
    assert op07_media.media_features(spark.createDataFrame([], SCHEMA)).count() == 0
    assert op07_media.media_features(frame(spark, [(1, "é" * 2_000_000)])).first()["n_bytes"] == 4_000_000


def brute_pairs(payload):
    """Peak pairs by sums instead of a fast transform, window by window."""
    x = list(payload)
    while len(x) < 256 or (len(x) - 256) % 128:
        x.append(x[-1])
    strongest = []
    for at in range(0, len(x) - 255, 128):
        w = np.array(x[at : at + 256], np.float64)
        w = (w - w.mean()) * np.hanning(256)
        power = [abs((w * np.exp(-2j * np.pi * k * np.arange(256) / 256)).sum()) ** 2 for k in range(129)]
        strongest.append([max((power[k], -k) for k in range(lo, hi)) for lo, hi in zip((2, 12, 32, 72), (12, 32, 72, 129))])
    out = []
    for band in range(4):
        peaks = [(i, -s[band][1]) for i, s in enumerate(strongest) if s[band][0] > 1 and all(s[band][0] >= strongest[j][band][0] for j in range(max(0, i - 2), min(len(strongest), i + 3)))]
        for n, (i, f) in enumerate(peaks):
            next_ones = [(i, (f * 256 + g) * 32 + j - i) for j, g in peaks[n + 1 : n + 3] if j - i < 32]
            out += next_ones or [(i, (f * 256 + f) * 32)]
    return sorted(out)


def test_media_features_by_brute_force():
    r = random.Random(15)
    for n in (64, 256, 320, 1024, 2112):
        payload = bytes(r.choice(b"the quick brown fox\n\xc3\xa9") for _ in range(n))
        times, codes = op07_media.peak_pairs(np.frombuffer(payload, np.uint8))
        assert list(zip(times.tolist(), codes.tolist())) == brute_pairs(payload)


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_many_pairs_within(monkeypatch):
    """Bands of one to four words against a table of edits; groups of few pairs go one by one, with the same answers."""
    rng = random.Random(31)
    a, b, k, want = [], [], [], []
    for number in range(160):
        letters = rng.choice(["ab", "abcd", "a\u00e9\u6f22\U0001f600\x00"])
        x = "".join(rng.choice(letters) for _ in range(rng.choice([0, 5, 60, 150])))
        y = list(x)
        for _ in range(rng.choice([0, 3, 40, 90])):
            place = rng.randrange(len(y) + 1)
            y[place : place + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        y = "".join(y)
        a.append(x)
        b.append(y)
        k.append(max(0, edits(x, y) + rng.choice([-1, 0, 1, 40])))
        want.append(edits(x, y) <= k[-1])
    assert {31 < v for v in k} == set(want) == {True, False}
    for few in (1, 1000):
        monkeypatch.setattr(op08_line_dedup, "_FEW", few)
        assert op08_line_dedup._all_within(a, b, np.array(k)).tolist() == want
    assert op08_line_dedup._all_within([], [], np.zeros(0, int)).tolist() == []


def test_within():
    r = random.Random(5)
    for _ in range(1500):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 12)))
        b = "".join(c for c in a if r.random() < 0.8) + r.choice(["", "a", "bc"])
        for k in range(4):
            assert op08_line_dedup.within(a, b, k) == (edits(a, b) <= k)


def brute_lines(docs):
    import xxhash

    h = lambda t: int.from_bytes(xxhash.xxh64(t.encode(), seed=42).digest(), "big", signed=True)
    first = lambda d: -(1 << 63) if d is None else d
    seen, out = [], {}
    for d, _, t in sorted({(first(d), h(t), t) for d, t in docs if t is not None}):
        kept, same, near = [], 0, 0
        for line in t.split("\n"):
            x = line.strip(" \t\r")
            if len(x) >= 16:
                if x in seen:
                    same += 1
                    continue
                is_near = any(abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2 for y in seen)
                seen.append(x)
                if is_near:
                    near += 1
                    continue
            kept.append(line)
        out[d, t] = (len(t.split("\n")) if t else 0, same, near, "\n".join(kept))
    return sorted([(d, *(out[first(d), t] if t is not None else (0, 0, 0, None))) for d, t in docs], key=repr)


def test_line_dedup(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(14, 40))) for _ in range(25)]

    def mutate(s):
        s = list(s)
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(s))
            s[i : i + r.randint(0, 1)] = r.choice(["", "a", "é"])
        return "".join(s) or "a"

    docs = [(0, None), (1, "")] + [(i + 2, "\n".join(mutate(r.choice(base)) if r.random() < 0.7 else r.choice(["", "  x", " " + r.choice(base) + "\t", "short"]) for _ in range(r.randint(1, 6)))) for i in range(60)]
    docs += [(7, docs[9][1]), (None, docs[20][1]), (9, docs[9][1])]
    assert rows(op08_line_dedup.dedup_lines(frame(spark, docs)), "doc_id", "n_lines", "n_same", "n_near", "kept_text") == brute_lines(docs)
    assert op08_line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_dedup_edits_grow_with_length(spark):
    r = random.Random(16)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(3, 9))) for _ in range(300)]
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (9, 10, 12, 18, 20, 35, 40, 42, 70, 90, 160, 170)]

    def mutate(s):
        most, s = len(s) // 20, list(s)
        if r.random() < 0.3:  # spread evenly, so that only one segment can be left whole
            at, n = range(9, len(s), 19), most + r.randint(0, 1)
            for i in list(at)[:n]:
                s[i] = "#"
        else:
            for _ in range(r.randint(0, most + 2)):
                i = r.randrange(len(s))
                s[i : i + r.randint(0, 1)] = r.choice(["", "a", "é"])
        return "".join(s)

    docs = [(i, "\n".join(mutate(r.choice(base)) for _ in range(3))) for i in range(30)]
    seen, want = [], []
    for d, t in docs:
        kept, near, same = [], 0, 0
        for x in t.split("\n"):
            if x in seen:
                same += 1
                continue
            most = [max(2, min(len(x), len(y)) // 20) for y in seen]
            is_near = any(abs(len(x) - len(y)) <= k and edits(x, y) <= k for y, k in zip(seen, most, strict=True))
            seen.append(x)
            near += is_near
            kept += [] if is_near else [x]
        want.append((d, 3, same, near, "\n".join(kept)))
    assert sum(w[3] for w in want) > 20 and sum(len(w[4].split("\n")) for w in want) > 12
    assert rows(op08_line_dedup.dedup_lines(frame(spark, docs)), "doc_id", "n_lines", "n_same", "n_near", "kept_text") == sorted(want, key=repr)
    for _ in range(300):
        a, b = r.choice(base)[:60], r.choice(base)[:60]
        k = edits(a, b)
        assert op08_line_dedup.within(a, b, k) and not (k and op08_line_dedup.within(a, b, k - 1))


def test_line_dedup_short_repeats(spark, tmp_path):
    docs = [(1, "And ornd.\n\nx"), (2, " And ornd.\t\n \nAnd ornd!"), (3, "x\nOf, edti oner.\nx"), (4, "Of, edti oner."), (5, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op08_line_dedup.query(spark, str(tmp_path))
    kept = {1: "And ornd.\n\nx", 2: " \nAnd ornd!", 3: "Of, edti oner.", 4: "", 5: ""}
    same = {1: 0, 2: 1, 3: 2, 4: 1, 5: 0}
    want = [(d, same[d], 0, hashlib.sha256(kept[d].encode()).hexdigest()) for d, _ in docs]
    assert rows(got, "doc_id", "n_same", "n_near", "kept_sha256") == sorted(want, key=repr)


def test_line_dedup_clashing_columns_tiles_and_digests(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(op08_line_dedup, "_TILE", 3)
    r = random.Random(17)
    thue = ["".join(pair[bin(i).count("1") % 2] for i in range(1024)) for pair in ("ab", "ba")]
    head = "".join(r.choice("abcdef") for _ in range(30))
    # Lines of one template: all share segments, few are within two edits.
    many = [head + "".join(r.choice("uvwxyz") for _ in range(9)) for _ in range(50)]
    many += [m[:-1] + r.choice("uvwxyz") for m in many[:10]]
    docs = [(1, thue[0]), (2, thue[1])] + [(3 + i, m) for i, m in enumerate(many)]
    df = frame(spark, docs)
    for name in ("near", "same", "line", "kept_text", "n_lines", "doc_id_2", "text_hash"):
        df = df.withColumn(name, F.lit(1))
    got = op08_line_dedup.dedup_lines(df)
    assert len(set(got.columns)) == len(got.columns) and "near" in got.columns
    want = [(*w[:4], w[4]) for w in brute_lines(docs)]
    assert rows(got, "doc_id", "n_lines", "n_same", "n_near", "kept_text") == want
    assert sum(w[3] for w in want) >= 5


def test_line_dedup_sends_few_rows_and_decides_repeats_where_they_are():
    r = random.Random(21)
    common = "A very common line that many documents hold."
    texts = [f"{common}\n{i} " + "".join(r.choice("abcdefghij ") for _ in range(200)) for i in range(3000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 100)), pa.array(range(i, i + 100)), pa.array(texts[i : i + 100])], ["doc_id", "text_hash", "text"]) for i in range(0, 3000, 100)]
    sent = [(b, p) for x in op08_line_dedup._occurrences(1)(iter(batches)) for b, p in zip(x["block"].to_pylist(), x["packed"].to_pylist())]
    seen = [np.frombuffer(p, op08_line_dedup._SEEN) for b, p in sent if b >= 0]
    # The common line travels to its block once from this task; its later occurrences are decided.
    assert sum(map(len, seen)) == 3001 and sum(len(p) for b, p in sent if b < 0) == 2999 * op08_line_dedup._SEEN.itemsize
    found = pa.Table.from_batches(op08_line_dedup._firsts(iter([pa.RecordBatch.from_arrays([pa.array([b for b, _ in sorted(sent)]), pa.array([p for _, p in sorted(sent)], pa.binary())], ["block", "packed"])])))
    assert found.num_rows == 6000 and sorted(found.filter(pc.equal(found["kind"], 1))["d"].to_pylist()) == list(range(1, 3000))
    # Values of a table's blocks: few rows for each block, however many slices and rows they come from.
    tables = list(op08_line_dedup._table_entries(16, 2, 20, 8, 0, 1)(iter(batches)))
    assert sum(x.num_rows for x in tables) <= 8
    probes = pa.RecordBatch.from_arrays([pa.array([i % 50 for i in range(3000)]), pa.array([r.randbytes(2 * op08_line_dedup._KEYED) for _ in range(3000)])], ["block", "packed"])
    assert sum(x.num_rows for x in op08_line_dedup._wanted_values(8)(iter([probes.slice(i, 100) for i in range(0, 3000, 100)]))) <= 8


def test_line_dedup_looks_at_few_bytes_at_once(monkeypatch):
    import tracemalloc

    r = random.Random(24)
    lines = ["".join(r.choice("abcdé ") for _ in range(r.randint(0, 3000))) for _ in range(2000)]
    raw, cuts = np.frombuffer("".join(lines).encode(), np.uint8), np.cumsum([0, *[len(x.encode()) for x in lines]])
    tracemalloc.start()
    counts = np.stack(op08_line_dedup._class_counts(raw, cuts[:-1], cuts[1:]), 1).view(np.uint8).reshape(-1, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in range(0, 2000, 100):
        c = Counter(op08_line_dedup._CLASS[b] for b in lines[i].encode())
        assert counts[i].tolist() == [c[k] % 256 for k in range(16)]
    assert len(raw) > 3 << 20 and peak < 20 << 20, peak
    monkeypatch.setattr(op08_line_dedup, "_TILED", 40_000)
    tiles = np.sort(np.array([r.randrange(60) for _ in lines]))
    table = pa.table({"tile": tiles, "line_text": lines})
    parts = list(op08_line_dedup._tiles(iter(table.to_batches(max_chunksize=300))))
    assert pa.concat_tables(parts).equals(table) and len(parts) > 20
    edges = [set(p["tile"].to_pylist()) for p in parts]
    assert sum(map(len, edges)) == len(set(tiles.tolist()))


def test_line_dedup_verifies_what_is_between_common_ends():
    r = random.Random(22)
    for _ in range(300):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(2))
        x, y = op08_line_dedup._between(a, b)
        assert len(x) >= len(y) and (not y or (x[0] != y[0] and x[-1] != y[-1])) and edits(x, y) == edits(a, b)


def test_ngram_join_passes_on_pairs_that_may_reach_the_threshold(spark, monkeypatch):
    passed, summed = [], op05_ngram_join._summed

    def counted(partial, percent):
        out = summed(partial, percent)
        passed.append((partial.count(), out.count()))
        return out

    monkeypatch.setattr(op05_ngram_join, "_summed", counted)
    monkeypatch.setattr(op05_ngram_join, "_TILE", 16)
    r = random.Random(23)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(60):  # near copies of one text, just below the threshold to most others
        w = list(base)
        for j in r.sample(range(5, 95), 3):
            w[j] = f"x{r.randrange(10**9)}"
        docs.append((i, " ".join(w)))
    got = op05_ngram_join.ngram_components(frame(spark, docs))
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(96)} for d, t in docs}
    root = {d: d for d in sets}
    for x in sets:
        for y in sets:
            if x < y and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                low, high = sorted((root[x], root[y]))
                root = {d: low if c == high else c for d, c in root.items()}
    assert {x["doc_id"]: x["component_id"] for x in got.collect()} == root
    (rows_passed, pairs), = passed
    assert rows_passed <= 2 * len(docs), passed


def test_line_dedup_passes_on_lines_not_pairs(spark, monkeypatch):
    counts, stored = {}, op08_line_dedup.stored

    def counted(df, name):
        out = stored(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(op08_line_dedup, "stored", counted)
    monkeypatch.setattr(op08_line_dedup, "_TILE", 40)
    r = random.Random(19)
    head = "".join(r.choice("abcdef") for _ in range(30))
    # Anagrams behind one head: all share two segments and have equal counts, few are within two edits.
    docs = [(i, head + "".join(r.sample("uvwxyzuvw", 9))) for i in range(100)] + [(200, head + "uvwxyzuv"), (201, head + "vwxyzuv")]
    got = op08_line_dedup.dedup_lines(frame(spark, docs))
    assert rows(got, "doc_id", "n_lines", "n_same", "n_near", "kept_text") == brute_lines(docs)
    assert max(counts.values()) <= 8 * len(docs), counts


def test_line_dedup_sends_only_keys_that_meet(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = random.Random(18)
    alone = ["".join(r.choice("abcdefghij ") for _ in range(r.choice([40, 150, 400]))) + "." for _ in range(300)]
    pairs = [(x, x[:20] + "#" + x[21:]) for x in alone[:5]]
    docs = [(i, x) for i, x in enumerate(alone)] + [(1000 + i, y) for i, (_, y) in enumerate(pairs)]
    keyed = frame(spark, docs).select("text")
    entries = sum(len(x) // 20 + 1 for _, x in docs)
    met, kept = op08_line_dedup._meeting_keys(keyed, entries, 6, 16, 2, 20)
    sent = met.agg(F.sum(F.length("packed"))).first()[0] // op08_line_dedup._KEYED
    assert 5 <= sent < entries // 10
    op08_line_dedup.drop_stored(*kept)
    # Tables of the least size, so that keys are dealt over four rounds.
    monkeypatch.setattr(op08_line_dedup, "_MOST_BLOCKS", 0)
    monkeypatch.setattr(op08_line_dedup, "_MOST_ROUNDS", 2)
    monkeypatch.setattr(op08_line_dedup, "_ENTRY_BITS", 1 << 14)
    got = op08_line_dedup.dedup_lines(frame(spark, docs))
    assert [x["doc_id"] for x in got.where("n_near > 0").orderBy("doc_id").collect()] == [1000 + i for i in range(5)]


def test_language_field(spark):
    r = random.Random(8)
    vocabulary = {lang: [a + b for a in start for b in end] for lang, start, end in (("aa", ["ka", "to", "mi", "ru"], ["ling", "sto", "ve"]), ("bb", ["ez", "oq", "ul", "yi"], ["ción", "ar", "ñe"]), ("cc", ["schn", "br", "gl", "pf"], ["ung", "heit", "öß"]))}
    docs = []
    for i in range(300):
        lang = r.choice(list(vocabulary))
        docs.append((i, " ".join(r.choice(vocabulary[lang]) for _ in range(r.randint(3, 400))), lang if i % 7 else None, lang))
    docs += [(1000, None, "aa", "und"), (1001, "12 34 — ?", "bb", "und"), (1002, "", None, "und"), (1003, "。、", "aa", "und")]
    df = spark.createDataFrame([(d, t, lang, 1) for d, t, lang, _ in docs], "doc_id long, text string, lang string, score long")
    got = {r["doc_id"]: r for r in op09_language_id.predict_languages(df).collect()}
    assert len(got) == len(docs)
    right = [got[d]["lang_pred"] == true for d, _, _, true in docs]
    assert sum(right) >= 0.99 * len(docs)
    for d, _, _, _ in docs:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= got[d]["score"] <= 1
    assert {got[d]["lang_pred"] for d in (1000, 1001, 1002, 1003)} == {"und"}
    kept = op09_language_id.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 300
    assert op09_language_id.predict_languages(df.limit(0)).count() == 0
    assert rows(op09_language_id.predict_languages(df.union(df.limit(20))).dropDuplicates(), "doc_id") == rows(df, "doc_id")
    # Words of a text that switches its language have their own labels.
    mixed = " ".join([r.choice(vocabulary["aa"]) for _ in range(30)] + ["- 5"] + [r.choice(vocabulary["bb"]) for _ in range(30)])
    own = df.union(spark.createDataFrame([(2000, mixed, None, 1)], df.schema))
    words = {r["doc_id"]: r["words"] for r in op09_language_id.label_words(own).where("doc_id in (2000, 1000, 3)").collect()}
    assert words[1000] == [] and [mixed[w["start"] : w["end"]] for w in words[2000]] == [w for w in mixed.split() if w[0].isalpha()]
    assert sum(w["lang"] == ("aa" if i < 30 else "bb") for i, w in enumerate(words[2000])) >= 57 and all(0 < w["p"] <= 1.0001 for w in words[2000])


def test_forward_backward():
    rng = np.random.default_rng(0)
    x, A = rng.random((900, 3)) + 0.01, rng.random((3, 3)) + 0.1
    first = np.array([0, 1, 1, 300, 900])
    got = op09_language_id._sums_of_marginals(x, first, A)
    for k in range(4):
        seg = x[first[k] : first[k + 1]]
        v, forward, back, total = np.full(3, 1 / 3), [], np.ones(3), np.zeros(3)
        for e in seg:
            v = (v @ A) * e
            v /= v.sum()
            forward.append(v)
        for f, e in zip(forward[::-1], seg[::-1]):
            total += f * back / (f * back).sum()
            back = A @ (e * back)
            back /= back.sum()
        assert np.allclose(total, got[k])


def test_warc(spark):
    html = ["<p>é</p>" * 40, "short", "", None, "x" * 100, "y" * 99, "\r\n\r\nWARC/1.1\r\n" * 20]
    pages = [(i, None if i % 5 == 0 else f"http://h/{i}\r\n", html[i % 7]) for i in range(40)] + [(None, "u", "x" * 100), (3, "u", None), (4, "a", "x" * 100), (900, "v", "long" * 200_000), (900, "v", "long" * 200_000), (None, "w", "z" * 300), (None, None, "z" * 300), (None, "w", "z" * 300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", __import__("pyspark").sql.functions.lit(1)).repartition(3)
    folder = op10_warc.scratch(spark, "warc-test")
    index = op10_warc.normalise_archives(op10_warc.write_archives(df, folder), folder)
    got = rows(op10_warc.read_archives(index, folder), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want, led = [], set()
    for p, _, h in pages:
        data = (h or "").encode()
        group = sorted([(q is None, q or 0, u is None, u or "", q) for q, u, g in pages if g == h])
        leads = len(data) < 100 or ((p is None, p or 0) == group[0][:2] and (p, h) not in led)
        led.add((p, h))
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "response" if leads else "revisit", None if leads else group[0][4]))
    assert got == sorted(want, key=repr)
    assert Counter(r[3] for r in got if r[2] == hashlib.sha256(b"z" * 300).hexdigest()) == {"response": 1, "revisit": 2}
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert got == sorted(con.sql(op10_warc.SQL).fetchall(), key=repr)
    empty = op10_warc.write_archives(df.limit(0), folder)
    assert op10_warc.read_archives(op10_warc.normalise_archives(empty, folder), folder).count() == 0
    # Every member can be inflated alone, and the sidecar lists them.
    path = folder.removeprefix("file://")
    for r in index.select("archive").distinct().collect():
        entries = [line.split() for line in open(f"{path}/{r['archive']}.idx")]
        whole = open(f"{path}/{r['archive']}", "rb").read()
        assert sum(int(e[3]) for e in entries) == len(whole)
        for _, kind, at, n in entries:
            assert f"WARC-Type: {kind}".encode() in zlib.decompress(whole[int(at) : int(at) + int(n)], 31)


def test_pipeline(spark, tmp_path, texts):
    import corpus_pipeline

    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    docs = [(i, "\n".join(" ".join(r.choice(vocabulary) for _ in range(12)) for _ in range(4)), "en", f"s{i % 3}", 5) for i in range(60)]
    docs += [(100, docs[0][1], "en", "s0", 5), (101, "1234 5678", "en", "s1", 5), (102, None, "en", "s1", 5)]
    near = docs[5][1].replace("\n", " ")
    docs.append((103, near + " more", "en", "s2", 5))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, now, str(tmp_path)), "test")
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids[name] = Counter(r["doc_id"] for r in now.collect())
    clean = {d[0] for d in docs[:60]}
    assert set(ids["language_id"]) == clean | {100, 103}
    assert set(ids["line_dedup"]) == clean | {103}
    assert set(ids["near_duplicates"]) == clean
    assert set(ids["mixing"]) <= clean and max(ids["mixing"].values()) <= 2
    out = corpus_pipeline.run(spark, str(tmp_path))
    codec = op02_bpe.codec(op02_bpe.default_path())
    want = sorted((d, len(codec.encode(dict((x[0], x[1]) for x in docs)[d])) // 4) for d, n in ids["mixing"].items() for _ in range(n))
    assert rows(out, "doc_id", "n_tokens") == sorted(want, key=repr)


def test_pipeline_of_an_empty_table_and_of_blanks(spark, tmp_path):
    import corpus_pipeline

    shape = "doc_id long, text string, lang string, source string, n_chars long"
    for name, docs in (("none", []), ("blank", [(1, None, "en", None, 0), (1, " ", None, "s", 1), (None, "12 34", "en", "s", 5)])):
        spark.createDataFrame(docs, shape).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.count() == 0 and {"doc_id", "n_tokens"} <= set(out.columns)
