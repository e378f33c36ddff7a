"""Vector codes, lexical search and byte-level encoding against plain versions, on nulls, ties, repeats, empty tables and further columns."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from accolade.llm import op11_vector_codes as V
from accolade.llm import op12_lexical_search as L
from accolade.llm import op13_byte_bpe as B

VECTORS = "vec_id long, embedding array<float>, label int, code string, part int"


def plain_codes(rows, parts, entries, rounds, scale):
    """Lloyd's rounds from the definitions, in Python's integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted(((i, [math.floor(scale * x) for x in v], lab) for i, v, lab in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        near = [[min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]
        if r < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [cut(v, p) for (_, v, _), n in zip(kept, near, strict=True) if n[p][1] == k]
                    if own:
                        books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    label = Counter()
    for (_, _, lab), n in zip(kept, near, strict=True):
        label[lab] += sum(d for d, _ in n)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda n: n if n < 1 << 63 else None
    return [(i, "".join(f"{k:02x}" for _, k in n), fits(sum(d for d, _ in n)), fits(label[lab]), sha) for (i, _, lab), n in zip(kept, near, strict=True)]


@pytest.mark.parametrize(("spread", "count"), [(1.0, 150), (3e6, 40), (2e10, 12)])
def test_vector_codes(spark, spread, count):
    r = random.Random(count)
    vector = lambda: [r.uniform(-spread, spread) for _ in range(12)]
    f32 = lambda v: None if v is None else [None if x is None else __import__("struct").unpack("f", __import__("struct").pack("f", x))[0] for x in v]
    rows = [(i, f32(vector()), r.choice([None, 1, 2])) for i in range(5, count)]
    rows += [(900, None, 1), (901, f32([1.0] * 11 + [None]), 1), (902, [float("nan")] + [0.0] * 11, 1), (903, [float("inf")] + [0.0] * 11, 2), (904, f32([0.5] * 11), 1), (905, [], 1)]
    rows += [rows[3], (None, rows[4][1], None), (7, f32([-0.001] * 12), None), (7, f32([-0.001] * 12), None)]
    df = spark.createDataFrame([(i, v, lab, "clash", 1) for i, v, lab in rows], VECTORS).repartition(3)
    codes, books = V.learn_codes(df, 4, 7, 2, 256)
    got = V.with_label_error(codes).collect()
    want = plain_codes(rows, 4, 7, 2, 256)
    assert sorted([(x["vec_id"], x["code"].hex(), x["error"], x["label_error"], books.sha256) for x in got], key=repr) == sorted(want, key=repr)
    back = V.decode_codes(codes, books).where("vec_id = 7").first()
    assert back["embedding"] == [x / 256 for p in range(4) for x in books.entries[p][back["code"][p]]]


def test_vector_codes_of_odd_tables(spark, monkeypatch):
    empty = spark.createDataFrame([], VECTORS)
    codes, books = V.learn_codes(empty)
    assert codes.count() == 0 and books.entries == [[]] * 16 and V.with_label_error(codes).count() == 0
    few = spark.createDataFrame([(1, [0.5] * 16, None, "", 0), (2, [0.5] * 16, 3, "", 0)], VECTORS)
    codes, books = V.learn_codes(few)
    assert [x["code"] for x in codes.collect()] == [bytes(16)] * 2 and books.entries[0] == [[128], [128]]
    with pytest.raises(Exception, match="beyond"):
        V.learn_codes(spark.createDataFrame([(1, [1e30] * 16, None, "", 0)], VECTORS))[0].count()
    # Beyond the bound of a broadcast, label sums are spread over shares.
    monkeypatch.setattr(V, "small", lambda df, n, row_bytes=32: df)
    assert [x["label_error"] for x in V.with_label_error(codes).collect()] == [0, 0]


def test_only_moved_parts_are_handed_on(spark):
    """A round's contributions are those of parts that changed their entry, and add up to the sums from scratch."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    books = V.Codebooks([[[0], [10]], [[0], [10]]])
    schema = spark.createDataFrame([], "vec_id long, label int, ints array<long>, code binary, part int, entry int, at int, gain decimal(38,0)").schema
    own = pa.RecordBatch.from_pylist([{"vec_id": 1, "label": None, "ints": [1, 9], "code": bytes([0, 1])}, {"vec_id": 2, "label": 1, "ints": [8, 2], "code": bytes([0, 0])}, {"vec_id": 3, "label": 1, "ints": [3, 3], "code": None}], to_arrow_schema(schema))
    out = [r for b in V._moved(books, ["vec_id", "label", "ints"], to_arrow_schema(schema))([own]) for r in b.to_pylist()]
    assert [(r["vec_id"], r["code"]) for r in out if r["part"] is None] == [(1, bytes([0, 1])), (2, bytes([1, 0])), (3, bytes([0, 0]))]
    assert sorted((r["part"], r["entry"], r["at"], int(r["gain"])) for r in out if r["part"] is not None) == [(0, 0, 1, -5), (0, 1, 0, 1), (0, 1, 1, 8), (1, 0, 0, 1), (1, 0, 1, 3)]


def plain_search(docs, items, top):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, words(t)) for d, t in docs if words(t)]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df, asked = Counter(t for _, w in held for t in set(w)), {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, w in held:
            tf, m = Counter(w), 100 - 90 + 90 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top])]
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_lexical_search(spark, monkeypatch, broadcast):
    r = random.Random(9)
    vocabulary = ["the", "The", "of", "naïve", "Été", "日本", "x1", "42", "a_b", "don't"] + [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, "the " + text(r.randint(1, 60))) for i in range(120)] + [(200, None), (201, ""), (202, " !?\n"), (None, "w1 w2 w3"), (3, "w1 w1 w1"), (3, "w1 w1 w1"), (500, "w7 " * 4000)]
    items = [(1, text(8)), (2, "nothing here"), (3, None), (4, "the The THE"), (5, "w1 w2"), (5, "w3"), (None, "w7")]
    if not broadcast:
        monkeypatch.setattr(L, "small", lambda df, n, row_bytes=32: df)
    frame = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], "doc_id long, text string, term string, n int, item_id int").repartition(4)
    got = L.search(frame, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int"), 10)
    assert sorted([(x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in got.collect()], key=repr) == sorted(plain_search(docs, items, 10), key=repr)
    index = L.postings(frame)
    assert index.where("term = ''").count() == sum(1 for _, t in docs if t and re.search(r"[^\W_]", t)) and index.where("term = 'w7' and doc_id = 500").first()["tf"] == 4000


def test_lexical_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some, asked = spark.createDataFrame([(1, "a b"), (2, "c")], docs.schema), spark.createDataFrame([(1, "a")], items.schema)
    assert L.search(docs, asked).count() == L.search(some, items).count() == L.search(docs, items).count() == 0
    assert [(x["doc_id"], x["rank"]) for x in L.search(some, asked).collect()] == [(1, 1)]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    c = B.codec(B.default_path(), B.default_pattern())
    return c, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def encoded(c, text):
    return [i for run in c.encode(text) for i in run]


def test_bytes_as_the_library_encodes_them(library, monkeypatch):
    c, own = library
    r = random.Random(6)
    texts = ["", " ", "a", "don't  stop\n\n x", "<|endoftext|>", "  x\u0085y", "é ﬁ İ ß", "👩‍👩‍👧 ok", "日本語のテキスト 12345", "\x1c\x1d ﻿x", "-" * 700, "ab" * 900 + "c"]
    for alphabet in ("ab", "abcdefghij", "etaoin shrdlu", "-=_ \n\t.", "éüñß漢字а б", "0123456789,. "):
        texts += ["".join(r.choice(alphabet) for _ in range(r.choice([2, 9, 40, 300]))) for _ in range(60)]
    want = [own.encode_ordinary(t) for t in texts]
    assert [encoded(c, t) for t in texts] == want
    assert ["".join(c.decode([ids])) for ids in want] == texts
    # Bounds of what is kept do not matter.
    for name, bound in (("STATES", 20), ("PAIRS", 3), ("PIECES", 2), ("STRETCH", 7), ("RUN", 1)):
        monkeypatch.setattr(B, name, bound)
    fresh = B.Codec(B.default_path(), B.default_pattern())
    assert [encoded(fresh, t) for t in texts] == want and ["".join(fresh.decode([ids])) for ids in want] == texts


def test_every_code_point_is_cut_as_the_library_cuts_it(library):
    c, own = library
    points = [chr(i) for i in range(0x3000)] + [chr(i) for i in range(0x3000, 0x110000, 37) if not 0xD800 <= i <= 0xDFFF]
    for form in ("a{0}b", " {0}{0}x", "1{0} \n"):
        for k in range(0, len(points), 500):
            text = "|".join(form.format(p) for p in points[k : k + 500])
            assert encoded(c, text) == own.encode_ordinary(text)


def test_a_long_unsplit_piece(library):
    """Emission keeps up with the input: what is pending stays below the longest token, and states recur."""
    c, own = library
    r = random.Random(1)
    text = "".join(r.choice("ACGT") for _ in range(20_000))
    assert encoded(c, text) == own.encode_ordinary(text)
    machine = B.Transducer(c.ranks)
    longest, state, most = max(map(len, c.ranks)), 0, 0
    for byte in text.encode():
        _, state = machine.moves.get(state << 8 | byte) or machine.step(state, byte)
        most = max(most, sum(len(machine.tokens_of[t]) for t in machine.states[state][1][-1][1]))
    assert most <= 2 * longest
    whole = "a" * 300_000
    assert len(encoded(c, whole)) <= 300_000 / 2 and "".join(c.decode([encoded(c, whole)])) == whole


def test_utf8_stream():
    r = random.Random(2)
    samples = ["aé日👩́".encode() * 3, b"\xf0\x90\x80", b"\xed\xa0\x80x", b"\xe0\x80\x80", b"\xc0\xafz", b"\xf4\x90\x80\x80", b"\xff\xfe\x80\x80", b"\xe2\x82"] + [bytes(r.choice([0x41, 0x80, 0xBF, 0xC3, 0xE2, 0xED, 0xF0, 0xF4, 0xFF]) for _ in range(12)) for _ in range(300)]
    for data in samples:
        machine, out, i = B.Utf8Stream(), "", 0
        while i < len(data):
            n = r.randint(1, 3)
            out += machine.feed(data[i : i + n])
            i += n
        assert out + machine.end() == data.decode("utf-8", "replace"), data


def test_byte_encoding_of_documents(spark, library):
    c, own = library
    texts = [(1, None), (2, ""), (3, "Low tide"), (3, "Low tide"), (None, "x"), (4, "long text " * 30_000)]
    df = spark.createDataFrame([(d, t, 7, "a") for d, t in texts], "doc_id long, text string, n_tokens int, ids string")
    got = B.encode_documents(df)
    want = []
    for d, t in texts:
        ids = own.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)))
    assert sorted([(x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"], tuple(x["ids"])) for x in got.collect()], key=repr) == sorted(want, key=repr)
    assert sorted((x["doc_id"] or 0, x["decoded"]) for x in B.decode_documents(got).collect()) == sorted((d or 0, t or "") for d, t in texts)
    assert B.encode_documents(df.limit(0)).count() == 0
