"""Byte-pair encoding and decoding with tree concatenation for long unsplit text.

A text is cut at special tokens, normalised and pre-tokenised as the tokenizer file says; a
piece that the pre-tokeniser leaves whole is encoded alone, so equal pieces are encoded once
and kept. A piece longer than a leaf is encoded as a tree: its leaves go to the library in one
parallel batch, then neighbours are joined. At each join a window of the last tokens of the left
side and the first of the right is encoded afresh; while the window's first or last token is not
the one that stood there, the window grows, up to both whole sides. Once both agree, what
lies outside the window is what encoding the whole would give.

Texts of ASCII and of Latin-1 letters take a path in which the file's normaliser and pattern
are the same as a plain lower-casing and one regular expression; any other character
sends the text through the library's own normaliser and pre-tokeniser.

Defined cases: a null text is empty and has no tokens; special tokens written in a text become
their ids, as the library does; an empty table gives an empty result; repeated rows and further columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from accolade.llm._shared import table

#: Bytes of an unsplit piece that are encoded at once, and how many encoded pieces a worker keeps.
LEAF, KEPT = 2048, 200_000
_ODD = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")


class Codec:
    """Encodes texts to packed little-endian 32-bit ids and decodes them, as the tokenizer file at `path` does."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole, self.leaf = Tokenizer.from_file(path), leaf
        self.normalizer, self.splitter = self.whole.normalizer, self.whole.pre_tokenizer
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        bare = spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.last = Tokenizer.from_str(json.dumps(bare))
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": spec["model"] | {"end_of_word_suffix": None}}))
        self.tokens = [self.whole.id_to_token(i) for i in range(self.whole.get_vocab_size())]
        self.plain = _Kept(self._plain_piece)
        self.mapped = _Kept(self.encode_piece)
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        self.simple = pattern in json.dumps(spec["pre_tokenizer"]).encode().decode("unicode_escape") and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]

    def _plain_piece(self, piece: str) -> bytes:
        return self.encode_piece(_to_bytes_alphabet(piece))

    def prepare(self, texts: list[list[str]]) -> None:
        """Encodes the new short pieces of many texts in one batch."""
        if len(self.plain) > KEPT // 2:
            self.plain.clear()
        new = [p for p in set().union(*texts).difference(self.plain) if len(p) <= 64]
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            for piece, e in zip(part, self.last.encode_batch_fast([_to_bytes_alphabet(p) for p in part], add_special_tokens=False), strict=True):
                ids = e.ids
                self.plain[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece that the pre-tokeniser left whole, in its byte alphabet."""
        if len(piece) <= self.leaf:
            return np.array(self.last.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array([i for i, _ in self._tree(piece)], "<u4").tobytes()

    def _leaves(self, parts: list[str], ends: list[bool]) -> list[list[tuple[int, int]]]:
        """Tokens as (id, length in the piece) of several strings, encoded in one parallel batch each for inner and last ones."""
        out: list = [None] * len(parts)
        for model, is_last in ((self.inner, False), (self.last, True)):
            at = [i for i, e in enumerate(ends) if e == is_last]
            for i, e in zip(at, model.encode_batch([parts[i] for i in at], add_special_tokens=False), strict=True):
                out[i] = [(t, b - a) for t, (a, b) in zip(e.ids, e.offsets, strict=True)]
        return out

    def _tree(self, piece: str) -> list[tuple[int, int]]:
        count = -(-len(piece) // self.leaf)
        cuts = [len(piece) * k // count for k in range(count + 1)]
        level = [[cuts[k], cuts[k + 1], t] for k, t in enumerate(self._leaves([piece[cuts[k] : cuts[k + 1]] for k in range(count)], [k == count - 1 for k in range(count)]))]
        while len(level) > 1:
            joined = [self._join(piece, *level[k], *level[k + 1]) for k in range(0, len(level) - 1, 2)]
            level = joined + level[len(level) - len(level) % 2 :]
        return level[0][2]

    def _join(self, piece: str, start: int, mid: int, left: list, mid2: int, end: int, right: list) -> list:
        size = 4
        while True:
            a, b = left[-size:], right[:size]
            lo, hi = mid - sum(n for _, n in a), mid2 + sum(n for _, n in b)
            window = self._leaves([piece[lo:hi]], [hi == len(piece)])[0]
            if (lo == start or window[0] == a[0]) and (hi == end or window[-1] == b[-1]):
                return [start, end, left[: len(left) - len(a)] + window + right[len(b) :]]
            size *= 2

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self._stretch(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._stretch(text[at : m.start()]), self.specials[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._stretch(text[at:])])

    def is_plain(self, text: str) -> bool:
        return self.simple and not _ODD.search(text) and not (self.special and self.special.search(text))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        pieces = [_PIECES.findall(t.lower()) if self.is_plain(t) else None for t in texts]
        self.prepare([p for p in pieces if p])
        return [self.encode(t) if p is None else b"".join(map(self.plain.__getitem__, p)) for t, p in zip(texts, pieces, strict=True)]

    def _stretch(self, text: str) -> bytes:
        if self.simple and not _ODD.search(text):
            return b"".join(map(self.plain.__getitem__, _PIECES.findall(text.lower())))
        return b"".join([self.mapped[p] for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text) if self.normalizer else text)])

    def decode(self, ids: bytes) -> str:
        """The tokens of packed ids, one space between two, as the library decodes where the file names no decoder."""
        if self.whole.decoder is not None:
            return self.whole.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b for b in _SELF} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SELF)))}


def _to_bytes_alphabet(piece: str) -> str:
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(_ALPHABET)


class _Kept(dict):
    """Encoded pieces by text; emptied when full, long pieces never stay."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(path: str, keep_ids: bool):
    def run(batches):
        c = codec(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                counts, ids_sha, text_sha, lists = [], [], [], []
                for ids in c.encode_all([t or "" for t in part.column("text").to_pylist()]):
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                    if keep_ids:
                        lists.append(np.frombuffer(ids, "<i4"))
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of the decoded text, and with keep_ids the ids, for every row of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(_encoder(path or default_path(), keep_ids), schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded, the text that the ids of (doc_id, ids) decode to; null ids give an empty text."""
    path = path or default_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            out = [c.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)
