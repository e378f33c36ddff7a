"""Byte-level BPE encoding by a lazily determinised transducer, and decoding as a stream.

Merging pairs by rank gives the tokens t1 … tn for a piece if and only if merging each t(i) t(i+1) by
itself gives those two back: no merge ever crosses a boundary of the result, so neighbours do not
see what lies further away. The merges are compiled to that relation of neighbours. It is a
non-deterministic transducer whose states are tokens partly read, with one accepting path for each
input. It is determinised while it is used: a state is the last token that is certain and the bytes
behind it; each prefix of those bytes has one sequence of tokens, and a boundary stays open while some longer
token begins as the bytes behind it do. A byte leads to the state in which the tokens that all open
boundaries have in common are emitted. No boundary stays open for more bytes than the longest token has,
so what is looked ahead is bounded by the vocabulary, whatever the length of the piece.

States and pairs are kept up to a bound and computed anew beyond it; results do not depend on it. Pieces
are what the pattern cuts a text into; a piece that is itself a token is that token, as the
library has it, and short pieces are kept with their ids. Long texts are cut where a space follows
another character, which no match of the pattern crosses, so memory does not grow with all of a
text's pieces.

Decoding joins the bytes of tokens in runs and passes them through a state machine that holds back a sequence
of UTF-8 that a run's end cuts off; bytes that are no UTF-8 become U+FFFD.

Defined cases: a null or empty text has no tokens; strings of special tokens are ordinary text; an empty table
gives an empty result; repeated rows and further columns do not matter.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from accolade.llm._shared import table

#: States, pairs and pieces that a worker keeps; code points of a piece that is kept; code points of a text cut at once; tokens of a run.
STATES, PAIRS, PIECES, SHORT, STRETCH, RUN = 250_000, 500_000, 300_000, 64, 1 << 16, 1 << 14
_NEVER = 1 << 62


class Transducer:
    """Encodes pieces of bytes by ranks of merges (token -> id).

    Beginnings of tokens are nodes of a tree, numbered from 0, the empty one. A state is the last certain token and, for each open boundary,
    the node of the bytes behind it and the tokens between; states have numbers too, and `moves` is the determinised part.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens_of = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at, self.grows = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.grows[node] = True
                below = self.child.setdefault(node << 8 | byte, len(self.token_at))
                if below == len(self.token_at):
                    self.token_at.append(-1)
                    self.grows.append(False)
                node = below
            self.token_at[node] = rank
        self.merges: dict[int, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.moves: dict[int, tuple[tuple[int, ...], int]] = {}
        self.states, self.numbers = [(-1, ((0, ()),))], {}

    def history(self, token: int) -> tuple[list, list]:
        """The merges by which a token comes about, as (rank, its last part after it) and (rank, its first part after it); both end with the token if it does."""
        found = self.merges.get(token)
        if found is None:
            whole = self.tokens_of[token]
            parts, found = [whole[i : i + 1] for i in range(len(whole))], ([(-1, whole[-1:])], [(-1, whole[:1])])
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if rank == _NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                found[0].append((rank, parts[-1]))
                found[1].append((rank, parts[0]))
            for side, part in zip(found, (parts[-1], parts[0]), strict=True):
                side.append((_NEVER, part))
            self.merges[token] = found
        return found

    def agree(self, left: int, right: int) -> bool:
        """Whether two tokens (or the first one, behind none, which is -1) can stand side by side.

        Each side's merges run in the order that ranks give; at no time may the parts that meet be a token of a lesser rank
        than what is next on either side (of equals the leftmost pair comes first).
        """
        key = (left + 1) << 32 | right
        found = self.pairs.get(key)
        if found is None:
            begins = self.history(right)[1]
            found = len(begins[-1][1]) == len(self.tokens_of[right])
            if found and left >= 0:
                ends, i, j, ranks = self.history(left)[0], 0, 0, self.ranks
                while found:
                    before, after = ends[i + 1][0], begins[j + 1][0]
                    rank = ranks.get(ends[i][1] + begins[j][1], _NEVER)
                    if rank < before and rank <= after and rank != _NEVER:
                        found = False
                    elif before == after == _NEVER:
                        break
                    elif before <= after:
                        i += 1
                    else:
                        j += 1
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def step(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        """The ids that are certain after one more byte, and the state it leads to."""
        (last, open_), moves = self.states[state], self.moves
        child, token_at, grows, pairs, whole, told, after, n = self.child, self.token_at, self.grows, self.pairs, None, None, [], 0
        for node, path in open_:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            token = token_at[node]
            if token >= 0 and whole is None:
                before = path[-1] if path else last
                fits = pairs.get((before + 1) << 32 | token)
                if fits or fits is None and self.agree(before, token):
                    whole = (*path, token)
            if grows[node]:
                after.append((node, path))
                if told is None:
                    told, n = path, len(path)
                else:
                    while path[:n] != told[:n]:
                        n -= 1
        after.append((0, whole))
        if told is None:
            told, n = whole, len(whole)
        else:
            while whole[:n] != told[:n]:
                n -= 1
            told = told[:n]
        if n:
            last = told[-1]
            after = [(node, path[n:]) for node, path in after]
        # The certain token does not matter where no boundary is open right behind it.
        key = (last if () in [path for _, path in after] else -2, tuple(after))
        number = self.numbers.get(key)
        if number is None:
            if len(self.states) >= STATES:
                self._forget()
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        found = told, number
        if moves is self.moves:  # else `state` is a number of before
            moves[state << 8 | byte] = found
        return found

    def tokens(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length, in one pass over its bytes."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            found = moves.get(state << 8 | byte)
            if found is None:
                found = self.step(state, byte)
                moves = self.moves
            told, state = found
            if told:
                out += told
        return out + [*self.states[state][1][-1][1]]


class Utf8Stream:
    """An incremental UTF-8 state machine over runs of bytes: between runs it holds the bytes of a sequence that has not ended."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._open(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end begin a sequence that more bytes could complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            length = 2 if 0xC2 <= lead <= 0xDF else 3 if lead & 0xF0 == 0xE0 else 4 if 0xF0 <= lead <= 0xF4 else 1
            # The second byte is narrower for some leads: no overlong forms, surrogates or values above U+10FFFF.
            least, most = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
            return back if length > back and (back == 1 or least <= data[1 - back] <= most) else 0
        return 0


class Codec:
    """Texts to ids and back, by a file of ranks and the pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.transducer, self.pieces = Transducer(self.ranks), regex.compile(pattern)
        self.bytes_of = self.transducer.tokens_of
        #: Ids of short pieces, and those of before the last time that there were too many: what is still asked for comes back from there.
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or tuple(self.transducer.tokens(piece.encode("utf-8", "replace")))
        if len(piece) <= SHORT:
            self.kept[piece] = ids
        return ids

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, stretch by stretch."""
        for stretch in stretches(text):
            if len(self.kept) >= PIECES:
                self.kept, self.older = {}, self.kept
            kept, own = self.kept, self._piece
            yield [i for p in self.pieces.findall(stretch) for i in kept.get(p) or own(p)]

    def decode(self, ids: Iterable[list[int]]) -> Iterator[str]:
        """The text of ids that come in runs."""
        machine = Utf8Stream()
        for run in ids:
            for k in range(0, len(run), RUN):
                yield machine.feed(b"".join(map(self.bytes_of.__getitem__, run[k : k + RUN])))
        yield machine.end()


def stretches(text: str, most: int | None = None) -> Iterator[str]:
    """A long text in parts, cut only where a space follows a character that is none."""
    most = most or STRETCH
    at = 0
    while len(text) - at > most:
        to = text.find(" ", at + most)
        while to > 0 and text[to - 1].isspace():
            to = text.find(" ", to + 1)
        if to < 0:
            break
        yield text[at:to]
        at = to
    if at < len(text):
        yield text[at:]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    made = Codec(path, pattern)
    # What is kept has no cycles and stays as long as the worker: collections walk the tables never, and the caches seldom.
    gc.freeze()
    gc.set_threshold(200_000, 20, 50)
    return made


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _encoder(path: str, pattern: str, keep_ids: bool):
    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            counts, ids_sha, text_sha, lists = [], [], [], []
            for text in batch.column("text"):
                n, told, said, whole = 0, hashlib.sha256(), hashlib.sha256(), []
                machine = Utf8Stream()
                for ids in c.encode(text.as_py() or ""):
                    told.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
                    n += len(ids)
                    said.update(machine.feed(b"".join(map(c.bytes_of.__getitem__, ids))).encode())
                    if keep_ids:
                        whole.append(np.array(ids, np.int32))
                said.update(machine.end().encode())
                counts.append(n)
                ids_sha.append(told.hexdigest())
                text_sha.append(said.hexdigest())
                lists.append(np.concatenate(whole) if whole else np.zeros(0, np.int32))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of the decoded text, and with keep_ids the ids, for every row of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(_encoder(path or default_path(), pattern or default_pattern(), keep_ids), schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded, the text that the ids of (doc_id, ids) decode to; null ids give an empty text, an id that no token has an error."""
    path, pattern = path or default_path(), default_pattern()

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            out = ["".join(c.decode([x or []])) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)
