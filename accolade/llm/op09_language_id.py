"""Language identification with a linear-chain conditional random field over words.

Each word is a position of the chain, each language a label. Emission features of a word are
its character n-grams between word marks (those that hold a mark are its affixes) and, for words
common enough in the sample, the word itself as a lexicon entry; transition weights between
languages are learned with them, so runs of one language are favoured and switches inside a
text remain possible. Forward-backward gives each word's label probabilities; a document's
are the means over its words; `label_words` gives the words' own labels.

The model is fitted on a bounded sample of labelled rows: about `per_language` documents of
each language, chosen by a hash of doc_id and text (of equal runs one), of each one run of `window` words. Rows whose
crc32(doc_id as text) mod 5 is 0 are held out and never fitted on; lang, source and doc_id are
no inputs of a prediction. Prediction reads every word of every text: texts are cut into
chunks whose transfer matrices are chained, which is exact and keeps the number of vector
steps independent of the longest text.

Defined cases: a text that is null or has no letter is `und` with score 0; without any labelled row
everything is `und`; an empty table gives no rows.
Repeated rows, ties (the label that sorts first wins) and further columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accolade.llm import textkit as K
from accolade.llm._shared import table

U64 = np.uint64
_SLOTS = 1 << 18
_ORDERS = (2, 3, 4, 5)
_CHUNK = 128
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _letter_words(raw: np.ndarray, at: np.ndarray):
    """Start, end and row of each run of ASCII letters and bytes beyond ASCII."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    is_letter = _LETTER[raw]
    fresh = np.empty(len(raw), bool)
    fresh[0], fresh[1:] = True, ~is_letter[:-1]
    fresh[at[:-1][at[:-1] < len(raw)]] = True
    starts = np.flatnonzero(fresh & is_letter)
    last = np.empty(len(raw), bool)
    last[-1], last[:-1] = True, fresh[1:] | ~is_letter[1:]
    ends = np.flatnonzero(last & is_letter) + 1
    return starts, ends, np.searchsorted(at[1:], starts, "right")


def _features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Feature slots of words, word after word, and where each word's begin. Letters count without ASCII case."""
    length = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(length)])
    marked = np.full(first[-1] + max(_ORDERS), 1, np.uint64)
    inside = np.ones(first[-1], bool)
    inside[first[:-1]] = inside[first[1:] - 1] = False
    source = np.repeat(starts - first[:-1] - 1, length) + np.arange(first[-1])
    low = raw[source[inside]].astype(np.uint64)
    low[(low >= 65) & (low < 91)] += U64(32)
    marked[: first[-1]][inside] = low
    left = np.repeat(first[1:], length) - np.arange(first[-1])
    slots = np.empty((len(_ORDERS), first[-1]), np.int64)
    h = np.zeros(first[-1], U64)
    done = 0
    for k, n in enumerate(_ORDERS):
        while done < n:
            h = h * U64(0x100000001B3) + marked[done : done + first[-1]] + U64(done)
            done += 1
        slots[k] = np.where(left >= n, K.mix(h) >> U64(64 - 18), _SLOTS).astype(np.int64)
    return slots, first


class Model:
    """Weights of a fitted field: emissions by feature slot (the last slot is none), lexicon words, transitions."""

    def __init__(self, labels, weights, lexicon, lexicon_weights, transitions):
        self.labels, self.weights, self.lexicon, self.lexicon_weights, self.transitions = labels, weights, lexicon, lexicon_weights, transitions

    def scores(self, raw, starts, ends, hashes) -> np.ndarray:
        """Emission scores of words, labels across."""
        slots, first = _features(raw, starts, ends)
        total = self.weights[slots[0]]
        for s in slots[1:]:
            total += self.weights[s]
        out = np.add.reduceat(total, first[:-1], axis=0) if len(starts) else np.zeros((0, len(self.labels)), np.float32)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), max(len(self.lexicon) - 1, 0))
        if len(self.lexicon):
            out += np.where((self.lexicon[at] == hashes)[:, None], self.lexicon_weights[at], 0)
        return out


def _positive(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(1, keepdims=True)) + np.float32(1e-9)


def _sums_of_marginals(x: np.ndarray, first: np.ndarray, A: np.ndarray, each: np.ndarray | None = None) -> np.ndarray:
    """For each row first[r]:first[r+1] of positive emissions, the sum of its words' label probabilities; `each` is filled with these.

    Before the first word all labels are alike. Chunks are run side by side: once for their
    transfer matrices, which are chained along each row, then forward and backward.
    """
    n_labels, lengths = x.shape[1], np.diff(first)
    chunks = -(-lengths // _CHUNK)
    c_first = np.concatenate([[0], np.cumsum(chunks)])
    doc = np.repeat(np.arange(len(lengths)), chunks)
    nth = np.arange(c_first[-1]) - np.repeat(c_first[:-1], chunks)
    start = first[:-1][doc] + nth * _CHUNK
    size = np.minimum(_CHUNK, first[1:][doc] - start)
    order = np.argsort(-size, kind="stable")
    start, size, doc = start[order], size[order], doc[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(_CHUNK)]
    M = np.tile(np.eye(n_labels, dtype=x.dtype), (len(order), 1, 1))
    for t, k in enumerate(active):
        if not k:
            break
        m = (M[:k].reshape(-1, n_labels) @ A).reshape(k, n_labels, n_labels) * x[start[:k] + t][:, None, :]
        M[:k] = m / m.sum((1, 2))[:, None, None]
    before = np.full((len(order), n_labels), 1 / n_labels, x.dtype)
    after = np.ones((len(order), n_labels), x.dtype)
    for j in range(int(chunks.max(initial=0)) - 1):
        rows = np.flatnonzero(chunks > j + 1)
        here, then = place[c_first[rows] + j], place[c_first[rows] + j + 1]
        v = np.einsum("ri,rij->rj", before[here], M[here])
        before[then] = v / v.sum(1, keepdims=True)
        here, prior = place[c_first[rows + 1] - 1 - j], place[c_first[rows + 1] - 2 - j]
        v = np.einsum("rij,rj->ri", M[here], after[here])
        after[prior] = v / v.sum(1, keepdims=True)
    forward = np.empty_like(x)
    for t, k in enumerate(active):
        if not k:
            break
        v = (before[:k] @ A) * x[start[:k] + t]
        before[:k] = v / v.sum(1, keepdims=True)
        forward[start[:k] + t] = before[:k]
    out = np.zeros((len(lengths), n_labels))
    total = np.zeros((len(order), n_labels))
    for t in range(_CHUNK - 1, -1, -1):
        k = active[t]
        if not k:
            continue
        at = start[:k] + t
        g = forward[at] * after[:k]
        g = g / g.sum(1, keepdims=True)
        total[:k] += g
        if each is not None:
            each[at] = g
        v = (x[at] * after[:k]) @ A.T
        after[:k] = v / v.sum(1, keepdims=True)
    np.add.at(out, doc, total)
    return out


def fit(rows: list[tuple[str, str]], window: int = 120, rounds: int = 40, step: float = 0.2) -> Model | None:
    """Fits the field to (lang, text) rows, already bounded; the same rows in the same order give the same weights.

    Runs of words of different rows stand one after another in the training sequences, which is
    where transitions between languages are seen.
    """
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    raw, at = K.buffers(pa.array([text for _, text in rows], pa.string()))
    starts, ends, row = _letter_words(raw, at)
    nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
    starts, ends, row = (v[nth < window] for v in (starts, ends, row))
    if not len(starts):
        return Model(labels, np.zeros((_SLOTS + 1, len(labels)), np.float32), np.zeros(0, U64), np.zeros((0, len(labels)), np.float32), np.zeros((len(labels), len(labels)), np.float32))
    n, n_labels = len(starts), len(labels)
    truth = np.array([labels.index(lang) for lang, _ in rows])[row]
    hashes = K.span_hashes(raw, starts, ends)
    unique, which, word, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    slots, first = _features(raw, starts[which], ends[which])
    used, slot = np.unique(slots, return_inverse=True)
    slot = slot.reshape(slots.shape)
    owner = np.repeat(np.arange(len(unique)), np.diff(first))
    common = count >= 3
    width = 128
    steps = -(-n // width)
    pad = steps * width - n
    W, G, T = np.zeros((len(used), n_labels)), np.zeros((len(unique), n_labels)), np.zeros((n_labels, n_labels))
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (W, G, T)]
    true_pairs = np.zeros((n_labels, n_labels))
    order = np.pad(truth, (0, pad)).reshape(steps, width)
    valid = np.pad(np.ones(n, bool), (0, pad)).reshape(steps, width)
    np.add.at(true_pairs, (order[:, :-1][valid[:, 1:]], order[:, 1:][valid[:, 1:]]), 1)
    none = used == _SLOTS
    for i in range(1, rounds + 1):
        W[none] = 0
        per = W[slot[0]]
        for s in slot[1:]:
            per = per + W[s]
        emit = np.add.reduceat(per, first[:-1], axis=0) + G * common[:, None]
        x = np.pad(_positive(emit[word]), ((0, pad), (0, 0)), constant_values=1).reshape(steps, width, n_labels)
        A = np.exp(T - T.max())
        forward = np.empty_like(x)
        v = np.full((steps, n_labels), 1 / n_labels)
        for t in range(width):
            v = (v @ A) * x[:, t]
            v /= v.sum(1, keepdims=True)
            forward[:, t] = v
        marginal, pairs, b = np.empty_like(x), np.zeros((n_labels, n_labels)), np.ones((steps, n_labels))
        for t in range(width - 1, -1, -1):
            g = forward[:, t] * b
            marginal[:, t] = g / g.sum(1, keepdims=True)
            xb = x[:, t] * b
            if t:
                joint = forward[:, t - 1][:, :, None] * A * xb[:, None, :]
                pairs += (joint / joint.sum((1, 2))[:, None, None])[valid[:, t]].sum(0)
            b = xb @ A.T
            b /= b.sum(1, keepdims=True)
        error = -marginal.reshape(-1, n_labels)[:n]
        error[np.arange(n), truth] += 1
        by_word = np.stack([np.bincount(word, error[:, k], len(unique)) for k in range(n_labels)], 1)
        by_slot = sum(np.stack([np.bincount(s, by_word[owner, k], len(used)) for k in range(n_labels)], 1) for s in slot)
        for v, g, (m1, m2) in zip((W, G, T), (by_slot / n - 1e-5 * W, by_word * common[:, None] / n - 1e-5 * G, (true_pairs - pairs) / n - 1e-5 * T), moments, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v += step * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-8)
    weights = np.zeros((_SLOTS + 1, n_labels), np.float32)
    weights[used] = W
    weights[_SLOTS] = 0
    return Model(labels, weights, unique[common], G[common].astype(np.float32), T.astype(np.float32))


def _window(window: int):
    """Of each text one run of at most `window` words, in the middle of the text."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = text.split()
                at = max(0, (len(words) - window) // 2)
                out.append(" ".join(words[at : at + window]))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.string()), batch.column("rank")], ["lang", "text", "rank"])

    return run


def sample(docs: DataFrame, per_language: int = 400, window: int = 120) -> list[tuple[str, str]]:
    """About per_language rows of each language outside the held-out fold, as (lang, run of words), in an order fixed by their hashes."""
    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return []
    rank = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    bounds = F.create_map(*[F.lit(v) for lang, count in sorted(counts.items()) for v in (lang, int(min(1.0, per_language / count) * (1 << 30)))])
    chosen = usable.select("lang", "text", rank.alias("rank")).where(F.col("rank") < bounds[F.col("lang")])
    rows = chosen.mapInArrow(_window(window), "lang string, text string, rank long").groupBy("lang", "text").agg(F.min("rank").alias("rank")).collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["rank"], r["lang"], r["text"]))]


def _label(model: Model | None, A, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """Labels and scores of the texts of a batch."""
    raw, at = K.buffers(batch.column("text"))
    starts, ends, row = _letter_words(raw, at)
    n = batch.num_rows
    count = np.bincount(row, minlength=n)
    labels, scores = ["und"] * n, np.zeros(n)
    if model is None or not len(starts):
        return labels, scores
    hashes = K.span_hashes(raw, starts, ends)
    unique, which, word = np.unique(hashes, return_index=True, return_inverse=True)
    x = _positive(model.scores(raw, starts[which], ends[which], unique))[word]
    total = _sums_of_marginals(x, np.concatenate([[0], np.cumsum(count)]), A)
    best = total.argmax(1)
    is_ascii = np.concatenate([[0], np.cumsum(_LETTER[raw] & (raw < 128))])
    ascii_letters = is_ascii[at[1:]] - is_ascii[at[:-1]]
    for i in np.flatnonzero(count):
        if ascii_letters[i] or any(map(str.isalpha, batch.column("text")[int(i)].as_py())):
            labels[i], scores[i] = model.labels[best[i]], min(1.0, total[i, best[i]] / count[i])
    return labels, scores


def _labelled(shared, batches):
    model = shared.value
    A = np.exp(model.transitions - model.transitions.max()).astype(np.float32) if model else None
    for whole in batches:
        for batch in K.slices(whole, "text"):
            yield batch, *_label(model, A, batch)


def _predictor(shared):
    def run(batches):
        for batch, labels, scores in _labelled(shared, batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _keeper(shared, least_score: float):
    def run(batches):
        for batch, labels, scores in _labelled(shared, batches):
            yield batch.filter(pa.array([label != "und" and score >= least_score for label, score in zip(labels, scores, strict=True)], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, least_score: float = 0.4, per_language: int = 400, window: int = 120) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...) whose language is found with at least the given score; columns stay as they are."""
    model = fit(sample(docs, per_language, window), window)
    return docs.mapInArrow(_keeper(docs.sparkSession.sparkContext.broadcast(model), least_score), docs.schema)


def predict_languages(docs: DataFrame, per_language: int = 400, window: int = 120) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of (doc_id, text, lang)."""
    spark = docs.sparkSession
    model = fit(sample(docs, per_language, window), window)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(_predictor(spark.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _word_labeller(shared):
    def run(batches):
        model = shared.value
        A = np.exp(model.transitions - model.transitions.max()).astype(np.float32) if model else None
        for whole in batches:
            for batch in K.slices(whole, "text"):
                raw, at = K.buffers(batch.column("text"))
                starts, ends, row = _letter_words(raw, at)
                count = np.bincount(row, minlength=batch.num_rows) if model else np.zeros(batch.num_rows, np.int64)
                bounds = np.concatenate([[0], np.cumsum(count)])
                best, p = np.zeros(bounds[-1], np.int64), np.zeros(bounds[-1])
                if bounds[-1]:
                    hashes = K.span_hashes(raw, starts, ends)
                    unique, which, word = np.unique(hashes, return_index=True, return_inverse=True)
                    x = _positive(model.scores(raw, starts[which], ends[which], unique))[word]
                    each = np.zeros_like(x)
                    _sums_of_marginals(x, bounds, A, each)
                    best = each.argmax(1)
                    p = each[np.arange(len(best)), best].astype(np.float64)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                begin, end = (chars[v] - chars[at[:-1][row]] if bounds[-1] else np.zeros(0, np.int64) for v in (starts, ends))
                labels = pa.array([model.labels[k] for k in best] if model else [], pa.string())
                words = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), labels, pa.array(p)], ["start", "end", "lang", "p"])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words)], ["doc_id", "words"])

    return run


def label_words(docs: DataFrame, per_language: int = 400, window: int = 120) -> DataFrame:
    """doc_id and `words`, for each word (a run of letters and characters beyond ASCII) its start and end (code points, end exclusive), most likely language and that one's probability, for every row of (doc_id, text, lang)."""
    model = fit(sample(docs, per_language, window), window)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_word_labeller(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, words array<struct<start:int,end:int,lang:string,p:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))
