"""Language ID by a linear-chain conditional random field over words.

Every word is scored for every language by its affixes (one to three bytes at either end), its byte n-grams (two and three) and a
lexicon (log odds of words known from the sample); learned transitions join neighbouring words, and forward-backward gives each word's probability of each language in its context. The
document's language is the one with the greatest mean probability, so code-switched texts are judged word by word.

The field is fitted on a bounded sample: at most PER_LANGUAGE documents of each language, chosen by hash, with SAMPLE_WORDS
consecutive words of each from a hashed place. Pieces of different languages are strung together, so that transitions are learned
from true switches. Prediction covers whole texts, in numpy over the Arrow batch's bytes: chains of a batch run side by side.

Defined results: null texts, texts without a letter, and tables with nothing to learn from give `und` with score 0; a null doc_id is not held out
and not learned from; repeated rows are predicted alike; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import words
from .wordhash import LOWER, mixed, slices, spans, word_hashes

PER_LANGUAGE, SAMPLE_WORDS, LEXICON = 300, 200, 20_000
ROWS = 1 << 17
LENGTH, EPOCHS, RATE, DECAY = 100, 6, 0.3, 1e-6
GROUP_BYTES = 12_000_000
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # ROWS x languages; the last row is 0 and stands for no feature
    known: np.ndarray  # sorted word hashes of the lexicon
    odds: np.ndarray  # their log odds, and 0 for other words in the last row
    scale: np.ndarray  # the lexicon's weight for each language
    step: np.ndarray  # transition scores


def _rows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows: (bytes x 2) of the n-grams that start at each byte, (words x 6) of the affixes."""
    none, mask = ROWS - 1, np.uint64(ROWS - 1)
    b = np.append(raw, np.zeros(3, dtype=np.uint8)).astype(np.uint64)
    row = lambda x, kind: (mixed(x + np.uint64(kind << 40)) & mask).astype(np.int32)
    n = len(raw)
    left = np.zeros(n + 1, dtype=np.int64)
    left[starts] = ends - starts
    pos = np.arange(n)
    word = np.cumsum(left[:-1] > 0) - 1
    left = np.where(word >= 0, ends[np.maximum(word, 0)] - pos, 0) if len(starts) else np.zeros(n)
    two, three = b[:n] << np.uint64(8) | b[1 : n + 1], b[:n] << np.uint64(16) | b[1 : n + 1] << np.uint64(8) | b[2 : n + 2]
    grams = np.stack([np.where(left >= 2, row(two, 1), none), np.where(left >= 3, row(three, 2), none)], axis=1)
    size = ends - starts
    affix = []
    for k in (1, 2, 3):
        for kind, at in ((2 + k, starts), (5 + k, np.maximum(ends - k, 0))):
            x = np.zeros(len(starts), dtype=np.uint64)
            for j in range(k):
                x = x << np.uint64(8) | b[at + j]
            affix.append(np.where(size >= k, row(x, kind), none))
    return grams, np.stack(affix, axis=1) if affix else np.empty((0, 6), dtype=np.int32)


def _lexicon_rows(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, h)
    hit = at < len(known)
    hit[hit] = known[at[hit]] == h[hit]
    return np.where(hit, at, len(known))


def emissions(model: Model, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words x languages: scores before context."""
    if not len(starts):
        return np.empty((0, len(model.langs)), dtype=np.float32)
    low = LOWER[raw]
    grams, affix = _rows(low, starts, ends)
    each = model.weights[grams[:, 0]] + model.weights[grams[:, 1]]
    out = np.add.reduceat(each, starts, axis=0)  # what lies between words has no features
    for k in range(affix.shape[1]):
        out += model.weights[affix[:, k]]
    return out + model.odds[_lexicon_rows(word_hashes(low, starts, ends), model.known)] * model.scale


def _passes(scores: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(potentials, forward, backward) of all chains side by side. Chain i has the words first[i] .. first[i + 1]; longest chains come first in
    each step, so chains that have ended drop off the end. Both passes are scaled to sum to 1 at each word."""
    potential = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # chains longer than t
    ahead, back = np.empty_like(potential), np.empty_like(potential)
    move = np.exp(step)
    a = None
    for t, k in enumerate(live):
        at = begin[:k] + t
        a = potential[at] if a is None else (a[:k] @ move) * potential[at]
        a /= a.sum(axis=1, keepdims=True)
        ahead[at] = a
    b = np.ones((0, potential.shape[1]))
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        if k > len(b):
            b = np.concatenate([b, np.ones((k - len(b), potential.shape[1]))])
        at = begin[:k] + t
        back[at] = b
        b = (b * potential[at]) @ move.T
        b /= b.sum(axis=1, keepdims=True)
    return potential, ahead, back


def _shares(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def marginals(scores: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """P(language) of each word in its chain, by forward-backward."""
    _, ahead, back = _passes(scores, first, step)
    return _shares(ahead * back)


def pair_marginals(scores: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, words with a successor in their chain, P(languages) of each such word and its successor)."""
    potential, ahead, back = _passes(scores, first, step)
    inner = np.setdiff1d(np.arange(len(scores) - 1), first[1:-1] - 1)
    pair = ahead[inner, :, None] * np.exp(step)[None] * (potential * back)[inner + 1, None, :]
    return _shares(ahead * back), inner, _shares(pair)


def _slopes(p: np.ndarray, inner: np.ndarray, pair: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the negative log likelihood by the scores of words and by the transition scores."""
    return p - y, pair.sum(axis=0) - y[inner].T @ y[inner + 1]


def fit(sample: list[tuple[str, list[str]]], seed: int = 7) -> Model | None:
    """Stochastic gradient (AdaGrad) on the log likelihood of strung-together pieces of the sample."""
    langs = sorted({lang for lang, w in sample if w})
    if not langs:
        return None
    rng, place = np.random.default_rng(seed), {x: k for k, x in enumerate(langs)}
    pieces = []
    for lang, w in sample:
        while w:
            n = int(rng.integers(5, 60))
            pieces.append((place[lang], w[:n]))
            w = w[n:]
    rng.shuffle(pieces)
    text, label = [w for _, p in pieces for w in p], np.array([k for k, p in pieces for _ in p])
    cut = len(text) // LENGTH * LENGTH if len(text) >= LENGTH else len(text)
    text, label = text[:cut], label[:cut]
    raw = np.frombuffer(" ".join(text).encode(), dtype=np.uint8)
    starts, ends, _ = spans(raw, np.array([0, len(raw)]))
    low = LOWER[raw]
    h, n = word_hashes(low, starts, ends), len(langs)
    count = {x: c for x, c in Counter(h.tolist()).most_common(LEXICON) if c > 1}
    known = np.array(sorted(count), dtype=np.uint64)
    row = _lexicon_rows(h, known)
    seen = np.zeros((len(known) + 1, n))
    np.add.at(seen, (row, label), 1.0)
    share = np.log((seen + 0.5) / (seen + 0.5).sum(axis=1, keepdims=True))
    odds = (share - share.mean(axis=1, keepdims=True)).astype(np.float32)
    odds[-1] = 0
    model = Model(langs, np.zeros((ROWS, n), dtype=np.float32), known, odds, np.full(n, 0.1, dtype=np.float32), np.zeros((n, n)))
    grams, affix = _rows(low, starts, ends)
    word = np.cumsum(np.isin(np.arange(len(raw)), starts)) - 1
    feature = np.concatenate([grams.ravel(), affix.ravel()])
    owner = np.concatenate([np.repeat(word, 2), np.repeat(np.arange(len(starts)), 6)])
    real = feature != ROWS - 1
    feature, owner = feature[real], owner[real]
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    size, per = LENGTH if len(text) >= LENGTH else len(text), 40
    squares = [np.full(x.shape, 1e-6) for x in (model.weights, model.scale, model.step)]
    for _ in range(EPOCHS):
        for chunk in rng.permutation(max(1, len(text) // (size * per))):
            lo, hi = chunk * size * per, min(len(text), (chunk + 1) * size * per)
            a, b = np.searchsorted(owner, [lo, hi])
            f, o = feature[a:b], owner[a:b] - lo
            score = model.odds[row[lo:hi]] * model.scale
            for k in range(n):
                score[:, k] += np.bincount(o, weights=model.weights[f, k], minlength=hi - lo)
            first = np.append(np.arange(0, hi - lo, size), hi - lo)
            y = np.eye(n)[label[lo:hi]]
            by_word, moves = _slopes(*pair_marginals(score, first, model.step), y)
            slope = np.zeros(model.weights.shape)
            for k in range(n):
                slope[:, k] = np.bincount(f, weights=by_word[o, k], minlength=ROWS)
            for x, g, s in zip((model.weights, model.scale, model.step), (slope + DECAY * model.weights, (by_word * model.odds[row[lo:hi]]).sum(axis=0), moves), squares, strict=True):
                s += g * g
                x -= (RATE * g / np.sqrt(s)).astype(x.dtype)
            model.weights[-1] = 0
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, n: int = SAMPLE_WORDS) -> list[tuple[str, list[str]]]:
    """At most `per_language` pieces of each language: rows whose hash falls under a rate that makes twice as many likely, and of those the
    ones with the least hashes, taken before anything reaches the driver."""
    train = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = sorted((r["lang"], r["n"]) for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    if not counts:
        return []
    most = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(2**63 - 1, int(2 * per_language / c * 2**63)))) for lang, c in counts))
    h = F.xxhash64("doc_id", F.lit("sample")).bitwiseAND(F.lit(2**63 - 1))
    least = W.partitionBy("lang").orderBy("_h", "doc_id", F.xxhash64("text"))
    chosen = train.withColumn("_h", h).where(F.col("_h") <= most).withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= per_language)
    chosen = chosen.withColumn("_w", words(F.col("text")))
    start = F.pmod(F.xxhash64("_h"), F.greatest(F.size("_w") - n + 1, F.lit(1))).cast("int") + 1
    rows = sorted((r["lang"], r["_n"], r["w"]) for r in chosen.select("lang", "_n", F.slice("_w", start, n).alias("w")).collect())
    return [(lang, w) for lang, _, w in rows]


def _predict(model: Model | None):
    def group(texts: pa.Array) -> Iterator[tuple[str, float, int, int]]:
        scores, first, letter = [], [0], []
        for lo, hi, raw, off in slices(texts):
            starts, ends, at = spans(raw, off)
            scores.append(emissions(model, raw, starts, ends))
            first.extend((at[1:] + first[-1]).tolist())
        letter = [bool(t and _LETTER.search(t)) for t in texts.to_pylist()]
        p = marginals(np.concatenate(scores), np.array(first), model.step) if first[-1] else np.empty((0, len(model.langs)))
        best = p.argmax(axis=1)
        turn = np.append(0, np.cumsum(best[1:] != best[:-1])) if len(best) else best
        for i, ok in enumerate(letter):
            a, b = first[i], first[i + 1]
            if not ok or a == b:
                yield "und", 0.0, b - a, 0
            else:
                mean = p[a:b].mean(axis=0)
                k = int(mean.argmax())
                yield model.langs[k], float(min(1.0, mean[k])), b - a, int(turn[b - 1] - turn[a])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            lo = 0
            while lo < batch.num_rows:
                hi, size = lo, 0
                while hi < batch.num_rows and (hi == lo or size < GROUP_BYTES):
                    size += len(text[hi].as_buffer() or b"") if text[hi].is_valid else 0
                    hi += 1
                got = list(group(text.slice(lo, hi - lo))) if model else [("und", 0.0, 0, 0)] * (hi - lo)
                cols = [pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *cols], ["doc_id", "held_out", "lang_pred", "score", "n_words", "switches"])
                lo = hi

    return of


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score, n_words, switches (changes of language between words)."""
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, n_words long, switches long")


def language_report(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(sample(docs)))
