"""Language of code-switched text by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from panelforecast.llm.common import fitting_rows, gather, mix, slices

FIT_DOCS = 1500
FIT_WORDS = 160
BUCKETS = 1 << 16
CHAINS = 1500
CHAIN_WORDS = 64
SPAN = (3, 24)
STEPS = 40
RATE = 0.3
DECAY = 1e-4
SEED = 6
CHUNK = 128
KNOWN_WORDS = 100_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_KINDS = np.array([0x51, 0x52, 0x53, 0x54, 0x55, 0x56], np.uint64) << np.uint64(56)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case, in order; numbers that are neither letters nor digits, like a half, make none."""
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of every word and their number: the word itself as a lexicon entry,
    prefixes and suffixes of one to three letters, and letter bigrams and trigrams."""
    edged = [f"\x02{w}\x03" for w in words]
    lengths = np.fromiter(map(len, edged), np.int64, len(edged))
    codes = np.frombuffer("".join(edged).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    left = lengths[owner] - place
    wide = np.concatenate((codes, np.zeros(4, np.uint64)))
    found, owners = [], []
    gram = codes.copy()
    factor = np.uint64(0x9E3779B97F4A7C15)
    for n in (2, 3, 4):
        gram = gram * factor + wide[n - 1 : n - 1 + len(codes)]
        # bigrams and trigrams anywhere (those at the edges are affixes of one or two letters), longer affixes at the edges
        keep = (left >= n) & ((n < 4) | (place == 0) | (left == n))
        found.append(gram[keep] ^ _KINDS[n])
        owners.append(owner[keep])
    power = mix(codes + factor * (place.astype(np.uint64) + np.uint64(1)))
    found.append(np.add.reduceat(power, starts) ^ _KINDS[0] if len(words) else np.empty(0, np.uint64))
    owners.append(np.arange(len(words)))
    keys, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (mix(keys[order]) % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(words))


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """A word's score in every language: the mean of its features' weights, times the root of their number."""
    if not words:
        return np.zeros((0, weights.shape[1]))
    keys, counts = features(words)
    return np.add.reduceat(weights[keys], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None]


def fit(texts: list[str | None], labels: list[str]) -> dict:
    """Weights of the features and the transitions, by gradient steps on the exact likelihood.

    The texts have one language each, so chains are spliced from spans of 3 to 24 words
    of texts chosen at random: the transitions then learn how seldom the language changes
    within running words. Everything is drawn from a fixed seed. No usable text gives a
    model without languages.
    """
    rng = np.random.default_rng(SEED)
    pairs = [(w, y) for w, y in zip(map(words_of, texts), labels) if w]
    languages = sorted({y for _, y in pairs})
    if not languages:
        return {"languages": [], "weights": np.zeros((BUCKETS, 0)), "moves": np.zeros((0, 0))}
    spans = []
    for w, y in pairs:
        at = int(rng.integers(0, max(1, len(w) - FIT_WORDS)))
        spans.append((w[at : at + FIT_WORDS], languages.index(y)))
    of_language = [[s for s in spans if s[1] == y] for y in range(len(languages))]
    vocabulary: dict[str, int] = {}
    x = np.zeros((CHAINS, CHAIN_WORDS), np.int64)
    y = np.zeros((CHAINS, CHAIN_WORDS), np.int64)
    for c in range(CHAINS):
        filled = 0
        while filled < CHAIN_WORDS:
            pool = of_language[int(rng.integers(len(languages)))]  # every language alike, however rare
            source, label = pool[int(rng.integers(len(pool)))]
            n = min(int(rng.integers(SPAN[0], SPAN[1] + 1)), CHAIN_WORDS - filled, len(source))
            at = int(rng.integers(0, len(source) - n + 1))
            x[c, filled : filled + n] = [vocabulary.setdefault(w, len(vocabulary)) for w in source[at : at + n]]
            y[c, filled : filled + n] = label
            filled += n
    keys, counts = features(list(vocabulary))
    begin = np.cumsum(counts) - counts
    owner, scale = np.repeat(np.arange(len(vocabulary)), counts), np.sqrt(counts)[:, None]
    size = len(languages)
    weights, moves = np.zeros((BUCKETS, size)), np.zeros((size, size))
    seen_w, seen_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    truth = np.zeros((len(vocabulary), size))
    np.add.at(truth, (x.ravel(), y.ravel()), 1)
    true_moves = np.zeros((size, size))
    np.add.at(true_moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    total = x.size
    for _ in range(STEPS):
        score = np.add.reduceat(weights[keys], begin, axis=0) / scale
        shares, expected = _marginals(score[x], moves)
        got = np.zeros_like(truth)
        for k in range(size):
            got[:, k] = np.bincount(x.ravel(), shares[:, :, k].ravel(), len(vocabulary))
        slope = ((truth - got) / scale)[owner]
        gradient = np.stack([np.bincount(keys, slope[:, k], BUCKETS) for k in range(size)], axis=1) / total - DECAY * weights
        push = (true_moves - expected) / total - DECAY * moves
        seen_w += gradient**2
        seen_m += push**2
        weights += RATE * gradient / np.sqrt(seen_w)
        moves += RATE * push / np.sqrt(seen_m)
    return {"languages": languages, "weights": weights.astype(np.float32), "moves": moves}


def _marginals(score: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains of one length: each word's language shares, and the expected moves."""
    e = np.exp(score - score.max(axis=2, keepdims=True))
    t = np.exp(moves)
    n = e.shape[1]
    forward, backward = np.empty_like(e), np.empty_like(e)
    forward[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    backward[:, -1] = 1.0
    for k in range(1, n):
        a = (forward[:, k - 1] @ t) * e[:, k]
        forward[:, k] = a / a.sum(axis=1, keepdims=True)
    for k in range(n - 2, -1, -1):
        b = (backward[:, k + 1] * e[:, k + 1]) @ t.T
        backward[:, k] = b / b.sum(axis=1, keepdims=True)
    shares = forward * backward
    shares /= shares.sum(axis=2, keepdims=True)
    pair = np.einsum("cki,ckj->ckij", forward[:, :-1], backward[:, 1:] * e[:, 1:]) * t
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return shares, pair.sum(axis=(0, 1))


def chain_shares(score: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Language shares of every word of chains of any length, all chains at once and exactly.

    Chains are cut into chunks. A chunk's transfer matrix carries the forward and backward
    sums over it, so the chunks' borders follow chain by chain from few small products, and
    the sums inside then run side by side over all chunks.
    """
    size = score.shape[1]
    e = np.exp(score - score.max(axis=1, keepdims=True))
    t = np.exp(moves - moves.max())
    chunks = -(-lengths // CHUNK)
    total = int(chunks.sum())
    first = np.cumsum(chunks) - chunks
    chain = np.repeat(np.arange(len(lengths)), chunks)
    rank = np.arange(total) - first[chain]
    begin = (np.cumsum(lengths) - lengths)[chain] + rank * CHUNK
    sizes = np.minimum(lengths[chain] - rank * CHUNK, CHUNK)
    grid = np.full((CHUNK, total, size), 1.0)
    steps = gather(np.zeros(total, np.int64), sizes)
    columns = np.repeat(np.arange(total), sizes)
    flat = gather(begin, sizes)
    grid[steps, columns] = e[flat]
    live = np.array([np.count_nonzero(sizes > k) for k in range(CHUNK)])
    by_size = np.argsort(-sizes, kind="stable")  # chunks that still have a k-th word come first
    grid, is_first = grid[:, by_size], (rank == 0)[by_size]
    carry = np.tile(np.eye(size), (total, 1, 1)) * grid[0][:, None, :]
    later = ~is_first
    carry[later] = t * grid[0, later][:, None, :]
    for k in range(1, CHUNK):
        n = live[k]
        step = (carry[:n].reshape(-1, size) @ t).reshape(n, size, size) * grid[k, :n][:, None, :]
        carry[:n] = step / step.max(axis=(1, 2), keepdims=True) if k % 8 == 0 else step
    back = np.empty(total, np.int64)
    back[by_size] = np.arange(total)
    carry = carry[back]
    carry /= carry.max(axis=(1, 2), keepdims=True)
    ahead, behind = np.ones((total, size)), np.ones((total, size))  # sums before a chunk's first word, after its last
    most = int(chunks.max()) if len(chunks) else 0
    order = np.argsort(-chunks, kind="stable")
    live_chains = np.searchsorted(-chunks[order], -np.arange(most), side="left")  # chains with more chunks than k
    for k in range(1, most):
        at = first[order[: live_chains[k]]] + k
        a = np.einsum("ci,cij->cj", ahead[at - 1], carry[at - 1])
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for k in range(most - 1, 0, -1):
        at = first[order[: live_chains[k]]] + k
        b = np.einsum("cij,cj->ci", carry[at], behind[at])
        behind[at - 1] = b / b.sum(axis=1, keepdims=True)
    forward = np.empty_like(grid)
    state = ahead[by_size]
    state = np.where(is_first[:, None], state, state @ t) * grid[0]
    forward[0] = state / state.sum(axis=1, keepdims=True)
    for k in range(1, CHUNK):
        n = live[k]
        state = (forward[k - 1, :n] @ t) * grid[k, :n]
        forward[k, :n] = state / state.sum(axis=1, keepdims=True)
    state = behind[by_size]
    for k in range(CHUNK - 1, -1, -1):
        n = live[k]
        s = forward[k, :n] * state[:n]
        forward[k, :n] = s / s.sum(axis=1, keepdims=True)
        b = (state[:n] * grid[k, :n]) @ t.T
        state[:n] = b / b.sum(axis=1, keepdims=True)
    out = np.empty((len(flat), size))
    out[flat] = forward[steps, back[columns]]
    return out


class Tagger:
    """Language shares of texts; words already scored in the task are looked up."""

    def __init__(self, model: dict):
        self.model, self.known = model, {}
        self.scores = np.zeros((0, len(model["languages"])))

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Shares of every word, one after another, and the number of words of each text."""
        if len(self.known) > KNOWN_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        parts = [words_of(t) for t in texts]
        flat = [w for p in parts for w in p]
        new = [w for w in dict.fromkeys(flat) if w not in self.known]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.scores = np.concatenate((self.scores, emissions(new, self.model["weights"])))
        codes = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        some = lengths > 0
        return chain_shares(self.scores[codes], lengths[some], self.model["moves"]), lengths

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names = self.model["languages"]
        if not names:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        shares, lengths = self.words(texts)
        out, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        some = np.flatnonzero(lengths)
        if len(some):
            sums = np.add.reduceat(shares, (np.cumsum(lengths) - lengths)[some], axis=0) / lengths[some, None]
            for i, k, s in zip(some.tolist(), sums.argmax(axis=1).tolist(), sums.max(axis=1).tolist()):
                out[i], scores[i] = names[k], min(1.0, max(0.0, s))
        return out, scores


def train(docs: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", fit_docs: int = FIT_DOCS) -> dict:
    """Fit on at most ``fit_docs`` of the usable rows, the first by a hash of their id.

    Bounded by ``fit_docs`` texts of at most ``FIT_WORDS`` words each, taken from a place
    chosen at random. Rows without text or language teach nothing. Ids are chosen without
    reading texts; the texts of the chosen are then read with the filter pushed down.
    """
    rows = docs.where(usable & F.col(lang_column).isNotNull())
    chosen = rows.select(F.xxhash64(F.col(id_column).cast("string")).alias("h"), F.col(lang_column).cast("string").alias("y"), F.col(id_column).alias("id"))
    ids = fitting_rows(chosen, fit_docs)
    if not ids:
        return fit([], [])
    # the cut of a text around a place that its id's hash chooses, so that what comes to the driver is bounded
    cut = FIT_WORDS * 12
    text = F.col(text_column).cast("string")
    start = F.lit(1) + F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.lit(1)), F.greatest(F.lit(1), F.length(text) - cut))
    picked = rows.where(F.col(id_column).isin([r.id for r in ids])).select(F.substring(text, start, F.lit(cut)).alias("t"), F.col(lang_column).cast("string").alias("y"), F.col(id_column).alias("id"))
    pairs = picked.orderBy("id", "y", "t").limit(2 * fit_docs).collect()
    return fit([r.t for r in pairs], [r.y for r in pairs])


def predict(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from the text alone, all rows and columns kept.

    Every word's language shares come from forward-backward over the whole text; the
    score is the mean share of the predicted language, 0 to 1. Null texts and texts
    without a letter are ``und`` with score 0. Columns of the same names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text_column)
    # names of any kind stay out of the map: columns travel by their place
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                names, scores = tagger.texts(part.column(at).to_pylist())
                columns = [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "lang_pred", "score"])

    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema).toDF(*kept, "lang_pred", "score")
