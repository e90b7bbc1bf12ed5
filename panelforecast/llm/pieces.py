"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from panelforecast.llm.common import gather, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: below the worst piece, for a character that no piece covers
ZIPF_SHIFT = 2.7  # fixed value: Zipf-Mandelbrot law of word ranks
NEVER = -1e8  # fixed value: scores below it only mark pieces that merging never makes
WIDTHS = (6, 9, 12, 16, 24, 48)
WINDOW = 512
KNOWN_SEGMENTS = 200_000


def load_model(path: str = MODEL) -> dict:
    """Pieces, log scores and their double-array trie as plain arrays, ready to broadcast.

    The white-space marker is kept as the byte 0x20 inside, so a marker character in a
    text is an ordinary unknown character. A model whose scores are merge ranks (minus
    0, 1, 2 ... in order) has no log scores of its own; the piece of rank r then gets
    ``-log(r + 2.7)``, the Zipf-Mandelbrot law of a vocabulary in order of frequency.
    The size is bounded by the vocabulary.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table, rows, byte_ids = [], [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
            table.append(bytes([int(piece[3:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            table.append(b"")
        else:
            table.append(piece.replace(MARKER, " ").encode())
            rows.append((table[-1], i, model.get_score(i)))
    scores = np.zeros(len(table))
    first = min(i for _, i, _ in rows)
    ranked = all(s == first - i or s <= NEVER for _, i, s in rows)
    for _, i, s in rows:
        scores[i] = -np.log(i - first + ZIPF_SHIFT) if ranked else s
    base, check, value = double_array({piece: i for piece, i, _ in rows})
    pieces = [p for p, _, _ in rows]
    return {
        "base": base, "check": check, "value": value, "scores": scores, "table": table,
        "unknown": float(min(scores[i] for _, i, _ in rows)) - UNKNOWN_PENALTY,
        "bytes": np.array([byte_ids[b] for b in range(256)], np.int32),
        # a text may be cut before a run of spaces and around line ends where no piece reaches over
        "cut": not any(b" " in p.lstrip(b" ") or b"\n" in p for p in pieces),
    }


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base``, ``check`` and ``value`` of a trie over bytes.

    The child of state s by byte b is ``t = base[s] + b`` if ``check[t] == s``; ``value[t]``
    is the word's number or -1. The root is state 0; states are at least 1 beyond it.
    """
    children: dict[int, dict[int, int]] = {0: {}}
    ends: dict[int, int] = {}
    for word, number in words.items():
        at = 0
        for b in word:
            at = children[at].setdefault(b, len(children))
            children.setdefault(at, {})
        ends[at] = number
    size = 4 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = bytearray(b"\x01") * size
    free[0] = 0
    place, queue, low, wide = {0: 0}, [0], 1, 1
    while queue:
        node = queue.pop()
        keys = sorted(children[node])
        if not keys:
            continue
        low = free.index(1, low)
        at = low if len(keys) == 1 else wide
        while True:  # the first free place of the first key that leaves the other keys' places free
            at = free.index(1, max(at, keys[0] + 1))
            offset = at - keys[0]
            if all(free[offset + k] for k in keys):
                break
            at += 1
        if len(keys) > 1:
            wide = max(wide, at - WINDOW)
        base[place[node]] = offset
        for k in keys:
            child, at = children[node][k], offset + k
            free[at], check[at], place[child] = 0, place[node], at
            value[at] = ends.get(child, -1)
            queue.append(child)
    return base, check, value


class Encoder:
    """Ids of texts; segments already seen in the task are looked up."""

    def __init__(self, model: dict):
        self.model = model
        self.cut = re.compile(rb" +[^ \n]*|[^ \n]+|\n+" if model["cut"] else rb"(?s).+")
        self.lists: tuple | None = None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        if len(self.known) > KNOWN_SEGMENTS:
            self._forget()
        parts = [self.cut.findall(b" " + t) if t else [] for t in texts]
        segments = [s for p in parts for s in p]
        new = [s for s in dict.fromkeys(segments) if s not in self.known]
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))
        lengths = self.lengths[codes]
        ids = self.flat[gather(self.starts[codes], lengths)]
        ends = np.cumsum([0, *map(len, parts)])
        totals = np.concatenate(([0], np.cumsum(lengths)))
        return ids, totals[ends[1:]] - totals[ends[:-1]]

    def _learn(self, segments: list[bytes]) -> None:
        ordered, ids, sizes, low = [], [], [], 0
        for high in WIDTHS:  # of about equal length, so that few steps go past an end
            some = [s for s in segments if low < len(s) <= high]
            best, counts = self._viterbi_many(some)
            ordered += some
            ids.append(best)
            sizes.append(counts)
            low = high
        long = [s for s in segments if len(s) > low]
        ids += [np.array(self._viterbi_one(s), np.int32) for s in long]
        sizes.append(np.array([len(r) for r in ids[len(WIDTHS) :]], np.int64))
        counts = np.concatenate(sizes)
        begin = len(self.flat) + np.cumsum(counts) - counts
        self.known.update(zip(ordered + long, range(len(self.known), len(self.known) + len(segments))))
        self.flat = np.concatenate((self.flat, *ids))
        self.starts, self.lengths = np.concatenate((self.starts, begin)), np.concatenate((self.lengths, counts))

    def _viterbi_many(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of all segments side by side: every step of the trie is one array operation."""
        n = len(segments)
        if not n:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        m = self.model
        lengths = np.fromiter(map(len, segments), np.int64, n)
        width = int(lengths.max())
        text = np.zeros((n, width + 1), np.int32)
        text[np.repeat(np.arange(n), lengths), gather(np.zeros(n, np.int64), lengths)] = np.frombuffer(b"".join(segments), np.uint8)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        piece, came = np.full((n, width + 1), -1, np.int32), np.zeros((n, width + 1), np.int32)

        def offer(rows: np.ndarray, end: np.ndarray | int, score: np.ndarray, ids: np.ndarray | int, start: int) -> None:
            better = score > best[rows, end]
            r = rows[better]
            e = end[better] if isinstance(end, np.ndarray) else end
            best[r, e], came[r, e] = score[better], start
            piece[r, e] = ids[better] if isinstance(ids, np.ndarray) else ids

        for start in range(width):
            rows = np.flatnonzero((lengths > start) & (best[:, start] > -np.inf))
            if not len(rows):
                continue
            lead = text[rows, start]
            size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)  # bytes of the character that begins here
            single = np.zeros(len(rows), bool)
            at, state, which = rows, np.zeros(len(rows), np.int32), np.arange(len(rows))
            for end in range(start + 1, width + 1):
                to = m["base"][state] + text[at, end - 1]
                ok = (m["check"][to] == state) & (lengths[at] >= end)
                at, state, which = at[ok], to[ok], which[ok]
                if not len(at):
                    break
                ids = m["value"][state]
                hit = ids >= 0
                if hit.any():
                    offer(at[hit], end, best[at[hit], start] + m["scores"][ids[hit]], ids[hit], start)
                    single[which[hit & (size[which] == end - start)]] = True
            lone = rows[~single]
            if len(lone):
                offer(lone, np.minimum(start + size[~single], lengths[lone]), best[lone, start] + m["unknown"], -1, start)
        out = []  # back from the ends, last pieces first; the fallback's bytes last to first as well
        at, rows = lengths.copy(), np.arange(n)
        while len(rows):
            start, ids = came[rows, at[rows]].astype(np.int64), piece[rows, at[rows]]
            known = ids >= 0
            out.append((rows[known], ids[known]))
            for back in range(1, 5):
                fall = rows[~known & (at[rows] - back >= start)]
                out.append((fall, m["bytes"][text[fall, at[fall] - back]]))
            at[rows] = start
            rows = rows[start > 0]
        owner, ids = np.concatenate([o for o, _ in out]), np.concatenate([i for _, i in out])
        order = np.argsort(owner[::-1], kind="stable")
        return ids[::-1][order].astype(np.int32), np.bincount(owner, minlength=n).astype(np.int64)

    def _viterbi_one(self, text: bytes) -> list[int]:
        """The same for one long segment."""
        m = self.model
        if self.lists is None:
            self.lists = tuple(m[k].tolist() for k in ("base", "check", "value", "scores"))
        base, check, value, scores = self.lists
        n, worst = len(text), m["unknown"]
        best, piece, came = [float("-inf")] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here = best[start]
            if here == float("-inf"):
                continue
            lead = text[start]
            size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single, state = False, 0
            for end in range(start + 1, n + 1):
                to = base[state] + text[end - 1]
                if check[to] != state:
                    break
                state = to
                i = value[to]
                if i >= 0:
                    single |= end - start == size
                    if here + scores[i] > best[end]:
                        best[end], piece[end], came[end] = here + scores[i], i, start
            end = min(start + size, n)
            if not single and here + worst > best[end]:
                best[end], piece[end], came[end] = here + worst, -1, start
        out, at = [], n
        while at:
            start = came[at]
            out.extend([piece[at]] if piece[at] >= 0 else [int(m["bytes"][b]) for b in reversed(text[start:at])])
            at = start
        return out[::-1]


def _id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))


def _null_where(lists: pa.ListArray, there: pa.BooleanArray) -> pa.Array:
    return lists if pc.all(there).as_py() in (True, None) else pc.if_else(there, lists, pa.scalar(None, lists.type))


def _joined(table: list[bytes], ids: list[int]) -> bytes:
    """The bytes of a text from its ids: pieces joined, without the space put before it."""
    return b"".join([table[i] for i in ids]).removeprefix(b" ")


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: dict | str = MODEL) -> DataFrame:
    """``(id, ids)``: the best segmentation of every whole text into pieces.

    A space is put before a text that is not empty, and spaces become the marker. The
    segmentation has the highest sum of log scores; of equal ones that with the
    longest last piece. A character without a piece of its own can only be read
    through its UTF-8 bytes. A null text has null ids, an empty one none; repeated rows
    are encoded each; other columns are not carried along.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model) if isinstance(model, str) else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in slices(batch):
                ids, counts = encoder.encode(part.column("text").cast(pa.large_binary()).to_pylist())
                lists = _null_where(_id_lists(ids, counts), part.column("text").is_valid())
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "ids"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", model: dict | str = MODEL) -> DataFrame:
    """``(id, text)``: the text of every list of ids; the exact opposite of ``encode``.

    Pieces are joined, the marker becomes a space again and the space put before the
    text goes. Ids of no text (control pieces) give nothing, bytes that are not UTF-8
    give the replacement character, a null list or an unknown id gives a null text.
    """
    shared = encoded.sparkSession.sparkContext.broadcast((load_model(model) if isinstance(model, str) else model)["table"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_pylist()
            texts, at = [], 0
            for k in lists.value_lengths().to_pylist():
                if k is None:
                    texts.append(None)
                    continue
                try:
                    texts.append(_joined(table, flat[at : at + k]).decode(errors="replace"))
                except (IndexError, TypeError):
                    texts.append(None)
                at += k
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
    return out.withColumnRenamed("id", id_column)


def round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: dict | str = MODEL) -> DataFrame:
    """``(id, ids, n_tokens, n_bytes, decoded_sha256)``: ids of every text, and the digest of what they decode to.

    Both ways in one pass, run by run, as ``encode`` and ``decode`` do them. ``n_bytes``
    counts the ids of the byte fallback. A null text has null ids, no tokens and a null
    digest.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model) if isinstance(model, str) else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = Encoder(shared.value), shared.value["table"]
        fallback = np.zeros(len(table), np.int64)
        fallback[shared.value["bytes"]] = 1
        for batch in batches:
            for part in slices(batch):
                there = part.column("text").is_valid()
                ids, counts = encoder.encode(part.column("text").cast(pa.large_binary()).to_pylist())
                fell = np.concatenate(([0], np.cumsum(fallback[ids])))
                ends = np.cumsum(counts)
                digests = [
                    hashlib.sha256(_joined(table, ids[end - k : end].tolist())).hexdigest() if known else None
                    for end, k, known in zip(ends.tolist(), counts.tolist(), there.to_pylist())
                ]
                lists = _null_where(_id_lists(ids, counts), there)
                columns = [part.column("id"), lists, pa.array(counts), pa.array(fell[ends] - fell[ends - counts]), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "n_tokens", "n_bytes", "decoded_sha256"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long, n_bytes long, decoded_sha256 string")
    return out.withColumnRenamed("id", id_column)
