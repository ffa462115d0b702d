"""SentencePiece encoding and decoding by a table of distinct chunks.

White space is turned into a visible mark.  Where no piece of the model has a mark behind another character, pieces cannot cross from one
marked word into the next, so a text falls into chunks (marks and the word behind them) that are segmented on their own.
A block of texts is cut into chunks, each different chunk is segmented once, and the ids are joined back by the chunks'
positions.  A character that no piece holds can take part in no merge, so it is a chunk, too.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.llm.bpe import parts
from reeltally.llm.chunks import distinct, gathered
from reeltally.llm.registry import query, table

MARK = "▁"
LONG = 32  # characters beyond which a chunk is merged by a heap, on its own
BLOCK_CHARS = 2_000_000
TOGETHER = 20_000  # chunks that are merged in step
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in the model's format


class Model(NamedTuple):
    pieces: list[tuple[str, float, int]]  # text, score, kind
    settings: dict[str, int | bytes]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def read_model(data: bytes) -> Model:
    """Pieces and settings of a model file.  A model that is not BPE with byte fallback, or changes characters, raises."""
    found, settings = [], {"kind": 1, "fallback": 0, "suffix": 0, "prefix": 1, "squeeze": 1, "escape": 1, "map": b""}
    names = {2: {3: "kind", 24: "suffix", 35: "fallback"}, 3: {2: "map", 3: "prefix", 4: "squeeze", 5: "escape"}}
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for inner, x in _fields(value):
                if inner == 1:
                    text = x.decode()
                elif inner == 2:
                    score = float(np.frombuffer(x, "<f4")[0])
                elif inner == 3:
                    kind = x
            found.append((text, score, kind))
        elif number in names:
            settings |= {names[number][inner]: x for inner, x in _fields(value) if inner in names[number]}
    want = {"kind": 2, "fallback": 1, "suffix": 0, "prefix": 1, "squeeze": 0, "escape": 1, "map": b""}
    wrong = [k for k, v in want.items() if settings[k] != v]
    if wrong or {kind for _, _, kind in found} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError(f"not a plain BPE model with byte fallback: {wrong}")
    return Model(found, settings)


class Segmenter:
    """Encoder and decoder for one model."""

    def __init__(self, data: bytes):
        model = read_model(data)
        self.words = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.bytes_ = np.zeros(256, np.int64)
        for i, (text, _, kind) in enumerate(model.pieces):
            if kind == BYTE:
                self.bytes_[int(text[3:5], 16)] = i
        named = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind == CONTROL}
        self.begin, self.end = named["<s>"], named["</s>"]
        self.size = len(model.pieces)
        # Symbols: pieces by their id, then characters that are only part of pieces, last what no piece holds.
        parts_ = sorted({c for text in self.words for c in text} - self.words.keys())
        self.symbol = dict(self.words) | {c: self.size + i for i, c in enumerate(parts_)}
        self.other = self.size + len(parts_)
        self.of_char = np.full(0x110000, self.other, np.int32)
        for text, number in self.symbol.items():
            if len(text) == 1:
                self.of_char[ord(text)] = number
        self.mark = int(self.of_char[ord(MARK)])
        self.apart = not any(MARK in text.lstrip(MARK) for text in self.words)
        # Rank of a pair: how its piece's score stands among all scores; equal scores share it, and the leftmost pair goes first.
        scores = sorted({score for _, score, _ in model.pieces}, reverse=True)
        rank = {score: i for i, score in enumerate(scores)}
        self.none = len(scores)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for text, number in self.words.items():
            for k in range(1, len(text)):
                a, b = self.symbol.get(text[:k]), self.symbol.get(text[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank[model.pieces[number][1]], number
        keys = np.array([a * (self.other + 1) + b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        made = np.array(list(self.pairs.values()), np.int64).reshape(-1, 2)[order]
        self.pair_keys, self.pair_rank, self.pair_made = keys[order], made[:, 0], made[:, 1]
        # What each piece says when decoded, and behind that what it says where a text begins.
        said = [text.replace(MARK, " ").encode() if kind == NORMAL else " ⁇ ".encode() if kind == UNKNOWN else b"" for text, _, kind in model.pieces]
        for b, i in enumerate(self.bytes_.tolist()):
            said[i] = bytes([b])
        self.leads = np.array([kind == NORMAL and text.startswith(MARK) for text, _, kind in model.pieces])
        said += [text[1:] if leads else text for text, leads in zip(said, self.leads.tolist())]
        self.text = np.frombuffer(b"".join(said), np.uint8)
        self.text_size = np.fromiter(map(len, said), np.int64, len(said))
        self.text_begin = np.cumsum(self.text_size) - self.text_size

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table of pairs and rank; pairs that make no piece have rank ``none``."""
        key = left * np.int64(self.other + 1) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return at, np.where(self.pair_keys[at] == key, self.pair_rank[at], self.none)

    def merged(self, symbols: list[int]) -> list[int]:
        """One chunk: the pair of best rank, leftmost first, until none is left; pairs wait in a heap."""
        n = len(symbols)
        now, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i, i + 1, *now[i : i + 2], p[1]) for i in range(n - 1) if (p := self.pairs.get((now[i], now[i + 1])))]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            if i >= 0 and j < n and (p := self.pairs.get((now[i], now[j]))):
                heapq.heappush(heap, (p[0], i, j, now[i], now[j], p[1]))

        while heap:
            _, i, j, a, b, made = heapq.heappop(heap)
            if now[i] != a or now[j] != b or after[i] != j:
                continue
            now[i], now[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(before[i], i)
            push(i, after[i])
        return [s for s in now if s >= 0]

    def merged_many(self, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`merged` for many chunks in step, one merge of every chunk in each round: flat ids, with the chunks' begins and sizes."""
        out_size = sizes.copy()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        single = np.flatnonzero(sizes == 1)
        held.append((single, symbols[begins[single]]))
        edges = (1, 4, 6, 8, 10, 13, 18, LONG)
        for low, high in zip(edges, edges[1:]):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            for lo in range(0, len(chosen), TOGETHER):
                rows = chosen[lo : lo + TOGETHER]
                cols = np.arange(high)
                inside = cols < sizes[rows][:, None]
                now = np.full((len(rows), high), self.other, np.int64)
                now[inside] = gathered(symbols, begins, sizes, rows)
                rank = np.full((len(rows), high), self.none, np.int64)
                rank[:, :-1] = self.found(now[:, :-1], now[:, 1:])[1]
                while len(rows):
                    k = rank.argmin(1)
                    r = np.arange(len(rows))
                    done = rank[r, k] == self.none
                    if done.any():
                        ended = rows[done]
                        n = out_size[ended]
                        held.append((ended, now[done][cols < n[:, None]]))
                        go = ~done
                        rows, now, rank, k = rows[go], now[go], rank[go], k[go]
                        if not len(rows):
                            break
                        r = np.arange(len(rows))
                    at, _ = self.found(now[r, k], now[r, k + 1])
                    # Closes the gap behind k; the pairs on both sides of the new symbol are ranked anew.
                    shut = np.minimum(cols + (cols > k[:, None]), high - 1)
                    now = np.take_along_axis(now, shut, 1)
                    now[:, -1] = self.other
                    rank = np.take_along_axis(rank, np.minimum(cols + (cols >= k[:, None]), high - 1), 1)
                    rank[:, -1] = self.none
                    now[r, k] = self.pair_made[at]
                    out_size[rows] -= 1
                    behind, ahead = np.maximum(k - 1, 0), np.minimum(k + 1, high - 1)
                    rank[r, k] = self.found(now[r, k], now[r, ahead])[1]
                    rank[r, behind] = np.where(k > 0, self.found(now[r, behind], now[r, k])[1], rank[r, behind])
        for i in np.flatnonzero(sizes > LONG).tolist():
            ids = self.merged(symbols[begins[i] : begins[i] + sizes[i]].tolist())
            out_size[i] = len(ids)
            held.append((np.array([i]), np.array(ids)))
        order = np.concatenate([rows for rows, _ in held])
        out_begin = np.zeros(len(sizes), np.int64)
        out_begin[order] = np.cumsum(out_size[order]) - out_size[order]
        return np.concatenate([ids for _, ids in held]).astype(np.int64), out_begin, out_size

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, between the begin and the end id."""
        marked = [MARK + text.replace(" ", MARK) if text else "" for text in texts]
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        del marked
        stops = np.cumsum(sizes)
        symbols = self.of_char[codes]
        begin = np.zeros(len(codes) + 1, bool)
        begin[stops - sizes] = True
        begin = begin[:-1]
        alone = symbols == self.other
        begin |= alone
        begin[1:] |= alone[:-1]
        if self.apart:
            begin[1:] |= (symbols[1:] == self.mark) & (symbols[:-1] != self.mark)
        begins = np.flatnonzero(begin)
        # Chunks are told apart by their characters: those that no piece holds differ in bytes.
        first, which = distinct(codes, begins)
        long = np.diff(begins, append=len(codes))
        flat, own_begin, own_size = self.merged_many(symbols, begins[first], long[first])
        flat, own_begin, own_size = self.spelled(flat, own_begin, own_size, codes[begins[first]])
        ids = gathered(flat, own_begin, own_size, which).astype("<u4")
        # Ids of a text: those of the chunks between its edges.
        ends = np.concatenate([[0], np.cumsum(own_size[which])])
        lo, hi = ends[np.searchsorted(begins, stops - sizes)], ends[np.searchsorted(begins, stops)]
        a, b = np.array([self.begin], "<u4"), np.array([self.end], "<u4")
        return [np.concatenate([a, ids[i:j], b]) for i, j in zip(lo.tolist(), hi.tolist())]

    def spelled(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols that are no piece as the pieces of their bytes.  ``head`` is each chunk's first character: all there is where no piece holds it."""
        lost = np.flatnonzero(np.logical_or.reduceat(gathered(flat, begins, sizes, np.arange(len(sizes))) >= self.size, np.cumsum(sizes) - sizes)) if len(sizes) else []
        more, extra = [flat], len(flat)
        chars = {number: text for text, number in self.symbol.items() if number >= self.size} if len(lost) else {}
        for i in lost:
            ids = []
            for s in flat[begins[i] : begins[i] + sizes[i]].tolist():
                ids += [s] if s < self.size else self.bytes_[list(chars.get(s, chr(head[i])).encode())].tolist()
            more.append(np.array(ids, np.int64))
            begins[i], sizes[i] = extra, len(ids)
            extra += len(ids)
        return np.concatenate(more), begins, sizes

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces side by side, marks as blanks, without the blank that begins every text.

        Byte pieces are read as UTF-8; one that belongs to no whole character is U+FFFD.
        """
        ids, out = np.asarray(ids, np.int64), []
        # Begin and end ids say nothing, but no character reaches over them.
        for run in np.split(ids, np.flatnonzero(self.text_size[ids] == 0)):
            run = run[self.text_size[run] > 0]
            if len(run) and not out and self.leads[run[0]]:
                run = np.concatenate([run[:1] + self.size, run[1:]])
            if len(run):
                out.append(gathered(self.text, self.text_begin, self.text_size, run).tobytes().decode("utf-8", "each_byte"))
        return "".join(out)


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("each_byte", _each_byte)
_SEGMENTERS: dict[bytes, Segmenter] = {}


def segmenter(data: bytes) -> Segmenter:
    """One segmenter for each Python worker."""
    key = hashlib.md5(data).digest()
    if key not in _SEGMENTERS:
        _SEGMENTERS[key] = Segmenter(data)
    return _SEGMENTERS[key]


def sentence_pieces(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids: ``id``, ``n_tokens``, ``ids`` (array of int, with begin and end id), ``decoded``.

    ``model`` is a SentencePiece file on the driver (BPE with byte fallback that leaves characters as they are; others raise), whose bytes, half a
    megabyte fixed by the tokenizer, are broadcast.  With ``digests`` ids and texts are replaced by ``ids_sha256`` and ``decoded_sha256``,
    so that they need not leave the task.

    One row for each row, in place, without a shuffle: the table of distinct chunks is that of a block of texts, about ``BLOCK_CHARS``
    characters.  Null and empty texts have the begin and the end id alone and decode to nothing; repeated rows give repeated rows;
    other columns are ignored; an empty table gives no rows.  A text is one row's work, whatever its length; a chunk of
    n characters takes n log n steps.
    """
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = segmenter(shared.value)
        for batch in batches:
            texts, row_ids = [t or "" for t in batch["text"]], batch["id"].to_numpy()
            for lo, hi in parts(texts, BLOCK_CHARS):
                found = own.encode_batch(texts[lo:hi])
                back = map(own.decode, found)
                yield pd.DataFrame(
                    {
                        "id": row_ids[lo:hi],
                        "n_tokens": [len(ids) for ids in found],
                        names[0]: [hashlib.sha256(ids.tobytes()).hexdigest() if digests else ids.astype("i4") for ids in found],
                        names[1]: [hashlib.sha256(text.encode()).hexdigest() if digests else text for text in back],
                    }
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    # Ids travel as text, so that nulls and wide types come back as they were.
    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"id string, n_tokens long, {rest}")
    return out.withColumn("id", F.col("id").cast(kind))


@query("op13_sentence_pieces")
def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = sentence_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
    return out.withColumnRenamed("id", "doc_id")
