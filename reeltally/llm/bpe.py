"""Byte-level BPE by monoid tree reduction.

Encoding is a fold over the halves of a piece.  A sequence of tokens is the BPE encoding of its bytes exactly when
every two neighbours are, i.e. when encoding the two tokens' bytes gives the two tokens again.  So two encoded halves
are joined by encoding a window around the seam anew and widening it until both its outer edges pass that test: from
there on no token outside can change.  Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.llm.chunks import distinct, gathered
from reeltally.llm.registry import query, table

LEAF_BYTES = 32
CACHED_PIECES = 300_000  # some 70 MB; emptied when a task ends
BATCH_CHARS = 1_000_000
# White space as the tokenizer libraries' patterns have it (Unicode White_Space); Python's adds U+001C to U+001F.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(kind: str) -> str:
    """The characters whose category begins with ``kind``, as ranges for a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def compiled(pattern: str) -> re.Pattern:
    """The pattern for ``re``, which is faster than a library with Unicode classes: they are written out."""
    letters, digits = _ranges("L"), _ranges("N")
    spaces = "".join(f"\\u{ord(c):04x}" for c in SPACES)
    inside = {r"\p{L}": letters, r"\p{N}": digits, r"\s": spaces}
    out = re.sub(r"\[\^(?:\\s|\\p\{L\}|\\p\{N\})+\]", lambda m: "[^" + re.sub(r"\\s|\\p\{.\}", lambda k: inside[k[0]], m[0][2:-1]) + "]", pattern)
    out = re.sub(r"\\p\{.\}|\\s", lambda m: f"[{inside[m[0]]}]", out)
    return re.compile(out.replace(r"\S", f"[^{spaces}]"))


class Splitter:
    """The matches of the usual byte-level pattern (contractions, words, numbers, signs, white space), by character class.

    A match begins where the class changes.  The last of several white space characters stands apart, and joins what
    follows if it is U+0020; an apostrophe that begins a match takes one of the endings with it.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    END = 0x110000  # stands behind every text, as a match of its own

    def __init__(self):
        kinds = {"L": 1, "N": 2}
        self.kind = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 3) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        self.kind[[ord(c) for c in SPACES]] = 0
        self.kind = np.append(self.kind, np.uint8(4))
        # Endings behind an apostrophe, by their first letter: how long they are, and the second letter of those of two.
        self.ending, self.second = np.zeros(128, np.int64), np.zeros(128, np.uint32)
        for text in ("s", "t", "re", "ve", "m", "ll", "d"):
            self.ending[ord(text[0])], self.second[ord(text[0])] = len(text), ord(text[-1])

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' code points, ``END`` behind each, and where each match begins."""
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32).copy()
        codes[np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1] = self.END
        kind = self.kind[codes]
        begins = np.empty(len(codes) + 1, bool)
        begins[0] = begins[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:-1])
        # Two texts may meet in nothing but their ends.
        begins[1:][kind == 4] = True
        last_space = np.flatnonzero(begins[1:-1] & (kind[:-1] == 0) & (kind[1:] != 4))
        begins[last_space] = True
        begins[last_space[codes[last_space] == 32] + 1] = False
        at = np.flatnonzero(begins[:-1] & (codes == 39))
        one = np.minimum(codes[at + 1], 127)
        n = self.ending[one]
        n[(n == 2) & (codes[np.minimum(at + 2, len(codes) - 1)] != self.second[one])] = 0
        at, n = at[n > 0], n[n > 0]
        begins[at + 1] = False
        begins[at[n == 2] + 2] = False
        begins[at + 1 + n] = True
        return codes, np.flatnonzero(begins[:-1])

    def findall(self, text: str) -> list[str]:
        edges = self.split([text])[1].tolist()
        return [text[a:b] for a, b in zip(edges, edges[1:])]

    def encode(self, texts: list[str], ids_of) -> list[np.ndarray]:
        """Ids of every text, each different match encoded once: ``ids_of`` maps a list of matches to their ids, little-endian unsigned 32-bit."""
        codes, begins = self.split(texts)
        first, which = distinct(codes, begins)
        joined = "\0".join([*texts, ""])
        stop = np.append(begins[1:], len(codes))
        ends = codes[begins[first]] == self.END
        known = ids_of([joined[a:b] for a, b in zip(begins[first[~ends]].tolist(), stop[first[~ends]].tolist())])
        sizes = np.zeros(len(first), np.int64)
        sizes[~ends] = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        ids = gathered(flat, np.cumsum(sizes) - sizes, sizes, which)
        edges = np.cumsum(sizes[which])[ends[which]]
        return np.split(ids, edges[:-1]) if len(texts) else []


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class ByteBPE:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_bytes: int = LEAF_BYTES):
        self.ranks, self.leaf = ranks, leaf_bytes
        self.pattern = Splitter() if pattern == Splitter.PATTERN else compiled(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        # Pairs of tokens whose bytes together are a token, sorted, for the leaves that are merged together.
        self.none = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        made = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    made[a * (self.none + 1) + b] = rank
        self.pair_keys = np.sort(np.fromiter(made, np.int64, len(made)))
        self.pair_made = np.array([made[k] for k in self.pair_keys.tolist()], np.int64)

    def merged(self, data: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left; pairs wait in a heap."""
        ranks, n = self.ranks, len(data)
        if n <= self.leaf:
            return self.merged_small(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            # Stale: i was swallowed (end 0), or one of the two parts has grown since.
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def merged_small(self, data: bytes) -> list[int]:
        """The same for a few bytes, where a list of all pairs' ranks is quicker."""
        get, none = self.ranks.get, len(self.ranks) + 1
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[x] for x in parts]

    def stable(self, left: int, right: int) -> bool:
        key = (left, right)
        if key not in self.fits:
            if len(self.fits) > CACHED_PIECES:
                self.fits.clear()
            self.fits[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return self.fits[key]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        i = j = 1
        while True:
            window = self.merged(b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j])))
            outer_l, outer_r = left[:-i], right[j:]
            ok_l = not outer_l or self.stable(outer_l[-1], window[0])
            ok_r = not outer_r or self.stable(window[-1], outer_r[0])
            if ok_l and ok_r:
                return outer_l + window + outer_r
            i, j = i if ok_l else 2 * i, j if ok_r else 2 * j

    def reduced(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.reduced(data[:half]), self.reduced(data[half:]))

    def merged_many(self, leaves: list[bytes]) -> list[bytes]:
        """:meth:`merged` of many leaves at once, one merge of every leaf in each round; ids as little-endian bytes."""
        out: list[bytes] = [b""] * len(leaves)
        sizes = np.fromiter(map(len, leaves), np.int64, len(leaves))
        for low, high in ((0, 6), (6, 10), (10, 16), (16, self.leaf)):
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            for lo in range(0, len(at), 20_000):
                rows = at[lo : lo + 20_000]
                ids = np.full((len(rows), high), self.none, np.int64)
                flat = np.frombuffer(b"".join([leaves[i] for i in rows.tolist()]), np.uint8)
                ids[np.arange(high) < sizes[rows][:, None]] = self.byte_ids[flat]
                ranks = np.full((len(rows), high), self.none, np.int64)
                ranks[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
                lens = sizes[rows].copy()
                cols = np.arange(high)
                while len(rows):
                    k = ranks.argmin(1)
                    best = ranks[np.arange(len(rows)), k]
                    done = best == self.none
                    if done.any():
                        for i, n, row in zip(rows[done].tolist(), lens[done].tolist(), ids[done].astype("<u4")):
                            out[i] = row[:n].tobytes()
                        go = ~done
                        rows, lens, ids, ranks, k, best = rows[go], lens[go], ids[go], ranks[go], k[go], best[go]
                        if not len(rows):
                            break
                    r = np.arange(len(rows))
                    ids[r, k] = best
                    # Closes the gap at k + 1 in the ids and at k in the ranks, then ranks the two new pairs.
                    src = np.minimum(cols + (cols > k[:, None]), high - 1)
                    ids = np.take_along_axis(ids, src, 1)
                    ids[:, -1] = self.none
                    src = np.minimum(cols + (cols >= k[:, None]), high - 1)
                    ranks = np.take_along_axis(ranks, src, 1)
                    ranks[:, -1] = self.none
                    lens -= 1
                    nxt = np.minimum(k + 1, high - 1)
                    ranks[r, k] = np.where(k + 1 < lens, self.pair_ranks(ids[r, k], ids[r, nxt]), self.none)
                    prev = np.maximum(k - 1, 0)
                    ranks[r, prev] = np.where(k > 0, self.pair_ranks(ids[r, prev], ids[r, k]), ranks[r, prev])
        return out

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.none + 1) + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_made[at], self.none)

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of matches of the pattern, little-endian; a match that is a token is that token."""
        out, leaves, places = [], [], []
        for piece in pieces:
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                out.append(rank.to_bytes(4, "little"))
            elif len(data) <= self.leaf:
                places.append(len(out))
                leaves.append(data)
                out.append(b"")
            else:
                out.append(np.array(self.reduced(data), "<u4").tobytes())
        for place, ids in zip(places, self.merged_many(leaves)):
            out[place] = ids
        return out

    def known_ids(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        known = self.known
        new = [piece for piece in pieces if piece not in known]
        known.update(zip(new, self.pieces(new)))
        return [known[piece] for piece in pieces]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if isinstance(self.pattern, Splitter):
            return self.pattern.encode(texts, self.known_ids)
        split = [self.pattern.findall(text) for text in texts]
        known = dict(zip(pieces := list(set().union(*split)), self.known_ids(pieces)))
        return [np.frombuffer(b"".join([known[piece] for piece in one]), "<u4") for one in split]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODERS: dict[tuple, ByteBPE] = {}


def coder(data: bytes, pattern: str) -> ByteBPE:
    """One coder for each Python worker."""
    key = (hashlib.md5(data).digest(), pattern)
    if key not in _CODERS:
        _CODERS[key] = ByteBPE(read_ranks(data), pattern)
    return _CODERS[key]


def parts(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``chars`` characters, so that what is held for them is bounded."""
    lo = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def byte_bpe(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids: ``id``, ``n_tokens``, ``ids`` (array of int), ``decoded`` (binary).

    ``vocabulary`` is a file of ranks on the driver; its bytes (fixed by the tokenizer, about 1 MB) are broadcast.  With
    ``digests`` the ids and bytes are replaced by ``ids_sha256`` and ``decoded_sha256``, so that they need not
    leave the task.  One row for each row, in place, without a shuffle.  Null and empty texts have no tokens; repeated rows
    give repeated rows; other columns are ignored; an empty table gives no rows.  A text is one row's work,
    whatever its length: time grows with length times its logarithm.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(shared.value, pattern)
        for batch in batches:
            texts, row_ids = [t or "" for t in batch["text"]], batch["id"].to_numpy()
            for lo, hi in parts(texts):
                found = bpe.encode_batch(texts[lo:hi])
                back = map(bpe.decode, found)
                yield pd.DataFrame(
                    {
                        "id": row_ids[lo:hi],
                        "n_tokens": [len(ids) for ids in found],
                        names[0]: [hashlib.sha256(ids.tobytes()).hexdigest() if digests else ids.astype("i4") for ids in found],
                        names[1]: [hashlib.sha256(data).hexdigest() if digests else data for data in back],
                    }
                )
        bpe.known.clear()
        bpe.fits.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    # Ids travel as text, so that nulls and wide types come back as they were.
    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"id string, n_tokens long, {rest}")
    return out.withColumn("id", F.col("id").cast(kind))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return out.withColumnRenamed("id", "doc_id")
