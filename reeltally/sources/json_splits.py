"""Records of JSON documents ``{..., "<key>": [{...}, {...}], ...}``, read in file splits.

The text source cuts files at every ``}``, so a document of any size is many short rows that many tasks read.  What a split means depends on what
stands before it, and only through three values: whether it begins inside a string, how deep it begins, and whether the array that is
open there is the wanted one.  So the files are scanned three times, each time in proportion to their length:

* The first scan leaves one row for each split: its quotes and its change of depth, for a beginning inside a string and for one outside.  These rows are
  composed along each file, which tells where every split begins.
* The second scan looks at the two depths that matter there, those of the document and of the wanted array.  Composed again, its rows give
  every split its place in the array and every document its verdict.
* The third scan cuts the records, numbered from the start of the array.  Only the ends of records that reach over an edge of a split are
  put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reeltally.plans.session import materialise
from reeltally.plans.verdicts import reason

OBJECT, ARRAY, WANTED, END_OBJECT, END_ARRAY = 1, 2, 3, 4, 5
STEP = np.array([0, 1, 1, 1, -1, -1], np.int32)
_CODE = np.zeros(256, np.uint8)
_CODE[list(b"{[}]")] = OBJECT, ARRAY, END_OBJECT, END_ARRAY
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True
SUMMARY = "path string, split long, size long, bytes long, toggles int, d0 long, d1 long"
LEVEL = "opens long, before long, event int, since long, inside long, wanted long"


def structure(raw: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of all brackets, their codes, whether each lies behind an even number of quotes, and the number of quotes.

    A ``[`` that follows ``"key":`` is ``WANTED``.  Quotes behind an odd run of backslashes count as text.
    """
    quotes = np.flatnonzero(raw == 34)
    if len(quotes) and (raw[quotes[quotes > 0] - 1] == 92).any():
        plain = np.flatnonzero(raw != 92)
        at = np.searchsorted(plain, quotes)
        before = np.where(at > 0, plain[np.maximum(at - 1, 0)], -1)
        quotes = quotes[(quotes - before) % 2 == 1]
    code = _CODE[raw]
    place = np.flatnonzero(code)
    code = code[place]
    square = np.flatnonzero(code == ARRAY)
    if len(square):
        solid = np.flatnonzero(~_BLANK[raw])
        rank = np.searchsorted(solid, place[square])
        colon, last = solid[np.maximum(rank - 1, 0)], solid[np.maximum(rank - 2, 0)]
        name = b'"' + key + b'"'
        first = last - len(name) + 1
        good = (rank >= 2) & (raw[colon] == 58) & (first >= 0)
        for i, byte in enumerate(name):
            good &= raw[np.maximum(first + i, 0)] == byte
        good &= (first < 1) | (raw[np.maximum(first - 1, 0)] != 92)
        code[square[good]] = WANTED
    return place, code, np.searchsorted(quotes, place) % 2 == 0, len(quotes)


def levels(code: np.ndarray, at: Sequence[int] | None = None) -> tuple[int, list[dict[str, int]]]:
    """Change of depth, and for each depth relative to the beginning (or those of ``at``) what happens to an array that is open there.

    ``opens``: objects opened at that depth; ``before``: those of them before the first change of what is open; ``event``: -1 without a change, else
    whether the wanted array is open at the end; ``since``: objects since it was opened; ``inside``: objects in wanted arrays that open here;
    ``wanted``: how many of these arrays there are.
    """
    depth = np.cumsum(STEP[code])
    start = depth - STEP[code]
    out = []
    for level in range(min(int(depth.min(initial=0)), 0), 3) if at is None else at:
        opens = np.flatnonzero((code == OBJECT) & (start == level))
        enters, leaves = (code <= WANTED) & (start == level - 1), (code >= END_OBJECT) & (start == level)
        turns = np.flatnonzero(enters | leaves)
        wanted = code[turns] == WANTED
        upto = np.searchsorted(opens, turns)
        held = np.diff(upto, append=len(opens))
        out.append(
            {
                "level": level,
                "opens": len(opens),
                "before": int(upto[0]) if len(turns) else len(opens),
                "event": int(wanted[-1]) if len(turns) else -1,
                "since": int(held[-1]) if len(turns) else 0,
                "inside": int(held[wanted].sum()),
                "wanted": int(wanted.sum()),
            }
        )
    return int(depth[-1]) if len(depth) else 0, out


def _runs(batch: pd.DataFrame) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """Stretches of a batch that belong to one split."""
    split, path = batch["split"].to_numpy(), batch["path"].to_numpy()
    edges = np.flatnonzero((split[1:] != split[:-1]) | (path[1:] != path[:-1])) + 1
    for a, b in zip([0, *edges], [*edges, len(batch)]):
        if a < b:
            yield (path[a], split[a]), batch.iloc[a:b]


def _bytes(values: pd.Series) -> np.ndarray:
    """The rows with the bracket behind each that the source took away."""
    return np.frombuffer(b"}".join([*values, b""]), np.uint8)


def _summaries(raw: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, size, n_bytes, quotes, delta = None, 0, 0, 0, [0, 0]
        row = lambda: pd.DataFrame([{"path": now[0], "split": now[1], "size": size, "bytes": n_bytes, "toggles": quotes % 2, "d0": delta[0], "d1": delta[1]}])
        for batch in batches:
            for split, part in _runs(batch):
                if split != now:
                    if now is not None:
                        yield row()
                    now, size, n_bytes, quotes, delta = split, int(part["size"].iloc[0]), 0, 0, [0, 0]
                data = _bytes(part["value"])
                _, code, even, n = structure(data, key)
                # A split that begins inside a string sees the brackets behind an odd number of quotes.
                for side in (0, 1):
                    delta[side] += int(STEP[code[even == ((quotes + side) % 2 == 0)]].sum())
                n_bytes, quotes = n_bytes + len(data), quotes + n
        if now is not None:
            yield row()

    return raw.mapInPandas(run, SUMMARY)


def _begun(summary: DataFrame) -> DataFrame:
    """Whether each split begins inside a string, and how deep."""
    before = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("long"))
    d = summary.withColumn("inside", sofar("toggles") % 2 == 1)
    d = d.withColumn("delta", F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0"))).drop("d0", "d1")
    return d.withColumn("depth", sofar("delta"))


def _turns(raw: DataFrame, key: bytes) -> DataFrame:
    """For each split its objects at the document's depth (``roots``), and what happens at that of the wanted array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, depth, inside, codes = None, 0, False, []

        def row() -> pd.DataFrame:
            root, array = levels(np.concatenate(codes), (-depth, 2 - depth))[1]
            return pd.DataFrame([{"path": now[0], "split": now[1], "roots": root["opens"], **array}]).drop(columns="level")

        for batch in batches:
            for split, part in _runs(batch):
                if split != now:
                    if now is not None:
                        yield row()
                    now, depth, inside, codes = split, int(part["depth"].iloc[0]), bool(part["inside"].iloc[0]), []
                _, code, even, quotes = structure(_bytes(part["value"]), key)
                codes.append(code[even != inside])
                inside = bool((quotes + inside) % 2)
        if now is not None:
            yield row()

    return raw.mapInPandas(run, f"path string, split long, roots long, {LEVEL}")


def _placed(begun: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Beginnings of splits (``inside``, ``depth``, ``target``, ``n``) and one row for each document."""
    before = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    at = turns.select("path", "split", "roots", F.struct("opens", "before", "event", "since", F.col("inside").alias("held"), "wanted").alias("at"))
    d = begun.join(at, ["path", "split"])
    d = d.withColumn("above", F.coalesce(F.sum("at.before").over(before), F.lit(0).cast("long")))
    turn = F.when(F.col("at.event") >= 0, F.struct(F.col("at.event").alias("event"), (F.col("at.since") - F.col("above") - F.col("at.before")).alias("n")))
    d = d.withColumn("turn", turn).withColumn("last", F.last("turn", True).over(before))
    d = d.withColumn("target", F.coalesce(F.col("last.event") == 1, F.lit(False)))
    d = d.withColumn("n", F.when(F.col("target"), F.col("last.n") + F.col("above")).otherwise(F.lit(0).cast("long")))
    count = F.col("at.held") + F.when(F.col("target"), F.col("at.before")).otherwise(F.lit(0).cast("long"))
    documents = d.groupBy("path").agg(
        F.sum(count).alias("records"),
        F.sum("at.wanted").alias("arrays"),
        F.sum("roots").alias("roots"),
        (F.sum("toggles") % 2).alias("open_string"),
        F.sum("delta").alias("depth"),
        F.sum("bytes").alias("bytes"),
        F.max("size").alias("size"),
    )
    # The source takes no bracket from the last row of a file that ends otherwise, and may skip a mark of byte order.
    ended = (F.col("bytes") == F.col("size")) | (F.col("bytes") == F.col("size") - 3)
    whole = (F.col("open_string") == 0) & (F.col("depth") == F.when(ended, 0).otherwise(-1)) & (F.col("roots") == 1)
    documents = documents.withColumn("reason", reason((~whole, "unreadable document"), (F.col("arrays") == 0, "no array"), (F.col("arrays") > 1, "repeated array")))
    return d.select("path", "split", "inside", "depth", "target", "n"), documents.select("path", "records", "reason")


def cut(data: np.ndarray, key: bytes, inside: bool, depth: int, target: bool, n: int):
    """Records in one stretch of a file: their numbers, and where each begins and ends (-1: before or behind the stretch); and the state behind it."""
    place, code, even, quotes = structure(data, key)
    outside = even != inside
    place, code = place[outside], code[outside]
    after = depth + np.cumsum(STEP[code])
    start = after - STEP[code]
    turns = np.flatnonzero((code <= WANTED) & (start == 1) | (code >= END_OBJECT) & (start == 2))
    opens, closes = np.flatnonzero((code == OBJECT) & (start == 2)), np.flatnonzero((code == END_OBJECT) & (start == 3))
    # Which of the arrays that come and go at depth two an object lies in: 0 is the one that was open before.
    array = np.searchsorted(turns, opens)
    wanted = np.concatenate([[target], code[turns] == WANTED])
    held = np.bincount(array, minlength=len(wanted))
    number = np.arange(len(opens)) - np.repeat(np.cumsum(held) - held, held) + np.where(array == 0, n, 0)
    take = wanted[array]
    close_array = np.searchsorted(turns, closes)
    begin, stop, number = place[opens[take]], place[closes[wanted[close_array]]] + 1, number[take]
    if target and depth > 2:  # a record was open before
        begin, number = np.concatenate([[-1], begin]), np.concatenate([[n - 1], number])
    if len(stop) < len(begin):
        stop = np.concatenate([stop, [-1]])
    last = int(after[-1]) if len(after) else depth
    count = int(held[-1]) + (n if len(wanted) == 1 else 0)
    return number, begin, stop, (bool((quotes + inside) % 2), last, bool(wanted[-1]), count)


def _pieces(raw: DataFrame, key: bytes) -> DataFrame:
    """``path``, ``n``, ``split``, ``whole`` and ``value``: records, and the parts of those that reach over an edge of their split."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, rest = None, None, []
        columns = ["path", "n", "split", "whole", "value"]

        def tail() -> pd.DataFrame:
            # A record that is open at the end of its split; ``rest`` tells whether it also began there.
            return pd.DataFrame([(now[0], state[3] - 1, now[1], False, b"".join(rest[1:]).decode("utf-8", "replace"))] if rest else [], columns=columns)

        for batch in batches:
            out = []
            for split, part in _runs(batch):
                if split != now:
                    if rest:
                        out.append(tail())
                    first = part.iloc[0]
                    now, state = split, (bool(first["inside"]), int(first["depth"]), bool(first["target"]), int(first["n"]))
                    # The part of a record that is held over from the last batch; its first item is whether the record began in this split.
                    rest = [False] if state[2] and state[1] > 2 else []
                data = _bytes(part["value"])
                number, begin, stop, state = cut(data, key, *state)
                text = data.tobytes()
                rows = []
                for n, a, b in zip(number.tolist(), begin.tolist(), stop.tolist()):
                    if a >= 0:
                        rest = [True]
                    rest.append(text[max(a, 0) : b if b >= 0 else len(text)])
                    if b >= 0:
                        rows.append((split[0], n, split[1], rest[0], b"".join(rest[1:]).decode("utf-8", "replace")))
                        rest = []
                out.append(pd.DataFrame(rows, columns=columns))
            yield pd.concat(out) if out else pd.DataFrame([], columns=columns)
        if rest:
            yield tail()

    return raw.mapInPandas(run, "path string, n long, split long, whole boolean, value string")


def read_json_records(
    spark: SparkSession, paths: str | Sequence[str], key: str, *, glob: str | None = None, judge: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(records, documents)``: ``path, n, value`` for each object of the array ``key`` of every document, and ``path, records, reason`` for the documents.

    ``n`` is the position in the array.  A document that is not one balanced object, lacks the array or has it twice has a ``reason`` and no records; ``judge``
    may give further documents one.  The key is matched as it is written, at the top level.  What lies in a record is for its parser to check; array items that
    are no objects are passed over.  An empty file is no document.  No row is longer than one record and the text up to the next ``}``.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "}")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(list(paths) if not isinstance(paths, str) else paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value")
    )
    name = key.encode()
    numbered = raw.drop("size").withColumn("__id", F.monotonically_increasing_id())
    # One short row a split: Spark broadcasts them by measured size, else both sides are dealt out by split.
    at = lambda splits: numbered.join(splits, ["path", "split"]).sortWithinPartitions("path", "split", "__id").drop("__id")
    begun = materialise(_begun(_summaries(raw, name)))
    starts, documents = _placed(begun, materialise(_turns(at(begun.select("path", "split", "inside", "depth")), name)))
    documents = materialise(judge(documents) if judge else documents)
    starts = starts.join(documents.where("reason is null").select("path"), "path", "left_semi")
    pieces = materialise(_pieces(at(starts), name))
    edges = pieces.where("not whole").groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("split", "value"))).alias("parts"))
    edges = edges.select("path", "n", F.array_join(F.transform("parts", lambda x: x["value"]), "").alias("value"))
    return pieces.where("whole").select("path", "n", "value").unionByName(edges), documents
