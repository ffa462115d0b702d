"""Exact top-k by inner product with a three-phase uniform threshold.

The components are cut into ``lists`` slices; a row's partial products over one slice are one score list.  Phase one gathers each
list's best entries, whose exact scores give every query a score that its k-th best cannot fall below.  A row that reaches
this score reaches an equal share of it in some list, so phase two collects the entries above the share, and phase three
resolves what they lack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reeltally.llm.registry import query, table
from reeltally.plans.session import materialise

QUERY_BLOCK, ROW_BLOCK, LISTS = 512, 4096, 2
EXACT = 2.0**53


def matrix(packed: pd.Series, width: int) -> np.ndarray:
    """Rows of 64-bit integers; shorter ones end in zeros."""
    out = np.zeros((len(packed), width), np.int64)
    for i, data in enumerate(packed):
        row = np.frombuffer(data, "<i8")
        out[i, : len(row)] = row
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integers: in floating point, which is quicker, where no sum can leave its range."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype("f8") @ b.T.astype("f8")).astype(np.int64)
    return a @ b.T


def slices(width: int, lists: int) -> list[slice]:
    edges = [width * i // lists for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def packed(rows: DataFrame) -> DataFrame:
    """``vec`` (array of long) as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["vec"] = [np.asarray(v, "<i8").tobytes() for v in batch["vec"]]
            yield batch

    return rows.mapInPandas(run, "id long, vec binary")


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int, *, lists: int = LISTS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """The ``k`` rows of highest inner product for every query, never the query's own id; ties go to the smaller id.

    Both frames have ``id`` (long) and ``vec`` (array of long; shorter vectors end in zeros; products stay below 2**63).
    Returns ``query_id``, ``rank`` (from 1), ``id``, ``score``.  Rows with a null id or vector take no part; nor may a vector
    hold nulls.  Repeated ids count once for each different vector.  Without rows or queries there is no result.

    Equal vectors are searched once: with their k + 1 smallest ids they stand for any number of copies.  Queries and rows
    meet in blocks of ``query_block`` by ``row_block`` vectors, each pair of blocks in a task of its own.
    """
    whole = "id is not null and vec is not null"
    rows, queries = packed(rows.select("id", "vec").where(whole)), packed(queries.select("id", "vec").where(whole))
    most = k + 1
    order = W.partitionBy("vec").orderBy("id")
    copies = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    copies = copies.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    texts = materialise(copies.select(F.col("ids")[0].alias("row"), "vec", "ids"))
    asked = materialise(queries.groupBy("vec").agg(F.min("id").alias("query")))
    row_blocks, query_blocks = -(-texts.count() // row_block), -(-asked.count() // query_block)

    def spread(df: DataFrame, id_col: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(max(n_own, 1))))
        return df.withColumn(other, F.explode(F.expr(f"sequence(0L, {max(n_other, 1) - 1}L)")))

    def cells(ask: DataFrame):
        left = spread(ask, "query", "qb", query_blocks, "rb", row_blocks).groupBy("qb", "rb")
        return left.cogroup(spread(texts.select("row", "vec"), "row", "rb", row_blocks, "qb", query_blocks).groupBy("qb", "rb"))

    def both(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        b = b.sort_values("row")
        width = max(max(map(len, a["vec"]), default=0), max(map(len, b["vec"]), default=0)) // 8
        return a["query"].to_numpy(), b["row"].to_numpy(), matrix(a["vec"], width), matrix(b["vec"], width)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Phase one: the best entries of each list, with their whole scores."""
        out = []
        if len(a) and len(b):
            q, r, x, y = both(a, b)
            for part in slices(x.shape[1], lists):
                scores = product(x[:, part], y[:, part])
                n = min(most, len(r))
                at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                whole = np.einsum("qd,qnd->qn", x, y[at]) if n else at
                out.append(pd.DataFrame({"query": np.repeat(q, n), "row": r[at].ravel(), "score": whole.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "row": [], "score": []})

    first = cells(asked).applyInPandas(best, "query long, row long, score long").distinct()
    place = W.partitionBy("query").orderBy(F.desc("score"), "row")
    floor = first.withColumn("n", F.row_number().over(place)).where(F.col("n") <= most)
    floor = floor.groupBy("query").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    floor = floor.select("query", F.when(F.col("n") == most, F.col("low")).alias("low"))
    cut = materialise(asked.join(floor, "query", "left"))

    def enough(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Phase two: of each list, the entries that reach an equal share of the query's cutoff."""
        out = []
        if len(a) and len(b):
            q, r, x, y = both(a, b)
            low = a["low"].to_numpy(dtype="f8", na_value=-np.inf)[:, None]
            for j, part in enumerate(slices(x.shape[1], lists)):
                scores = product(x[:, part], y[:, part])
                i, at = np.nonzero(scores >= np.floor(low / lists))
                out.append(pd.DataFrame({"query": q[i], "row": r[at], "list": np.full(len(i), j), "score": scores[i, at]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "row": [], "list": [], "score": []})

    entries = cells(cut).applyInPandas(enough, "query long, row long, list long, score long")
    seen = F.sum(F.expr("shiftleft(1L, cast(list as int))")).alias("seen")
    known = entries.groupBy("query", "row").agg(F.sum("score").alias("sum"), seen, F.count(F.lit(1)).alias("n"))
    # Phase three: what no sum of shares can lift to the cutoff goes; the lists not seen are read for the rest.
    known = known.join(cut.select("query", "low"), "query")
    # Written, as both the complete and the lacking sums read it.
    known = materialise(known.where("low is null or sum + (%d - n) * (low / %d) >= low" % (lists, lists)).drop("low"))
    complete = known.where(F.col("n") == lists).select("query", "row", F.col("sum").alias("score"))
    lacking = known.where(F.col("n") < lists).join(cut.select("query", F.col("vec").alias("q_vec")), "query").join(texts.select("row", "vec"), "row").select("query", "row", "sum", "seen", "q_vec", "vec")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            width = max(max(map(len, batch["vec"]), default=0), max(map(len, batch["q_vec"]), default=0)) // 8
            x, y = matrix(batch["q_vec"], width), matrix(batch["vec"], width)
            score, seen = batch["sum"].to_numpy(), batch["seen"].to_numpy()
            for j, part in enumerate(slices(width, lists)):
                score = score + np.where(seen >> j & 1, 0, np.einsum("nd,nd->n", x[:, part], y[:, part]))
            yield pd.DataFrame({"query": batch["query"], "row": batch["row"], "score": score})

    total = complete.unionByName(lacking.mapInPandas(resolve, "query long, row long, score long"))
    total = total.withColumn("n", F.row_number().over(place)).where(F.col("n") <= most).select("query", "row", "score")
    # Back from vectors to ids: of the rows' copies, then of the queries'.
    total = total.join(texts.select("row", "ids"), "row").select("query", F.explode("ids").alias("id"), "score")
    ranked = queries.distinct().join(asked, "vec").select("query", F.col("id").alias("query_id")).join(total, "query").where("id <> query_id")
    ranked = ranked.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return ranked.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


@query(
    "op2_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, cast(list_dot_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    ), r AS (
        SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & sound)
    rows = rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec"))
    out = exact_top_k(rows, rows.where("id % 50 = 0"), 5)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
