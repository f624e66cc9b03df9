"""Filling fixed-capacity containers with items (problem 6): hierarchical residual packing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, materialize, table
from .packing import best_fit
from .tokens import DEFAULT_VOCABULARY, counter

NEARLY_FULL = 0.98  # fill at which a container is done
CHUNK = 200_000  # items that are packed together in a task; more are packed chunk by chunk
FAN_IN = 8  # partitions that merge into one in each round
OPEN = 32  # of the containers over half full, how many a task hands on for the rest of others
LIMITS = 1000  # container sizes that are packed at once
_CONTENT = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece_no", T.IntegerType()), T.StructField("n_tokens", T.IntegerType())]))
_BINS = T.StructType([T.StructField("limit_name", T.StringType()), T.StructField("fill", T.IntegerType()), T.StructField("done", T.BooleanType()), T.StructField("contents", _CONTENT)])


def _batches(rows: list[tuple], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 20_000):
        columns = list(zip(*rows[a : a + 20_000]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _pack(limit: str, capacity: int, items: list[tuple[int, list]], last: bool = False) -> list[tuple]:
    """Containers of one task.  After best fit no two of them fit together, so one at most is half empty; that one
    and the OPEN emptiest of the others go on to the next round, whatever the sizes, and all else is done."""
    bins = sorted(best_fit([x for x in items if x[0]], capacity), key=lambda b: b[0])
    empty = [c for n, contents in items if not n for c in contents]
    if empty and not bins:
        bins = [(0, [])]
    for i, c in enumerate(empty):  # texts without tokens take no space: evenly over the containers
        bins[-1 - i % len(bins)][1].append(c)
    open_ = 0 if last else OPEN + sum(2 * fill <= capacity for fill, _ in bins)
    return [(limit, fill, i >= open_ or fill >= NEARLY_FULL * capacity, contents) for i, (fill, contents) in enumerate(bins)]


def token_counts(documents: DataFrame, vocabulary: str, key: str, text: str) -> DataFrame:
    """key, n: tokens of each text, zero for null and empty ones; of a key that comes twice the longer text counts.

    The vocabulary's file is read here and sent to the workers (about a MB), which need not have it.
    """
    with open(vocabulary, "rb") as f:
        data = documents.sparkSession.sparkContext.broadcast(f.read())

    def make():
        count = counter(data.value)
        return lambda c: {"k": c["k"], "n": [count(t) for t in c[text]]}

    rows = map_rows(documents.select(F.col(key).cast("bigint").alias("k"), text), make, "k bigint, n int")
    return rows.where("k is not null").groupBy("k").agg(F.max("n").alias("n"))


def first_round(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Pieces of texts above a capacity, and best-fit packing inside each partition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[tuple[int, list]]] = {k: [] for k in limits}
        full: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(full)
            full.clear()
            for limit, items in waiting.items():
                rows += _pack(limit, limits[limit], items)
                items.clear()
            yield from _batches(rows, arrow)

        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for limit, capacity in limits.items():
                    pieces, rest = divmod(n, capacity)
                    for p in range(pieces):
                        full.append((limit, capacity, True, [(k, p, capacity)]))
                    if rest or not pieces:
                        waiting[limit].append((rest, [(k, pieces, rest)]))
                if len(full) + sum(map(len, waiting.values())) > CHUNK:
                    yield from flush()
        yield from flush()

    return counts.mapInArrow(run, _BINS)


def next_round(bins: DataFrame, limits: dict[str, int], last: bool) -> DataFrame:
    """Underfull containers as items, packed again inside each partition; in the last round all are done."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[tuple[int, list]]] = {k: [] for k in limits}

        def flush() -> Iterator[pa.RecordBatch]:
            for limit, items in waiting.items():
                yield from _batches(_pack(limit, limits[limit], items, last), arrow)
                items.clear()

        for batch in batches:
            for limit, fill, contents in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                waiting[limit].append((fill, [(c["doc_id"], c["piece_no"], c["n_tokens"]) for c in contents]))
            if sum(map(len, waiting.values())) > CHUNK:
                yield from flush()
        yield from flush()

    return bins.select("limit_name", "fill", "contents").mapInArrow(run, _BINS)


def pack(documents: DataFrame, limits: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Container of each text or piece: limit_name, container_id, key, piece_no, n_tokens, fill.

    A text above the capacity is split into pieces of the capacity and a rest; no other text is split.
    Partitions best-fit locally and emit all containers but the emptiest, OPEN and one of each limit; those are
    merged FAN_IN partitions at a time and packed again as items, until one partition is left.  So no task of a
    later round reads more than FAN_IN * (OPEN + 1) containers of each limit (for each CHUNK of its items), whatever
    the sizes of the texts.  Null and empty texts have no tokens and ride in some container; rows without a key,
    and limits that are null or below one, are left out; more than LIMITS limits are an error.  Which texts share
    a container depends on the partitions, that each text is in one does not.
    """
    rows = limits.where((F.col("capacity_tokens") > 0) & F.col("limit_name").isNotNull()).select("limit_name", "capacity_tokens").distinct().limit(LIMITS + 1).collect()
    if len(rows) > LIMITS:
        raise ValueError(f"more than {LIMITS} container sizes")
    by = {r[0]: r[1] for r in sorted(rows)}
    bins = materialize(first_round(token_counts(documents, vocabulary, key, text), by))
    done = bins.where("done")
    left = materialize(bins.where("not done"))  # few rows; the done ones are not read again
    n = left.rdd.getNumPartitions()
    while True:
        n = max(1, -(-n // FAN_IN))
        bins = materialize(next_round(left.coalesce(n), by, n == 1))
        done = done.unionByName(bins.where("done"))
        if n == 1:
            break
        left = bins.where("not done")
    first = F.array_min("contents")
    return done.select(
        "limit_name", F.concat_ws("-", "limit_name", first["doc_id"], first["piece_no"]).alias("container_id"), "fill", F.explode("contents").alias("c")
    ).select("limit_name", "container_id", F.col("c.doc_id").alias(key), "c.piece_no", "c.n_tokens", "fill")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of each text or piece for each limit."""
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and used share of their space for each limit."""
    limits = table(spark, sf_dir, "pack_limits")
    per = p6_containers(spark, sf_dir).groupBy("limit_name").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))
    return per.join(F.broadcast(limits.distinct()), "limit_name").withColumn("used", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 4))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing has to keep, for each limit: documents packed, pieces packed twice, overfull containers, texts split
    that would have fitted whole."""
    limits = table(spark, sf_dir, "pack_limits").distinct()
    c = materialize(p6_containers(spark, sf_dir))
    docs = c.groupBy("limit_name", "doc_id").agg(F.count("*").alias("pieces"), F.countDistinct("piece_no").alias("kinds"), F.sum("n_tokens").alias("n")).join(F.broadcast(limits), "limit_name")
    docs = docs.groupBy("limit_name").agg(
        F.count("*").alias("n_documents"), F.sum(F.col("pieces") - F.col("kinds")).alias("n_twice"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("n_torn")
    )
    bins = c.groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(limits), "limit_name")
    return docs.join(bins.groupBy("limit_name").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_overfull")), "limit_name")


SQL = {
    "p6_invariants": "SELECT limit_name, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, 0::BIGINT AS n_twice, 0::BIGINT AS n_torn, 0::BIGINT AS n_overfull FROM (SELECT DISTINCT limit_name FROM pack_limits WHERE capacity_tokens > 0)"
}
