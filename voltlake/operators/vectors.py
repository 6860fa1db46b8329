"""Vector search at scale: an inverted-list index that is written once, searched in blocks.

Centroids are fitted on a bounded sample; every distinct vector goes to the list of its nearest centroid. A list is cut into blocks of at most about
BLOCK vectors, so that a frequent region of space is many blocks. A query visits the ``probes`` lists whose centroids are nearest to it (all lists in the exact mode);
each visit is a matrix product of a chunk of queries and a block, which returns its best rows, and these are merged.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE = 20_000  # vectors that centroids are fitted on
MAX_LISTS = 16_384
BLOCK = 4096
CHUNK = 1024
COPIES = 100  # ids kept of equal vectors; a search can return no more of them


def _matrix(column):
    import numpy as np

    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(flat), -1)


def _sample(vectors: DataFrame, vec_id: str, vector: str):
    """At most SAMPLE vectors, those with the smallest hashes of their ids."""
    few = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(vec_id), vec_id).limit(SAMPLE).select(vector).toArrow()
    return _matrix(few.column(0)) if few.num_rows else None


def fit_centroids(vectors: DataFrame, vec_id: str, vector: str, lists: int | None = None, rounds: int = 6):
    """Unit centroids by k-means on a sample; sqrt(n) lists for n vectors unless given."""
    import numpy as np

    x = _sample(vectors, vec_id, vector)
    if x is None:
        return np.zeros((1, 0), dtype=np.float32)
    want = lists or math.ceil(math.sqrt(vectors.count()))
    c = x[np.linspace(0, len(x) - 1, max(1, min(want, MAX_LISTS, len(x)))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[k: k + 4096] @ c.T, axis=1) for k in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c).astype(np.float32)
    return c


def probes_for(vectors: DataFrame, vec_id: str, vector: str, centroids, k: int = 10, recall: float = 0.95, queries: int = 512) -> int:
    """The number of lists to visit so that ``recall`` of the k best of the sample are found, measured with some of its vectors as queries."""
    import numpy as np

    x = _sample(vectors, vec_id, vector)
    if x is None:
        return 1
    own = np.concatenate([np.argmax(x[i: i + 4096] @ centroids.T, axis=1) for i in range(0, len(x), 4096)])
    needed = []
    for i in range(0, min(queries, len(x)), 64):
        q = x[i: min(i + 64, queries)]
        order = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)  # of each list its place in the query's order
        best = np.argsort(-(q @ x.T), axis=1)[:, : min(k, len(x))]
        needed.append(np.take_along_axis(order, own[best], axis=1).ravel() + 1)
    return max(1, int(np.quantile(np.concatenate(needed), recall, method="inverted_cdf")))


def _assigned(rows: DataFrame, key: str, vector: str, centroids, probes: int) -> DataFrame:
    """Rows (key, vector, list) with the ``probes`` nearest lists of each row."""
    probes = max(1, min(probes, len(centroids)))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            near = _matrix(b.column(vector)) @ centroids.T
            top = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < near.shape[1] else np.tile(np.arange(near.shape[1]), (b.num_rows, 1))
            at = pa.array(np.repeat(np.arange(b.num_rows), probes))
            yield pa.RecordBatch.from_arrays([b.column(key).take(at), b.column(vector).take(at), pa.array(top.ravel().astype(np.int32))], [key, vector, "list"])

    return rows.select(key, vector).mapInArrow(run, f"`{key}` {kind}, `{vector}` array<float>, list int")


def write_index(vectors: DataFrame, vec_id: str, vector: str, centroids, path: str) -> DataFrame:
    """The index as a table (list, block, ids, vector): every distinct vector once, with the smallest ids that have it. Null vectors are left out."""
    spark = vectors.sparkSession
    place = F.row_number().over(W.partitionBy(vector).orderBy(vec_id))
    few = vectors.where(F.col(vector).isNotNull() & F.col(vec_id).isNotNull()).withColumn("_r", place).where(F.col("_r") <= COPIES)  # limited before the shuffle too
    own = few.groupBy(vector).agg(F.array_sort(F.collect_list(vec_id)).alias("ids")).withColumn("first", F.col("ids")[0])
    listed = f"{path}-listed"
    _assigned(own, "first", vector, centroids, 1).withColumnRenamed("first", "f").join(own.select("first", "ids"), F.col("f") == F.col("first")).select("ids", vector, "list").write.parquet(listed)
    rows = spark.read.parquet(listed)
    blocks = rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))  # one row a list
    cut = rows.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0]), "n_blocks").cast("int"))
    cut.select("list", "block", "n_blocks", "ids", vector).repartitionByRange("list", "block").sortWithinPartitions("list", "block").write.parquet(path)
    return spark.read.parquet(path)


def search(queries: DataFrame, query_id: str, vector: str, index: DataFrame, centroids, k: int = 10, probes: int | None = 16) -> DataFrame:
    """(query_id, vec_id, score, rank) of the ``k`` vectors most similar to each query, scores to five places, ties by id. ``probes`` None visits every list."""
    kind = queries.schema[query_id].dataType.simpleString()
    if k > COPIES or query_id == "vec_id":
        raise ValueError(f"k is at most {COPIES}, and the ids of the queries need a name of their own")
    lists = index.groupBy("list").agg(F.max("n_blocks").alias("n_blocks"))  # one row a list, at most MAX_LISTS
    asked = _assigned(queries.where(F.col(vector).isNotNull()), query_id, vector, centroids, probes or len(centroids)).join(F.broadcast(lists), "list")
    chunks = asked.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n_chunks"))
    asked = asked.join(F.broadcast(chunks), "list").withColumn("chunk", F.pmod(F.xxhash64(query_id), "n_chunks").cast("int"))
    asked = asked.select(query_id, vector, "list", "chunk", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    held = index.join(F.broadcast(chunks), "list").select("list", "block", "ids", F.col(vector).alias("_v"), F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))

    def best(q, x):
        import numpy as np
        import pyarrow as pa

        names = [query_id, "vec_id", "score"]
        if not q.num_rows or not x.num_rows:
            return pa.table({n: [] for n in names}, schema=pa.schema([(query_id, q.schema.field(query_id).type), ("vec_id", pa.int64()), ("score", pa.float64())]))
        ids = x.column("ids").to_pylist()
        near = np.round(_matrix(q.column(vector)).astype(np.float64) @ _matrix(x.column("_v")).astype(np.float64).T, 5)
        out = []
        cut = min(k, near.shape[1])
        for row, scores in enumerate(near):
            least = np.partition(scores, len(scores) - cut)[len(scores) - cut]
            found = sorted((-scores[j], i) for j in np.flatnonzero(scores >= least) for i in ids[j][:k])[:k]
            out += [(row, i, -s) for s, i in found]
        rows, vec, score = zip(*out, strict=True)
        return pa.table([q.column(query_id).take(pa.array(rows)), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names=names)

    by = ["list", "block", "chunk"]
    met = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(best, f"`{query_id}` {kind}, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)
