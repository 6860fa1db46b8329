"""Token counts by a separator scan of flat token files.

The files hold nothing but little-endian 16-bit token ids, an end-of-document id after every document, and no index. They are read
in blocks of fixed size. Each block finds its separators in one vectorised search and reports the documents that end in
it, with what lies before its first and after its last separator; a prefix scan over the blocks of a file carries
the open document and the document number across block borders.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlake.llm.common import attempt_name, open_store, small_batches, written
from voltlake.session import scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
EOD = 50256
BLOCK = 4 << 20  # bytes
SIDE = "file string, ordinal long, doc_id long"
_ENCODERS: dict = {}


def encoder(ranks: dict, name: str):
    """The tokenizer of these ranks, kept by the process."""
    import tiktoken

    if name not in _ENCODERS:
        _ENCODERS[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write one flat file a task and return (file, ordinal, doc_id), which the scan does not use. A null text has no tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared = spark.sparkContext.broadcast(ranks)  # a vocabulary of below 2^16 entries

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, (store, base) = encoder(shared.value, tokenizer), open_store(folder)
        store.create_dir(base, recursive=True)
        name, out, at = attempt_name("tokens", ".bin"), None, 0
        for rows in batches:
            if out is None:
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            for text in rows.column("text").to_pylist():
                ids = enc.encode_ordinary(text or "")
                ids.append(EOD)
                out.write(np.array(ids, dtype="<u2").tobytes())
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n)), rows.column("doc_id")], ["file", "ordinal", "doc_id"])
            at += n
        if out is not None:
            out.close()

    return written(docs.select("doc_id", "text").mapInArrow(run, SIDE), "token-side")


def blocks(spark: SparkSession, folder: str, names: DataFrame, block: int) -> DataFrame:
    """(file, block, start, size): the blocks of the files, which are sized where they lie."""

    def sizes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, base = open_store(folder)
        for rows in batches:
            own = rows.column("file").to_pylist()
            info = [i.size for i in store.get_file_info([f"{base}/{n}" for n in own])]
            yield pa.RecordBatch.from_arrays([rows.column("file"), pa.array(info, pa.int64())], ["file", "bytes"])

    sized = names.mapInArrow(sizes, "file string, bytes long").filter("bytes > 0")
    every = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"cast((bytes - 1) div {block} as int)"))))
    start = F.col("block").cast("long") * block
    return every.select("file", "block", start.alias("start"), F.least(F.lit(block), F.col("bytes") - start).alias("size"))


def scan(spark: SparkSession, folder: str, names: DataFrame, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the files named; tokens after the last separator are a last document."""
    if block % 2:
        raise ValueError("a block must hold whole ids")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, base = open_store(folder)
        for rows in batches:
            for name, k, start, size in zip(*(rows.column(c).to_pylist() for c in ("file", "block", "start", "size")), strict=True):
                with store.open_input_file(f"{base}/{name}") as f:
                    f.seek(start)
                    ids = np.frombuffer(f.read(size), dtype="<u2")
                ends = np.flatnonzero(ids == eod)
                length = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([k], pa.int32()), pa.array([length.tolist()], pa.list_(pa.int64())), pa.array([tail], pa.int64())], ["file", "block", "lengths", "tail"])

    raw = blocks(spark, folder, names, block)
    found = written(raw.repartition(F.col("file"), F.col("block")).mapInArrow(run, "file string, block int, lengths array<long>, tail long"), "token-scan")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.size("lengths").cast("long")
    # tokens open at the end of a block: its tail, and while no separator comes, the tails before
    light = found.select("file", "block", ends.alias("ends"), "tail")
    group = F.coalesce(F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    light = light.withColumn("run", group)
    open_ = F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    light = light.withColumn("open", open_)
    at = Window.partitionBy("file").orderBy("block")
    light = light.select("file", "block", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("base"), F.coalesce(F.lag("open").over(at), F.lit(0)).alias("carry"),
                         "open", "ends", F.lead("block").over(at).isNull().alias("last"))
    docs = found.select("file", "block", F.posexplode("lengths").alias("k", "length")).join(light.select("file", "block", "base", "carry"), ["file", "block"])
    docs = docs.select("file", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("length") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))
    rest = light.filter("last and open > 0").select("file", (F.col("base") + F.col("ends")).alias("ordinal"), F.col("open").alias("n_tokens"))
    return docs.union(rest)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of every row: its tokens are written to flat files and counted there. Repeated rows count each."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    side = write_tokens(docs, folder, tokenizer)
    counted = scan(spark, folder, side.select("file").distinct(), block=block)
    return side.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
