"""Token counts from flat, unindexed token files by a separator scan.

`write_tokens` makes such files: a task's documents one after the other, each as little-endian
unsigned 16- or 32-bit identifiers and an end-of-document identifier. There is no index.

`scan` cuts every file into blocks of `block_tokens`, searches each block for the separator with one
vectorised comparison, and stitches documents across block borders with a prefix scan: a block's
first document begins where the last separator before the block was, and its number is the
separators before the block. The scan has two levels (groups of `GROUP` blocks, then the groups), so
the largest file's blocks don't go through one task with their positions; a document may span any number of blocks.

Defined results: an empty document has 0 tokens; tokens after a file's last separator are a document
that isn't terminated; a file of no tokens has no documents. Null text counts as empty. Identifiers equal
to the separator can't be written (the tokenizer must leave one free). Repeated rows are documents
of their own. Empty table: no files and no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import scratch_path, table, written
from larkspur.llm.shared_files import make, opened, publish, read_range

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EOD = 50256
GROUP = 512
#: Fixed value: the pattern that splits text before byte-pair merging, as published with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, eod: int = EOD, width: int = 2) -> DataFrame:
    """Writes a flat file for each task into `folder`. Returns what the files themselves don't say: (doc_id, file, ordinal)."""
    make(folder)
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, fixed in size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        name = f"tokens-{TaskContext.get().partitionId():08d}.bin"
        encode, at = encoder(ranks.value).encode_ordinary, 0
        first = next(batches, None)
        if first is None:
            return
        with publish(folder, name) as out:
            while first is not None:
                for t in first.column(1):
                    ids = encode(t.as_py() or "")
                    ids.append(eod)
                    out.write(np.array(ids, dtype=f"<u{width}").tobytes())
                n = first.num_rows
                yield pa.record_batch([first.column(0), pa.array([name] * n, pa.string()), pa.array(range(at, at + n), pa.int64())], names=["doc_id", "file", "ordinal"])
                at, first = at + n, next(batches, None)

    return written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, file string, ordinal long"), "manifest")


def files(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """(file, tokens) of the token files in a folder: one row a file, listed by the driver."""
    from pyarrow import fs

    store, path = opened(folder)
    found = [(i.base_name, i.size // width) for i in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.is_file and not i.base_name.startswith(("_", "."))]
    return spark.createDataFrame(sorted(found), "file string, tokens long")


def scan(spark: SparkSession, folder: str, eod: int = EOD, width: int = 2, block_tokens: int = 1 << 20) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) for every document of the folder's token files."""
    cut = files(spark, folder, width).filter("tokens > 0")
    size = F.lit(block_tokens)
    blocks = cut.select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("tokens") / size) - 1)).alias("block"))

    def search(batches):
        store, root = opened(folder)
        for batch in batches:
            name, tokens, block = (batch.column(i).to_pylist() for i in range(3))
            ends = []
            for f, n, k in zip(name, tokens, block, strict=True):
                lo = k * block_tokens
                ids = np.frombuffer(read_range(store, f"{root}/{f}", lo * width, min(block_tokens, n - lo) * width), dtype=f"<u{width}")
                ends.append(np.flatnonzero(ids == eod).astype(np.int64) + lo)
            last = [int(e[-1]) if len(e) else None for e in ends]
            yield pa.record_batch([*batch.columns, pa.array(ends, pa.list_(pa.int64())), pa.array(last, pa.int64()), pa.array(list(map(len, ends)), pa.int64())], names=["file", "tokens", "block", "ends", "last", "n"])

    # few large reads a task: blocks are spread before they are read, since their list is one small table
    spread = blocks.repartition(max(1, min(4096, blocks.count() // 4 + 1)), "file", "block")
    found = written(spread.mapInArrow(search, "file string, tokens long, block long, ends array<bigint>, last long, n long"), "separators")

    # prefix scan: within groups of blocks, then over the groups
    heads = found.select("file", "block", "last", "n", F.floor(F.col("block") / GROUP).alias("group"))
    before = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = heads.select("file", "block", "group", F.max("last").over(before).alias("in_last"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("in_n"))
    groups = heads.groupBy("file", "group").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    earlier = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    outer = groups.select("file", "group", F.max("last").over(earlier).alias("out_last"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("out_n"))
    carry = inner.join(outer, ["file", "group"]).select("file", "block", F.coalesce("in_last", "out_last", F.lit(-1)).alias("open"), (F.col("in_n") + F.col("out_n")).alias("base"))

    whole = found.join(carry, ["file", "block"])
    closed = whole.select("file", "base", "open", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("base") + F.col("i")).alias("ordinal"),
        (F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("ends")[F.col("i") - 1]) + 1).alias("start"), "end", F.lit(True).alias("terminated"),
    )
    final = whole.filter((F.col("block") + 1) * size >= F.col("tokens")).select("file", (F.col("base") + F.col("n")).alias("ordinal"), (F.coalesce("last", "open") + 1).alias("start"), F.col("tokens").alias("end"), F.lit(False).alias("terminated"))
    return closed.unionAll(final.filter("start < end")).select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "terminated")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return scan(spark, folder).join(manifest, ["file", "ordinal"], "left").select("doc_id", "n_tokens", "file", "ordinal", "start", "terminated")
