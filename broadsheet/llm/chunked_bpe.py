"""Byte-level BPE (9) by overlapping chunks.

A long text is cut into chunks that overlap; each is pre-tokenised on its own, with its bounds in the two overlaps noted.
Matching runs forward only, so two scans that share a bound agree from there on: a chunk is stitched to the one before at
the first bound that both have. The pieces between such bounds are encoded one by one, and their ids and bytes put together
in order. If an overlap holds no common bound (one endless word, say), the piece goes on to the end of the text.

Null texts count as empty: no ids, the hash of the empty string. Long rows with the same id and text are encoded once and
given as often as they came. Other columns are ignored, an empty table gives no rows. Only texts of one chunk
skip the stitching: they are whole pieces already. A row's pieces meet on its one output row, which is about as long as
its text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import per_process, table

CHUNK = 16_384
OVERLAP = 512
#: A match that ends this near a chunk's end could go on behind it (the longest fixed alternative has three characters).
LOOK_AHEAD = 4
_PIECE = "n_tokens long, ids string, decoded binary"


def encoding(path: str, pattern: str):
    """The rank file's encoding, loaded once in each process."""
    def load():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return per_process(("encoding", path, pattern), load)


def _encoded(texts, path: str, pattern: str):
    import pyarrow as pa

    enc = encoding(path, pattern)
    counts, ids, decoded = [], [], []
    for t in texts:
        found = enc.encode_ordinary(t.as_py() or "")
        counts.append(len(found))
        ids.append(" ".join(map(str, found)))
        decoded.append(enc.decode_bytes(found))
    return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.binary())]


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, one space between) and decoded bytes of ``docs`` (doc_id, text)."""
    if not 0 < LOOK_AHEAD < overlap <= chunk // 2:
        raise ValueError("the overlap has to be longer than the look-ahead and at most half a chunk")
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    step = chunk - overlap
    one = F.length("text") <= chunk

    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_encoded(b.column(1), path, pattern)], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    short = docs.filter(one).mapInArrow(whole, f"doc_id {kind}, {_PIECE}")

    # The last chunk ends with the text; a chunk that the one before already covers isn't made.
    last = F.ceil((F.length("text") - chunk) / step).cast("int")
    chunks = docs.filter(~one).select(
        "doc_id", F.sha2("text", 256).alias("text_key"), last.alias("last"), F.posexplode(F.transform(
            F.sequence(F.lit(0), last), lambda k: F.substr("text", k * step + 1, F.lit(chunk)))).alias("k", "chunk"))
    bounds = "head array<int>, tail array<int>"
    given = f"doc_id {kind}, text_key string, last int, k int, chunk string"

    def pre_tokenise(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        scan = per_process(("pattern", pattern), lambda: regex.compile(pattern).finditer)
        for b in batches:
            heads, tails = [], []
            for text, is_last in zip(b.column(4), (a == z for a, z in zip(b.column(3).to_pylist(), b.column(2).to_pylist()))):
                text = text.as_py()
                ends = [0, *(m.end() for m in scan(text))]
                sure = [e for e in ends if e <= len(text) - LOOK_AHEAD]
                heads.append([e for e in sure if e < overlap])
                tails.append([] if is_last else [e - step for e in sure if e >= step])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                                             ["doc_id", "text_key", "last", "k", "chunk", "head", "tail"])

    row = ["doc_id", "text_key"]
    noted = chunks.mapInArrow(pre_tokenise, f"{given}, {bounds}").repartition(*row)
    # Equal rows give equal chunks: one of each goes on, with their number. All windows share one shuffle by row.
    same = Window.partitionBy(*row, "k")
    noted = noted.withColumn("copies", F.count("*").over(same)).withColumn("copy", F.row_number().over(same.orderBy("last")))
    noted = noted.filter("copy = 1").drop("copy")
    along = Window.partitionBy(*row).orderBy("k")
    # Chunk-relative position from which this chunk and the one before agree; null where they share no bound.
    met = F.array_min(F.array_intersect(F.lag("tail").over(along), "head"))
    stitched = noted.withColumn("met", F.when(F.col("k") == 0, 0).otherwise(met))
    # A chunk that never met the one before proves nothing about the next, so the rest of its row is one piece.
    astray = F.max(F.col("met").isNull()).over(along)
    stitched = stitched.withColumn("met", F.when(~astray, F.col("met")))
    stitched = stitched.withColumn("next_met", F.lead("met").over(along))
    begin = F.coalesce("met", F.lit(overlap))  # without a common bound the chunk before has covered the overlap
    end = F.when(F.col("k") == F.col("last"), F.length("chunk")).otherwise(step + F.coalesce("next_met", F.lit(overlap)))
    parts = stitched.select(*row, "k", "copies", F.substr("chunk", begin + 1, end - begin).alias("part"),
                            F.sum(F.col("met").isNotNull().cast("int")).over(along).alias("piece"))
    pieces = parts.groupBy(*row, "piece").agg(
        F.first("copies").alias("copies"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("text"))

    def by_piece(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *_encoded(b.column(4), path, pattern)],
                                             ["doc_id", "text_key", "piece", "copies", "n_tokens", "ids", "decoded"])

    done = pieces.mapInArrow(by_piece, f"doc_id {kind}, text_key string, piece long, copies long, {_PIECE}")
    in_order = F.array_sort(F.collect_list(F.struct("piece", "ids", "decoded")))
    rows = done.groupBy(*row).agg(F.first("copies").alias("copies"), F.sum("n_tokens").alias("n_tokens"), in_order.alias("p"))
    long = rows.select(
        "doc_id", "n_tokens", F.array_join(F.transform("p", lambda x: x["ids"]), " ").alias("ids"),
        F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["decoded"])), "")).alias("decoded"), "copies")
    long = long.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
    return short.unionByName(long)


def op9_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op9_chunked_bpe": op9_chunked_bpe}
