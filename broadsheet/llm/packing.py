"""Packing (2) with a controlled mixture: deficit round-robin over source queues.

Each source is a queue of tokens. A round gives each queue the tokens of one window times its target share, added to what it
was still owed; the queue sends whole packets of PACKET tokens while its credit lasts and carries the rest (its deficit) into
the next round. The rounds' output, in order, is cut into windows of ``size`` tokens, so nothing but the last window is
padded, and each holds every source's share to within a packet or two.

The state of the round-robin has a closed form, so no partition waits for another: packet j of a queue with quantum q goes out
in round ceil((j + 1) * PACKET / q), the last packet when the queue's total is reached. Token offsets in queues and in the
output are prefix sums over blocks of bounded size, never over a whole queue.

A queue that runs dry is missing from later rounds; the others go on in their proportions, and windows stay full.

Null texts count as empty: such a document is one end token. Null sources are a queue of their own. Repeated rows are
documents of their own; other columns are ignored; an empty table gives no rows. Very long texts are tokenised whole, by one task. A
source without a given target share keeps its share of the tokens; shares are scaled to add up to one. Sources with a
target of 0 are packed after all others, mixed by their own shares; a target for an absent source is void; a negative
or non-finite one raises.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Mapping
from itertools import accumulate, chain

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import let, per_process, stored, table

SIZE = 4096
PACKET = 16
#: A queue has at least so many slices, whose documents are numbered together; beyond, the root of the number of rows.
SLICES = 256
#: Rounds (and blocks of rounds) whose pieces are numbered together.
ROUNDS = 64
BLOCKS = 4096
CACHE = 500_000
LONGEST_CACHED = 100
#: Characters of texts that are tokenised together.
TOGETHER = 1_000_000
#: The mark at the end of a word's last token, and the pattern by which the tokenizer file cuts lower-case text.
WORD_END = "</w>"
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokens:
    """Token ids of texts by words between ASCII blanks, which the tokenizer never joins.

    Words (in bytes) and, below them, their lower-case pre-tokens come from two caches that take no more than CACHE entries each. What
    is not there is cut and encoded for many texts at once: pre-tokens as one text with blanks between, whose ids part behind
    each token that ends a word.
    """

    def __init__(self, path: str):
        import re

        import numpy as np
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.words_known, self.parts_known = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tok.get_vocab()
        self.kind = "<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.parts = regex.compile(PRE_TOKENS + "|\n").findall
        # Below U+0300 every text is in composed form and lower-cases letter by letter.
        self.other = re.compile("[^\x00-\u02ff]").search
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda t: None

    def raw(self, texts: list[str]) -> list[bytes]:
        from array import array

        code = "H" if self.kind == "<u2" else "I"
        return [array(code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def through(self, cache: dict, keys: list, make) -> list[bytes]:
        """The values of ``keys``; those not in the cache are made, each once, and kept while there is room."""
        found = list(map(cache.get, keys))
        if None not in found:
            return found
        new = list(dict.fromkeys(k for k, v in zip(keys, found) if v is None))
        fresh = dict(zip(new, make(new)))
        if len(cache) < CACHE:
            cache.update((k, v) for k, v in fresh.items() if len(k) <= LONGEST_CACHED)
        return [fresh[k] if v is None else v for k, v in zip(keys, found)]

    def new_parts(self, parts: list[str]) -> list[bytes]:
        import numpy as np

        ids = np.array(self.tok.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, self.kind)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
        if len(cuts) != len(parts):  # not a tokenizer of this kind
            return self.raw(parts)
        whole = ids.tobytes()
        return [whole[a:z] for a, z in zip([0, *cuts], cuts)]

    def new_words(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        plain = [t for t in texts if not self.other(t)]
        parts = self.parts("\n".join(plain).lower())
        found = iter(self.through(self.parts_known, [p for p in parts if p != "\n"], self.new_parts))
        known, run = [], []
        for p in parts:
            if p == "\n":
                known.append(b"".join(run))
                run = []
            else:
                run.append(next(found))
        known.append(b"".join(run))
        known, rest = iter(known), iter(self.raw([t for t in texts if self.other(t)]))
        return [next(rest) if self.other(t) else next(known) for t in texts]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        words = [[] if self.added(t) else t.encode().split() for t in texts]
        found = self.through(self.words_known, list(chain.from_iterable(words)), self.new_words)
        ends = list(accumulate(map(len, words)))
        # Added tokens may hold or touch blanks: the library cuts such a text.
        return [self.raw([t])[0] if self.added(t) else b"".join(found[a:z]) for t, a, z in zip(texts, [0, *ends], ends)]

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]


def tokenise(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """row_id, doc_id, queue, n and ids (little-endian) of ``docs``, stored: row ids are fixed from here on."""
    source = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    queue = F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))
    given = docs.select("doc_id", queue.alias("queue"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words = per_process(("words", path), lambda: WordTokens(path))
        end = np.array([end_id], words.kind).tobytes()
        for b in batches:
            ids, run, size = [], [], 0
            for t in b.column(2).to_pylist():
                run.append(t)
                size += len(t)
                if size >= TOGETHER:
                    ids += words.many(run)
                    run, size = [], 0
            ids = [i + end for i in ids + words.many(run)]
            counts = pa.array([len(i) // len(end) for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), counts, pa.array(ids, pa.binary())], ["doc_id", "queue", "n", "ids"])

    found = given.mapInArrow(run, f"doc_id {kind}, queue string, n long, ids binary")
    return stored(found.withColumn("row_id", F.monotonically_increasing_id()), "tokens")


def queue_offsets(tokens: DataFrame, size: int, targets: Mapping[str, float] | None) -> DataFrame:
    """row_id, queue, n, at (tokens before it in its queue), total, quantum (tokens per round) and wait (rounds before its first) of its queue."""
    for name, share in (targets or {}).items():
        if not 0 <= share < math.inf:
            raise ValueError(f"target of {name!r} must be a number of at least 0, not {share}")
    slices = max(SLICES, math.isqrt(tokens.count()))
    rows = tokens.select("row_id", "queue", "n", F.pmod(F.xxhash64("row_id"), F.lit(slices)).alias("slice"))
    sums = rows.groupBy("queue", "slice").agg(F.sum("n").alias("n"))
    of_queue = Window.partitionBy("queue")
    before = F.sum("n").over(of_queue.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("queue", "slice", F.coalesce(before, F.lit(0)).alias("slice_at"), F.sum("n").over(of_queue).alias("total"))
    queues = sums.groupBy("queue").agg(F.sum("n").alias("total"))
    all_queues = Window.partitionBy(F.lit(1))  # a row per queue
    weight = F.col("total") / F.sum("total").over(all_queues)
    for name, share in (targets or {}).items():
        weight = F.when(F.col("queue") == f"={name}", F.lit(float(share))).otherwise(weight)
    weighed = queues.withColumn("weight", weight).withColumn("last", F.col("weight") == 0)
    together = Window.partitionBy("last")
    weighed = weighed.withColumn("weight", F.when(F.col("last"), F.col("total").cast("double")).otherwise(F.col("weight")))
    quanta = weighed.withColumn("quantum", F.col("weight") / F.sum("weight").over(together) * size)
    rounds = F.max(F.when(~F.col("last"), F.ceil(F.col("total") / F.col("quantum")))).over(all_queues)
    quanta = quanta.select("queue", "quantum", F.when(F.col("last"), F.coalesce(rounds, F.lit(0))).otherwise(0).cast("long").alias("wait"))
    starts = starts.join(quanta, "queue")
    in_slice = Window.partitionBy("queue", "slice").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("in_slice", F.coalesce(F.sum("n").over(in_slice), F.lit(0)))
    return numbered.join(starts, ["queue", "slice"]).select(
        "row_id", "queue", "n", (F.col("slice_at") + F.col("in_slice")).alias("at"), "total", "quantum", "wait")


def sent_in_rounds(rows: DataFrame, packet: int) -> DataFrame:
    """What each document sends in each round: row_id, queue, round, at (in the queue), start (in the document), length."""
    first, last = F.expr(f"at div {packet}"), F.expr(f"(at + n - 1) div {packet}")
    due = lambda j: F.col("wait") + F.ceil(F.least((j + 1) * packet, F.col("total")) / F.col("quantum")).cast("long")

    def runs(r):
        cuts = F.filter(F.transform(r, lambda x, i: F.when(~F.get(r, i - 1).eqNullSafe(x), i)), lambda i: i.isNotNull())
        return let(cuts, lambda c: F.transform(c, lambda i, k: F.struct(
            F.get(r, i).alias("round"), (F.col("first") + i).alias("from"),
            (F.col("first") + F.coalesce(F.get(c, k + 1), F.size(r)) - 1).alias("to"))))

    rows = rows.withColumn("first", first)
    sent = rows.select("row_id", "queue", "at", "n", F.explode(let(F.transform(F.sequence(first, last), due), runs)).alias("s"))
    begin, end = F.greatest("at", F.col("s.from") * packet), F.least(F.col("at") + F.col("n"), (F.col("s.to") + 1) * packet)
    return sent.select("row_id", "queue", F.col("s.round").alias("round"), begin.alias("at"),
                       (begin - F.col("at")).alias("start"), (end - begin).alias("length"))


def positions(sent: DataFrame) -> DataFrame:
    """``sent`` with ``pos``: the tokens before it in the output, ordered by round, queue and place in the queue."""
    sent = sent.withColumn("block", F.expr(f"round div {ROUNDS}"))
    above = lambda c: F.coalesce(F.sum("length").over(
        Window.partitionBy(c[0]).orderBy(*c[1:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sent.groupBy("block").agg(F.sum("length").alias("length")).withColumn("group", F.expr(f"block div {BLOCKS}"))
    groups = blocks.groupBy("group").agg(F.sum("length").alias("length")).withColumn("one", F.lit(1))
    groups = groups.select("group", above(("one", "group")).alias("group_at"))
    starts = blocks.withColumn("block_at", above(("group", "block"))).join(groups, "group").select(
        "block", (F.col("block_at") + F.col("group_at")).alias("block_at"))
    inside = sent.withColumn("inside", above(("block", "round", "queue", "at")))
    return inside.join(starts, "block").withColumn("pos", F.col("block_at") + F.col("inside"))


def pack(docs: DataFrame, path: str, end_id: int, size: int = SIZE, packet: int = PACKET,
         targets: Mapping[str, float] | None = None) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text, source): where it stands in its document and in its sequence."""
    tokens = tokenise(docs, path, end_id)
    sent = stored(sent_in_rounds(queue_offsets(tokens, size, targets), packet), "rounds")
    placed = positions(sent)
    end = F.col("pos") + F.col("length")
    cut = placed.select("row_id", "start", "length", "pos", F.explode(F.sequence(
        F.expr(f"pos div {size}"), F.expr(f"(pos + length - 1) div {size}"))).alias("sequence_id"))
    begin, stop = F.greatest("pos", F.col("sequence_id") * size), F.least(end, (F.col("sequence_id") + 1) * size)
    piece = F.struct((F.col("start") + begin - F.col("pos")).alias("start"), (stop - begin).alias("length"), "sequence_id",
                     (begin - F.col("sequence_id") * size).alias("offset"))
    by_row = cut.groupBy("row_id").agg(F.collect_list(piece).alias("pieces"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def checksums(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids, counts, pieces = b.column(1), b.column(2).to_pylist(), b.column(3)
            crc, row = [], np.repeat(np.arange(len(b)), pieces.value_lengths().to_numpy())
            flat = pieces.flatten()
            starts, lengths = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            last, wide = -1, b""
            for r, s, n in zip(row.tolist(), starts.tolist(), lengths.tolist()):
                if r != last:
                    raw = ids[r].as_buffer()
                    wide, last = memoryview(np.frombuffer(raw, f"<u{raw.size // counts[r]}").astype("<u4").tobytes()), r
                crc.append(zlib.crc32(wide[4 * s:4 * (s + n)]))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), flat.field(0), flat.field(1), pa.array(crc, pa.int64()), b.column(2).take(take), flat.field(2), flat.field(3)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    whole = tokens.join(by_row, "row_id").select("doc_id", "ids", "n", "pieces")
    return whole.mapInArrow(checksums, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


QUERIES = {"op2_packing": op2_packing}
