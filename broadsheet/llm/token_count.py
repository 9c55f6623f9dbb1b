"""Token counts (4) by the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that give exactly their own id are proven whole tokens. Texts are
cut into pre-tokens; a pre-token that is proven counts one, and only the rest, each distinct one once per worker, goes
through the library's merges. Pre-tokens are the library's own: one pattern cuts texts whose characters all
implementations class alike, and the library itself cuts the others.

Null texts count as empty: 0 bytes, 0 tokens. Strings of added tokens inside a text count as one token, as the library
has it by default. Rows are independent: repeated rows repeat, other columns are ignored, an empty table gives no rows.
Whole texts are counted whatever their length; the memory of merged pre-tokens is bounded by CACHE entries.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.common import per_process, table

CACHE = 300_000
#: Characters below this one are classed alike by all versions of the Unicode tables in use.
CLASSED_ALIKE = 0x530


def library(path: str):
    """The tokenizer of a JSON file, loaded once in each process."""
    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return per_process(("tokenizer", path), load)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + k): b for k, b in enumerate(others)}}


def prove_whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that, encoded alone, are one pre-token and give their own id only."""
    tok, letters = library(path), byte_letters()
    known: dict[str, int] = {}
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            known[bytes(letters[c] for c in token).decode()] = i
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: no text encodes to it alone
    names = list(known)
    found = tok.encode_batch(names, add_special_tokens=False)
    return frozenset(s for s, e in zip(names, found) if e.ids == [known[s]] and len(tok.pre_tokenizer.pre_tokenize_str(s)) == 1)


class Counter:
    """Counts tokens of texts with the proven strings; keeps the counts of other pre-tokens it has merged."""

    def __init__(self, path: str, whole: frozenset[str], pattern: str):
        import regex

        self.tok, self.whole, self.merged = library(path), whole, {}
        self.cut = regex.compile(pattern).findall
        self.unsure = regex.compile(f"[^\\x00-\\u{CLASSED_ALIKE - 1:04x}]").search
        added = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def pre_tokens(self, text: str) -> list[str]:
        if self.unsure(text):
            return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return self.cut(text)

    def count(self, text: str) -> int:
        pieces = self.added.split(text) if self.added else [text]
        total = len(pieces) - 1
        for piece in pieces:
            parts = self.pre_tokens(piece)
            rest = [p for p in parts if p not in self.whole]
            total += len(parts) - len(rest)
            new = list({p for p in rest if p not in self.merged})
            if new:
                if len(self.merged) + len(new) > CACHE:
                    self.merged, new = {}, list(set(rest))
                self.merged.update(zip(new, (len(e) for e in self.tok.encode_batch(new, add_special_tokens=False))))
            total += sum(map(self.merged.__getitem__, rest))
        return total


def count_tokens(docs: DataFrame, path: str, limit: int, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of ``docs`` (doc_id, text)."""
    proven = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))  # no larger than the vocabulary
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = given.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = per_process(("counter", path, pattern), lambda: Counter(path, proven.value, pattern))
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], schema.names)

    return given.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


QUERIES = {"op4_token_counts": op4_token_counts}
