"""Packing documents into token sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.shared import cut, process_cache, small_batches, tidy


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, equal to those of the byte-level BPE in the file ``path``.

    Such a BPE first splits a text into parts. Where no white space follows white space, its pattern needs no look ahead, and
    ``tiktoken`` encodes such texts through the same vocabulary and merges with the plain pattern; other texts take the pattern
    as it is. Texts with the string of a special token go to the tokenizer itself. The tests hold the ids against the tokenizer's.
    """

    # Fixed value: the split pattern of the byte-level BPE.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: The same for texts whose white space stands alone.
    PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # Vocabulary files write bytes that don't print as the code points from 256 on, in order.
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte[c] for c in w): i for w, i in vocabulary.items() if w not in special}
        made = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bpe, self.plain = made("bpe", self.PATTERN), made("plain", self.PLAIN)
        self.apart = re.compile(r"\s\s")
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def encode(self, text: str) -> bytes:
        if self.special.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        bpe = self.bpe if self.apart.search(text) else self.plain
        return bpe.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


def patterns(histogram: dict[int, int], max_length: int) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first: ``(count, lengths)`` of each packing pattern, counts above 0.

    Places lengths longest first. All pieces of a length go to the pattern with the most room, as many as it has packs,
    one piece a pack; when no pattern has room, new packs open, each with as many pieces as the same length fills.
    """
    room: dict[int, list[tuple[int, list[int]]]] = {}
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n > 0:
            free = max((r for r, open_ in room.items() if open_), default=-1)
            if free < length:
                each = min(max_length // length, n)
                packs = n // each
                room.setdefault(max_length - each * length, []).append((packs, [length] * each))
                n -= packs * each
                continue
            count, lengths = room[free].pop()
            each = min(free // length, max(1, n // count))
            packs = min(count, n // each)
            if packs < count:
                room[free].append((count - packs, lengths))
            room.setdefault(free - each * length, []).append((packs, lengths + [length] * each))
            n -= packs * each
    return [x for r in sorted(room) for x in room[r] if x[0]]


def pack(docs: DataFrame, tokenizer: str, max_length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts every document into pieces and places them in sequences of at most ``max_length`` tokens.

    A document is its ids by the tokenizer at path ``tokenizer``, then ``end_id``. It is cut at multiples of ``max_length``;
    only last pieces are shorter. The histogram of lengths, at most ``max_length`` rows, goes to the driver, which places
    them by :func:`patterns`. The pieces of a length have ranks, which map to sequence and offset through the patterns.
    Ranks are counted in each task and offset by the tasks before it, so no task gathers the pieces of one length.

    Returns a row per piece: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and
    ``padding``, what its sequence is padded with: up to ``max_length``, or none at a power of two. NULL and empty texts are
    the end id alone. Each input row is a document, repeated keys and NULL keys too. An empty table gives no rows. Other
    columns are ignored.
    """

    small_batches(docs.sparkSession)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = process_cache("encoders")
        encoder = cache.get(tokenizer) or cache.setdefault(tokenizer, Encoder(tokenizer))
        seen, task = np.zeros(max_length + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in tidy(batches, "encoders"):
            rows = []
            for k, t in enumerate(batch["_text"]):
                ids = encoder.encode(t) + end
                n = len(ids) // 4
                for start in range(0, n, max_length):
                    length = min(max_length, n - start)
                    rows.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, seen[length]))
                    seen[length] += 1
            out = pd.DataFrame(rows, columns=["k", "start", "length", "ids_crc32", "doc_tokens", "rank"]).astype("int64")
            yield out.assign(task=task, **{key: batch[key].to_numpy()[out["k"]]}).drop(columns="k")

    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    numbers = "start long, length long, ids_crc32 long, doc_tokens long, rank long, task long"
    texts = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = cut(texts.mapInPandas(pieces, f"{numbers}, `{key}` {kind}"), "pack-pieces")
    counts = found.groupBy("length", "task").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}

    # Where the pieces of a length go, by rank: spans of ranks of one pattern, of ``each`` in a sequence.
    spans: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used, sequence = dict.fromkeys(histogram, 0), 0
    for count, lengths in patterns(histogram, max_length):
        total, offset = sum(lengths), 0
        padding = 0 if total & (total - 1) == 0 else max_length - total
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            spans.setdefault(length, []).append((used[length], each, sequence, offset, padding))
            used[length] += count * each
            offset += each * length
        sequence += count
    ends = np.zeros(max_length + 2, np.int64)
    for length, of in spans.items():
        ends[length + 1] = len(of)
    first = np.cumsum(ends)
    at = np.array([x for length in sorted(spans) for x in spans[length]], np.int64).reshape(-1, 5)
    # Spans of all lengths in one sorted list: length and rank as one number.
    far = 1 << 48
    starts = at[:, 0] + np.repeat(np.arange(max_length + 1), np.diff(first)) * far

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank, length = b["rank"].to_numpy() + b["ahead"].to_numpy(), b["length"].to_numpy()
            x = at[np.searchsorted(starts, length * far + rank, side="right") - 1]
            turn, slot = np.divmod(rank - x[:, 0], x[:, 1])
            yield b.drop(columns=["rank", "ahead"]).assign(sequence_id=x[:, 2] + turn, offset=x[:, 3] + slot * length, padding=x[:, 4])

    rows = found.join(ahead, ["length", "task"]).select(key, "start", "length", "ids_crc32", "doc_tokens", "rank", "ahead")
    numbers = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"
    return rows.mapInPandas(place, f"`{key}` {kind}, {numbers}")
