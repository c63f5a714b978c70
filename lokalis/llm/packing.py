"""Containers of fixed capacity filled with texts, measured in tokens (`byte_bpe_50k.tiktoken` unless another path is given).

Method: minimum bin slack. Each container begins with the longest text left; the rest of it is filled by the multiset of
remaining lengths whose sum comes closest, found by a subset-sum dynamic program on a bitset (one bit for each sum), whose
steps are traced back to counts of each length. A text longer than the capacity gives whole containers of its own and a
remainder that is placed like a text; any other text stays whole.

Lengths are packed in shards of about `SHARD_TEXTS` texts, so no task holds more; a shard leaves at most its last containers
unfilled. Token counts are written to the checkpoint folder once and used for every capacity.

Defined results: NULL and empty texts get no place; every other token is placed exactly once; repeated ids are separate texts;
an empty table gives no containers; a capacity below 1 is an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalis.llm.token_count import Counter
from lokalis.runtime import cut, ship, spread

SHARD_TEXTS = 20_000
PLACED = "pack_no long, container long, doc_id long, piece int, start_token long, tokens long"


def closest_fill(lengths: list[int], count: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) with the largest sum of at most `room`. `lengths`: those left, descending."""
    reach, steps, want = 1, [], 1 << room
    for size in lengths:
        if size > room:
            continue
        steps.append((size, reach))
        for _ in range(min(count[size], room // size)):
            more = reach | reach << size
            if more == reach:
                break
            reach = more
        if reach & want:
            break
    at = (reach & ((want << 1) - 1)).bit_length() - 1
    out = []
    for size, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at -= size
            n += 1
        if n:
            out.append((size, n))
    return out


def pack(items: list[tuple[int, Any]], capacity: int) -> Iterator[list[Any]]:
    """Containers as lists of keys, for (length, key) items of at most `capacity`."""
    keys: dict[int, list] = defaultdict(list)
    for size, key in items:
        keys[size].append(key)
    count = {size: len(k) for size, k in keys.items()}
    lengths = sorted(count, reverse=True)
    while lengths:
        first = lengths[0]
        take = [(first, 1)]
        count[first] -= 1
        if first < capacity:
            take += closest_fill([s for s in lengths if s <= capacity - first and count[s]], count, capacity - first)
        box = []
        for size, n in take:
            box += [keys[size].pop() for _ in range(n)]
        for size, n in take[1:]:
            count[size] -= n
        if any(not count[s] for s, _ in take):
            lengths = [s for s in lengths if count[s]]
        yield box


def token_lengths(documents: DataFrame, doc_id: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, tokens) of the texts with at least one token."""
    ship(documents.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Counter(tokenizer)
        for p in parts:
            yield pd.DataFrame({"doc_id": p.doc_id, "tokens": tokens.all(p.text)})

    src = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and text <> ''")
    return src.mapInPandas(run, "doc_id long, tokens long")


def pack_documents(documents: DataFrame, sizes: DataFrame, doc_id: str = "doc_id", tokenizer: str | None = None, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """(pack_no, container, doc_id, piece, start_token, tokens): where each text, or piece of an oversized one, is placed."""
    lengths = cut(token_lengths(documents, doc_id, tokenizer))
    shards = max(1, -(-lengths.count() // shard_texts))
    # The rows are fixed by the checkpoint, so their numbers are the same whenever a task runs again.
    row = F.monotonically_increasing_id()
    capacities = [(int(r["pack_no"]), int(r["capacity_tokens"])) for r in sizes.select("pack_no", "capacity_tokens").where("pack_no is not null and capacity_tokens is not null").distinct().collect()]
    if any(c < 1 for _, c in capacities):
        raise ValueError("a capacity must be at least 1")
    if not capacities:
        return lengths.sparkSession.createDataFrame([], PLACED)
    each = lengths.withColumn("shard", F.pmod(F.xxhash64(row), F.lit(shards))).select("*", F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("pack_no"), F.lit(c).cast("long").alias("capacity")) for n, c in capacities))).alias("to")).select("doc_id", "tokens", "shard", "to.*")

    def run(key: tuple[Any, ...], p: pd.DataFrame) -> pd.DataFrame:
        pack_no, capacity, shard = (int(k) for k in key)
        base = shard << 32
        items, rows, box = [], [], 0
        for d, n in zip(p.doc_id.tolist(), p.tokens.tolist()):
            piece, start = 0, 0
            while n - start > capacity:
                rows.append((pack_no, base + box, d, piece, start, capacity))
                box, piece, start = box + 1, piece + 1, start + capacity
            items.append((n - start, (d, piece, start, n - start)))
        for keys in pack(items, capacity):
            rows += [(pack_no, base + box, *k) for k in keys]
            box += 1
        return pd.DataFrame(rows, columns=["pack_no", "container", "doc_id", "piece", "start_token", "tokens"])

    return spread(each, "pack_no", "capacity", "shard").groupBy("pack_no", "capacity", "shard").applyInPandas(run, PLACED)
