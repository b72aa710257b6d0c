"""Problem 8: filling fixed-capacity containers.

Variable-capacity best-fit decreasing: items of a shard go, longest first, into the open container with the least room that
still holds them; where none does, the permitted capacity of least cost is opened. The cost of a capacity is the share of it that would stay empty if its room
were filled with the longest items to come that fit, one after the other; equal costs go to the larger capacity. So a capacity is opened that the items to come complete, not always the largest. At the end each container is downsized to
the smallest permitted capacity that holds its contents. An item above the largest capacity is split into full
containers and a remainder, which is packed like an item.

Scale: sizes are taken in the JVM (octet_length + 1: the byte-level tokenizer ByT5 has one token a UTF-8 byte and an end token),
texts are never shuffled, and items are spread over shards by a salted hash so that a shard holds about SHARD_TOKENS
tokens (at least one shard). A shard is packed in one task; its last container is the only one that may stay loose.

Defined results: a null text has no tokens and is not placed; an empty text has one token (the end token); repeated
rows of an id are separate items (item_no tells them apart); with no permitted capacity nothing is placed.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_TOKENS = 40_000_000


def pack(sizes: list[int], capacities: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, start, tokens, container) for the items, then nothing else; containers are numbered from 0.

    Capacities must be positive. Deterministic: ties go to the item given first and the container opened first."""
    top = max(capacities)
    small = sorted(set(capacities))
    parts = []
    for i, n in enumerate(sizes):
        for k, s in enumerate(range(0, n, top)):
            parts.append((min(top, n - s), i, k, s))
    parts.sort(key=lambda p: (-p[0], p[1], p[2]))
    rising = [p[0] for p in reversed(parts)]
    rooms: list[tuple[int, int]] = []  # (room, container), sorted
    out, bins = [], 0

    def empty(room: int, to_come: int) -> int:
        """What stays of a room that the longest of the items to come fill in turn."""
        hi = to_come
        while room and hi:
            hi = bisect.bisect_right(rising, room, 0, hi) - 1
            if hi < 0:
                break
            room -= rising[hi]
        return room

    for n, (size, i, k, s) in enumerate(parts):
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            fit = small[bisect.bisect_left(small, size) :]
            to_come = len(parts) - n - 1
            room = fit[0] if len(fit) == 1 else min(fit, key=lambda c: (empty(c - size, to_come) / c, -c))
            b, bins = bins, bins + 1
        if room > size:
            bisect.insort(rooms, (room - size, b))
        out.append((i, k, s, size, b))
    return out


def packed(documents: DataFrame, capacities: list[tuple[str, list[int]]], shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row a document and container: (plan, container_id, container_tokens, capacity_tokens, doc_id, item_no, piece_no, start_token, n_tokens).

    capacities: for each plan its name and the permitted capacities; every plan places every document once."""
    items = documents.where("text is not null").select("doc_id", (F.octet_length("text").cast("bigint") + 1).alias("size"))
    total = items.agg(F.sum("size").alias("n")).first().n or 0
    shards = max(1, -(-int(total) // shard_tokens))
    sets = {name: sorted({int(c) for c in caps if c and c > 0}) for name, caps in capacities}

    def work(key, pdf):
        pdf = pdf.sort_values(["doc_id", "size"], kind="stable").reset_index(drop=True)
        no = pdf.groupby("doc_id", dropna=False).cumcount().to_numpy()
        plan, shard = key
        rows = pack(pdf["size"].tolist(), sets[plan])
        r = pd.DataFrame(rows, columns=["i", "piece_no", "start_token", "n_tokens", "bin"])
        load = r.groupby("bin")["n_tokens"].transform("sum").to_numpy()
        caps = np.array(sets[plan])
        fit = caps[np.searchsorted(caps, load)]
        ids = pdf["doc_id"].to_numpy()[r["i"]]
        return pd.DataFrame({"plan": plan, "container_id": [f"{plan}-{shard}-{b}" for b in r["bin"]], "container_tokens": load, "capacity_tokens": fit, "doc_id": ids, "item_no": no[r["i"]], "piece_no": r["piece_no"], "start_token": r["start_token"], "n_tokens": r["n_tokens"]})

    plans = [name for name, caps in sets.items() if caps]
    out = "plan string, container_id string, container_tokens bigint, capacity_tokens bigint, doc_id bigint, item_no bigint, piece_no bigint, start_token bigint, n_tokens bigint"
    if not plans:
        return documents.sparkSession.createDataFrame([], out)
    dealt = items.select("*", F.explode(F.array(*[F.lit(p) for p in plans])).alias("plan"), F.pmod(F.xxhash64("doc_id", "size"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("plan", "shard").applyInPandas(work, out)
