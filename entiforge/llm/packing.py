"""Filling containers of fixed capacity with documents measured in tokens of a public tokenizer.

Documents are measured in Arrow batches where they lie.  Only ``(id, piece, tokens)`` is shuffled, into slices of at
most about ``slice_items`` pieces by a hash of the id, and each slice is packed by best-fit decreasing: a segment tree
over the remaining capacities finds the tightest open container in logarithmic time.  A slice is a bounded task
whatever one source or author holds, and it leaves at most one badly filled container.

A document larger than the capacity fills whole containers with its pieces, and the rest of it is packed like any
other; no other document is ever cut.

Defined results: null and empty texts have 0 tokens and are placed in no container (``container_id`` null); repeated
ids are packed as often as they occur; an unknown kind of container raises; special strings of the tokenizer are
ordinary text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entiforge.plans.lineage import cut

TOKENIZER = os.environ.get("ENTIFORGE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def count_tokens(documents: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)`` of each document's whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        tok.encode_special_tokens = True
        tok.no_truncation()
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            sizes = []
            for at in range(0, len(texts), 256):
                sizes += [len(e.ids) for e in tok.encode_batch(texts[at : at + 256], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": sizes})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_tokens bigint")


class TightestFit:
    """Segment tree over the remaining capacities 0..capacity: how many open containers have each, by range."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, box: int) -> None:
        self.open[room].append(box)
        i = room + self.width
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and gives ``(room, container)`` of the smallest room of at least ``size``."""
        i = size + self.width
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.width
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(container, offset)`` for each size, in input order; every size lies in 1..capacity."""
    box = np.zeros(len(sizes), dtype="int64")
    offset = np.zeros(len(sizes), dtype="int64")
    tree, boxes = TightestFit(capacity), 0
    for k in np.argsort(-sizes, kind="stable"):
        n = int(sizes[k])
        got = tree.take(n)
        if got is None:
            room, b = capacity, boxes
            boxes += 1
        else:
            room, b = got
        box[k], offset[k] = b, capacity - room
        if room > n:
            tree.put(room - n, b)
    return box, offset


def pack(sized: DataFrame, capacity: int, slice_items: int = 100_000) -> DataFrame:
    """``(doc_id, piece, n_tokens, container_id, offset)`` for ``sized(doc_id, n_tokens)``.

    Pieces that fill a container alone are placed where they are; only documents up to the capacity, and the rests of
    longer ones, are packed - one piece a document, so slices are counted by documents.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = cut(sized.withColumn("copy", F.monotonically_increasing_id()), "sized")  # measured once: the slices need the number of documents first
    slices = max(1, -(-sized.where(F.col("n_tokens") % capacity > 0).count() // slice_items))
    full = F.floor(F.col("n_tokens") / capacity)
    whole = (
        sized.where(full > 0)
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)))
        .select("doc_id", F.col("piece").cast("int").alias("piece"), F.lit(capacity).cast("int").alias("n_tokens"), F.concat_ws("-", F.lit("full"), "copy", "piece").alias("container_id"), F.lit(0).alias("offset"))
    )
    rests = sized.where(F.col("n_tokens") % capacity > 0).select("doc_id", full.cast("int").alias("piece"), (F.col("n_tokens") % capacity).cast("int").alias("n_tokens"), "copy")
    placed = (
        rests.withColumn("slice", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(slices)).cast("int"))
        .drop("copy")
        .groupBy("slice")
        .applyInPandas(_pack_slice(capacity), "doc_id bigint, piece int, n_tokens int, container_id string, offset int")
    )
    none = sized.where("n_tokens = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.lit(None).cast("string").alias("container_id"), F.lit(0).alias("offset"))
    return placed.unionByName(whole).unionByName(none)


def unused_room(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: ``n_pieces, n_containers, fewest_containers`` (the tokens over the capacity, rounded up: no packing
    has fewer), ``used_tokens, unused_tokens, unused_share`` and ``over_full`` containers (none)."""
    boxes = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("n"))
    one = boxes.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_pieces"), F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("used_tokens"), F.coalesce(F.sum((F.col("n") > capacity).cast("bigint")), F.lit(0)).alias("over_full"))
    room = F.col("n_containers") * capacity - F.col("used_tokens")
    return one.select(
        "n_pieces", "n_containers", F.ceil(F.col("used_tokens") / capacity).cast("bigint").alias("fewest_containers"), "used_tokens", room.alias("unused_tokens"),
        F.coalesce(room / (F.col("n_containers") * capacity), F.lit(0.0)).alias("unused_share"), "over_full",
    )


def _pack_slice(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        box, offset = best_fit_decreasing(pdf["n_tokens"].to_numpy(), capacity)
        name = pdf["slice"].astype(str) + "-" + pd.Series(box).astype(str)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "n_tokens": pdf["n_tokens"], "container_id": name, "offset": offset.astype("int32")})

    return run


def capacity_of(containers: DataFrame, kind: str) -> int:
    row = containers.where(F.col("container_kind") == kind).first()
    if row is None or row.capacity_tokens is None:
        raise ValueError(f"no container of kind {kind!r}")
    return int(row.capacity_tokens)


def pack_documents(documents: DataFrame, containers: DataFrame, kind: str = "medium", tokenizer_path: str = TOKENIZER) -> DataFrame:
    return pack(count_tokens(documents, tokenizer_path), capacity_of(containers, kind))
