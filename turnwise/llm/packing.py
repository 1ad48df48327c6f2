"""Filling fixed-capacity containers with texts (problem 6).

Refined harmonic packing: a text whose length lies in (C/(j+1), C/j] belongs to class j, and containers of
class j take exactly j of them, so any j fit and no search is needed.  A text of more than half the
capacity leaves a rest that harmonic classes would waste: its container takes one more text, the largest
of the smaller classes that fits.  Classes are filled by each task on its own.  What classes leave over
(containers short of their count, the smallest texts) is then laid into the rooms still open.  Only ids
and lengths are shuffled, by id, so the containers and their names follow from the data alone.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

TOKENIZERS = os.environ.get("TURNWISE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts below C / (CLASSES + 1) share containers one after another.
CLASSES = 16
#: The word pattern of the vocabulary (a fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(length: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a text: itself, or full containers and a rest where it is larger."""
    if length <= capacity:
        return [length]
    return [capacity] * (length // capacity) + ([length % capacity] if length % capacity else [])


def pack(lengths: list[int], capacity: int, classes: int = CLASSES) -> list[int]:
    """The container number of each length; all lengths must be between 0 and the capacity."""
    where = [-1] * len(lengths)
    rooms: list[int] = []  # what is left in each container

    def put(n: int, at: int) -> None:
        where[n] = at
        rooms[at] -= lengths[n]

    order = sorted(range(len(lengths)), key=lambda n: (lengths[n], n))
    small = [n for n in order if 2 * lengths[n] <= capacity]
    sizes = [lengths[n] for n in small]
    # The next free text at or before a place, with the steps taken remembered.
    free = list(range(len(small) + 1))

    def fitting(room: int) -> int:
        """The place of the largest free small text that fits, or -1."""
        at = bisect_right(sizes, room)
        path = []
        while free[at] != at:
            path.append(at)
            at = free[at]
        for x in path:
            free[x] = at
        return at - 1

    def take(room: int, at: int) -> int:
        k = fitting(room)
        if k >= 0:
            put(small[k], at)
            free[k + 1] = k
        return k

    # Class 1, fullest first: each container takes its text and the best complement.
    for n in reversed(order[len(small) :]):
        rooms.append(capacity)
        put(n, len(rooms) - 1)
        take(rooms[-1], len(rooms) - 1)
    # The other classes: j texts of class j to a container, then one more if the room allows.
    while (k := fitting(capacity)) >= 0:
        j = capacity // sizes[k] if sizes[k] else classes + 1
        rooms.append(capacity)
        if j <= classes:
            for _ in range(j):
                take(min(rooms[-1], capacity // j), len(rooms) - 1)
        while take(rooms[-1], len(rooms) - 1) >= 0:
            pass
    # Whole containers that fit together are merged, the fullest with the emptiest.
    used = [capacity - r for r in rooms]
    ranked = sorted(range(len(used)), key=lambda b: (-used[b], b))
    target = list(range(len(used)))
    left, right = 0, len(ranked) - 1
    while left < right:
        a = ranked[left]
        while left < right and used[a] + used[ranked[right]] <= capacity:
            used[a] += used[ranked[right]]
            target[ranked[right]] = a
            right -= 1
        left += 1
    return [target[w] for w in where]


_SCHEMA = "window_id int, doc_id long, piece int, n_tokens long, container string"


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of the texts that have any, in one scan."""
    path = os.path.join(tokenizers, vocabulary)

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)))

    texts = documents.where("text IS NOT NULL AND text <> '' AND doc_id IS NOT NULL")
    return texts.select("doc_id", count("text").alias("n_tokens"))


def fill_containers(
    documents: DataFrame,
    windows: DataFrame,
    tokenizers: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
    classes: int = CLASSES,
    parts: int | None = None,
) -> DataFrame:
    """(window_id, doc_id, piece, n_tokens, container): where each text lies, for each capacity.

    Defined results: null and empty texts take no room and are left out; a text larger than the capacity
    becomes pieces, all but the last of them full; equal texts are placed one by one; a document delivered
    several times counts once; windows with a null or non-positive capacity are left out.  Documents are
    packed in ``parts`` independent parts by id (as many as the session's shuffle partitions by default); a
    part holds its ids and lengths in memory, 16 bytes a document.  A container is named after the first
    piece in it, so the same data give the same names.  The capacities (a handful) are read to the driver,
    whose number is checked.
    """
    caps = [(r.window_id, r.capacity_tokens) for r in windows.select("window_id", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(1001).collect()]
    if len(caps) > 1000:
        raise ValueError("more than 1000 capacities")
    n = parts or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [pdf for pdf in batches if len(pdf)]
        if not frames:
            return
        whole = pd.concat(frames).drop_duplicates("doc_id").sort_values("doc_id")
        ids, sizes = whole["doc_id"].tolist(), whole["n_tokens"].tolist()
        for window, capacity in sorted(caps, key=str):
            told = [(i, k, p) for i, s in zip(ids, sizes) for k, p in enumerate(pieces(s, capacity))]
            bins = pack([p for _, _, p in told], capacity, classes)
            names: dict[int, str] = {}
            for (i, k, _), b in zip(told, bins):
                names.setdefault(b, f"{window}-{i}-{k}")
            columns = {"window_id": window, "doc_id": [i for i, _, _ in told], "piece": [k for _, k, _ in told], "n_tokens": [p for _, _, p in told]}
            yield pd.DataFrame({**columns, "container": [names[b] for b in bins]})

    return token_counts(documents, tokenizers, vocabulary).repartition(n, "doc_id").mapInPandas(place, _SCHEMA)


def usage(placed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, containers, texts, filled): how full the containers are."""
    bins = placed.groupBy("window_id", "container").agg(F.sum("n_tokens").alias("used"))
    per = bins.groupBy("window_id").agg(F.count("*").alias("containers"), F.sum("used").alias("used"))
    return per.join(windows.select("window_id", "capacity_tokens").distinct(), "window_id").select("window_id", "containers", "used", (F.col("used") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))
