"""Evaluation texts leaking into documents (problem 7).

Winnowing: of the hashes of all k-word grams, the smallest of each window of w is a fingerprint, so any
shared run of k + w - 1 words shares one.  Both sides are fingerprinted once and joined on the hash; of the
documents only fingerprints that some passage may have reach the shuffle, told by a bit table of fixed
size.  Pairs with enough common fingerprints are candidates: their hits are extended along their diagonals
over scattered changes of words, and a document leaks an item if the extended hits hold at least half
of the passage, in one piece or several.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

K = 3
WINDOW = 4
#: Hits whose diagonals differ by less belong together.
BAND = 12
#: Hits in one band for each word that must be held.  An unchanged copy has 2 / (WINDOW + 1) = 0.4, one
#: with every sixth word changed still about 0.15.
HITS_PER_WORD = 0.12
#: Share of a passage that must be held.
LEAST = 0.5
#: Bits of the table of held-out fingerprints (2 MB, whatever the number of passages).
TABLE_BITS = 1 << 24
#: Parts into which the documents that share one fingerprint are split.
SALTS = 8

_HYPHEN = re.compile(r"(\w)-[ \t]*\r?\n[ \t]*(\w)")
_ESCAPES = re.compile(r"\\[nrt]")
_WORD = re.compile(r"[^\W_]+")
_DROPPED = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])


def words_of(text: str | None) -> list[str]:
    """Words without case, punctuation, spacing, line layout, escapes and compatibility forms."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_DROPPED))
    if "-" in text:
        text = _HYPHEN.sub(r"\1\2", text)
    if "\\" in text:
        text = _ESCAPES.sub(" ", text)
    return _WORD.findall(text.lower())


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode())


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))


def gram_hashes(hashed: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = (out ^ hashed[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the fingerprints: the rightmost smallest hash of each window."""
    n = len(grams)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(grams[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(n - window + 1) + window - 1 - views.argmin(axis=1))


#: The least part of what is wanted of an item that counts as a piece of it.
PIECE = 0.3


@dataclass
class HeldOut:
    """Fingerprints of a block of held-out passages, sorted by hash."""

    hashes: np.ndarray
    items: np.ndarray
    positions: np.ndarray
    ids: list[int]
    words: list[np.ndarray]
    grams: list[np.ndarray]
    lengths: np.ndarray

    @staticmethod
    def of(passages: list[tuple[int, str | None]], k: int = K, window: int = WINDOW) -> "HeldOut":
        ids, words, h, it, pos = [], [], [], [], []
        for item_id, passage in passages:
            hashed = _hashes(words_of(passage))
            if len(hashed) < k:
                continue
            grams = gram_hashes(hashed, k)
            at = winnow(grams, window)
            h.append(grams[at])
            it.append(np.full(len(at), len(ids)))
            pos.append(at)
            ids.append(item_id)
            words.append(hashed)
        if not ids:
            e = np.empty(0, dtype=np.int64)
            return HeldOut(e.astype(np.uint64), e, e, [], [], [], e)
        hashes, items, positions = np.concatenate(h), np.concatenate(it), np.concatenate(pos)
        order = np.argsort(hashes, kind="stable")
        return HeldOut(hashes[order], items[order], positions[order], ids, words, [gram_hashes(w, k) for w in words], np.array([len(w) for w in words]))

    def candidates(self, grams: np.ndarray, at: np.ndarray, share: float) -> list[tuple[int, list[int]]]:
        """(item number, middles of the bands, most hits first) of items with enough hits whose diagonals lie together.

        ``share`` is the number of hits wanted in a band for each word of the item; a piece of a third
        of a passage word by word has twice as many.
        """
        own = grams[at]
        left, right = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        n = right - left
        if not n.any():
            return []
        doc = np.repeat(at, n)
        found = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
        items, place = self.items[found], self.positions[found]
        bins = (doc - place) // BAND
        low, wide, deep = int(bins.min()), int(bins.max() - bins.min()) + 2, int(place.max()) + 1
        key = np.unique(((items * wide) + (bins - low)) * deep + place) // deep  # one hit for each place of an item
        cells, counts = np.unique(key, return_counts=True)
        after = np.append(np.diff(cells) == 1, False)
        joint = counts + np.where(after, np.append(counts[1:], 0), 0)
        needed = share * self.lengths
        strong = np.nonzero(joint >= needed[cells // wide])[0]
        out: dict[int, list[tuple[int, int]]] = {}
        for c in strong[np.lexsort((cells[strong], -joint[strong]))]:
            item, spot = int(cells[c] // wide), int(cells[c] % wide)
            bands = out.setdefault(item, [])
            if all(abs(spot - other) > 1 for _, other in bands):
                bands.append((int(joint[c]), spot))
        return [(item, [(spot + low + 1) * BAND for _, spot in bands]) for item, bands in out.items()]


def held_words(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(start, end) in the item of the best local alignment of two word sequences.

    An equal word counts 1, a changed, missing or additional one -1; the stretch with the best sum is
    what the document holds of the item, with its scattered changes.
    """
    m = len(doc)
    steps = np.arange(1, m + 1)
    row = np.zeros(m + 1, dtype=np.int64)
    start = np.zeros(m + 1, dtype=np.int64)
    best, found = 0, (0, 0)
    for i, word in enumerate(item):
        same = np.where(doc == word, 1, -1)
        diagonal, above = row[:-1] + same, row[1:] - 1
        take = np.maximum(np.maximum(diagonal, above), 0)
        origin = np.where(take == 0, i + 1, np.where(diagonal >= above, np.where(row[:-1] == 0, i, start[:-1]), start[1:]))
        # A gap in the item: the best cell to the left, less its distance.
        reach = np.maximum.accumulate(take + steps)
        value = reach - steps
        source = np.maximum.accumulate(np.where(take + steps == reach, np.arange(m), 0))
        origin = np.where(value > take, origin[source], origin)
        row = np.concatenate(([0], np.maximum(value, 0)))
        start = np.concatenate(([i + 1], origin))
        top = int(row.max())
        if top > best:
            j = int(row.argmax())
            best, found = top, (int(start[j]), i + 1)
    return found


def covered(doc: np.ndarray, doc_grams: np.ndarray, item: np.ndarray, item_grams: np.ndarray, middles: list[int], least: float, k: int = K) -> float:
    """Share of the item held in the stretches of the document around its bands of hits, up to the first that makes it enough.

    What one stretch leaves of the item is looked for in the same and in the next ones.  A stretch
    that is not enough alone counts if it is at least a part of PIECE of what is wanted and mostly
    made of the item's grams, so that chance words do not add up.  The alignment is left out where
    too few of the item's grams occur in the stretches at all.
    """
    n = len(item)
    windows = [(max(0, m - 2 * BAND), m + n + 2 * BAND) for m in middles if m + n + 2 * BAND > 0]
    present = np.zeros(len(item_grams), dtype=bool)
    for a, b in windows:
        present |= np.isin(item_grams, doc_grams[a:b])
    mark = np.zeros(n, dtype=bool)
    for i in range(k):
        mark[i : n - k + 1 + i] |= present
    if mark.mean() < 0.6 * least:
        return 0.0
    held, free = 0, [(0, n)]
    for a, b in windows:
        todo, free = free, []
        while todo:
            left, right = todo.pop()
            if right - left < PIECE * least * n:
                continue
            x, y = (left + v for v in held_words(doc[a:b], item[left:right]))
            if y - x < least * n and (y - x < PIECE * least * n or mark[x:y].mean() < 0.6):
                free.append((left, right))
                continue
            held += y - x
            if held >= least * n:
                return held / n
            todo += [(left, x), (y, right)]
    return held / n


@lru_cache(maxsize=2)
def _read(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, gram hashes); the candidates of a document follow each other, so it is read once."""
    hashed = _hashes(words_of(text))
    return hashed, gram_hashes(hashed)


def leaked_items(text: str | None, held: HeldOut, least: float = LEAST, k: int = K, window: int = WINDOW) -> list[tuple[int, float]]:
    """(item id, share held) of the passages that a text gives away."""
    hashed, grams = _read(text)
    if k != K:
        grams = gram_hashes(hashed, k)
    if not len(grams) or not held.ids:
        return []
    out = []
    for item, middles in held.candidates(grams, winnow(grams, window), HITS_PER_WORD * least):
        share = covered(hashed, grams, held.words[item], held.grams[item], middles, least, k)
        if share >= least:
            out.append((held.ids[item], share))
    return out


def fingerprints(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, hashes, positions) of a text; hashes as signed numbers."""
    hashed = _hashes(words_of(text))
    grams = gram_hashes(hashed)
    at = winnow(grams)
    return len(hashed), grams[at].view(np.int64), at


_PRINTS = T.StructType(
    [T.StructField("n", T.IntegerType()), T.StructField("prints", T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("place", T.IntegerType())])))]
)


@F.pandas_udf(_PRINTS)
def prints_of(texts: pd.Series) -> pd.DataFrame:
    rows = [fingerprints(t) for t in texts]
    return pd.DataFrame({"n": [n for n, _, _ in rows], "prints": [[{"h": int(h), "place": int(p)} for h, p in zip(hs, ps)] for _, hs, ps in rows]})


_FOUND = T.StructType([T.StructField("h", T.ArrayType(T.LongType())), T.StructField("at", T.ArrayType(T.LongType()))])


def _known_prints(table: Broadcast):
    """The fingerprints of a text, and their positions, that the table holds."""

    def known(texts: pd.Series) -> pd.DataFrame:
        kept = []
        for t in texts:
            _, hashes, at = fingerprints(t)
            bits = hashes & (TABLE_BITS - 1)
            held = np.nonzero((table.value[bits >> 6] >> (bits & 63)) & 1)[0]
            kept.append((hashes[held], at[held]))
        return pd.DataFrame({"h": [h for h, _ in kept], "at": [at for _, at in kept]})

    return F.pandas_udf(known, _FOUND)


def _bit_table(prints: DataFrame) -> np.ndarray:
    """The fingerprints as set bits; the driver gets at most TABLE_BITS / 64 numbers."""
    bit = F.col("h").bitwiseAND(F.lit(TABLE_BITS - 1))
    words = prints.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((h & {TABLE_BITS - 1}) & 63 AS INT))")).alias("b"))
    table = np.zeros(TABLE_BITS // 64, dtype=np.int64)
    for r in words.toLocalIterator():
        table[r.w] = r.b
    return table


def _verifier(least: float):
    def share(texts: pd.Series, items: pd.Series, passages: pd.Series) -> pd.Series:
        held: dict[int, HeldOut] = {}
        out = []
        for text, item, passage in zip(texts, items, passages):
            if (item, passage) not in held:
                if len(held) > 1000:
                    held.clear()
                held[item, passage] = HeldOut.of([(item, passage)])
            found = leaked_items(text, held[item, passage], least)
            out.append(found[0][1] if found else None)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(share, T.DoubleType())


def leak_candidates(documents: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id) of pairs with a band of enough common fingerprints.

    A band is two neighbouring classes of diagonals (position in the document less place in the item); each
    place of the item counts once in a class.
    """
    p = items.withColumn("f", prints_of("passage")).select("item_id", F.col("f.n").alias("n"), F.explode("f.prints").alias("p"))
    p = p.select("item_id", "n", "p.h", "p.place")
    table = documents.sparkSession.sparkContext.broadcast(_bit_table(p))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    d = documents.select("doc_id", _known_prints(table)("text").alias("f"))
    d = d.select("doc_id", F.explode(F.arrays_zip("f.h", "f.at")).alias("f")).select("doc_id", "f.h", "f.at", salt)
    p = p.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    hit = F.struct(F.floor((F.col("at") - F.col("place")) / BAND).alias("b"), "place")
    hits = d.join(p, ["h", "salt"]).groupBy("doc_id", "item_id").agg(F.collect_set(hit).alias("s"), F.first("n").alias("n"))
    enough = f"exists(s, x -> size(filter(s, y -> y.b = x.b OR y.b = x.b + 1)) >= n * {HITS_PER_WORD * least!r}D)"
    return hits.where(enough).select("doc_id", "item_id")


def find_leaks(documents: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, share), distinct: documents that hold at least ``least`` of an item's passage.

    Null or empty texts and passages leak nothing; passages of fewer than three words are too short to tell;
    equal texts under several ids are each reported.  Documents are fingerprinted in one scan, whatever
    the number of items; the second scan reads the texts of candidates.
    """
    held = items.select("item_id", "passage").where("item_id IS NOT NULL AND passage IS NOT NULL").distinct()
    texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    pairs = leak_candidates(texts, held, least).join(held, "item_id").join(texts, "doc_id")
    found = pairs.select("doc_id", "item_id", _verifier(least)("text", "item_id", "passage").alias("share"))
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share")).where("share IS NOT NULL")
