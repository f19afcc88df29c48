"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Shards of documents are packed on their own, longest piece first. Open bins are ordered by residual; each carries one bitmap of the
sources that are full in it and one of the duplicate clusters it holds. The search starts at the smallest residual that takes the
piece and goes on to the next larger one until a compatible bin is found.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table
from .mixing import words

CAPACITY, SHARD_ROWS, PER_SOURCE = 2_048, 4_096, 2
_WORD = re.compile(r"[^\x20\x09-\x0D]+", re.A)


class Bins:
    """Open bins by residual. ``free`` has a bit for every residual that some bin has, so the successor search skips the rest."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.at: dict[int, dict[int, None]] = defaultdict(dict)
        self.free = 0
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.counts: list[Counter] = []
        self.left: list[int] = []

    def _move(self, b: int, size: int) -> None:
        old = self.left[b]
        if b in self.at[old]:
            del self.at[old][b]
            if not self.at[old]:
                self.free &= ~(1 << old)
        self.left[b] = new = old - size
        if new > 0:
            self.at[new][b] = None
            self.free |= 1 << new

    def add(self, size: int, source: int, cluster: int | None) -> int:
        """Bin of a piece: of the compatible bins the one with the smallest residual, of equal ones the oldest; else a new bin."""
        s, c = 1 << source, 0 if cluster is None else 1 << cluster
        residual, found = size, -1
        while found < 0 and (rest := self.free >> residual):
            residual += (rest & -rest).bit_length() - 1
            found = next((b for b in self.at[residual] if not (self.sources[b] & s or self.clusters[b] & c)), -1)
            residual += 1
        if found < 0:
            found = len(self.left)
            self.left.append(self.capacity), self.sources.append(0), self.clusters.append(0), self.counts.append(Counter())
        self.counts[found][source] += 1
        if self.counts[found][source] >= self.per_source:
            self.sources[found] |= s
        self.clusters[found] |= c
        self._move(found, size)
        return found


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[tuple[int, int, int, int]]:
    """(row, first word, words, bin) of every piece. Rows of over ``capacity`` words are cut into full pieces and a rest."""
    source_of = {s: i for i, s in enumerate(dict.fromkeys(sources))}
    often = {c: i for i, c in enumerate(c for c, n in Counter(clusters).items() if n > 1)}
    pieces = [(min(capacity, n - k), i, k) for i, n in enumerate(sizes) for k in range(0, max(n, 1), capacity) if n]
    bins, out = Bins(capacity, per_source), []
    for n, i, k in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        # pieces of one long document never meet: all but its last fill a bin
        out.append((i, k, n, bins.add(n, source_of[sources[i]], often.get(clusters[i]))))
    return out


PACKED = "sequence_id string, position int, doc_id long, first_word long, n_words long, source string, text string"


def pack(df: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS, seed: int = 3) -> DataFrame:
    """One row per piece of ``df`` (doc_id, text, source): sequence, place in it, words and text of the piece.

    A sequence holds at most ``capacity`` words, ``per_source`` pieces of one source and one document of each cluster of equal texts.
    Documents without words have no piece; nulls are a source of their own; repeated rows are copies of each other.
    Rows are dealt to shards by a hash of their content and id, about ``shard_rows`` to a shard.
    """
    shards = max(1, -(-df.count() // shard_rows))
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source").withColumn("n", words(F.col("text")))
    rows = rows.withColumn("cluster", F.xxhash64("text")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "cluster"), F.lit(shards)).cast("int"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "cluster", "source"], kind="stable").reset_index(drop=True)
        got = sorted(pack_shard(f["n"].tolist(), f["source"].tolist(), f["cluster"].tolist(), capacity, per_source), key=lambda p: (p[3], -p[2], p[0], p[1]))
        shard, place, out = int(f["shard"].iloc[0]), Counter(), []
        ids, texts, sources = f["doc_id"].tolist(), f["text"].tolist(), f["source"].tolist()
        for i, k, n, b in got:
            text = texts[i]
            if k or n < f["n"].iat[i]:
                spans = [m.span() for m in _WORD.finditer(text)]
                text = text[spans[k][0] if k else 0 : spans[k + n][0] if k + n < len(spans) else len(text)]
            out.append((f"{shard:06d}-{b:06d}", place[b], None if pd.isna(ids[i]) else int(ids[i]), k, n, sources[i], text))
            place[b] += 1
        release()
        return pd.DataFrame(out, columns=["sequence_id", "position", "doc_id", "first_word", "n_words", "source", "text"]).astype({"doc_id": "Int64"})

    return rows.groupBy("shard").applyInPandas(run, PACKED)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
