"""Removal of repeated byte strings, and finding of repeated passages of words, with a suffix array built by the difference-cover algorithm.

A suffix array over all symbols (bytes or words) of a corpus would hold almost only strings that occur once, so the array is built over
what is left after two exact reductions:

1. Every window of ``length`` symbols names one anchor, the shorter string in it with the least fingerprint. Windows that are equal
   have equal anchors at equal places. Anchors that occur once are dropped; runs of windows whose whole context occurs
   twice are repeated, and only one copy of each context goes on.
2. The windows that are left are cut into blocks of neighbours. All windows of a block hold its core; blocks whose core
   occurs once are dropped, and a core becomes a single symbol.

The remaining strings (some symbols, a core symbol, some symbols) are dealt out by core. In each deal the difference-cover algorithm
sorts sampled triples, recurses on their names, merges the remaining suffixes, and adjacent prefixes are compared.
Cores with too many contexts for one task are decided by grouping their windows, symbols and all, in SQL.
Anchors and contexts are told apart by fingerprints of 64 bits each with bases of their own, cores by 128 bits of BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, U64, batch_rows, discard, materialize, mix, pieces, signed, table, tidy, word_hashes, word_ranges


class Unit(NamedTuple):
    """What windows are made of: the anchor's and the block's length, the bytes of a symbol, the fewest text bytes of n symbols."""

    name: str
    anchor: int
    block: int
    width: int

    def symbols(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        return data if self.name == "bytes" else word_hashes(data, *word_ranges(data))

    def least_bytes(self, n: int) -> int:
        return n if self.name == "bytes" else 2 * n - 1


BYTES, WORDS = Unit("bytes", 256, 36, 1), Unit("words", 16, 14, 8)
BUNDLE_ROWS, HOT_ROWS = 8_000, 40_000
OUT_ROWS = 5_000  # blocks handed on together: a table for each document costs more than its blocks
_BLOCK = ["doc_id", "th", "lo", "hi", "at", "core", "core2", "c", "left", "right"]
SLICE = 1 << 20  # windows of a text looked at together
PIECE = 1 << 17  # bytes of texts looked at together
HOT_KEYS, SALTS = 2_048, 64
NO_ID = -(1 << 63)  # stands for a null doc_id in joins
_PLACE = U64((1 << 28) - 1)
_CONTEXT_BASE = 0xD1342543DE82EF95


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers by the difference cover of 3, each step over whole arrays."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
    a = sample[order]
    new = np.ones(len(a), bool)
    new[1:] = (t[a[1:]] != t[a[:-1]]) | (t[a[1:] + 1] != t[a[:-1] + 1]) | (t[a[1:] + 2] != t[a[:-1] + 2])
    names = np.zeros(len(sample), np.int64)
    names[order] = np.cumsum(new)
    rank = np.zeros(n + 3, np.int64)
    if new.all():
        rank[sample] = names
    else:
        rank[sample[suffix_array(names)]] = np.arange(1, len(sample) + 1)
    real = sample[sample < n]
    s12 = real[np.argsort(rank[real], kind="stable")]
    zero = np.arange(0, n, 3)
    s0 = zero[np.lexsort((rank[zero + 1], t[zero]))]
    one, two = s12[s12 % 3 == 1], s12[s12 % 3 == 2]
    big = np.int64(len(sample) + 2)
    before = np.searchsorted(t[one] * big + rank[one + 1], t[s0] * big + rank[s0 + 1])
    pairs = np.unique(np.concatenate([t[two], t[s0]]) * np.int64(t.max() + 1) + np.concatenate([t[two + 1], t[s0 + 1]]), return_inverse=True)[1]
    before = before + np.searchsorted(pairs[: len(two)] * big + rank[two + 2], pairs[len(two) :] * big + rank[s0 + 2])
    at = np.arange(len(s0)) + before
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = s0, s12
    return out


def anchors(data: np.ndarray, length: int, unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first and last start, anchor place, fingerprints of anchor and context."""
    found = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, U64)] * 2]
    for first in range(0, len(data) - length + 1, SLICE):
        lo, hi, p, anchor, ctx, _ = _anchors(data[first : first + SLICE + length - 1], length, unit.anchor, np.zeros(1, np.int64))
        found.append([lo + first, hi + first, p + first, anchor, ctx])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(data: np.ndarray, length: int, size: int, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``anchors``, over texts of at least ``length`` symbols that begin at ``starts``, and the number of each run's text."""
    width = length - size + 1
    roll = Rolling(data)
    at = np.arange(len(data) - size + 1)
    h = roll.of(at, at + size)
    least = (h & ~_PLACE) | at.astype(U64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    place = (least & _PLACE).astype(np.int64)
    over = np.append(starts[1:], len(data)) - length + 1  # the first window of each text that would reach into the next
    edge = np.unique(np.concatenate([np.flatnonzero(place[1:] != place[:-1]) + 1, starts, over]))
    lo, hi = edge[:-1], edge[1:] - 1
    text = np.searchsorted(starts, lo, side="right") - 1
    inside = lo < over[text]
    lo, hi, text = lo[inside], hi[inside], text[inside]
    p = place[lo]
    return lo, hi, p, h[p], Rolling(data, _CONTEXT_BASE).of(lo, hi + length) ^ mix((p - lo).astype(U64)), text


def _anchors_of(texts: list[bytes], length: int, unit: Unit) -> tuple[np.ndarray, ...]:
    """As ``_anchors`` for whole texts, with places counted from the start of each."""
    if len(texts) == 1:
        found = anchors(unit.symbols(texts[0]), length, unit)
        return *found, np.zeros(len(found[0]), np.int64)
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if unit.name == "bytes":  # by name: a unit that travelled to a worker is another object
        keep = np.ones(len(data), bool)
        keep[begin[1:-1] - 1] = False
        data, counts = data[keep], np.diff(begin) - 1
    else:
        ws, we = word_ranges(data)
        data, counts = word_hashes(data, ws, we), np.diff(np.searchsorted(ws, begin))
    fit = counts >= length
    data, which = data[np.repeat(fit, counts)], np.flatnonzero(fit)
    if not len(which):
        return *[np.zeros(0, np.int64)] * 3, *[np.zeros(0, U64)] * 2, which
    starts = np.cumsum(counts[fit]) - counts[fit]
    lo, hi, p, anchor, ctx, text = _anchors(data, length, unit.anchor, starts)
    return lo - starts[text], hi - starts[text], p - starts[text], anchor, ctx, which[text]


def _runs(length: int, unit: Unit):
    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part in pieces(f, "text", limit=PIECE):
                lo, hi, p, anchor, ctx, text = _anchors_of([t.encode() for t in part["text"]], length, unit)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[text], "th": part["th"].to_numpy()[text], "lo": lo, "hi": hi, "p": p, "anchor": signed(anchor), "ctx": signed(ctx)})

    return run


def _blocks(length: int, unit: Unit):
    """Blocks of undecided runs with the symbols left and right of their core."""
    size, w = unit.block, unit.width

    def blocks(k: int, th: int, text: bytes, lo: np.ndarray, hi: np.ndarray, p: np.ndarray, c: np.ndarray) -> tuple:
        b = (p - hi) // size
        count = (p - lo) // size - b + 1
        run = np.repeat(np.arange(len(lo)), count)
        b = b[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        core = p[run] - b * size
        end = core - size + 1 + length
        first, last = np.maximum(lo[run], core - size + 1), np.minimum(hi[run], core)
        names, left, right = [], [], []
        for i, j, x, y in zip((core * w).tolist(), (end * w).tolist(), (first * w).tolist(), ((last + length) * w).tolist(), strict=True):
            names.append(hashlib.blake2b(text[i:j], digest_size=16).digest())
            left.append(text[x:i])
            right.append(text[j:y])
        name = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
        return np.full(len(run), k), np.full(len(run), th), first, last, core, name[:, 0], name[:, 1], c[run], left, right

    def joined(out: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*out, strict=True))
        numbers = {name: np.concatenate(x) for name, x in zip(_BLOCK, columns[:8], strict=False)}
        return pd.DataFrame(numbers | {"left": list(chain(*columns[8])), "right": list(chain(*columns[9]))})

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, out, rows = zstandard.ZstdDecompressor(), [], 0
        for f in frames:
            for k, th, z, *runs in zip(*(f[c] for c in ("doc_id", "th", "z", "lo", "hi", "p", "c")), strict=True):
                text = unpack.decompress(z)
                if unit.name != "bytes":
                    text = unit.symbols(text).tobytes()
                # a long text has many runs: so many at a time as make about one table
                for a in range(0, len(runs[0]), OUT_ROWS):
                    out.append(blocks(k, th, text, *(np.asarray(x[a : a + OUT_ROWS], np.int64) for x in runs)))
                    rows += len(out[-1][0])
                    if rows >= OUT_ROWS:
                        yield joined(out)
                        out, rows = [], 0
        if out:
            yield joined(out)

    return run


def decide(f: pd.DataFrame, unit: Unit = BYTES, across: bool = False) -> pd.DataFrame:
    """Repeated windows of blocks (core, core2, left, right, lo, hi, at, c): suffix array over the collapsed blocks, then adjacent
    prefixes of a block's length compared; a window also counts as repeated where its block occurs more than once (c). With
    ``across`` only windows that also start in another document count."""
    f = f.reset_index(drop=True)
    cores = f.groupby(["core", "core2"], sort=False).ngroup().to_numpy()
    n, w, kind = len(f), unit.width, "u1" if unit.width == 1 else "<u8"
    left, right = f["left"].tolist(), f["right"].tolist()
    size_a, size_b = (np.array([len(x) for x in side], np.int64) // w for side in (left, right))
    ends = np.cumsum(size_a + size_b + 2)
    starts = ends - (size_a + size_b + 2)
    names, symbols = np.unique(np.frombuffer(b"".join(x for two in zip(left, right, strict=True) for x in two), kind), return_inverse=True)
    s = np.zeros(int(ends[-1]), np.int64)
    s[starts + size_a], s[ends - 1] = len(names) + 1 + cores, len(names) + 1 + n + np.arange(n)
    s[s == 0] = symbols + 1
    s = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    count = (f["hi"] - f["lo"] + 1).to_numpy()
    row = np.repeat(np.arange(n), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(starts, count) + offset
    owner = np.full(len(s), -1)
    owner[at] = np.arange(len(row))
    sa = suffix_array(s)
    sa = sa[owner[sa] >= 0]
    same = np.zeros(len(sa), bool)
    t = np.concatenate([s, np.zeros(unit.block, np.int64)])
    for i in range(0, len(sa) - 1, 1 << 16):
        a, b = sa[i : i + (1 << 16)], sa[i + 1 : i + 1 + (1 << 16)]
        a = a[: len(b)]
        equal = np.ones(len(b), bool)
        for k in range(unit.block):
            equal[equal] = t[a[equal] + k] == t[b[equal] + k]
        same[i + 1 : i + 1 + len(b)] = equal
    twice = f["c"].to_numpy() > 1
    if across:
        doc = f.groupby(["doc_id", "th"], sort=False).ngroup().to_numpy()[row[owner[sa]]]
        first = np.flatnonzero(~same)
        many = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) | np.logical_or.reduceat(twice[row[owner[sa]]], first)
        repeated = many[np.cumsum(~same) - 1]
    else:
        repeated = same | np.concatenate([same[1:], [False]])
    got = owner[sa[repeated]]
    got = got[~twice[row[got]]]
    r = row[got]
    at = f["lo"].to_numpy()[r] + offset[got]
    return pd.DataFrame({"doc_id": f["doc_id"].to_numpy()[r], "th": f["th"].to_numpy()[r], "lo": at, "hi": at})


def _squeeze(f: pd.DataFrame) -> pd.DataFrame:
    """Runs of consecutive windows of one document."""
    if not len(f):
        return f
    f = f.sort_values(["doc_id", "th", "lo"], kind="stable")
    new = (f["doc_id"] != f["doc_id"].shift()) | (f["th"] != f["th"].shift()) | (f["lo"] != f["lo"].shift() + 1)
    return f.groupby(new.cumsum(), sort=False).agg({"doc_id": "first", "th": "first", "lo": "min", "hi": "max"})


SPANS = "doc_id long, th long, lo int, hi int"


def _owners() -> F.Column:
    """Whether the rows of a group are of more than one document, by numbers alone: structs would have to be sorted."""
    return (F.min("doc_id") != F.max("doc_id")) | (F.min("th") != F.max("th"))


def _semi(rows: DataFrame, keys: DataFrame, on: list[str], hot: int) -> DataFrame:
    """Rows whose key is among ``keys`` (with ``n``, its rows). The rows of keys of over ``hot`` rows, of which there are few, are dealt over
    many tasks by a salt. Keys are small and dealt evenly, so each task hashes its own and nothing is sorted."""
    often = F.broadcast(keys.filter(F.col("n") > hot).select(*on, F.lit(True).alias("__hot")))
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), F.lit(SALTS)).cast("int")
    salted = rows.join(often, on, "left").withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(0)).drop("__hot")
    every = F.when(F.col("n") > hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    wanted = keys.select(*on, F.explode(every).alias("__salt"))
    return salted.join(wanted.hint("shuffle_hash"), [*on, "__salt"], "left_semi").select(*rows.columns)


def repeated_windows(df: DataFrame, length: int, unit: Unit = BYTES, across: bool = False) -> DataFrame:
    """``doc_id, th, lo, hi``: starts of windows of ``length`` symbols that also start elsewhere in the texts of ``df`` (doc_id, th, text);
    with ``across`` only those that also start in a row with another doc_id or th."""
    if length <= unit.anchor + unit.block:
        raise ValueError(f"length must exceed {unit.anchor + unit.block}")
    long_ = df.filter(F.octet_length("text") >= unit.least_bytes(length))
    runs = materialize(long_.mapInPandas(_runs(length, unit), "doc_id long, th long, lo int, hi int, p int, anchor long, ctx long"), "runs")
    hot = max(1, runs.count() // HOT_KEYS)  # so many rows make a key hot: there are 2,048 such keys at most
    copies = F.when(_owners(), 2).otherwise(1) if across else F.least(F.count("*"), F.lit(2))
    often = runs.groupBy("anchor").agg(F.count("*").alias("n"), copies.alias("c")).filter("c > 1").drop("c")
    shared = materialize(_semi(runs, often, ["anchor"], hot), "shared_runs")
    contexts = materialize(shared.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), copies.cast("int").alias("c"), *(F.first(x).alias(x) for x in ("doc_id", "th", "lo", "hi", "p"))), "contexts")
    whole = materialize(_semi(shared, contexts.filter("c > 1").select("anchor", "ctx", "n"), ["anchor", "ctx"], hot).select("doc_id", "th", "lo", "hi"), "whole")
    # contexts that occur once, and those that share their anchor
    open_ = contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.min("c").alias("least")).filter("n > 1 and least = 1").drop("least")
    open_ = _semi(contexts, open_, ["anchor"], hot)
    wanted = open_.filter("n = 1 or c > 1").select("doc_id", "th", "lo", "hi", "p", "c")
    if across:  # contexts that repeat inside one document only: each of them may also start elsewhere
        inside = open_.filter("n > 1 and c = 1").select("anchor", "ctx", "n")
        wanted = wanted.union(_semi(shared, inside, ["anchor", "ctx"], hot).select("doc_id", "th", "lo", "hi", "p", F.lit(1)))
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi", "p", "c")).alias("runs"))
    parts = packed(long_).join(wanted, ["doc_id", "th"]).select("doc_id", "th", "z", "runs.lo", "runs.hi", "runs.p", "runs.c").mapInPandas(_blocks(length, unit), SPANS + ", at int, core long, core2 long, c long, left binary, right binary")
    parts = materialize(parts, "blocks")
    discard(runs, shared, contexts)
    cores = parts.groupBy("core", "core2").agg(F.count("*").alias("n"), F.min("c").alias("least")).filter("n > 1 and least = 1").drop("least")
    near = materialize(parts.join(cores, ["core", "core2"]), "open_blocks")
    bundles = max(1, near.count() // BUNDLE_ROWS)
    small = near.filter(F.col("n") <= HOT_ROWS).withColumn("bundle", F.pmod("core", F.lit(bundles)))
    decided = small.groupBy("bundle").applyInPandas(lambda f: _squeeze(decide(f, unit, across)), SPANS)
    hot = near.filter(F.col("n") > HOT_ROWS).withColumn("w", F.explode(F.sequence("lo", "hi")))
    before = F.col("at") - F.col("w")
    key = F.concat(F.expr(f"substring(left, (w - lo) * {unit.width} + 1)"), F.expr(f"substring(right, 1, ({unit.block - 1} - (at - w)) * {unit.width})"))
    hot = hot.select("doc_id", "th", "c", "w", "core", "core2", before.alias("before"), key.alias("key"))
    names = ["core", "core2", "before", "key"]
    total = F.when(_owners(), 2).otherwise(F.max("c")) if across else F.sum("c")
    counted = hot.groupBy(*names).agg(total.alias("copies")).filter("copies > 1").drop("copies")
    hot = hot.filter("c = 1").join(counted, names, "left_semi").select("doc_id", "th", F.col("w").alias("lo"), F.col("w").alias("hi"))
    return whole.union(decided).union(hot)


def packed(df: DataFrame) -> DataFrame:
    """``doc_id, th, z``: texts compressed for the shuffle."""

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "th": f["th"], "z": [pack.compress(t.encode()) for t in f["text"]]})

    return df.mapInPandas(run, "doc_id long, th long, z binary")


def _covered(size: int, lo: np.ndarray | None, hi: np.ndarray | None, length: int) -> np.ndarray:
    """Which of ``size`` symbols lie in a window that starts at lo to hi of one of the spans."""
    if lo is None:
        return np.zeros(size, bool)
    edge = np.bincount(lo, minlength=size + 1) - np.bincount(np.asarray(hi) + length, minlength=size + 1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(df: DataFrame, length: int = 400, passage: int = 51) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, kept`` (the remaining bytes) for each row of ``df`` (doc_id, text).

    A byte goes where a ``length``-byte string that covers it also starts anywhere else. n_passage_words counts the words that lie in a
    string of ``passage`` words (between ASCII white space) that another document holds too; nothing is removed for that. Texts are judged as
    UTF-8 bytes, null as empty; texts shorter than a window lose nothing; long texts are read in slices. Rows that repeat a doc_id and text
    count as documents of their own for bytes (they lose the same bytes) and as one for passages; a null doc_id is a doc_id like others. Other
    columns of ``df`` play no part. An empty table gives no rows. ``kept`` may end in the midst of a code point, so it is binary.
    """
    with batch_rows(df.sparkSession, 1_000):
        return _remove_repeats(df, length, passage)


def _remove_repeats(df: DataFrame, length: int, passage: int) -> DataFrame:
    docs = df.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text", "doc_id").alias("th"), "text")
    spans = {}
    for name, unit, size in (("spans", BYTES, length), ("passages", WORDS, passage)):
        windows = repeated_windows(docs, size, unit, unit.name == "words")
        spans[name] = materialize(windows.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias(name)).select("doc_id", "th", *(F.col(f"{name}.{c}").alias(f"{name}_{c}") for c in ("lo", "hi"))), name)
    found = spans["spans"].join(spans["passages"], ["doc_id", "th"], "full")

    @tidy
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for f in frames:
            out = []
            for k, z, lo, hi, words_lo, words_hi in zip(*(f[c] for c in f.columns), strict=True):
                text = unpack.decompress(z) if z[:4] == b"\x28\xb5\x2f\xfd" else b""
                gone = _covered(len(text), lo, hi, length)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                shared = int(_covered(len(text.split()), words_lo, words_hi, passage).sum()) if words_lo is not None else 0
                out.append((k, len(text), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest(), shared, kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept"])

    got = packed(docs).join(found, ["doc_id", "th"], "left").select("doc_id", "z", "spans_lo", "spans_hi", "passages_lo", "passages_hi").mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, kept binary")
    return got.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 400 bytes, and its words in passages of over 50 words that another document holds."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
