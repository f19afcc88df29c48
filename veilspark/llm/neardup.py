"""Near-duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

SuperMinHash gives each element a random permutation of the signature's slots and ranks that grow along it, so an element
stops as soon as no slot of its document can still fall. Documents with equal sets count as one. Documents that share a
band are compared in rounds: first each with one central document of its bands, then every pair that still lies in
different components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, batch_rows, discard, materialize, mix, pieces, release, signed, table, tidy, word_hashes, word_ranges
from .components import components

SLOTS, ROWS = 128, 4
# Fewest equal 8-bit slots of a pair worth verifying: 6.7 standard deviations below what a similarity of 0.8 gives.
LEAST_EQUAL = 72
ELEMENTS = 1 << 17
TEXT_ROWS = 1_000
_STEP = 0x9E3779B97F4A7C15


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index and two independent hashes of every distinct shingle, sorted by the first. Words are cut at ASCII white space and lower-cased A-Z."""
    data = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    doc_of_end = np.cumsum([len(t) + 1 for t in texts])
    ws, we = word_ranges(data)
    wd = np.searchsorted(doc_of_end, ws, side="right")
    n_words = np.bincount(wd, minlength=len(texts))
    at = np.flatnonzero(wd[size - 1 :] == wd[: len(wd) - size + 1]) if len(wd) >= size else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    runs = [(at, size)] + [(first[n_words == k], k) for k in range(1, size)]
    d = np.concatenate([wd[x] for x, _ in runs])

    def hashes(which: int) -> np.ndarray:
        wh, out = word_hashes(data, ws, we, which), []
        for x, k in runs:
            h = np.full(len(x), k, U64)
            for j in range(k):
                h = mix(h * U64(0x100000001B3) + wh[x + j])
            out.append(h)
        return np.concatenate(out)

    h, g = hashes(0), hashes(1)
    order = np.lexsort((h, d))
    d, h, g = d[order], h[order], g[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new], g[new]


def superminhash(doc: np.ndarray, h: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n x slots) of n documents from their elements' hashes; documents without elements have infinite slots."""
    sig = np.full(n * slots, np.inf)
    for i in range(0, len(doc), ELEMENTS):
        _lower(sig, doc[i : i + ELEMENTS], h[i : i + ELEMENTS], n, slots)
    return sig.reshape(n, slots)


def _lower(sig: np.ndarray, doc: np.ndarray, h: np.ndarray, n: int, slots: int) -> None:
    """Put some elements into the signatures."""
    perm: np.ndarray | None = None
    for j in range(slots):
        if not len(doc):
            break
        rank = (mix(h + U64((2 * j + 1) * _STEP % (1 << 64))) >> U64(12)).astype(np.float64) / float(1 << 52) + j
        k = j + (mix(h + U64((2 * j + 2) * _STEP % (1 << 64))) % U64(slots - j)).astype(np.int64)
        rows = np.arange(len(doc))
        if perm is None:
            slot = k
        else:
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, doc * slots + slot, rank)
        # a document is done when its largest slot lies below every rank still to come
        open_ = (sig.reshape(n, slots).max(axis=1) >= j + 1)[doc]
        if j == 0:
            doc, h, k = doc[open_], h[open_], k[open_]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(doc), 1))
            perm[np.arange(len(doc)), k] = 0
        elif not open_.all():
            doc, h, perm = doc[open_], h[open_], perm[open_]


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(U64)
    out = np.tile(np.arange(sig.shape[1] // rows, dtype=U64), (len(sig), 1))
    for r in range(rows):
        out = mix(out * U64(0x100000001B3) + bits[:, r::rows])
    return out


def _sketch(size: int):
    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        for f in frames:
            for part in pieces(f, "text", limit=1 << 19):
                texts = [t.encode() if isinstance(t, str) else b"" for t in part["text"]]
                d, h, g = shingle_sets(texts, size)
                n = len(part)
                count = np.bincount(d, minlength=n)
                starts = np.searchsorted(d, np.arange(n))
                total = lambda x: np.concatenate([[U64(0)], np.cumsum(x, dtype=U64)])
                a, b = total(mix(h)), total(mix(g))
                ends = starts + count
                sig = superminhash(d, h, n)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "th": part["th"].to_numpy(), "n": count.astype(np.int64), "f1": signed(a[ends] - a[starts]), "f2": signed(b[ends] - b[starts]),
                    "sig": [x.tobytes() for x in (mix(np.ascontiguousarray(sig).view(U64)) & U64(255)).astype(np.uint8)], "bands": list(signed(_bands(sig, ROWS))),
                    "z": [pack.compress(t) for t in texts],
                })

    return run


def exact_names(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index and name of every shingle, equal names for equal words and no others: words are numbered, then pairs of numbers."""
    split = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    padded = np.where(counts > 0, np.maximum(counts, size), 0)
    ids, words = pd.factorize(np.array(list(chain.from_iterable(split)), object))
    ends = np.cumsum(padded)
    flat = np.full(int(ends[-1]) if len(ends) else 0, len(words), np.int64)  # a text of few words is filled up with a number of its own
    flat[np.arange(len(ids)) + np.repeat(ends - padded - np.cumsum(counts) + counts, counts)] = ids
    doc = np.repeat(np.arange(len(texts)), padded)
    at = np.flatnonzero(doc[size - 1 :] == doc[: len(doc) - size + 1]) if len(doc) >= size else np.zeros(0, np.int64)
    name = flat[at]
    for k in range(1, size):
        name = pd.factorize(name * (len(words) + 1) + flat[at + k])[0]
    return doc[at], name


def _similar(size: int, percent: int):
    """Pairs (a, b) of which the full sets of both texts overlap enough, compared word by word."""

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for f in frames:
            for i in range(0, len(f), 128):
                part = f.iloc[i : i + 128].reset_index(drop=True)
                part["a_"], part["b_"] = ([unpack.decompress(z) for z in part[c]] for c in ("z_a", "z_b"))
                for some in pieces(part, "a_", "b_", limit=1 << 19):
                    n = len(some)
                    d, name = exact_names([*some["a_"], *some["b_"]], size)
                    left, right = (pd.DataFrame({"p": d[x] % n, "s": name[x]}).drop_duplicates() for x in (d < n, d >= n))
                    count = np.bincount(left["p"], minlength=n) + np.bincount(right["p"], minlength=n)
                    shared = np.bincount(left.merge(right, on=["p", "s"])["p"], minlength=n)
                    ok = (shared > 0) & (100 * shared >= percent * (count - shared))
                    yield pd.DataFrame({"u": some["a"].to_numpy()[ok], "v": some["b"].to_numpy()[ok]})

    return run


def _full_sets(size: int):
    """The distinct shingles of each text, as the bytes of sorted 64-bit hashes."""

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for f in frames:
            for i in range(0, len(f), 128):
                rep, texts = f["rep"].to_numpy()[i : i + 128], [unpack.decompress(z) for z in f["z"][i : i + 128]]
                d, h, _ = shingle_sets(texts, size)
                cuts = np.searchsorted(d, np.arange(len(texts) + 1))
                yield pd.DataFrame({"rep": rep, "shingles": [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    return run


def _block_links(percent: int):
    """Links that join components, of one pair of blocks (or of one block with itself).

    Every pair in different components whose sizes are near enough and that agrees in enough slots is verified on full sets,
    here and not as a row of its own. Components that a link joins count as one from then on, so a pair of blocks gives fewer
    links than it has components.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["own", "rep"]).reset_index(drop=True)
        left = (f["own"] == f["p"]).to_numpy()
        right = np.flatnonzero((f["own"] == f["q"]).to_numpy())
        rep, n = f["rep"].to_numpy(), f["n"].to_numpy()
        comp = np.unique(f["comp"].to_numpy(), return_inverse=True)[1]
        sig = np.stack([np.frombuffer(x, np.uint8) for x in f["sig"]])
        sets = [np.frombuffer(x, U64) for x in f["shingles"]]
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        mine = np.zeros(len(names), np.int64)
        u, v = [], []
        for r in np.flatnonzero(left):
            at = right[(comp[right] != comp[r]) & (100 * np.minimum(n[r], n[right]) >= percent * np.maximum(n[r], n[right]))]
            at = at[(sig[at] == sig[r]).sum(axis=1) >= LEAST_EQUAL]
            if not len(at):
                continue
            own = ids[starts[r] : starts[r + 1]]
            mine[own] = 1
            for some in np.array_split(at, 1 + int(n[at].sum()) // (1 << 22)):
                size = n[some]
                ends = np.cumsum(size)
                shared = np.add.reduceat(mine[ids[np.repeat(starts[some] - ends + size, size) + np.arange(ends[-1])]], ends - size)
                for k in some[100 * shared >= percent * (n[r] + size - shared)]:
                    if comp[k] != comp[r]:
                        u.append(rep[r]), v.append(rep[k])
                        comp[comp == comp[k]] = comp[r]
            mine[own] = 0
        out = pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})
        del f, sig, sets, names, ids, mine
        release()
        return out

    return run


def _open_links(open_: DataFrame, sets: DataFrame, texts: DataFrame, size: int, percent: int, block: int, shingles: int) -> DataFrame:
    """Links between documents of different components that share a band (band, key, rep, comp), enough to join what belongs together.

    Buckets that share documents form a cluster; a document goes there once, not once for each band. Within a cluster, documents
    meet those of their own class of set sizes and of the two next to it (further ones are too small or too large), in pairs of
    blocks of about ``block`` documents or ``shingles`` shingles. The largest component of a cluster does not meet itself.
    """
    buckets = open_.groupBy("band", "key").agg(F.min("rep").alias("v"))
    cluster = components(open_.join(buckets, ["band", "key"]).select(F.col("rep").alias("u"), "v").distinct())
    rows = open_.select("rep", "comp").distinct().join(cluster.select(F.col("u").alias("rep"), F.col("v").alias("cluster")), "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep"))
    width = -math.log(percent / 100)
    rows = materialize(rows.join(sets.select("rep", "n", "sig"), "rep").withColumn("class", F.floor(F.log("n") / width).cast("int")), "open")
    largest = rows.groupBy("cluster", "comp").count().groupBy("cluster").agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"))
    rows = rows.join(largest, "cluster").withColumn("rest", F.col("comp") != F.col("largest")).drop("largest")
    blocks = rows.groupBy("cluster", "class", "rest").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / shingles)).cast("int").alias("blocks"))
    rows = rows.join(blocks, ["cluster", "class", "rest"])
    own = F.struct("class", "rest", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    met = blocks.select("cluster", F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])).alias("class"), F.col("class").alias("other_class"), F.col("rest").alias("other_rest"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other_block"))
    placed = rows.withColumn("own", own).join(met, ["cluster", "class"]).filter("rest or other_rest")
    other = F.struct(F.col("other_class").alias("class"), F.col("other_rest").alias("rest"), F.col("other_block").alias("block"))
    placed = placed.select("cluster", "rep", "comp", "n", "sig", "own", F.least("own", other).alias("p"), F.greatest("own", other).alias("q"))
    named = [F.to_json(c).alias(c) for c in ("own", "p", "q")]
    full = texts.join(rows.select("rep").distinct(), "rep", "left_semi").select("rep", "z").mapInPandas(_full_sets(size), "rep long, shingles binary")
    return placed.select("cluster", "rep", "comp", "n", "sig", *named).join(full, "rep").groupBy("cluster", "p", "q").applyInPandas(_block_links(percent), "u long, v long")


def near_duplicates(df: DataFrame, size: int = 4, percent: int = 80, star_rounds: int = 2, block: int = 1024, shingles: int = 1 << 19) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash, stays`` for each row of ``df`` (doc_id, text).

    Two documents are linked where their sets of distinct ``size``-word shingles have at least ``percent`` % in common, compared
    word by word; documents whose sets have one size and equal 128-bit sums of hashes count as copies. A text of fewer words is one shingle; texts
    without words (null, empty, blank) are linked with nothing. component_id is the smallest doc_id reachable. Rows with a null doc_id are
    linked with nothing and kept is null. Rows that repeat a doc_id are rows of their own, with the text they have: ``text_hash`` tells them
    apart, and ``stays`` marks the one of each component with the smallest doc_id, then text_hash (rows equal in both are marked alike).
    Long texts are read in slices. Other columns of ``df`` play no part. An empty table gives no rows. A pair at the threshold is missed with a
    probability of 5e-8 (32 bands of 4 slots), and in the last step of 3e-10 (fewer than 72 of 128 equal slots).
    """
    spark = df.sparkSession
    with batch_rows(spark, TEXT_ROWS):
        return _near_duplicates(df.select("doc_id", "text", F.xxhash64("text").alias("th")), size, percent, star_rounds, block, shingles)


def _near_duplicates(docs: DataFrame, size: int, percent: int, star_rounds: int, block: int, shingles: int) -> DataFrame:
    sketched = materialize(docs.mapInPandas(_sketch(size), "doc_id long, th long, n long, f1 long, f2 long, sig binary, bands array<long>, z binary"), "sketches")
    least = F.min(F.struct("doc_id", "th"))
    # rep numbers the sets: rows that repeat a doc_id may belong to several
    sets = sketched.filter("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(least.alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    sets = materialize(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")
    in_band = sets.select("rep", F.posexplode("bands").alias("band", "key"))
    crowded = in_band.groupBy("band", "key").agg(F.count("*").alias("c")).filter("c > 1")
    members = materialize(in_band.join(crowded.drop("c"), ["band", "key"]), "band_members")
    wanted = sets.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "least.doc_id", "least.th")
    texts = materialize(wanted.join(sketched.select("doc_id", "th", "z"), ["doc_id", "th"]).groupBy("rep").agg(F.min("z").alias("z")), "band_texts")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("z").alias("z_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("z").alias("z_b")), "b")
        return both.select("a", "b", "z_a", "z_b").mapInPandas(_similar(size, percent), "u long, v long")

    def with_component(rows: DataFrame, links: DataFrame | None) -> DataFrame:
        if links is None:
            return rows.withColumn("comp", F.col("rep"))
        return rows.join(links.select(F.col("u").alias("rep"), F.col("v").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    links: DataFrame | None = None
    for r in range(star_rounds):
        now = with_component(members, links)
        order = F.struct(F.xxhash64(F.lit(r), "rep"), F.col("rep").alias("rep"), F.col("comp").alias("comp"))
        least, most = F.min(order).alias("least"), F.max(order).alias("most")
        # of each bucket two members in a seeded order; each document meets the one that most of its bands name
        hubs = now.groupBy("band", "key").agg(least, most, F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").drop("c1", "c2")
        met = now.join(hubs, ["band", "key"]).select("rep", "comp", F.explode(F.array(F.struct("least.rep", "least.comp"), F.struct("most.rep", "most.comp"))).alias("hub")).filter("hub.comp <> comp")
        met = met.groupBy("rep", F.col("hub.rep").alias("hub")).count()
        best = met.groupBy("rep").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
        pairs = best.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
        found, before = verified(pairs), links
        links = components(found if links is None else found.union(links))
        if before is not None:
            discard(before)

    now = with_component(members, links)
    mixed = now.groupBy("band", "key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").drop("c1", "c2")
    mixed = materialize(now.join(mixed, ["band", "key"]), "mixed")
    found = materialize(_open_links(mixed, sets, texts, size, percent, block, shingles), "open_links")
    checked = verified(found.select(F.col("u").alias("a"), F.col("v").alias("b")))
    links, before = components(checked if links is None else checked.union(links)), links
    discard(members, texts, mixed, found, *([] if before is None else [before]))
    groups = with_component(sets.select("rep", "least", "f1", "f2", "n"), links)
    names = groups.groupBy("comp").agg(F.min("least").alias("first"))
    groups = groups.join(names, "comp").select("f1", "f2", "n", "first")
    out = sketched.select("doc_id", "th", "n", "f1", "f2").join(groups, ["f1", "f2", "n"], "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.coalesce("first.doc_id", "doc_id")).otherwise(F.col("doc_id"))
    stays = ~linked | ((F.col("first.doc_id") == F.col("doc_id")) & F.col("first.th").eqNullSafe(F.col("th")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("th").alias("text_hash"), F.coalesce(stays, F.lit(True)).alias("stays"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "text_hash", "stays")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by four-word shingles, 80 % in common."""
    return near_duplicates(table(spark, sf_dir, "documents"))
