"""Token ids in patched frame-of-reference blocks.

A file holds whole documents: their ids and token counts, an index of block starts, and blocks of 128 ids. Each block
stores its minimum, the differences to it packed at the width that 90 % of them need, and an exception list
(position, value) for the rest. Files are rows of a Parquet table with one ``data`` column, so every store that Spark
writes can hold them; ``export_files`` copies them out one by one.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, compress, islice
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

BLOCK, PERCENTILE, MAGIC = 128, 90, b"PFR1"
FILE_TOKENS = 1 << 20
CACHE_WORDS = 800_000


def _bits(diff: np.ndarray) -> np.ndarray:
    """Bits that each value needs, from the exponent of its double; 0 for 0."""
    return np.maximum((diff.astype(np.float64).view(np.uint64) >> np.uint64(52)).astype(np.int16) - 1022, 0).astype(np.uint8)


def encode_blocks(ids: np.ndarray) -> bytes:
    """Pack unsigned 32-bit ids: header, minima, widths, exception counts, block starts (the index), bits, exceptions."""
    n = len(ids)
    nb = -(-n // BLOCK)
    padded = np.full(nb * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    rows = padded.reshape(nb, BLOCK)
    low = rows.min(axis=1) if nb else np.zeros(0, np.uint32)
    diff = rows - low[:, None]
    bits, rank = _bits(diff), int(BLOCK * PERCENTILE / 100)
    width = np.partition(bits, rank, axis=1)[:, rank] if nb else np.zeros(0, np.uint8)
    odd_row, odd_at = np.nonzero(bits > width[:, None])
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    packed = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        size = 2 if w <= 16 else 4
        planes = np.unpackbits(diff[at].astype(f"<u{size}").view(np.uint8).reshape(len(at), BLOCK, size), axis=2, bitorder="little")[:, :, :w]
        body = np.packbits(planes.reshape(len(at), -1), axis=1, bitorder="little")
        packed[(starts[at][:, None] + np.arange(body.shape[1]))] = body
    counts = np.bincount(odd_row, minlength=nb).astype(np.uint8)
    parts = (low.astype("<u4"), width, counts, starts[:-1].astype("<u8"), packed, odd_at.astype(np.uint8), diff[odd_row, odd_at].astype("<u4"))
    return b"".join([MAGIC, struct.pack("<QQQ", n, len(packed), len(odd_row)), *(p.tobytes() for p in parts)])


def decode_blocks(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive; None: all that follow). Only the blocks that hold them are unpacked: the index gives their place."""
    if data[:4] != MAGIC:
        raise ValueError("not a block file")
    n, size, odd = struct.unpack_from("<QQQ", data, 4)
    nb, at = -(-n // BLOCK), 28

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    low, width, counts, starts = take("<u4", nb), take("u1", nb), take("u1", nb), take("<u8", nb).astype(np.int64)
    packed, odd_at, odd_value = take("u1", size), take("u1", odd), take("<u4", odd)
    last = n if last is None else min(last, n)
    b0, b1 = min(first // BLOCK, nb), -(-last // BLOCK)
    odd_from, odd_to = int(counts[:b0].sum(dtype=np.int64)), int(counts[:b1].sum(dtype=np.int64))
    low, width, counts, starts = low[b0:b1], width[b0:b1], counts[b0:b1], starts[b0:b1]
    rows = np.zeros((len(low), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        at_w = np.flatnonzero(width == w)
        body = packed[starts[at_w][:, None] + np.arange(int(w) * (BLOCK // 8))]
        planes = np.zeros((len(at_w), BLOCK, 32), np.uint8)
        planes[:, :, :w] = np.unpackbits(body, axis=1, bitorder="little").reshape(len(at_w), BLOCK, w)
        rows[at_w] = np.packbits(planes, axis=2, bitorder="little").reshape(len(at_w), BLOCK * 4).view("<u4")
    rows[np.repeat(np.arange(len(low)), counts), odd_at[odd_from:odd_to]] = odd_value[odd_from:odd_to]
    return (rows + low[:, None]).reshape(-1)[first - b0 * BLOCK : max(last - b0 * BLOCK, 0)]


_HOLE, _END = b"\xff\xff\xff\xff", b"\xfe\xff\xff\xff"


class _Known(dict):
    """Ids of pieces as bytes. A piece that is not known is noted and stands as a hole."""

    def __init__(self):
        super().__init__({"": b"", "\n": _END})
        self.missed: list[str] = []

    def __missing__(self, piece: str) -> bytes:
        self.missed.append(piece)
        return _HOLE


def cut(text: str | None) -> list[str]:
    """Pieces of a text between white space, in lower case where that cannot change their tokens, and the end mark ``\\n``.

    In Latin-1 every character is composed already and has a lower-case form of its own, so such texts are lowered whole,
    unless they hold ``<|`` (added tokens are matched on raw text) or separators that are white space to Python only. Of other texts
    only the pieces of plain ASCII are lowered."""
    if not text:
        return ["\n"]
    if "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        try:
            text.isascii() or text.encode("latin-1")
            return [*text.lower().split(), "\n"]
        except UnicodeEncodeError:
            pass
    return [*(p.lower() if p.isascii() and "<|" not in p else p for p in text.replace("\n", " ").split(" ")), "\n"]


class WordEncoder:
    """Token ids of texts. A tokenizer that drops white space, lowers letters and marks the last token of each word gets texts cut at
    white space, where no token or normalisation can span; pieces are looked up in a bounded cache, so that the library
    encodes each piece about once, plain words many at a time. With any other tokenizer whole texts are encoded."""

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(Path(path).read_text())
        self.by_piece = _cuts_at_blanks(form)
        self.known = _Known()
        self.last, self.plain = np.zeros(0, bool), self.tokenizer
        if self.by_piece:
            # lower-case Latin-1 words need no normalisation and are one pre-token each; the library's own cache only costs time here
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            for t in (self.tokenizer, self.plain):
                getattr(t.model, "_resize_cache", lambda n: None)(0)
            vocabulary, suffix = self.tokenizer.get_vocab(), form["model"]["end_of_word_suffix"]
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _ids(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        # a word with one trailing comma or full stop is the word and the mark, two tokens' worth of pieces
        marked = [p for p in pieces if p[-1] in ".," and p[:-1].isalpha()]
        wanted = pieces.difference(marked).union((p[:-1] for p in marked), (p[-1] for p in marked))
        wanted = [p for p in wanted if p not in self.known]
        simple = [p.isalpha() and (p.isascii() or (p.islower() and max(p) < "\u0100")) for p in wanted]
        plain, others = list(compress(wanted, simple)), [p for p, x in zip(wanted, simple, strict=True) if not x]
        for i in range(0, len(plain), 1024):
            part = plain[i : i + 1024]
            (ids,) = self._ids([" ".join(part)], self.plain)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):  # letters to Python that are none to the tokenizer
                others += part
                continue
            data, at = ids.tobytes(), (4 * ends).tolist()
            self.known.update(zip(part, map(data.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True))
        for i in range(0, len(others), 1024):
            part = others[i : i + 1024]
            self.known.update(zip(part, [x.tobytes() for x in self._ids(part)], strict=True))
        self.known.update((p, self.known[p[:-1]] + self.known[p[-1]]) for p in marked)

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, each text's followed by ``end_id``, and the number of ids of each text."""
        if not self.by_piece:
            got = self._ids([t or "" for t in texts])
            end = np.array([end_id], "<u4")
            return np.concatenate([x for g in got for x in (g, end)]) if got else end[:0], np.array([len(g) + 1 for g in got], np.int64)
        known = self.known
        if len(known) > CACHE_WORDS:  # the pieces seen first are the frequent ones
            self.known = _Known()
            self.known.update(islice(known.items(), CACHE_WORDS // 2))
            known = self.known
        ids = np.frombuffer(b"".join(map(known.__getitem__, chain.from_iterable(map(cut, texts)))), "<u4")
        if known.missed:
            missed, known.missed = known.missed, []
            self._learn(set(missed))
            found = [known[p] for p in missed]
            size = np.array([len(x) // 4 for x in found], np.int64)
            hole = ids == 0xFFFFFFFF
            take = np.ones(len(ids), np.int64)
            take[hole] = size
            start = np.cumsum(take) - take
            out = np.empty(int(take.sum()), "<u4")
            out[start[~hole]] = ids[~hole]
            out[np.repeat(start[hole] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = np.frombuffer(b"".join(found), "<u4")
            ids = out
        else:
            ids = ids.copy()
        ends = np.flatnonzero(ids == 0xFFFFFFFE)
        ids[ends] = end_id
        return ids, np.diff(ends, prepend=-1)


def _cuts_at_blanks(form: dict) -> bool:
    """Whether a tokenizer file has the steps that ``WordEncoder`` relies on to cut texts into pieces."""
    norms = (form.get("normalizer") or {}).get("normalizers") or []
    steps = [(x.get("type"), x.get("pattern"), x.get("content")) for x in norms]
    before = (form.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = before[0] if before else {}
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
        and [x.get("type") for x in before] == ["Split", "ByteLevel"]
        and split["behavior"] == "Removed" and split["invert"] and "[^\\s" in split["pattern"].get("Regex", "") and "[\\p{L}]+" in split["pattern"].get("Regex", "")
        and form["model"].get("type") == "BPE" and bool(form["model"].get("end_of_word_suffix"))
        and all(not x["normalized"] and x["content"].startswith("<|") for x in form.get("added_tokens") or [])
    )


FILE_SCHEMA = "part int, seq int, before long, n_docs long, n_tokens long, data binary"


def _file(ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    known = np.array([x is not None for x in ids], np.uint8)
    keys = np.array([0 if x is None else x for x in ids], "<i8")
    return b"".join([struct.pack("<Q", len(ids)), known.tobytes(), keys.tobytes(), lengths.astype("<u8").tobytes(), encode_blocks(tokens)])


def _head(data: bytes) -> tuple[list[int | None], np.ndarray, bytes]:
    (n,) = struct.unpack_from("<Q", data)
    known, keys = np.frombuffer(data, np.uint8, n, 8), np.frombuffer(data, "<i8", n, 8 + n)
    return [int(k) if ok else None for k, ok in zip(keys, known, strict=True)], np.frombuffer(data, "<u8", n, 8 + 9 * n).astype(np.int64), data[8 + 17 * n :]


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and all tokens of one file."""
    ids, lengths, blocks = _head(data)
    return ids, lengths, decode_blocks(blocks)


def read_one(data: bytes, doc_id: int | None) -> list[np.ndarray]:
    """Tokens of each document of that id in one file. Only the blocks that hold them are unpacked."""
    ids, lengths, blocks = _head(data)
    ends = np.cumsum(lengths)
    return [decode_blocks(blocks, int(ends[i] - lengths[i]), int(ends[i])) for i, k in enumerate(ids) if k == doc_id]


def encode_documents(df: DataFrame, tokenizer: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Files of ``df`` (doc_id, text) in ascending doc_id order: ``part`` and ``seq`` order them, ``before`` counts the tokens of the part's
    earlier files. Null texts have the end id only; null doc_ids come first; equal doc_ids are ordered by text."""
    parts = parts or max(df.rdd.getNumPartitions() * 2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select("doc_id", "text").repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        coder, part = WordEncoder.at(tokenizer), TaskContext.get().partitionId()
        seq = before = size = 0
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "before": [before], "n_docs": [len(ids)], "n_tokens": [size], "data": [_file(ids, np.concatenate(lengths), np.concatenate(tokens))]})

        for f in frames:
            for k in range(0, len(f), 512):
                piece = f.iloc[k : k + 512]
                ids += [None if pd.isna(x) else int(x) for x in piece["doc_id"]]
                new, counts = coder.encode([t if isinstance(t, str) else None for t in piece["text"]], end_id)
                tokens.append(new), lengths.append(counts)
                size += len(new)
                if size >= FILE_TOKENS:
                    yield flush()
                    seq, before, size, ids, tokens, lengths = seq + 1, before + size, 0, [], [], []
        if ids:
            yield flush()

    return rows.mapInPandas(run, FILE_SCHEMA)


def read_documents(files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32. One total per part is brought to the driver."""
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base = dict(zip([p for p, _ in totals], np.cumsum([0, *[n for _, n in totals]]).tolist()[:-1], strict=True))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, before, data in zip(f["part"], f["before"], f["data"], strict=True):
                ids, n, tokens = read_file(data)
                ends = np.cumsum(n)
                raw = memoryview(np.ascontiguousarray(tokens, "<u4")).cast("B")
                yield pd.DataFrame({
                    "doc_id": pd.array(ids, "Int64"), "start": base[part] + before + ends - n, "n_tokens": n,
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)],
                })

    return files.select("part", "before", "data").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_files(files: DataFrame, folder: str) -> int:
    """Copy the files to a local folder, one at a time; returns how many."""
    n = 0
    for r in files.select("part", "seq", "data").toLocalIterator():
        Path(folder, f"{r['part']:05d}-{r['seq']:06d}.pfr").write_bytes(r["data"])
        n += 1
    return n


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    files = materialize(encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2), "tokens")
    return read_documents(files)
