"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays.

Statistics come from one vectorised pass over the bytes of a batch. The trees are fitted on a bounded, hash-chosen sample
of the labelled documents (``MAX_TRAIN`` rows) with monotonic constraints: more symbols, repeated words or repeated
lines can never raise a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, U64, mix, pieces, table, tidy, with_fields, word_ranges

MAX_TRAIN = 20_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
# feature: sign of its constraint (0: free)
FEATURES = {
    "n_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 1,
    "digit_share": 0, "upper_share": 0, "ascii_share": 0, "punct_share": 0, "words_per_line": 0,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its (doc, key) was seen before, and whether it occurs twice or more."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    same = np.concatenate([[False], (d[1:] == d[:-1]) & (k[1:] == k[:-1])]) if len(d) else np.zeros(0, bool)
    later = np.zeros(len(doc), bool)
    later[order] = same  # lexsort is stable: the first entry of a run is the earliest
    often = np.zeros(len(doc), bool)
    often[order] = same | np.concatenate([same[1:], [False]]) if len(d) else same
    return later, often


def statistics(texts: list[bytes]) -> pd.DataFrame:
    """Base counts and features of every text of a batch."""
    n = len(texts)
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) if n else np.zeros(0, np.int64)
    doc_of = np.repeat(np.arange(n), np.diff(ends, prepend=0)) if n else np.zeros(0, np.int64)
    count = lambda doc, w=None: np.bincount(doc, weights=w, minlength=n).astype(np.int64)
    roll = Rolling(data)
    ws, we = word_ranges(data)
    wd = doc_of[ws]
    n_words = count(wd)
    heads = (data & 0xC0) != 0x80  # first bytes of code points
    chars = np.concatenate([[0], np.cumsum(heads)])
    word_chars = count(wd, chars[we] - chars[ws])
    n_symbols = count(doc_of, SYMBOLS[data])
    # lines: the separator between documents ends a line too
    le = np.flatnonzero(data == 0x0A)
    ls = np.concatenate([[0], le[:-1] + 1]) if len(le) else le
    has_word = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
    ld = doc_of[le[has_word]]
    later, _ = _repeats(ld, roll.of(ls[has_word], le[has_word]))
    n_dup_lines = count(ld, later)
    n_lines = count(ld)
    wh = roll.of(ws, we)
    three = (wd[2:] == wd[:-2]) if len(wd) > 2 else np.zeros(0, bool)
    at = np.flatnonzero(three)
    h = mix(wh[at] * U64(3) + mix(wh[at + 1] * U64(5) + mix(wh[at + 2])))
    _, often = _repeats(wd[at], h)
    covered = np.zeros(len(wd), bool)
    for k in range(3):
        covered[at[often] + k] = True
    n_repeat = count(wd, covered)
    seen, _ = _repeats(wd, wh)
    words, size = np.maximum(n_words, 1), np.maximum(count(doc_of, heads) - 1, 1)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    punct = np.isin(data, np.frombuffer(b".,;:!?", np.uint8))
    return pd.DataFrame({
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "mean_word": word_chars / words, "symbol_share": n_symbols / words, "dup_line_share": n_dup_lines / np.maximum(n_lines, 1), "repeat_share": n_repeat / words,
        "distinct_share": 1 - count(wd, seen) / words, "digit_share": count(doc_of, digit) / size, "upper_share": count(doc_of, upper) / size,
        "ascii_share": count(doc_of, data < 128) / size, "punct_share": count(doc_of, punct) / size, "words_per_line": n_words / np.maximum(n_lines, 1),
    })


class Trees:
    """Boosted trees of equal depth in flat arrays: node i of a tree has children 2i+1 and 2i+2."""

    def __init__(self, bias: float, depth: int, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, threshold: float = 0.0):
        self.bias, self.depth, self.feature, self.cut, self.leaf, self.threshold = bias, depth, feature, cut, leaf, threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of features."""
        rows, out = np.arange(len(x)), np.full(len(x), self.bias)
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - len(f)]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, reg: float = 5.0) -> Trees:
    """Logistic boosting on histogram splits. A constrained split must order its children's values, and each child's values
    stay on its side of their midpoint all the way down."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p0 / (1 - p0)))
    out, inner = np.full(len(y), bias), (1 << depth) - 1
    feats, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        bounds = {0: (-np.inf, np.inf)}
        node = np.zeros(len(y), np.int64)
        for i in range(inner):
            low, high = bounds[i]
            here, best = np.flatnonzero(node == i), (1e-6, None)
            value = lambda a, b, low=low, high=high: np.clip(a / (b + reg), low, high)
            gain = lambda a, b, v: v * a - 0.5 * v * v * (b + reg)
            G, H = g[here].sum(), h[here].sum()
            whole = gain(G, H, value(G, H))
            for f in range(x.shape[1]):
                k = len(cuts[f])
                if not k or len(here) < 20:
                    continue
                gl = np.cumsum(np.bincount(binned[here, f], g[here], k + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[here, f], h[here], k + 1))[:-1]
                vl, vr = value(gl, hl), value(G - gl, H - hl)
                score = gain(gl, hl, vl) + gain(G - gl, H - hl, vr) - whole
                score[(signs[f] * (vr - vl) < 0) | (hl < 1) | (H - hl < 1)] = -np.inf
                j = int(np.argmax(score))
                if score[j] > best[0]:
                    best = (score[j], (f, j, float(vl[j]), float(vr[j])))
            if best[1] is None:
                bounds[2 * i + 1] = bounds[2 * i + 2] = bounds[i]
                node[here] = 2 * i + 1
                continue
            f, j, a, b = best[1]
            feature[i], cut[i] = f, cuts[f][j]
            middle = (a + b) / 2
            left, right = (low, high), (low, high)
            if signs[f] > 0:
                left, right = (low, middle), (middle, high)
            elif signs[f] < 0:
                left, right = (middle, high), (low, middle)
            bounds[2 * i + 1], bounds[2 * i + 2] = left, right
            node[here] = 2 * i + 1 + (binned[here, f] > j)
        G, H = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        limits = np.array([bounds[inner + k] for k in range(inner + 1)])
        leaf = rate * np.clip(G / (H + reg), limits[:, 0], limits[:, 1])
        out = out + leaf[node - inner]
        feats.append(feature), thresholds.append(cut), leaves.append(leaf)
    return Trees(bias, depth, np.array(feats), np.array(thresholds), np.array(leaves))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, keep_recall: float = 0.998) -> Trees | None:
    """Fit on the ``max_train`` labelled documents with the smallest hash of doc_id; None without two classes. The threshold is the
    score that ``keep_recall`` of the good documents of every fifth (held-out) row reach, at most 0.5."""
    picked = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64(F.lit(10), "doc_id")).limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    @tidy
    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (p for frame in frames for p in pieces(frame, "text")):
            out = statistics([(t or "").encode() for t in f["text"]])[list(FEATURES)]
            out.insert(0, "doc_id", f["doc_id"].to_numpy())
            out["quality"] = f["quality"].to_numpy()
            yield out

    got = rows.mapInPandas(measure, "doc_id long, " + ", ".join(f"{c} double" for c in FEATURES) + ", quality int").toPandas().sort_values("doc_id", kind="stable")
    x, y = got[list(FEATURES)].to_numpy(float), got["quality"].to_numpy(float)
    if len(y) < 50 or y.min() == y.max():
        return None
    held = np.arange(len(y)) % 5 == 4
    model = fit(x[~held], y[~held], np.array(list(FEATURES.values())))
    good = model.score(x[held & (y > 0)])
    model.threshold = float(min(0.5, np.quantile(good, 1 - keep_recall))) if len(good) else 0.0
    return model


def judge(df: DataFrame, model: Trees | None) -> DataFrame:
    """All columns of ``df`` with the base counts, ``base_failed``, ``score`` and ``kept``. Needs a ``text`` column; null counts as empty.
    Without a model (no labels) the base rules decide alone. Columns of ``df`` named like the new ones are replaced."""
    new = [*BASE, "base_failed", "score", "kept"]
    df = df.drop(*new)
    schema = with_fields(df, ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, score double, kept boolean")

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (p for frame in frames for p in pieces(frame, "text")):
            s = statistics([t.encode() if isinstance(t, str) else b"" for t in f["text"]])
            failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            score = model.score(s[list(FEATURES)].to_numpy(float)) if model else np.ones(len(f))
            out = pd.concat([f.reset_index(drop=True), s[list(BASE)]], axis=1)
            yield out.assign(base_failed=failed, score=score, kept=~failed & (score >= (model.threshold if model else 0.0)))

    return df.mapInPandas(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *BASE, "base_failed", "kept", F.round("score", 6).alias("score"))
