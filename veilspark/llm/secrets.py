"""Secret scans: fixed patterns and generic high-entropy tokens are candidates; a character convolutional network in numpy
scores each candidate with its surrounding context.

The network is trained on labelled findings: those of all documents themselves (what the fixed patterns find is a secret, every other
candidate is none) and those that ``labelled_findings`` writes from seeded templates, as the tables hold few kinds of secrets. The
findings are dealt to blocks of about ``PART`` windows; in each round every block takes the common weights through one pass over its
windows and the templates, and the mean over the blocks, weighted by their windows, goes into the next round (``fitted``). Its scores
are calibrated by a logistic fit on all held-out findings (every fourth source), and the threshold is the largest that keeps ``RECALL``
of the held-out secrets. ``findings_of`` and ``trained`` do the same on the driver with a bounded sample; the query does not use them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_rows, discard, materialize, table, tidy, with_fields

# fixed patterns; hex runs shorter than 24 would be dropped, so only maximal runs of 24 or more are looked for
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex")
WINDOW, BEFORE, AFTER = 48, 20, 8
WIDTH = BEFORE + WINDOW + AFTER
RECALL = 0.98
MAX_DOCS, MAX_FINDINGS = 4_000, 2_000  # of findings_of only
TEMPLATES, ROUNDS = 2_400, 6
PART, GATHERED = 4_096, 32  # windows of a block; blocks whose weights are added up before they go to the driver

_CLASSES = "0123456789abcdefghijklmnopqrstuvwxyz"
SYMBOL = np.full(128, 41, np.int8)
for _i, _c in enumerate(_CLASSES):
    SYMBOL[ord(_c)] = _i + 1
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    SYMBOL[ord(_c)] = 42 + ord(_c) - 65
SYMBOL[[32, 9, 10]] = 37
SYMBOL[[ord("="), ord(":")]] = 38
SYMBOL[[ord('"'), ord("'")]] = 39
SYMBOL[[ord("_"), ord("-"), ord("."), ord("/"), ord("+")]] = 40
N_SYMBOLS = 68


def windows(text: str, start: int, end: int) -> np.ndarray:
    """One row of symbols per 48 characters of the candidate, each with the context before and after the whole of it."""
    code = lambda s: SYMBOL[np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"), 127).astype(np.int64)]
    left, right = code(text[max(0, start - BEFORE) : start]), code(text[end : end + AFTER])
    body = code(text[start:end])
    out = np.zeros((max(1, -(-len(body) // WINDOW)), WIDTH), np.int8)
    for i, row in enumerate(out):
        part = body[i * WINDOW : (i + 1) * WINDOW]
        row[BEFORE - len(left) : BEFORE] = left
        row[BEFORE : BEFORE + len(part)] = part
        row[BEFORE + WINDOW : BEFORE + WINDOW + len(right)] = right
    return out


class CharCnn:
    """Embedding, one convolution of width 5, global maximum over candidate and context, one hidden layer, logistic output."""

    def __init__(self, seed: int = 7, dim: int = 8, filters: int = 24, hidden: int = 16, span: int = 5):
        r = np.random.default_rng(seed)
        self.span = span
        self.p = {
            "e": r.normal(0, 0.5, (N_SYMBOLS, dim)), "w": r.normal(0, 0.25, (span * dim, filters)), "b": np.zeros(filters),
            "v": r.normal(0, 0.3, (2 * filters, hidden)), "c": np.zeros(hidden), "u": r.normal(0, 0.3, hidden), "d": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> dict:
        p, n = self.p, len(x)
        emb = p["e"][x]
        cols = np.lib.stride_tricks.sliding_window_view(emb, self.span, axis=1).transpose(0, 1, 3, 2).reshape(n, WIDTH - self.span + 1, -1)
        act = np.maximum(cols @ p["w"] + p["b"], 0)
        top, mean = act.argmax(axis=1), act.mean(axis=1)
        pooled = np.concatenate([act.max(axis=1), mean], axis=1)
        hid = np.maximum(pooled @ p["v"] + p["c"], 0)
        return {"cols": cols, "act": act, "top": top, "pooled": pooled, "hid": hid, "z": hid @ p["u"] + p["d"][0]}

    def flat(self, m: dict, v: dict) -> np.ndarray:
        """Weights and moments as one array."""
        return np.concatenate([a.ravel() for part in (self.p, m, v) for a in part.values()])

    def unflat(self, values: np.ndarray) -> tuple[dict, dict]:
        """Weights taken from what ``flat`` gave; the moments are returned."""
        cuts, i = [], 0
        for _ in range(3):
            cuts.append({})
            for name, a in self.p.items():
                cuts[-1][name] = values[i : i + a.size].reshape(a.shape).copy()
                i += a.size
        self.p = cuts[0]
        return cuts[1], cuts[2]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = ROUNDS, batch: int = 64, rate: float = 4e-3, seed: int | list[int] = 7, at: tuple[dict, dict, int] | None = None) -> tuple[dict, dict, int]:
        """Adam on the logistic loss; goes on from the moments and steps ``at`` and returns the new ones."""
        r, p = np.random.default_rng(seed), self.p
        m, v, t = at or ({k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                some = order[i : i + batch]
                f = self._forward(x[some])
                n, k = len(some), p["w"].shape[1]
                dz = (1 / (1 + np.exp(-f["z"])) - y[some]) / n
                dh = np.outer(dz, p["u"]) * (f["hid"] > 0)
                dpool = dh @ p["v"].T
                dact = np.repeat(dpool[:, None, k:] / f["act"].shape[1], f["act"].shape[1], axis=1)
                np.add.at(dact, (np.arange(n)[:, None], f["top"], np.arange(k)[None]), dpool[:, :k])
                dact *= f["act"] > 0
                dcols = (dact @ p["w"].T).reshape(n, dact.shape[1], self.span, -1)
                demb = np.zeros((n, WIDTH, p["e"].shape[1]))
                for s in range(self.span):
                    demb[:, s : s + dact.shape[1]] += dcols[:, :, s]
                de = np.zeros_like(p["e"])
                np.add.at(de, x[some], demb)
                grads = {"e": de, "w": (f["cols"].transpose(0, 2, 1) @ dact).sum(0), "b": dact.sum((0, 1)), "v": f["pooled"].T @ dh, "c": dh.sum(0), "u": f["hid"].T @ dz, "d": np.array([dz.sum()])}
                t += 1
                for name, g in grads.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    p[name] -= rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
        return m, v, t

    def calibrate(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, group: np.ndarray, recall: float = RECALL) -> None:
        """Logistic scale and shift of the raw score on held-out findings, then the threshold that keeps ``recall`` of the positives of each
        group (templates, tables). A finding's score is the largest of its windows (rows of ``x``; ``owner`` is its place in ``y``), as in a scan."""
        z, a, b = np.full(len(y), -np.inf), 1.0, 0.0
        np.maximum.at(z, owner, self._forward(x)["z"])
        for _ in range(300):
            q = 1 / (1 + np.exp(-(a * z + b)))
            a, b = a - 0.05 * float(((q - y) * z).mean()), b - 0.05 * float((q - y).mean())
        self.scale, self.shift = a, b
        p = 1 / (1 + np.exp(-(a * z + b)))
        self.threshold = min((float(np.quantile(p[(y > 0) & (group == g)], 1 - recall, method="lower")) for g in np.unique(group[y > 0])), default=0.5)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = [self._forward(x[i : i + 2048])["z"] for i in range(0, len(x), 2048)]
        return np.concatenate(out) if out else np.zeros(0)

    def chance(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * z + self.shift)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.chance(self.raw(x))


def labelled_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """``n`` candidates in context (text, start, end) with label 1 for secrets: random keys of several alphabets against long words,
    identifiers, paths, dashes, rulers and numbers."""
    r = np.random.default_rng(seed)
    pick = lambda s, k: "".join(np.array(list(s))[r.integers(0, len(s), k)])
    word = lambda: pick("etaoinshrdlu", 1 + int(r.integers(2, 9)))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    out, label = [], []
    for _ in range(n):
        k, lead = int(r.integers(20, 65)), " ".join(word() for _ in range(4)) + " "
        if good := bool(r.integers(0, 2)):
            body = [pick("0123456789abcdef", k), pick(lower + upper + digits, k), pick(lower + upper + digits + "+/", k) + "=", "AKIA" + pick(upper + digits, 16), "ghp_" + pick(lower + upper + digits, 36)][int(r.integers(0, 5))]
            lead += ["", "key=", "password=", 'token = "', "secret: ", "auth "][int(r.integers(0, 6))]
        else:
            body = [
                "".join(word() for _ in range(8))[: max(20, k)].ljust(20, "e"), "_".join(word() for _ in range(6)).ljust(20, "a"), "-" * k, "=" * k, pick(digits, 1) * k,
                "/".join(word() for _ in range(6)).ljust(20, "x"), "".join(word().title() for _ in range(6)).ljust(20, "e"), "-".join(word() for _ in range(4)) + "-" + pick(digits, 4) + "-" * 12,
                "2024-01-02-" + word() + "-" + word() + "-" + word(), word() * 6 + "1" + "a" * 12,
            ][int(r.integers(0, 10))]
            lead += ["", "", "see ", "the "][int(r.integers(0, 4))]
        text = lead + body + ['"', " ", ". ", ""][int(r.integers(0, 4))] + word()
        out.append((text, len(lead), len(lead) + len(body)))
        label.append(good)
    return out, np.array(label, float)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, and as kind ``generic`` all runs of 16 or more key characters that overlap none of them, by start."""
    found, taken, out = base_spans(text), [], []
    for s, e in sorted((s, e) for s, e, _ in found):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    k = 0
    for m in GENERIC.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            out.append((m.start(), m.end(), "generic"))
    return found + out


def _learnt(text: str) -> Iterator[tuple[str, int, int, int]]:
    """Every candidate of ``text`` with its context alone (text, start, end), and label 1 if a fixed pattern found it. An assignment's is its value."""
    for s, e, kind in candidates(text):
        if kind == "assign":
            s = ASSIGN.match(text, s).start(2)
        a = max(0, s - BEFORE)
        yield text[a : e + AFTER], s - a, e - a, int(kind != "generic")


def _fold(df: DataFrame) -> F.Column:
    """Fold 0 to 3 of a row by its source (without one, by doc_id); 3 is held out."""
    return F.pmod(F.xxhash64(F.col("source") if "source" in df.columns else F.col("doc_id").cast("string")), F.lit(4))


def findings_of(df: DataFrame, max_docs: int = MAX_DOCS, max_findings: int = MAX_FINDINGS) -> pd.DataFrame:
    """Labelled findings (text, start, end, label, held) of the ``max_docs`` documents of ``df`` (doc_id, text, and source if there is one) with the
    smallest hash of doc_id: ``max_findings`` of each label at most. An assignment's finding is its value. Every fourth source is held out."""
    picked = df.filter("text is not null").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(7), "doc_id")).limit(max_docs)
    rows = df.select("doc_id", "text", _fold(df).alias("fold")).join(F.broadcast(picked), "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(*x, bool(fold == 3)) for text, fold in zip(f["text"], f["fold"], strict=True) for x in _learnt(text or "")]
            yield pd.DataFrame(out, columns=["text", "start", "end", "label", "held"])

    found = rows.mapInPandas(run, "text string, start int, end int, label int, held boolean").distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("text", "start"), "text", "start"))
    return found.withColumn("place", place).filter(F.col("place") <= max_findings).drop("place").toPandas()


def _rows(found: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    some = [windows(*f) for f in found]
    return np.concatenate(some) if some else np.zeros((0, WIDTH), np.int8), np.repeat(np.arange(len(some)), [len(w) for w in some])


def trained(seen: pd.DataFrame | None = None, seed: int = 7, n: int = TEMPLATES) -> CharCnn:
    """A network fitted on template findings and those of ``seen``, calibrated on every fourth template and the held-out sources."""
    rows, y = labelled_findings(n, seed)
    held = np.arange(n) % 4 == 3
    if seen is not None and len(seen):
        rows = rows + list(seen[["text", "start", "end"]].itertuples(index=False, name=None))
        y, held = np.concatenate([y, seen["label"].to_numpy(float)]), np.concatenate([held, seen["held"].to_numpy(bool)])
    model = CharCnn(seed)
    x, owner = _rows([r for r, h in zip(rows, held, strict=True) if not h])
    model.fit(x, y[~held][owner])
    model.calibrate(*_rows([r for r, h in zip(rows, held, strict=True) if h]), y[held], (np.arange(len(y)) >= n)[held])
    return model


def learnt_windows(df: DataFrame) -> DataFrame:
    """The windows of every finding of all documents of ``df`` (text, and source or doc_id): x (symbols, a byte each), key (of the finding,
    16 bytes of BLAKE2), label, held. What is alike in all four counts once, so copies of a text add nothing. Every fourth source is held out."""

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, out = ["x", "key", "label", "held"], []
        for f in frames:
            for text, fold in zip(f["text"], f["fold"], strict=True):
                for around, s, e, label in _learnt(text or ""):
                    key = hashlib.blake2b(f"{s}:{e}:{around}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    for row in windows(around, s, e):
                        out.append((row.tobytes(), key, label, bool(fold == 3)))
                        if len(out) == 20_000:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
        yield pd.DataFrame(out, columns=columns)

    rows = df.filter("text is not null").select("text", _fold(df).alias("fold"))
    return rows.mapInPandas(run, "x binary, key binary, label int, held boolean").distinct()


def _blocks(found: DataFrame) -> tuple[DataFrame, int, int]:
    """One row (held, shard, x, key, label: arrays of bytes) per about ``PART`` windows of ``found``, dealt by hash, and the number of
    windows to train on and of those held out."""
    n = {r["held"]: r["count"] for r in found.groupBy("held").count().collect()}
    parts = {h: max(1, round(n.get(h, 0) / PART)) for h in (False, True)}
    deal = F.pmod(F.xxhash64("x", "key", "label"), F.when(F.col("held"), parts[True]).otherwise(parts[False])).cast("int")

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["x", "key", "label"])
        return pd.DataFrame({"held": [f["held"].iloc[0]], "shard": [f["shard"].iloc[0]], "x": [b"".join(f["x"])], "key": [b"".join(f["key"])], "label": [f["label"].to_numpy(np.int8).tobytes()]})

    # several times as many partitions as blocks, so that few blocks share a file and they are worked on side by side
    dealt = found.withColumn("shard", deal).repartition(4 * sum(parts.values()), "held", "shard")
    return dealt.groupBy("held", "shard").applyInPandas(pack, "held boolean, shard int, x binary, key binary, label binary"), n.get(False, 0), n.get(True, 0)


def _symbols(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int8).reshape(-1, WIDTH)


def _platt(sums: Callable[[float, float], np.ndarray]) -> tuple[float, float]:
    """Scale and shift of least logistic loss by Newton's method with halved steps. ``sums`` gives, at a scale and shift, the loss, its two
    first and three second derivatives."""
    at = np.array([1.0, 0.0])
    loss, *d = sums(*at)
    for _ in range(50):
        step = np.linalg.solve(np.array([[d[2], d[3]], [d[3], d[4]]]) + 1e-9 * np.eye(2), np.array(d[:2]))
        new, *e = sums(*(at - step))
        while not new <= loss and abs(step).max() > 1e-7:
            step /= 2
            new, *e = sums(*(at - step))
        if new <= loss:
            at, loss, d = at - step, new, e
        if abs(step).max() <= 1e-5:
            break
    return float(at[0]), float(at[1])


def _calibrated(model: CharCnn, blocks: DataFrame, templates: tuple[np.ndarray, np.ndarray], recall: float) -> None:
    """Scale, shift and threshold of ``model`` from all held-out findings (a finding's score is the largest of its windows) and the held-out
    templates. What is summed over the table are decimals, so that the order of the rows changes nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for x, key, label in zip(f["x"], f["key"], f["label"], strict=True):
                keys = [key[i : i + 16] for i in range(0, len(key), 16)]
                yield pd.DataFrame({"key": keys, "label": np.frombuffer(label, np.int8).astype(np.int32), "z": model.raw(_symbols(x))})

    best = blocks.filter("held").select("x", "key", "label").mapInPandas(run, "key binary, label int, z double").groupBy("key", "label").agg(F.max("z").alias("z"))
    best = materialize(best, "secret-scores")
    n = {r["label"]: r["count"] for r in best.groupBy("label").count().collect()}
    z0, y0 = templates
    # targets just inside 0 and 1 (Platt), so that findings which the score parts wholly have a finite fit
    most = 1 - 1 / (n.get(1, 0) + (y0 > 0).sum() + 2)
    least = 1 / (n.get(0, 0) + (y0 == 0).sum() + 2)

    def sums(a: float, b: float) -> np.ndarray:
        u, goal = a * z0 + b, np.where(y0 > 0, most, least)
        q = 1 / (1 + np.exp(-u))
        own = [np.maximum(u, 0) + np.log1p(np.exp(-abs(u))) - goal * u, (q - goal) * z0, q - goal, q * (1 - q) * z0 * z0, q * (1 - q) * z0, q * (1 - q)]
        z, u = F.col("z"), F.lit(float(a)) * F.col("z") + F.lit(float(b))
        goal, q = F.when(F.col("label") == 1, F.lit(float(most))).otherwise(F.lit(float(least))), 1 / (1 + F.exp(-u))
        terms = [F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u))) - goal * u, (q - goal) * z, q - goal, q * (1 - q) * z * z, q * (1 - q) * z, q * (1 - q)]
        row = best.agg(*[F.coalesce(F.sum(t.cast("decimal(28,18)")), F.lit(0)) for t in terms]).first()
        return np.array([float(v) for v in row]) + np.array([v.sum() for v in own])

    model.scale, model.shift = _platt(sums)
    lowest = [np.quantile(z0[y0 > 0], 1 - recall, method="lower")]
    if n.get(1):
        k = int((1 - recall) * (n[1] - 1))
        lowest.append(best.filter("label = 1").select("z").orderBy("z").limit(k + 1).agg(F.max("z")).first()[0])
    model.threshold = float(model.chance(np.array(lowest)).min())
    discard(best)


def fitted(df: DataFrame, seed: int = 7, n: int = TEMPLATES, recall: float = RECALL) -> CharCnn:
    """A network fitted on every finding of all documents of ``df`` outside the held-out sources and on ``n`` templates, calibrated on every
    finding of the held-out sources and every fourth template. Equal tables give equal networks, however their rows are partitioned.

    The work is done in blocks on the executors; the driver gets the sum of ``GATHERED`` blocks' weights at a time, and sums over held-out findings."""
    spark = df.sparkSession
    found = materialize(learnt_windows(df), "secret-windows")
    packed, n_seen, _ = _blocks(found)
    blocks = materialize(packed, "secret-blocks")
    discard(found)
    rows, y = labelled_findings(n, seed)
    held = np.arange(n) % 4 == 3
    x0, owner = _rows([r for r, h in zip(rows, held, strict=True) if not h])
    y0 = y[~held][owner]

    def one(state: np.ndarray, t: int, epoch: int, shard: int, x: np.ndarray, label: np.ndarray) -> tuple[int, int, np.ndarray]:
        """Weight, steps and weighted weights of one block after a pass over its windows and the templates."""
        model = CharCnn(seed)
        m, v = model.unflat(state)
        m, v, steps = model.fit(np.concatenate([x0, x]), np.concatenate([y0, label]), 1, seed=[seed, epoch, shard], at=(m, v, t))
        return len(x0) + len(x), steps, (len(x0) + len(x)) * model.flat(m, v)

    def add(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("shard")
        return pd.DataFrame({"shard": [f["shard"].iloc[0]], "weight": [f["weight"].sum()], "steps": [f["steps"].max()], "state": [sum(np.frombuffer(s) for s in f["state"]).tobytes()]})

    model = CharCnn(seed)
    state, t = model.flat({k: np.zeros_like(a) for k, a in model.p.items()}, {k: np.zeros_like(a) for k, a in model.p.items()}), 0
    none = np.zeros((0, WIDTH), np.int8), np.zeros(0)
    schema = "shard int, weight long, steps long, state binary"
    with batch_rows(spark, 4):
        for epoch in range(ROUNDS):

            @tidy
            def run(frames: Iterator[pd.DataFrame], state: np.ndarray = state, t: int = t, epoch: int = epoch) -> Iterator[pd.DataFrame]:
                for f in frames:
                    for shard, x, label in zip(f["shard"], f["x"], f["label"], strict=True):
                        weight, steps, new = one(state, t, epoch, shard, _symbols(x), np.frombuffer(label, np.int8).astype(float))
                        yield pd.DataFrame({"shard": [shard], "weight": [weight], "steps": [steps], "state": [new.tobytes()]})

            if n_seen:
                own = blocks.filter("not held").select("shard", "x", "label").mapInPandas(run, schema)
                got = add(own.groupBy(F.floor(F.col("shard") / GATHERED)).applyInPandas(add, schema).toPandas())
                weight, t, state = int(got["weight"].iloc[0]), int(got["steps"].iloc[0]), np.frombuffer(got["state"].iloc[0])
            else:
                weight, t, state = one(state, t, epoch, 0, *none)
            state = state / weight
        model.unflat(state)
        x, owner = _rows([r for r, h in zip(rows, held, strict=True) if h])
        z = np.full(held.sum(), -np.inf)
        np.maximum.at(z, owner, model.raw(x))
        _calibrated(model, blocks, (z, y[held]), recall)
    discard(blocks)
    return model


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns in (start, kind) order."""
    low, out = text.lower(), []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def scan(df: DataFrame, model: CharCnn | None = None) -> DataFrame:
    """``df`` with ``secrets``: array of (start, end, kind, score). Needs a ``text`` column; null and empty texts have none.

    The network scores every candidate. Spans of fixed patterns stay whatever their score; other runs of 16 or more key characters
    that overlap no such span are added as kind ``generic`` where the score reaches the threshold. Long texts are scored in parts; repeated
    rows have equal spans; a column named ``secrets`` is replaced, other columns stay. An empty table gives no rows.
    """
    model = model or trained()
    df = df.drop("secrets")
    schema = with_fields(df, "secrets array<struct<start:int,end:int,kind:string,score:double>>")
    order = {k: j for j, k in enumerate((*KINDS, "generic"))}

    def spans(text: str) -> list[dict]:
        found, out = candidates(text), []
        for i in range(0, len(found), 2_048):
            part = found[i : i + 2_048]
            x, owner = _rows([(text, s, e) for s, e, _ in part])
            best = np.zeros(len(part))
            np.maximum.at(best, owner, model.score(x))
            out += [{"start": s, "end": e, "kind": k, "score": float(p)} for (s, e, k), p in zip(part, best, strict=True) if k != "generic" or p >= model.threshold]
        return sorted(out, key=lambda y: (y["start"], order[y["kind"]]))

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(secrets=[spans(t) if isinstance(t, str) else [] for t in f["text"]])

    return df.mapInPandas(run, schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, with a network that is trained and calibrated on the findings of all of them."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs.select("doc_id", "text"), fitted(docs))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            spans = [[(x["kind"], x["start"], x["end"], x["score"]) for x in s] for s in f["secrets"]]
            text = lambda s, base: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in s if k in KINDS or not base)
            yield pd.DataFrame({
                "doc_id": f["doc_id"], **{f"n_{k}": [sum(x[0] == k for x in s) for s in spans] for k in KINDS},
                "base_sha256": [hashlib.sha256(text(s, True).encode()).hexdigest() for s in spans], "spans": [text(s, False) for s in spans],
                "max_score": [max((x[3] for x in s), default=None) for s in spans],
            })

    return found.select("doc_id", "secrets").mapInPandas(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, max_score double")
