"""Quality classifier: Bradley-Terry pairwise ranking over document statistics.

Every text becomes a row of surface statistics. Each statistic is cut into bins at
exact quantiles of all labelled rows of the training folds, so the ranking score is an additive function of
step functions. Preference pairs (a document labelled 1 over one labelled 0) give
the logistic loss on feature differences; each round takes all pairs, within shards
whose weights are averaged. The cut lies at the quantile of the
scores that equals the share of label 0, and the score is mapped to 0..1 so that
the cut falls on THRESHOLD.

Defined results: a null text counts as empty; the empty text has a score like any
other; a null doc_id belongs to the held-out fold; repeated rows are scored alike and
count once in the fit;
without labelled rows of both kinds every score is 1; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, fold, raw_texts, slices

#: Rows that sample_labelled() takes at most, those with the lowest hash of the id.
FIT_ROWS = 20_000
#: Labelled rows that are fitted together, about.
SHARD_ROWS = 20_000
ROUNDS = 300
#: The scores of either label are dealt to so many points, between two by proportion, to sum over all pairs.
POINTS = 1024
THRESHOLD = 0.3
FOLDS = 5
BINS = 12

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_SYMBOL = b"#*$%&|<>{}[]\\^~@=_+/"
_END = b".!?"
_HIGH = bytes(range(128, 256))

FEATURES = (
    "log_words", "distinct_words", "adjacent_repeats", "top_word", "distinct_pairs", "mean_word", "long_words",
    "upper", "lower", "digits", "symbols", "ends", "bang", "pipes", "high_bytes", "log_lines", "distinct_lines",
    "short_lines", "end_words", "symbol_words", "single_words", "longest_word", "commas", "odd_tail",
)


def features(text: bytes) -> list[float]:
    """The statistics of one text."""
    size = len(text) or 1
    words = text.split()
    n = len(words) or 1
    distinct = set(words)
    tops = Counter(words).most_common(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = len(lines) or 1
    lengths = list(map(len, words))
    without = lambda chars: (size - len(text.translate(None, chars)) if text else 0) / size
    tails = Counter(w[-2:] for w in words)
    return [
        math.log1p(len(words)), len(distinct) / n, sum(map(eq, words, words[1:])) / n, (tops[0][1] if tops else 0) / n,
        len(set(zip(words, words[1:]))) / n, sum(lengths) / n, sum(x > 15 for x in lengths) / n,
        without(_UPPER), without(_LOWER), without(_DIGIT), without(_SYMBOL), without(_END), without(b"!"), without(b"|"),
        without(_HIGH), math.log1p(len(lines)), len(set(lines)) / m, sum(len(x) < 40 for x in lines) / m,
        sum(v for k, v in tails.items() if k[-1:] in (b".", b"!", b"?")) / n,
        sum(v for k, v in tails.items() if k[-1:] in b"#*$%&|<>{}[]=_+/\\") / n,
        sum(x == 1 for x in lengths) / n, math.log1p(max(lengths, default=0)), text.count(b",") / n,
        max(tails.values(), default=0) / n,
    ]


@dataclass
class Ranker:
    """edges: (features, BINS - 1) bin edges; weights: (features, BINS); score = sigmoid(scale * (latent - cut) + logit of THRESHOLD)."""

    edges: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        # Statistics count as float32, in the fit and in the score.
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.astype(np.float32).T.astype(float), strict=True)], axis=1)

    def latent(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.weights[np.arange(b.shape[1]), b].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.ones(len(x))
        z = self.scale * (self.latent(x) - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _ordered(x: np.ndarray) -> np.ndarray:
    """float32 values as numbers of 32 bits in the same order."""
    bits = (x.astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def _value(bits: int) -> float:
    bits = bits ^ (1 << 31) if bits >> 31 else bits ^ 0xFFFFFFFF
    return float(np.array([bits], dtype=np.uint32).view(np.float32)[0])


def order_statistics(rows: DataFrame, ranks: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int, int], float]:
    """(y, j, rank) to the value of that rank, from 0, in column j of x among all rows (x array<float>, y) of that y.

    Each pass counts the values by some more of their leading bits, those only that start like a value that is looked for."""
    found = {(y, j, r): (0, r) for (y, j), many in ranks.items() for r in many}  # leading bits, rank among values that start so
    for before, shift in ((32, 16), (16, 8), (8, 0)):
        starts: dict[tuple[int, int], list[int]] = {}
        for (y, j, _), (start, _) in found.items():
            starts.setdefault((y, j), []).append(start)

        def run(batches: Iterator[pa.RecordBatch], before=before, shift=shift, starts=starts) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                bits, y = _ordered(x).astype(np.int64), batch.column("y").to_numpy()
                for (c, j), wanted in starts.items():
                    own = bits[y == c, j]
                    lead, n = np.unique(own[np.isin(own >> before, wanted)] >> shift, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c, np.int32)), pa.array(np.full(len(n), j, np.int32)), pa.array(lead), pa.array(n)], ["y", "j", "lead", "n"])

        counts = rows.select("x", "y").mapInArrow(run, "y int, j int, lead long, n long").groupBy("y", "j", "lead").agg(F.sum("n").alias("n"))
        # 2^16 rows of a column at most in the first pass, 2^8 of a rank in the others.
        got: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in counts.collect():
            got.setdefault((r.y, r.j), []).append((r.lead, r.n))
        table = {k: np.array(sorted(v), dtype=np.int64) for k, v in got.items()}
        for (y, j, r), (start, left) in found.items():
            own = table[y, j]
            own = own[own[:, 0] >> (before - shift) == start]
            ends = np.cumsum(own[:, 1])
            at = int(np.searchsorted(ends, left, side="right"))
            found[y, j, r] = int(own[at, 0]), int(left - ends[at] + own[at, 1])
    return {k: _value(bits) for k, (bits, _) in found.items()}


def quantiles(rows: DataFrame, wanted: dict[tuple[int, int], list[float]], counts: dict[int, int]) -> dict[tuple[int, int], np.ndarray]:
    """Quantiles, between two values by proportion, of all values of column j of the counts[y] rows of y; wanted: (y, j) to shares."""
    places = {(y, j): np.array(q) * (counts[y] - 1) for (y, j), q in wanted.items()}
    got = order_statistics(rows, {k: sorted({int(f(x)) for x in p for f in (math.floor, math.ceil)}) for k, p in places.items()})
    return {
        (y, j): np.array([got[y, j, math.floor(x)] + (x - math.floor(x)) * (got[y, j, math.ceil(x)] - got[y, j, math.floor(x)]) for x in p.tolist()])
        for (y, j), p in places.items()
    }


def fit_pairs(codes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by (feature, bin) of a Bradley-Terry fit: all pairs of a row labelled 1 with a row labelled 0, by Adam on the
    logistic loss of their feature difference. A row's share of the gradient is the mean, over all rows of the other label, of the
    chance that the pair is the wrong way round; it comes from the distribution of their scores on POINTS points."""
    good = y == 1
    sign = np.where(good, -1 / good.sum(), 1 / (~good).sum())
    at = codes.astype(np.int32) + np.arange(codes.shape[1], dtype=np.int32) * BINS
    w = np.zeros(codes.shape[1] * BINS)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):
        s = w[at].sum(axis=1)
        width = max(1e-9, float(np.ptp(s))) / (POINTS - 1)
        place = (s - s.min()) / width
        low = np.minimum(place.astype(np.int64), POINTS - 2)
        part = place - low
        ups, downs = (np.bincount(low[c], 1 - part[c], POINTS) + np.bincount(low[c] + 1, part[c], POINTS) for c in (good, ~good))
        wrong = 1 / (1 + np.exp(-np.clip(width * np.arange(1 - POINTS, POINTS), -50, 50)))  # by score of the 0 less score of the 1
        of_good, of_bad = np.correlate(wrong, downs / downs.sum(), "valid")[::-1], np.convolve(wrong, ups / ups.sum(), "valid")
        p = np.where(good, (1 - part) * of_good[low] + part * of_good[low + 1], (1 - part) * of_bad[low] + part * of_bad[low + 1])
        g = np.bincount(at.ravel(), np.repeat(sign * p, at.shape[1]), len(w)) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w.reshape(codes.shape[1], BINS)


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """(text, label) of the documents of at most `rows` labelled ids outside the held-out fold; the ids with the lowest hash are taken."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(FOLDS, F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` rows of two numbers: safe to broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, x, y) of all documents labelled 0 or 1 outside the held-out fold: statistics and label; rows equal in all are one.

    The statistics and not the texts are shuffled."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(t) for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])

    trains = F.col("doc_id").isNotNull() & (fold(FOLDS, F.col("doc_id")) != 0)
    known = labels.where(F.col(label).isNotNull() & trains).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where("y IN (0, 1)")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(trains).mapInArrow(measure, "doc_id long, x array<float>")
    return rows.join(known, "doc_id").distinct()


def fit(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> Ranker:
    """Bins, weights, cut and scale from all labelled rows. Weights are fitted in shards of about shard_rows rows, dealt by
    id, and averaged by rows; the driver holds quantiles and weights only."""
    rows = durable(labelled(docs, labels, "quality"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        discard(rows)
        return Ranker(np.empty((0, BINS - 1)), np.empty((0, BINS)), 0.0, 1.0)
    marks = np.linspace(0, 1, BINS + 1)[1:-1].tolist()
    # Quantiles of either class, so that a rare class has bins of its own.
    cuts = quantiles(rows, {(y, j): marks[1 - y :: 2] for y in (0, 1) for j in range(len(FEATURES))}, counts)
    edges = np.stack([np.sort(np.concatenate([cuts[1, j], cuts[0, j]])) for j in range(len(FEATURES))])
    ranker = Ranker(edges, np.zeros((len(FEATURES), BINS)), 0.0, 1.0)
    total = sum(counts.values())
    # Every shard is to have rows of both labels.
    shards = max(1, min(total // shard_rows, min(counts.values()) // 100))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            codes, y = (np.concatenate(x) for x in zip(*parts, strict=True))
            if y.min() != y.max():
                yield pa.RecordBatch.from_pydict({"shard": [shard], "n": [len(y)], "w": [fit_pairs(codes, y).ravel().tolist()]})

        shard, parts = None, []
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            codes, y, of = ranker.bins(x).astype(np.uint8), batch.column("y").to_numpy(), batch.column("shard").to_numpy()
            for s in np.unique(of).tolist():
                if s != shard and parts:
                    yield from done(parts)
                    parts = []
                shard = s
                parts.append((codes[of == s], y[of == s]))
        if parts:
            yield from done(parts)

    while True:
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "x"), F.lit(shards))).repartition("shard").sortWithinPartitions("shard", "doc_id", "x")
        got = sorted(dealt.select("shard", "x", "y").mapInArrow(train, "shard long, n long, w array<double>").collect(), key=lambda r: r.shard)
        if sum(r.n for r in got) == total:
            break
        # A shard has rows of one label only: they are to be in pairs too.
        shards = max(1, shards // 2)
    ranker.weights = np.average([r.w for r in got], axis=0, weights=[r.n for r in got]).reshape(len(FEATURES), BINS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The latent score of each row, under its label and under 2 for all rows."""
        for batch in batches:
            s = ranker.latent(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)).astype(np.float32)
            y = batch.column("y").to_numpy()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(2 * len(s) + 1, dtype=np.int32)), pa.array(np.concatenate([s, s])))
            yield pa.RecordBatch.from_arrays([lists, pa.array(np.concatenate([y, np.full_like(y, 2)]))], ["x", "y"])

    latent = rows.mapInArrow(place, "x array<float>, y int")
    at = quantiles(latent, {(0, 0): [0.5], (1, 0): [0.5], (2, 0): [counts[0] / total]}, counts | {2: total})
    ranker.cut = float(at[2, 0][0])
    ranker.scale = 4 / max(1e-6, float(at[1, 0][0] - at[0, 0][0]))
    discard(rows)
    return ranker


def score(docs: DataFrame, ranker: Ranker, keep: list[str] | None = None) -> DataFrame:
    """Adds score to the columns in keep (all by default); docs needs text."""
    keep = docs.columns if keep is None else keep
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").alias("text"))
    schema = ", ".join(f"c{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in raw_texts(batch)]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ranker.score(x))], [*batch.schema.names[:-1], "score"])

    out = inner.mapInArrow(rate, f"{schema}, score double" if schema else "score double")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "score")
