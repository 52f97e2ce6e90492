"""Language-model scoring with a log-bilinear neural model, trained by noise contrast.

Words are counted over all training documents. The most frequent words, and the end
of a text, are units of their own; all other words, unseen ones too, share CLUSTERS
units by their spelling (k-means of hashed letter triples). A unit's probability is
the softmax of q . R[u] + b[u], where q adds a vector for each of the last NEAR words
and one for the words before them (BAG of them), so one matrix product for a batch of
tokens gives normalised log-probabilities over all units. The CONTEXT most frequent words
have context vectors of their own, the others share their cluster's. Within a shared unit a word
has (c + 0.1) / (sum over its words of (c + 0.1) + 0.1), the last term for unseen
words; so every context has a distribution over all words.

Training: a warm start on WARM documents, then each shard (dealt by hash, so that it
doesn't matter how the table lies in files) trains on all of its
documents from there, and the results are averaged by tokens. Noise units come from
the unigram distribution, shared by a minibatch.

The counts of the VOCAB most frequent words go to all tasks (a fixed bound); the
others stay distributed and are joined to the texts that use them.

Defined results: a null text counts as empty (one end token); a null doc_id belongs
to fold 0; repeated rows are counted and returned once each; without training
documents c, N and V are 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, raw_texts, row_key, slices

END = b"\n"  # never a word
VOCAB = 1 << 18
HEAD, CLUSTERS = 128, 64
UNITS = HEAD + CLUSTERS
#: Words with context vectors of their own; the others share their cluster's.
CONTEXT = 4096
BEFORE = CONTEXT + CLUSTERS
DIM, NEAR, BAG = 16, 3, 17
WIDE = (NEAR + 1) * DIM
BATCH, NOISE, WARM, WARM_ROUNDS = 2048, 32, 2_000, 3
FEATURES, FIT_WORDS = 16, 20_000
#: Bytes of text that are worked on at once: a slice's unknown words are placed once.
TAKEN = 4 << 20
#: Bytes of text, about, that one task trains on.
SHARD = 16 << 20
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000
SMOOTH = 0.1


def triples() -> np.ndarray:
    return np.random.default_rng(3).standard_normal((1 << 12, FEATURES)).astype(np.float32)


def spelling(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """A unit vector for each word from its letter triples, with marks at both ends."""
    joined = np.frombuffer(b"".join(b"\x02" + w + b"\x03\x03" for w in words), dtype=np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 3)[:-1]])
    code = np.zeros(len(joined), dtype=np.int64)
    code[:-2] = (joined[:-2] * 961 + joined[1:-1] * 31 + joined[2:] * 7919) & 4095
    sums = np.add.reduceat(table[code], starts, axis=0)
    return sums / np.maximum(1e-6, np.linalg.norm(sums, axis=1, keepdims=True))


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centers.T - 0.5 * (centers**2).sum(axis=1), axis=1)


def clusters(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """k-means centers of the words' spellings."""
    if not words:
        return np.zeros((CLUSTERS, FEATURES), dtype=np.float32)
    x = spelling(words, table)
    centers = x[np.random.default_rng(5).choice(len(x), CLUSTERS, replace=len(x) < CLUSTERS)]
    for _ in range(12):
        at = nearest(x, centers)
        n = np.bincount(at, minlength=CLUSTERS)[:, None]
        sums = np.stack([np.bincount(at, x[:, j], CLUSTERS) for j in range(x.shape[1])], axis=1)
        centers = np.where(n > 0, sums / np.maximum(n, 1), centers).astype(np.float32)
    return centers


@dataclass
class Words:
    """What all tasks know of the vocabulary."""

    words: list[bytes]  # the head first, END before all
    counts: np.ndarray
    total: int
    distinct: int
    centers: np.ndarray
    units: np.ndarray  # of the words
    mass: np.ndarray = field(default_factory=lambda: np.zeros(UNITS))  # c + 0.1 of a unit's words, and 0.1
    share: np.ndarray = field(default_factory=lambda: np.zeros(UNITS))  # of the training tokens


class Numbers(dict):
    """Word to number; new words get the next numbers until they are forgotten."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.base, self.new = len(words), []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.base + len(self.new)
        self.new.append(word)
        return n

    def forget(self) -> None:
        for w in self.new:
            del self[w]
        self.new = []


def numbered(texts: list[bytes], numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens, ends included, and where each text starts and stops."""
    split = [t.lower().split() for t in texts]
    for s in split:
        s.append(END)
    ends = np.concatenate([[0], np.cumsum([len(s) for s in split], dtype=np.int64)])
    tokens = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=ends[-1])
    return tokens, ends


def unit_of(words: Words, new: list[bytes], table: np.ndarray) -> np.ndarray:
    """Units of the known words, then of the new ones."""
    return np.concatenate([words.units, HEAD + nearest(spelling(new, table), words.centers)]) if new else words.units


def context_of(words: Words, units: np.ndarray) -> np.ndarray:
    """Context rows of words by number: their own for the first ones, their cluster's for the others."""
    n = np.arange(len(units))
    return np.where(n < min(CONTEXT, len(words.words)), n, CONTEXT + units - HEAD)


@dataclass
class Model:
    """Rows of R (units), b, and context vectors: a row holds NEAR vectors, one for each distance, and one for the bag; row BEFORE stands before a text."""

    out: np.ndarray
    bias: np.ndarray
    near: np.ndarray

    @staticmethod
    def start(share: np.ndarray) -> Model:
        rng = np.random.default_rng(11)
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        return Model(small(UNITS, DIM), np.log(np.maximum(share, 1e-7)).astype(np.float32), small(BEFORE + 1, WIDE))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.out, self.bias, self.near)])

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        shapes = [(UNITS, DIM), (UNITS,), (BEFORE + 1, WIDE)]
        parts = np.split(np.asarray(flat, dtype=np.float32), np.cumsum([math.prod(s) for s in shapes])[:-1])
        return Model(*(p.reshape(s).copy() for p, s in zip(parts, shapes, strict=True)))

    def query(self, context: np.ndarray, first: np.ndarray, a: int, b: int) -> tuple[np.ndarray, tuple]:
        """Query vectors of tokens a..b; first: where each token's text starts."""
        at = np.arange(a, b)
        base = max(0, a - NEAR - BAG)
        rows = self.near[context[base:b]]
        sums = np.zeros((b - base + 1, DIM), dtype=np.float32)
        np.cumsum(rows[:, NEAR * DIM :], axis=0, out=sums[1:])
        hi = np.maximum(np.maximum(at - NEAR, first[a:b]) - base, 0)
        lo = np.maximum(np.maximum(at - NEAR - BAG, first[a:b]) - base, 0)
        q = sums[hi]
        q -= sums[lo]
        q *= np.float32(1 / BAG)
        none = []  # tokens with no word at a distance
        for k in range(1, NEAR + 1):
            part = slice((k - 1) * DIM, k * DIM)
            out = np.flatnonzero(at - k < first[a:b])
            q += rows[np.maximum(at - k - base, 0), part]
            if len(out):
                q[out] += self.near[BEFORE, part] - rows[np.maximum(at[out] - k - base, 0), part]
            none.append(out)
        return q, (base, lo, hi, none)

    def log_probs(self, units: np.ndarray, first: np.ndarray, context: np.ndarray | None = None) -> np.ndarray:
        """Natural log-probability of each token's unit, normalised over all units; context defaults to that of the units."""
        if context is None:
            context = np.where(units < HEAD, units, CONTEXT + units - HEAD)
        res = np.empty(len(units))
        ones = np.ones(UNITS, dtype=np.float32)
        turned = np.ascontiguousarray(self.out.T)
        for a in range(0, len(units), BATCH // 2):  # what fits in a core's cache
            b = min(len(units), a + BATCH // 2)
            q, _ = self.query(context, first, a, b)
            s = q @ turned
            s += self.bias
            own = s[np.arange(b - a), units[a:b]]
            high = s.max(axis=1) if s.max() > 60 else None  # too far for a 32-bit exponential
            if high is not None:
                s -= high[:, None]
                own -= high
            np.exp(s, out=s)
            res[a:b] = own - np.log(s @ ones)
        return res


def _scatter(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows by index."""
    order = (index[:, None] * DIM + np.arange(DIM)).ravel()
    return np.bincount(order, rows.ravel(), n * DIM).reshape(n, DIM)


class Trainer:
    """Noise-contrastive estimation by AdaGrad."""

    def __init__(self, model: Model, share: np.ndarray, rate: float, calm: float, seed: int):
        self.m, self.rate, self.rng = model, rate, np.random.default_rng(seed)
        noise = 0.9 * share / max(1e-9, share.sum()) + 0.1 / UNITS
        self.noise, self.log_noise = noise / noise.sum(), np.log(NOISE * noise / noise.sum()).astype(np.float32)
        self.sq = [np.full(x.shape, calm, dtype=np.float32) for x in (model.out, model.bias, model.near)]
        self.tokens = 0

    def learn(self, units: np.ndarray, context: np.ndarray, first: np.ndarray) -> None:
        for a in range(0, len(units), BATCH):
            self.step(units, context, first, a, min(len(units), a + BATCH))
        self.tokens += len(units)

    def step(self, units: np.ndarray, context: np.ndarray, first: np.ndarray, a: int, b: int) -> None:
        m, y = self.m, units[a:b]
        q, (base, lo, hi, none) = m.query(context, first, a, b)
        drawn = self.rng.choice(UNITS, NOISE, p=self.noise)
        ry, rn = m.out[y], m.out[drawn]
        t = np.einsum("nd,nd->n", q, ry) + m.bias[y] - self.log_noise[y]
        s = q @ rn.T + (m.bias[drawn] - self.log_noise[drawn])
        gt = (-1 / (1 + np.exp(np.clip(t, -30, 30)))).astype(np.float32)
        np.clip(s, -30, 30, out=s)
        np.negative(s, out=s)
        np.exp(s, out=s)
        s += 1
        gn = np.reciprocal(s, out=s)
        dq = gt[:, None] * ry + gn @ rn
        n = np.float32(1 / (b - a))
        d_out = _scatter(y, gt[:, None] * q, UNITS) + _scatter(drawn, gn.T @ q, UNITS)
        d_bias = np.bincount(y, gt, UNITS) + np.bincount(drawn, gn.sum(axis=0), UNITS)
        for x, g, sq in zip((m.out, m.bias), (d_out, d_bias), self.sq, strict=False):
            g = (g * n).astype(np.float32)
            sq += g * g
            x -= self.rate * g / np.sqrt(sq)
        # What each place gets as the word at each distance before a token, and as one of a bag; then summed by context row.
        size = b - base
        rows = np.zeros((size + 1, WIDE), dtype=np.float32)
        for k, out in enumerate(none, 1):
            part = slice((k - 1) * DIM, k * DIM)
            here = dq
            if len(out):
                rows[size, part] = dq[out].sum(axis=0)
                here = dq.copy()
                here[out] = 0
            skip = max(0, k - (a - base))
            rows[a - base - k + skip : size - k, part] = here[skip:]
        # A place is in the bags of the tokens whose lo isn't after it and whose hi is; both are in order.
        upto = np.zeros((b - a + 1, DIM), dtype=np.float32)
        np.cumsum(dq, axis=0, out=upto[1:])
        place = np.arange(size)
        rows[:size, NEAR * DIM :] = (upto[np.searchsorted(lo, place, side="right")] - upto[np.searchsorted(hi, place, side="right")]) * np.float32(1 / BAG)
        who = np.append(context[base:b], BEFORE).astype(np.uint16)
        order = np.argsort(who, kind="stable")
        who = who[order]
        starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        g = np.add.reduceat(rows[order], starts, axis=0)
        g *= n
        who = who[starts]
        sq = self.sq[2][who]
        sq += g * g
        self.sq[2][who] = sq
        g *= np.float32(self.rate)
        g /= np.sqrt(sq)
        m.near[who] -= g


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the texts, ends of texts included; words are binary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])
        for batch in slices(batches, most=TAKEN):
            for t in raw_texts(batch):
                seen.update(t.lower().split())
            seen[END] += batch.num_rows
            if len(seen) > COUNTED:
                yield flush()
                seen.clear()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Words:
    """counts should be stored: it is read four times."""
    scale = (F.log2("c") * 8).cast("int")
    bins = counts.groupBy(scale.alias("b")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()  # a few hundred rows at most
    total, distinct = sum(r.c for r in bins), sum(r.n for r in bins)
    least, room = 1 << 30, VOCAB
    for r in sorted(bins, key=lambda r: -r.b):
        room -= r.n
        if room < 0:
            break
        least = r.b
    got = counts.where((scale >= least) | (F.col("word") == F.lit(bytearray(END)))).toArrow()  # VOCAB rows at most
    pairs = sorted(zip(got["word"].to_pylist(), got["c"].to_pylist(), strict=True), key=lambda p: (p[0] != END, -p[1], p[0]))
    if not pairs or pairs[0][0] != END:
        pairs.insert(0, (END, 0))
    known = [p[0] for p in pairs]
    table = triples()
    centers = clusters(known[HEAD : HEAD + FIT_WORDS], table)
    units = np.arange(len(known))
    if len(known) > HEAD:
        units[HEAD:] = HEAD + nearest(spelling(known[HEAD:], table), centers)
    words = Words(known, np.array([p[1] for p in pairs], dtype=np.int64), total, distinct, centers, units)

    heads = set(known[:HEAD])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(w, c) for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True) if w not in heads]
            if pairs:
                at = HEAD + nearest(spelling([w for w, _ in pairs], table), centers)
                c = np.array([c for _, c in pairs], dtype=float)
                n, s = np.bincount(at, minlength=UNITS), np.bincount(at, c, UNITS)
                u = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n[u]), pa.array(s[u])], ["u", "n", "c"])

    words.mass = np.full(UNITS, SMOOTH)
    words.share = np.zeros(UNITS)
    for r in counts.mapInArrow(group, "u long, n long, c double").groupBy("u").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect():
        words.mass[r.u] += r.c + SMOOTH * r.n
        words.share[r.u] = r.c
    words.share[: min(HEAD, len(known))] = words.counts[:HEAD]
    words.share /= max(1, words.share.sum())
    return words


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, n, w): the sums of n and of n * w; a task holds the sums of its rows i only."""
    sums: dict[int, list] = {}
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = batch.column("w").offsets.to_numpy()
        flat = batch.column("w").values.to_numpy()
        for k, i in enumerate(batch.column("i").to_pylist()):
            w = flat[ends[k] : ends[k + 1]] * n[k]
            if i in sums:
                sums[i][0] += n[k]
                sums[i][1] += w
            else:
                sums[i] = [n[k], w]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x[0] for x in sums.values()]), pa.array([x[1] for x in sums.values()], pa.list_(pa.float64()))], ["i", "n", "w"])


def train(docs: DataFrame, words: Words) -> Model:
    """A warm start on at most WARM texts, then every partition on all of its texts, averaged by tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def fit(start: np.ndarray | None, rounds: int, rate: float, calm: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            trainer = Trainer(Model.start(known.share) if start is None else Model.of(start), known.share, rate, calm, 1)
            numbers, table = Numbers(known.words), triples()

            def units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                tokens, ends = numbered(raw_texts(batch), numbers)
                u = unit_of(known, numbers.new, table)
                context = context_of(known, u)[tokens].astype(np.int32)
                numbers.forget()
                return u[tokens].astype(np.int32), context, np.repeat(ends[:-1], np.diff(ends))

            if rounds == 1:
                for batch in slices(batches, most=TAKEN):
                    trainer.learn(*units(batch))
            else:  # a bounded sample
                held = [units(batch) for batch in slices(batches, most=TAKEN)]
                for _ in range(rounds):
                    for x in held:
                        trainer.learn(*x)
            if trainer.tokens and start is None:
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([1.0]), pa.array([trainer.m.flat()], pa.list_(pa.float32()))], ["i", "n", "w"])
            elif trainer.tokens:
                # How far the outputs (row -1) and the context rows that it has used went from the start.
                begun = Model.of(start)
                head = [x.ravel() - y.ravel() for x, y in ((trainer.m.out, begun.out), (trainer.m.bias, begun.bias))]
                moved = trainer.m.near - begun.near
                used = np.flatnonzero(moved.any(axis=1))
                i = pa.array(np.append(-1, used))
                n = pa.array(np.full(len(used) + 1, float(trainer.tokens)))
                yield pa.RecordBatch.from_arrays([i, n, pa.array([np.concatenate(head), *moved[used]], pa.list_(pa.float32()))], ["i", "n", "w"])

        return run

    bound = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM)
    sample = docs.join(F.broadcast(bound), "doc_id", "left_semi").orderBy(F.xxhash64("text"), "text").select("text").limit(WARM)
    first = sample.mapInArrow(fit(None, WARM_ROUNDS, 0.1, 1e-6), "i long, n double, w array<float>").collect()
    start = np.array(first[0].w) if first else Model.start(words.share).flat()
    # Texts are dealt by hash and come in its order, so the result doesn't depend on how the table lies in files.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    mark = F.xxhash64("doc_id", "text")  # copies of a text are spread
    dealt = docs.repartition(1 + size // SHARD, mark).sortWithinPartitions(mark).select("text")
    parts = dealt.mapInArrow(fit(start, 1, 0.03, 1e-5), "i long, n double, w array<float>")
    got = {r.i: r for r in parts.repartition("i").sortWithinPartitions("i", "n", "w").mapInArrow(_summed, "i long, n double, w array<double>").collect()}  # the model's rows
    model = Model.of(start)
    if got:
        # A shard that hasn't used a row leaves it where it was.
        total = got[-1].n
        head = np.array(got[-1].w) / total
        model.out += head[: UNITS * DIM].reshape(UNITS, DIM).astype(np.float32)
        model.bias += head[UNITS * DIM :].astype(np.float32)
        for i, r in got.items():
            if i >= 0:
                model.near[i] += (np.array(r.w) / total).astype(np.float32)
    return model


def score(docs: DataFrame, counts: DataFrame, words: Words, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each text."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast((words, model))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = shared.value
        numbers, table = Numbers(known.words), triples()
        size = len(known.words)
        log_c = np.log10(known.counts + SMOOTH)
        log_all = math.log10(known.total + SMOOTH * (known.distinct + 1))
        log_mass = np.log10(np.maximum(known.mass, 1e-300))
        for batch in slices(batches, most=TAKEN):
            texts = raw_texts(batch)
            tokens, ends = numbered(texts, numbers)
            unit = unit_of(known, numbers.new, table)
            context = context_of(known, unit)[tokens].astype(np.int32)
            unit = unit[tokens]
            new = numbers.new
            numbers.forget()
            owner = np.repeat(np.arange(len(texts)), np.diff(ends))
            net_log = net.log_probs(unit.astype(np.int32), ends[:-1][owner], context) / math.log(10)
            own = np.where(tokens < size, log_c[np.minimum(tokens, size - 1)], 0.0)
            shares = np.where(unit >= HEAD, own - log_mass[unit], 0.0)
            total = lambda x: np.bincount(owner, x, len(texts))
            seen = (tokens < size) & (known.counts[np.minimum(tokens, size - 1)] > 0)
            ids = batch.column("doc_id").to_pylist()
            keys = [row_key(i, t) for i, t in zip(ids, texts, strict=True)]
            n = len(texts)
            tail = tokens >= size
            pairs, times = np.unique(owner[tail] * (len(new) + 1) + tokens[tail] - size, return_counts=True)
            at, word = np.divmod(pairs, len(new) + 1)
            rows = pa.array(keys, pa.binary())
            sums = [np.diff(ends).astype(float), total(seen), total(own) - log_all * np.diff(ends), total(net_log + shares)]
            names = ["key", "row", "times", "n_tokens", "seen", "base", "net", "doc_id"]
            # A key with a space is no word: the text's own row joins nothing, and such rows spread evenly.
            mark = pa.array([b" " + k for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([mark, rows, pa.array(np.zeros(n, np.int32)), *map(pa.array, sums), batch.column("doc_id")], names)
            if len(pairs):
                found = [pa.array(new, pa.binary()).take(pa.array(word)), rows.take(pa.array(at)), pa.array(times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*found, *(pa.nulls(len(pairs), pa.float64()) for _ in sums), pa.nulls(len(pairs), batch.schema.field("doc_id").type)], names)

    rows = docs.mapInArrow(rate, f"key binary, row binary, times int, n_tokens double, seen double, base double, net double, doc_id {kind}")
    joined = rows.join(counts.withColumnRenamed("word", "key"), "key", "left")
    c = F.coalesce("c", F.lit(0))
    per = joined.groupBy("row").agg(
        F.sum((F.col("times") == 0).cast("long")).alias("copies"),
        *(F.max(c).alias(c) for c in ("n_tokens", "seen", "base", "net")),
        F.max("doc_id").alias("doc_id"),
        F.sum(F.col("times") * F.log10(c + F.lit(SMOOTH))).alias("rest"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
    )
    # Equal rows share a key; each copy has added the same words.
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rest, known = F.col("rest") / F.col("copies"), (F.col("known") / F.col("copies")).cast("long")
    return per.select(
        "doc_id",
        F.col("n_tokens").cast("long").alias("n_tokens"),
        (F.col("seen").cast("long") + known).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"),
        (F.col("net") + rest).alias("score"),
    )


def score_all(docs: DataFrame, training: Column) -> DataFrame:
    """Learns from the documents where training holds, and scores all."""
    known = docs.where(training)
    counts = durable(count_words(known))
    words = vocabulary(counts)
    model = train(known, words)
    return score(docs, counts, words, model)
