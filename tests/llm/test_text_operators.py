"""Each text operator against brute force or planted cases, and on odd rows: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import common, components, fingerprints, language_model, line_quality, ngram_join, packing, passages, pieces, quality, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, spans string"
R = random.Random(11)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) if r.random() < share else w for w in text.split())


def table(spark, texts, ids=None):
    rows = [(i, t, None, f"host{(i or 0) % 2}" if i else None, 1, 0.5, 3, "x") for i, t in zip(ids or range(1, len(texts) + 1), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [None, "", "   \n", "one", "a b c", "x" * 30_000, prose(20_000, 1), prose(80, 2), prose(80, 2), "Größe ☃ \x0b ▁ 😀", "to " * 300]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [*ODD, "no id", "no id too"], [*range(1, len(ODD) + 1), None, None]).unionByName(table(spark, [prose(80, 2)], [8])).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, ["x"]).where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0), "x") for i in range(1, 200)] + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string")


def runs(docs, labels):
    yield sharding.shard(docs, 1 << 14)
    yield language_model.score_all(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0)
    yield line_quality.judge(docs)
    yield pieces.decode(pieces.encode(docs))
    yield passages.dedup(docs)
    yield ngram_join.join(docs, 4, 85, 100)
    yield packing.pack(docs)
    yield toxicity.score(docs, toxicity.fit(docs, labels))
    yield quality.score(docs, quality.fit(docs, labels))


def test_odd_rows_and_empty_tables(odd, none, labels):
    n = odd.count()
    for k, (out, empty) in enumerate(zip(runs(odd, labels), runs(none, labels), strict=True)):
        assert empty.count() == 0, k
        if k == 6:
            assert out.where("start = 0").count() == n
        else:
            assert out.count() == n, k


def test_fingerprints_of_odd_rows(odd, none):
    got = fingerprints.compare_with_next(odd).collect()
    assert len(got) == odd.select("doc_id", F.coalesce("text", F.lit(""))).distinct().count()
    assert fingerprints.compare_with_next(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[8].fingerprint == by[9].fingerprint and by[1].fingerprint == by[2].fingerprint
    assert by[8].near_next == 1.0 and by[4].near_next == 0.0


def _hash(*values):
    """xxhash64 of a row of longs, texts and ints (given as one-tuples)."""
    seed = 42
    for v in values:
        b = v.encode() if isinstance(v, str) else struct.pack("<i", *v) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(b, seed)
        seed -= (seed >> 63) << 64
        hashed, seed = seed, seed % (1 << 64)
    return hashed


def _sketch(text):
    w = [x for x in re.split("[ \t\n\x0b\f\r]+", text) if x]
    if any(len(x.encode()) > 48 for x in w):
        w = [p for x in w for p in (re.findall(".{1,12}", x) if len(x.encode()) > 48 else [x])]
    h = [_hash(x) for x in w]
    g = [_hash(*h)] if 0 < len(h) < 3 else [_hash(*h[i : i + 3]) for i in range(len(h) - 2)]
    seen, entries = Counter(), []
    for p, x in enumerate(g):
        entries.append((_hash(x, (seen[x],)), p))
        seen[x] += 1
    bins = {}
    for e in sorted(entries):
        bins.setdefault(e[0] >> 59, []).append(e)
    kept = [e for b in sorted(bins) for e in bins[b][:2]]
    out = ["-"] * 32
    for i, e in enumerate(kept):
        if i and kept[i - 1][0] >> 59 == e[0] >> 59:
            continue
        other = kept[(i + 1) % len(kept)]
        pair = [e] if len(kept) == 1 else sorted((e, other), key=lambda x: x[1])
        out[(e[0] >> 59) + 16] = f"{_hash(*(x[0] for x in pair)) & 0x7FFFFFFF:x}"
    return ".".join(out)


def test_fingerprints_match_brute_force(spark):
    texts = [t or "" for t in ODD if t != ODD[6]] + [prose(n, n) for n in (3, 4, 9, 25, 34, 300)] + [f"{prose(40, 5)} {prose(40, 5)} {prose(9, 6)}", "a b c d " * 30]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited_text = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[i + 1]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited_text.encode()).hexdigest()
        assert r.fingerprint == _sketch(t) and r.edited_fingerprint == _sketch(edited_text)
        for other, near in ((edited_text, r.near_edited), (after, r.near_next)):
            a, b = _sketch(t).split("."), _sketch(other).split(".")
            some = sum(x != "-" or y != "-" for x, y in zip(a, b, strict=True))
            assert near == (sum(x == y != "-" for x, y in zip(a, b, strict=True)) / some if some else 1.0)


def test_fingerprints_of_short_texts_carry_order(spark):
    pairs = [prose(24, 400 + i).split() for i in range(10)]
    texts = [" ".join(x) for w in pairs for x in (w, w[12:] + w[:12])]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(table(spark, texts)).collect()}
    # Two of 22 k-mers change, but half of all pairs change places.
    assert np.mean([got[i].near_next for i in range(1, 20, 2)]) < 0.75


def test_fingerprints_of_equal_rows_are_one(spark):
    docs = spark.range(10_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(prose(40, 1)).alias("text")).unionByName(table(spark, [prose(40, 2)], [6]).select("doc_id", "text"))
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs).collect()}
    assert len(got) == 2 and got[5].fingerprint == _sketch(prose(40, 1))


def test_sharding_splits_only_what_is_too_large(spark):
    docs = table(spark, [prose(R.randint(1, 300), i) for i in range(300)])
    out = sharding.shard(docs, 20_000).collect()
    size = Counter()
    for r in out:
        size[r.shard] += r.bytes
    assert all(v <= 20_000 for v in size.values()) and {r.shard: r.shard_bytes for r in out} == size
    for s in size:  # the parent of each shard was too large
        assert sum(v for k, v in size.items() if k.startswith(s[:-1])) > 20_000
    d = sharding.directory(sharding.shard(docs, 20_000)).collect()
    assert sum(int(r.after - r.first) for r in d) == 2 ** d[0].global_depth
    hot = table(spark, [prose(100, i) for i in range(200)], [7] * 200)  # one key
    assert all(r.fits for r in sharding.shard(hot, 20_000).collect())


def test_language_model_beats_counts_and_is_normalised(spark):
    r = random.Random(3)
    texts = []
    for i in range(600):  # two kinds of text with words of their own
        part = VOCAB[:400] if i % 2 else VOCAB[400:800]
        texts.append(" ".join(part[int(400 * r.random() ** 3)] for _ in range(60)))
    docs = table(spark, texts)
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    out = language_model.score_all(docs, ~held).join(docs.select("doc_id", held.alias("h")), "doc_id").where("h").collect()
    assert sum(x.score for x in out) > sum(x.base_score for x in out)
    train = [t for i, t in enumerate(texts, 1) if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in t.split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    for x in out[:5]:
        words = texts[x.doc_id - 1].split()
        want = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words) + np.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        assert abs(x.base_score - want) < 1e-6 and x.n_tokens == len(words) + 1 and x.train_tokens == n
    m = language_model.Model.start(np.full(language_model.UNITS, 1 / language_model.UNITS))
    first = np.zeros(4, dtype=np.int64)
    p = sum(np.exp(m.log_probs(np.array([1, 2, 3, u], dtype=np.int32), first)[3]) for u in range(language_model.UNITS))
    assert abs(p - 1) < 1e-4


def test_line_rule_rejects_depleted_documents(spark):
    common = [prose(12, 900 + i) for i in range(4)]
    texts = ["\n".join([*common, prose(8, i)]) for i in range(30)] + [prose(60, 2000 + i) for i in range(30)]
    rows = [(i, t, None, "h", 1, 0.5, 3, "x") for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in line_quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(out[i].kept for i in range(30)) and all(out[i].kept for i in range(30, 60))
    assert out[0].n_frequent_lines == 4 and not out[0].base_failed


def test_pieces_match_brute_force_and_round_trip(spark):
    p = pieces.Pieces.load(pieces.public_pieces())
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=pieces.public_pieces())
    score = {s.id_to_piece(i): s.get_score(i) for i in range(s.get_piece_size()) if not (s.is_byte(i) or s.is_control(i) or s.is_unknown(i))}
    low = min(x for x in score.values() if x > -1e8) - 1
    words = [f" {w}" for w in VOCAB[:80]] + ["Größe", "  x", " 😀☃a", "\n", "   "]
    for w, ids, got in p.encode_words(words):
        t = w.replace(" ", "▁")
        best = [0.0] + [-1e18] * len(t)
        for e in range(1, len(t) + 1):
            for a in range(max(0, e - p.longest), e):
                if t[a:e] in score:
                    best[e] = max(best[e], best[a] + max(score[t[a:e]], low))
            best[e] = max(best[e], best[e - 1] + p.byte_score * len(t[e - 1].encode()))
        assert abs(best[-1] - got) < 1e-6, w
        assert b"".join(p.values[i] for i in np.frombuffer(ids, "<u4")).decode() == w
    docs = table(spark, ODD)
    assert all((r.text or "") == r.decoded for r in pieces.decode(pieces.encode(docs)).collect())


def test_compact_windows_match_brute_force():
    r = np.random.default_rng(0)
    for width in (1, 2, 5, 46):
        for _ in range(25):
            v = r.integers(1, r.integers(3, 999), r.integers(1, 200)).astype(np.uint64)
            v[r.random(len(v)) < 0.02] = 0
            want = {}
            for i in np.flatnonzero(v).tolist():
                a = b = i
                while a > 0 and v[a - 1] >= v[i]:
                    a -= 1
                while b + 1 < len(v) and v[b + 1] >= v[i]:
                    b += 1
                if b - a + 1 >= width:
                    want.setdefault((a, b), []).append(i)
            got = zip(*(x.tolist() for x in passages.compact_windows(v, width)), strict=True)
            assert sorted(got) == sorted((a, c[0], c[-1], b) for (a, b), c in want.items())


def test_repeated_passages_are_found_and_clean_texts_left_alone(spark):
    shared = [prose(70, 5000 + i) for i in range(3)]
    texts = [f"{prose(60, i)} {shared[i % 3] if i < 30 else ''} {prose(60, 300 + i)}" for i in range(90)]
    texts += [texts[40], edited(texts[41], 1, 0.01)]
    out = {r.doc_id: r for r in passages.dedup(table(spark, texts)).collect()}
    for i in range(30):
        assert out[i + 1].class_id == i % 3 + 1
        assert (out[i + 1].n_dup_words >= 70) == (i >= 3)
    assert all(out[i].n_dup_words == 0 and out[i].class_id == i for i in range(31, 91))
    assert out[91].class_id == 41 and out[91].n_dup_words == out[91].n_words and out[92].class_id == 42
    t = texts[10].encode()
    left = passages.cut(t, [(x.start, x.stop) for x in out[11].spans]).decode()
    assert shared[1] not in left and left.startswith(prose(60, 10)[:100])


def test_short_passages_near_the_threshold_are_found(spark):
    """Pairs of texts with a passage of 50 to 60 words at a similarity of 0.8 to 0.85, against brute force."""
    cases = [(50, (25,)), (60, (30,)), (60, (30, 31))]
    texts, pairs = [], []
    for i in range(90):
        n, changed = cases[i % 3]
        one = prose(n, 6000 + i).split()
        two = ["changed" if j in changed else w for j, w in enumerate(one)]
        a, b = ({tuple(x[j : j + 5]) for j in range(n - 4)} for x in (one, two))
        assert 0.8 <= len(a & b) / len(a | b) <= 0.85
        pairs.append((len(texts) + 1, len(texts) + 2))
        texts += [f"{prose(40, 7000 + 2 * i + k)} {' '.join(x)} {prose(40, 8000 + 2 * i + k)}" for k, x in enumerate((one, two))]
    out = {r.doc_id: r for r in passages.dedup(table(spark, texts)).collect()}
    assert sum(out[b].class_id == a for a, b in pairs) >= 0.97 * len(pairs)
    assert all(out[a].class_id == a and out[a].n_dup_words == 0 for a, _ in pairs)


def test_a_passage_is_settled_only_by_a_link_over_it(spark):
    """Each hub shares one passage with two texts and too little of another passage that they share with each other."""
    texts = []
    for i in range(30):
        licence, own = prose(60, 9000 + i), prose(50, 9100 + i).split()
        texts.append(f"{licence} {prose(40, 9200 + i)} {' '.join(own[:49])} end {prose(40, 9300 + i)}")
        texts += [f"{licence} {prose(40, 9400 + 2 * i + k)} {' '.join(own)} {prose(40, 9500 + 2 * i + k)}" for k in range(2)]
    out = {r.doc_id: r for r in passages.dedup(table(spark, texts)).collect()}
    for i in range(1, 90, 3):
        assert [out[i + k].class_id for k in range(3)] == [i] * 3
        assert out[i + 1].n_dup_words < 70 and out[i + 2].n_dup_words >= 110


def test_a_settled_text_still_meets_those_that_the_hub_does_not_match(spark):
    """The middle text of three matches both others, which differ from it in one word each; the first is the hub."""
    texts = []
    for i in range(30):
        w = prose(60, 11_000 + i).split()
        one, two = [*w[:20], "first", *w[21:]], [*w[:40], "second", *w[41:]]
        texts += [f"{prose(30, 12_000 + 3 * i + k)} {' '.join(x)} {prose(30, 13_000 + 3 * i + k)}" for k, x in enumerate((one, w, two))]
    out = {r.doc_id: r for r in passages.dedup(table(spark, texts)).collect()}
    assert np.mean([out[i + 2].class_id == i for i in range(1, 90, 3)]) > 0.95
    assert np.mean([out[i + 2].n_dup_words >= 50 for i in range(1, 90, 3)]) > 0.95


def test_thousands_with_one_line_in_common_fall_apart(spark):
    line = prose(30, 77)
    texts = [f"{prose(45, 14_000 + i)} {line} {prose(45, 15_000 + i)}" for i in range(400)]
    texts += [f"{prose(45, 16_000 + i)} {texts[i]}" for i in range(5)]
    out = {r.doc_id: r for r in passages.dedup(table(spark, texts)).collect()}
    assert all(out[401 + i].class_id == i + 1 and out[401 + i].n_dup_words == 120 for i in range(5))
    assert all(out[i].class_id == i and out[i].n_dup_words == 0 for i in range(1, 401))


def test_links_do_not_depend_on_how_many_share_a_key(spark):
    """Pairs that match each other and not the hub, with few and with many texts under the keys of a line that all share."""
    line = prose(40, 78)
    pairs = []
    for i in range(20):
        w = prose(30, 18_000 + i).split()
        pairs += [f"{prose(45, 19_000 + 2 * i + k)} {line} {' '.join(w)} {prose(45, 20_000 + 2 * i + k)}" for k in range(2)]
    others = [f"{prose(45, 21_000 + i)} {line} {prose(75, 22_000 + i)}" for i in range(200)]
    for more in ([], others):
        out = {r.doc_id: r for r in passages.dedup(table(spark, [*pairs, *more])).collect()}
        assert all(out[i + 1].class_id == i and out[i + 1].n_dup_words >= 70 for i in range(1, 41, 2))
        assert all(out[i].class_id == i for i in range(41, 41 + len(more)))


def test_a_settled_text_under_a_large_key_meets_the_open_ones(spark):
    """As many matches of the hub as make a large key; the last text matches those with its change only, which the hub has settled."""
    w = prose(60, 23_000).split()
    one, both, two = [*w[:20], "first", *w[21:]], w, [*w[:40], "second", *w[41:]]
    texts = [f"{prose(30, 24_000 + i)} {' '.join(x)} {prose(30, 25_000 + i)}" for i, x in enumerate([one] * 70 + [both] + [two])]
    out = {r.doc_id: r for r in passages.dedup(table(spark, texts)).collect()}
    assert all(out[i].class_id == 1 for i in range(1, 73))
    assert out[72].n_dup_words >= 50


def test_texts_of_one_id_and_of_none_are_told_apart(spark):
    """Three texts under a null id and three under id 5: a copy, a near copy of document 3, an unrelated one."""
    base, free = prose(120, 21), [prose(120, 22), prose(120, 23)]
    near = " ".join([*base.split()[:119], "end"])
    texts, ids = [base, base, near, free[0], base, near + " more", free[1]], [3, 5, 5, 5, None, None, None]
    docs = table(spark, texts, ids)
    got = {(r.doc_id, r.text_hash): r for r in passages.dedup(docs).collect()}
    h = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    for i, t, c, n in [(3, 0, 3, 0), (5, 1, 3, 120), (5, 2, 3, 119), (5, 3, 5, 0), (None, 4, 3, 120), (None, 5, 3, 120), (None, 6, None, 0)]:
        r = got[i, h[texts[t]]]
        assert (r.class_id, r.n_dup_words) == (c, n) or (t == 5 and r.n_dup_words >= 119 and r.class_id == 3)
    groups = sorted(((r.doc_id, r.component_id) for r in ngram_join.join(docs, 4, 85, 100).collect()), key=str)
    assert groups == sorted([(3, 3), (5, 3), (5, 3), (5, 5), (None, 3), (None, 3), (None, None)], key=str)
    left = ngram_join.one_of_each(docs, 5, 8, 10).collect()
    assert sorted(r.text for r in left) == sorted([base, *free])


def test_a_pair_under_several_shares_of_a_hub_is_told_once():
    """The second share, which isn't the pair's own (lo 0), still tells what only its keys lead to."""
    same, other, third = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60)), " ".join(f"c{i}" for i in range(60))
    texts = {1: same, 2: f"{same} {other}", 3: f"{same} {other} {third}"}
    rows = [(1, share, None, m, own if m != 1 else 0, None, None, None, texts[m]) for share, own in ((0, 1), (1, 0)) for m in texts]
    # The places of texts 2 and 3 lie in their other passage, which the hub doesn't have.
    rows += [(1, 1, 7, m, 70, 75, 10, 15, None) for m in (2, 3)]
    rows.sort(key=lambda r: (r[1], r[2] is not None))
    names = ["hub", "share", "key", "m", "lo", "hi", "hub_lo", "hub_hi", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "text" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)
    found = [r for out in passages._compare(iter([batch])) for r in zip(*(out.column(c).to_pylist() for c in ("m", "hub", "start", "stop")), strict=True)]
    assert sorted(found) == [(2, 1, 0, 60), (3, 1, 0, 60), (3, 2, 0, 120)]


def test_release_gives_freed_memory_back():
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024  # noqa: E731, SIM115
    rows = [np.full(1000, float(i)) for i in range(30_000)]
    last, most = rows[-1], held()
    del rows
    common.release()
    assert held() < most - 150 and last[0] == 29_999


def test_keys_alone_are_those_of_the_windows(spark):
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(m, " ".join(f"w{i}" for i in rng.integers(0, most, 300))) for m, most in enumerate((5, 40, 10_000))], "m long, text string")
    whole = {(r.key, r.m) for r in passages.windows(docs).select("key", "m").collect()}
    assert {(r.key, r.m) for r in passages.windows(docs, keys=True).collect()} == whole


def test_runs_found_elsewhere_dont_part_a_passage():
    a = np.arange(1, 66, dtype=np.uint64)
    b = np.concatenate([a[:30], np.arange(100, 105, dtype=np.uint64), a[35:], np.arange(200, 300, dtype=np.uint64), a[32:33]])
    assert passages.shared(a, b) == [(0, 65, 0, 65)]


def test_frequent_lines_are_taken_out(spark):
    own = [[prose(12, 9800 + i), "", prose(9, 9900 + i)] for i in range(40)]
    texts = [f"{a}\nShare this  page 12\n{b}\nshare this page {i}\n{c}" for i, (a, b, c) in enumerate(own)]
    docs = table(spark, [*texts, None, own[0][0]]).withColumn("source", F.lit("h"))
    out = {r.doc_id: r for r in line_quality.clean(docs).collect()}
    for i, lines in enumerate(own):
        assert out[i + 1].text == "\n".join(lines) and out[i + 1].n_frequent_lines == 2
    assert out[41].text is None and out[42].text == own[0][0] and out[42].n_frequent_lines == 0
    assert {r.n_frequent_lines for r in line_quality.judge(docs).where("doc_id <= 40").collect()} == {2}


def test_jaccard_components_match_brute_force(spark):
    texts = [prose(R.randint(1, 12), i) for i in range(60)]
    base = [prose(n, 700 + n) for n in (9, 13, 16, 17, 40, 150, 300)]
    texts += base + [edited(b, s, share) for b in base for s in range(8) for share in (0.005, 0.02, 0.05)]
    texts += [" ".join(b.split()[1:]) for b in base] + [b.upper() for b in base] + [prose(150, 850)] * 5
    texts += [edited(prose(120, 999), s, 0.015) for s in range(60)]  # longer lists than SHORT
    out = {r.doc_id: r for r in ngram_join.join(table(spark, texts), 4, 85, 100).collect()}
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    assert [out[i + 1].component_id for i in range(len(sets))] == [find(i) + 1 for i in range(len(sets))]
    assert all(out[i + 1].n_shingles == len(s) for i, s in enumerate(sets))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[x] for x in (90, 95, 100)} == {90}


def test_packing_keeps_every_id_once(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, "It's  Ünïcode x’s 12345 İ", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", *(prose(R.randint(1, 900), i) for i in range(80))]
    rows = packing.pack(table(spark, texts), keep_ids=True).collect()
    tok = Tokenizer.from_file(packing.public_tokenizer())
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts, 1)}
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, {})[r.start] = list(np.frombuffer(r.ids, "<u4"))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(want[r.doc_id])
    for i, ids in want.items():
        got = [x for _, p in sorted(docs[i].items()) for x in p]
        assert got == ids
    padding = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_packing_keeps_large_ids_next_to_null_ones(spark):
    ids = [2**53 + 1, None, -(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(i, prose(30, k)) for k, i in enumerate(ids)], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack(rows).collect()} == set(ids)


def test_packing_takes_tokenizers_that_dont_split_by_words(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = lambda: public_tokenizers.path("byte_bpe_50k.json")
    texts = [x for x in ODD if x] + ["two  words\n\n and lines"]
    tok, got = Tokenizer.from_file(path()), {}
    for r in packing.pack(table(spark, texts), tokenizer=path, keep_ids=True).collect():
        got.setdefault(r.doc_id, {})[r.start] = list(np.frombuffer(r.ids, "<u4"))
    for i, t in enumerate(texts, 1):
        assert [x for _, p in sorted(got[i].items()) for x in p] == [*tok.encode(t, add_special_tokens=False).ids, 1]


def test_classifiers_learn(spark):
    r = random.Random(9)
    texts, rows = [], []
    for i in range(1, 901):
        toxic, good = i % 6 == 0, i % 4 != 0
        words = prose(60, i).split()
        if toxic:
            words.insert(r.randint(0, 59), r.choice(["zorgus", "moron", "zorgal"]))
        if not good:
            words = [f"{w}###" for w in words]
        texts.append(" ".join(words))
        rows.append((i, int(good), int(toxic)))
    docs, labels = table(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    t = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()}
    q = {x.doc_id: x.score for x in quality.score(docs, quality.fit(docs, labels), ["doc_id"]).collect()}
    test = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert np.mean([(t[i] >= 0.5) == bool(y) for i, _, y in test]) > 0.97
    assert np.mean([(q[i] >= 0.3) == bool(y) for i, y, _ in test]) > 0.97


def test_quality_pairs_are_all_pairs():
    """Against the gradient of every pair; rows in another order give the same weights."""
    rng = np.random.default_rng(3)
    codes, y = rng.integers(0, quality.BINS, (90, 5)), (rng.random(90) < 0.3).astype(int)
    codes[y == 1, 0] = rng.integers(4, quality.BINS, y.sum())
    at = codes + np.arange(5) * quality.BINS
    x = np.zeros((90, 5 * quality.BINS))
    x[np.arange(90)[:, None], at] = 1
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, x.shape[1])
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, quality.ROUNDS + 1):
        g = -(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    got = quality.fit_pairs(codes, y)
    assert np.abs(x @ got.ravel() - x @ w).max() < 0.05 * np.ptp(x @ w)
    order = rng.permutation(90)
    assert np.allclose(quality.fit_pairs(codes[order], y[order]), got, atol=1e-4)


def test_quality_is_fitted_on_all_labelled_rows(spark):
    r = random.Random(4)
    texts = ["x" * r.randint(1, 10**4) + " y" * r.randint(0, 3) for _ in range(26_000)]
    rows = [(i, int(len(t) > 3000)) for i, t in enumerate(texts, 1)]
    got = quality.fit(table(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int"))
    j = quality.FEATURES.index("longest_word")
    x = {y: [quality.features(texts[i - 1].encode())[j] for i, z in rows if z == y and zlib.crc32(str(i).encode()) % 5] for y in (0, 1)}
    marks = np.linspace(0, 1, quality.BINS + 1)[1:-1]
    assert len(x[0]) + len(x[1]) > 20_000
    assert np.allclose(got.edges[j], np.sort(np.concatenate([np.quantile(x[1], marks[::2]), np.quantile(x[0], marks[1::2])])), atol=1e-6, rtol=0)


def test_order_statistics_match_a_sort(spark):
    x = np.random.default_rng(3).normal(size=(500, 2)).astype(np.float32)
    x[::7] = 0
    rows = spark.createDataFrame([(a.tolist(), i % 2) for i, a in enumerate(x)], "x array<float>, y int")
    got = quality.order_statistics(rows, {(y, j): [0, 17, 40, 249] for y in (0, 1) for j in (0, 1)})
    assert got == {(y, j, k): float(np.sort(x[y::2, j])[k]) for y in (0, 1) for j in (0, 1) for k in (0, 17, 40, 249)}


def test_label_model_rates_voters():
    r = np.random.default_rng(4)
    y = r.random(4000) < 0.3
    vote = lambda acc: np.where(r.random(4000) < acc, y, ~y) * 2 - 1
    noisy = vote(0.7)
    votes = np.stack([np.where(r.random(4000) < 0.5, vote(0.99), 0), vote(0.9), noisy, noisy, vote(0.8)], axis=1).astype(np.int8)
    post, accuracy, corr = toxicity.label_model(votes, 0.3)
    assert np.mean((post > 0.5) == y) > 0.93 and accuracy[1] > accuracy[2] and corr[2, 3] > 0.9


def test_label_model_weighs_voters():
    """Accuracies come back (less some for the tenth of the labels that is wrong), copies of a poor voter don't outvote good
    ones, and a row's own label is no vote."""
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.4).astype(float)
    cast = lambda right: np.where(rng.random(len(y)) < right, y, 1 - y) * 2 - 1
    good, fair, poor = cast(0.95), cast(0.85), cast(0.6)
    votes = np.stack([good, fair, poor, poor, poor, poor], axis=1)
    votes[rng.random(len(y)) < 0.3, 0] = 0
    known = np.where(rng.random(len(y)) < 0.1, 1 - y, y)
    post, accuracy, corr = toxicity.label_model(votes, known.mean(), known)
    assert abs(accuracy[0] - 0.95) < 0.1 and abs(accuracy[1] - 0.85) < 0.1 and abs(accuracy[2] - 0.6) < 0.1
    assert corr[2, 3] > 0.9 and corr[0, 2] < 0.2
    majority = np.mean((votes.sum(axis=1) > 0) == (y > 0))
    found = np.mean((post > 0.5) == (y > 0))
    assert found > 0.88 and found > majority + 0.1
    for row in np.unique(votes, axis=0):
        assert np.ptp(post[(votes == row).all(axis=1)]) < 1e-9
