"""Vector codes, exact copies and phrases, next to plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import corpus, empty, frame
from tracelab.llm import exact_dedup, phrases, vector_codes

LOW = {c: c + 32 for c in range(65, 91)}
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# -- vector codes ------------------------------------------------------------


def lloyd(rows, parts, entries, rounds, scale=1024):
    """Every part meets every entry in every round."""
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, _, v in kept), default=0)
    size = -(-longest // parts)
    cut = [[tuple((v + [0] * (parts * size))[p * size : (p + 1) * size]) for p in range(parts)] for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def near(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, e)), n) for n, e in enumerate(book))

    for turn in range(rounds + 1):
        found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
        if turn < rounds:
            for p in range(parts):
                for n in range(len(books[p])):
                    own = [c[p] for c, f in zip(cut, found) if f[p][1] == n]
                    if own:
                        books[p][n] = tuple(sum(x) // len(own) for x in zip(*own))
    errors = defaultdict(int)
    for (_, label, _), f in zip(kept, found):
        errors[label] += sum(d for d, _ in f)
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return Counter((i, "".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f), errors[label], digest) for (i, label, _), f in zip(kept, found))


def vectors(n, width, seed, kinds=12):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(kinds)]
    rows = [(i * 3 % 101 + i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(5, None, 1), (6, [1.0] * (width - 1) + [None], 1), (7, [float("nan")] * width, 1), (8, [float("inf")] + [0.0] * (width - 1), 0)]
    rows += [rows[0], rows[0], (None, [0.25] * width, None), (900, [0.5] * width, 2), (901, [0.5] * width, 2)]  # repeats, no id, ties
    return rows


def table(spark, rows):
    more = [(i, v, label, "x", 1) for i, v, label in rows]
    return spark.createDataFrame(more, "vec_id long, embedding array<float>, label int, code string, n long").repartition(3)


@pytest.mark.parametrize(("width", "entries", "rounds"), [(8, 16, 4), (6, 4, 3), (4, 256, 2)])
def test_vector_codes(spark, width, entries, rounds):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in vectors(150, width, width)]
    codes = vector_codes.compress(table(spark, rows), entries=entries, rounds=rounds)
    got = Counter(map(tuple, vector_codes.code_table(codes).collect()))
    assert got == lloyd(rows, 4, entries, rounds)


def test_active_entries_spare_most_comparisons(spark):
    rows = vectors(400, 8, 1, kinds=10)
    codes = vector_codes.compress(table(spark, rows), entries=32)
    kept = codes.coded.count()
    assert codes.rescans[0] == 4 * kept and codes.rescans[-1] < 0.7 * 4 * kept


def test_lengths_and_large_components(spark):
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [1.0], 0), (3, [], 1), (4, [200_000.0, -200_000.0, 0.5, 0.25, 1.0], None), (5, [1e38] * 5, None)]
    limit = vector_codes.LIMIT / 1024
    clipped = [(i, [max(-limit, min(limit, x)) for x in v], label) for i, v, label in rows]
    codes = vector_codes.compress(table(spark, rows), entries=2, rounds=2)
    assert Counter(map(tuple, vector_codes.code_table(codes).collect())) == lloyd(clipped, 4, 2, 2)


def test_lower_index_wins_among_moved_and_held():
    entries = np.array([[0, 0], [4, 0], [0, 0], [9, 9]])
    points = np.array([[0, 0], [2, 0], [4, 0], [9, 9]])
    held, error = np.array([2, 1, 1, 3]), np.array([0, 4, 0, 0])
    moved = np.array([True, False, False, False])
    new, far, scans = vector_codes.reassigned(points, entries, moved, held, error)
    assert new.tolist() == [0, 0, 1, 3] and far.tolist() == [0, 4, 0, 0] and scans == 0


def test_no_vectors(spark):
    none = table(spark, [(1, None, 0)])
    assert vector_codes.code_table(vector_codes.compress(none)).count() == 0
    assert vector_codes.code_table(vector_codes.compress(none.limit(0))).count() == 0


# -- exact copies ------------------------------------------------------------


def copies():
    rng = random.Random(4)
    rows = corpus(40)
    rows += [(40_000 + k, rng.choice(["Same TEXT", "same text", "SAME text\n"]), "many") for k in range(300)]
    rows += [(50_000 + k, f"only one {k}", "single") for k in range(200)]
    rows += [(60_000, "É", "a"), (60_001, "é", "b"), (None, "same text", None), (40_001, "same text", "again")]
    return rows


def test_exact_dedup(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 64)  # several blocks in a partition, so that messages cross blocks
    monkeypatch.setattr(exact_dedup, "OWNED", 2)
    rows = copies()
    group = defaultdict(list)
    for i, t, _ in rows:
        group[(t or "").translate(LOW)].append(i)
    keep = {k: max((i for i in v if i is not None), default=None) for k, v in group.items()}
    want = Counter()
    for i, t, _ in rows:
        k = (t or "").translate(LOW)
        want[i, sha(k), keep[k], len(group[k])] += 1
    got = exact_dedup.verdicts(frame(spark, rows)).collect()
    assert Counter((r.id, bytes(r.sha).hex(), r.keep_id, r.group_size) for r in got) == want
    kept = exact_dedup.deduplicated(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert Counter((r.doc_id, (r.text or "").translate(LOW)) for r in kept.collect()) == Counter((v, k) for k, v in keep.items())
    assert exact_dedup.verdicts(empty(spark)).count() == 0 and exact_dedup.deduplicated(empty(spark)).count() == 0


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS", 6)  # nearly every fingerprint is shared, and bytes decide
    rows = copies()[:200]
    sizes = Counter((t or "").translate(LOW) for _, t, _ in rows)
    got = exact_dedup.verdicts(frame(spark, rows)).collect()
    assert Counter((bytes(r.sha).hex(), r.group_size) for r in got) == Counter({(sha(k), n): n for k, n in sizes.items()})


def test_golomb_code():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 500):
        for low in (0, 3, 40):
            prints = np.unique(rng.integers(5, 5 + (1 << 10) * n + 1 if low < 20 else 2**47, n, dtype=np.uint64))
            code = exact_dedup.coded(prints, low, 5)
            assert (exact_dedup.decoded(code, len(prints), low, 5) == prints).all()
    prints = np.unique(rng.integers(0, 2**40, 4096, dtype=np.uint64))
    assert len(exact_dedup.coded(prints, 27, 0)) < 0.75 * 5 * len(prints)  # raw: 40 bits each


# -- phrases -----------------------------------------------------------------


def collocations(rows, best, least):
    """Counts of all phrases of all lengths."""
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = defaultdict(int)
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(covered[p[i : i + k]], a)
        told = []
        for p, a in cand.items():
            if p in covered and 100 * covered[p] >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            told.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(told)[:best], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def talk():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, t, None if s == "odd" else "en") for i, t, s in corpus(30) if s != "odd"]
    rows += [(i, t, "odd") for i, t, s in corpus(1) if s == "odd"]
    for k in range(120):
        text = []
        for _ in range(rng.randint(1, 60)):
            text.append(rng.choice(["New York City", "new york", "as soon as possible", "la la la la", rng.choice(words), rng.choice(words).upper()]))
            if rng.random() < 0.1:
                text[-1] += rng.choice([",", ".", "!", "\n", "\r\n", ";", "\x0b"])
        rows.append((2000 + k, rng.choice([" ", "\t", "  "]).join(text), rng.choice(["en", "de", None, "und"])))
    rows += [(3000 + k, "one two three four, five", "sw") for k in range(9)]
    return rows


def as_documents(spark, rows):
    return frame(spark, rows).withColumnRenamed("source", "lang").withColumn("w1", F.lit(1)).withColumn("rank", F.lit(2))


@pytest.mark.parametrize(("shards", "best"), [(2, 2000), (4, 15), (1, 2000)])
def test_collocations(spark, monkeypatch, shards, best):
    monkeypatch.setattr(phrases, "TOKENS", 700)  # several stretches in a task, with phrases across their border
    monkeypatch.setattr(phrases, "TEXT_BYTES", 4000)
    rows = talk()
    got = phrases.collocations(as_documents(spark, rows), best=best, threshold=9, shards=shards)
    want = collocations(rows, best, 9)
    assert {tuple(r) for r in got.collect()} == want
    assert any(r[0] == "sw" for r in want) and len(want) > 60 if best > 15 else len(want) > 30


def test_collocations_of_nothing(spark):
    none = as_documents(spark, [])
    assert phrases.collocations(none).count() == 0
    few = as_documents(spark, [(1, "a b c", "en"), (2, None, None)])
    assert phrases.collocations(few).count() == 0


def test_longer_phrases_wait_for_both_parts(spark):
    """A phrase is counted from the scan after its parts' threshold on, and in every shard once."""
    rows = [(k, "a b c d", "en") for k in range(12)]
    docs = as_documents(spark, rows)
    counts = phrases.frequent(docs, threshold=4, shards=3, spread=F.col("doc_id"))
    assert {r.n for r in counts.where("w1 != 0").collect()} == {12} and counts.where("w1 != 0").count() == 10
    assert counts.where("w1 = 0").first().n == 48
