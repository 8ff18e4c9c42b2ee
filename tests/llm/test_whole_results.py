"""Whole results of the sketches and of the quality verdict, recomputed in plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.cases import SF, corpus, empty, frame
from tracelab.llm import fingerprints, quality


def shingles(text, size):
    """Hashes of word runs, each hash the seed of the next."""
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.split(r"[\x20\x09-\x0D]+", text) if w]

    def run(hashes):
        state = 42
        for h in hashes:
            state = xxhash.xxh64(h.to_bytes(8, "little"), seed=state).intdigest()
        return signed(state)

    if len(words) < size:
        return {run(words)} if words else set()
    return {run(words[k : k + size]) for k in range(len(words) - size + 1)}


def sketch(text, size=5, fraction=1 / 8):
    every = shingles(text, size)
    low = {h for h in every if h < fingerprints.threshold(fraction)}
    return low or ({min(every)} if every else set())


def likeness(a, b):
    if not a and not b:
        return 1.0
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


@pytest.fixture(scope="module")
def rows():
    out, seen = [], set()
    for i, t, s in corpus(50):  # one row per id here, rows without an id apart
        if i is not None and i not in seen:
            seen.add(i)
            out.append((i, t, s))
    return out


def test_fingerprints_and_likeness(spark, rows):
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    want = {}
    for (i, t, _), (_, other, _) in zip(order, order[1:] + order[:1], strict=True):
        t, other = t or "", other or ""
        third = len(t) // 3
        own, edited, following = sketch(t), sketch(t[: len(t) - third] + other[:third]), sketch(other)
        told = lambda s: ",".join(f"{h & (2**64 - 1):016x}" for h in sorted(s))
        want[i] = (told(own), told(edited), likeness(own, edited), likeness(own, following))
    got = fingerprints.edited_likeness(frame(spark, rows)).collect()
    assert {r.id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got} == want
    assert len(got) == len(rows)


def test_rows_that_share_an_id_and_rows_without_one(spark):
    texts = {k: f"text {k} " + " ".join(f"w{k}x{n}" for n in range(30)) for k in range(40)}
    rows = [(k // 4 if k < 20 else None if k < 30 else 1000 + k, texts[k], "s") for k in range(40)]
    got = fingerprints.edited_likeness(frame(spark, rows)).collect()
    assert len(got) == 40
    by = defaultdict(set)
    for i, t, _ in rows:
        by[i].add(t)
    ids = sorted((i for i in by if i is not None), reverse=True) + [None]
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    # all rows of an id follow the same text of the next id
    for i in by:
        own = [r for r in got if r.id == i]
        options = [
            {(likeness(sketch(t), sketch(n)), ",".join(f"{h & (2**64 - 1):016x}" for h in sorted(sketch(t)))) for t in by[i]} for n in by[after[i]]
        ]
        assert any({(r.near_next, r.fingerprint) for r in own} == o for o in options)


def test_one_document_follows_itself(spark):
    one = fingerprints.edited_likeness(frame(spark, [(3, "a b c d e f g h i", "s")])).first()
    assert one.near_next == 1.0 and one.n_chars == 17
    null = fingerprints.edited_likeness(frame(spark, [(None, None, None)])).first()
    assert null.near_next == 1.0 and null.fingerprint == ""
    assert fingerprints.edited_likeness(empty(spark)).count() == 0


def verdicts(told, weight, least):
    """From each text's own chance, by the formulas of the docstrings."""
    paths, hosts = defaultdict(list), defaultdict(list)
    for host, path, p in told:
        paths[host, path].append(p)
        hosts[host].append(p)
    n = len(told)
    prior = sum(p for *_, p in told) / n
    mean = lambda v: sum(v) / len(v)

    def pull(groups, spread):
        chance = prior * (1 - prior)
        return max(1.0, chance / max(spread - chance * groups / n, chance * 1e-4) - 1)

    of_host = pull(len(hosts), sum(len(v) * (mean(v) - prior) ** 2 for v in hosts.values()) / n)
    p_host = {h: (sum(v) + of_host * prior) / (len(v) + of_host) for h, v in hosts.items()}
    of_path = pull(len(paths), sum(len(v) * (mean(v) - mean(hosts[k[0]])) ** 2 for k, v in paths.items()) / n)
    p_path = {k: (sum(v) + of_path * p_host[k[0]]) / (len(v) + of_path) for k, v in paths.items()}
    odds = lambda p: math.log(p / (1 - p))
    bound = lambda p: max(quality.EDGE, min(1 - quality.EDGE, p))
    out = []
    for host, path, p in told:
        keep = 1 / (1 + math.exp(-(odds(p) + weight * (odds(bound(p_path[host, path])) - odds(bound(prior))))))
        out.append((p_host[host], p_path[host, path], keep, keep >= least))
    return out


def test_verdicts_from_given_chances(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.limit(3).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6))
    where = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    got = quality.judged(docs, labels).collect()
    assert len(got) == docs.count()
    want = verdicts([(*where[r.id], r.p_text) for r in got], quality.SITE_WEIGHT, 0.5)
    for r, w in zip(got, want, strict=True):
        assert (r.p_host, r.p_path, r.p_keep) == pytest.approx(w[:3], rel=1e-9) and r.keep == w[3]
    assert Counter(r.keep for r in got)[True] > 0


def test_pipeline_stages_with_clashing_names_and_without_rows(spark):
    import corpus_pipeline as pipeline

    names = ("row", "fp", "id", "node", "kept", "keep", "n", "starts", "hashes", "s_id", "h1")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumns({name: F.lit(name) for name in names})
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert out.where(" AND ".join(f"`{name}` = '{name}'" for name in names)).count() == out.count()
        docs = spark.createDataFrame(out.collect(), docs.schema)
    nothing = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
