"""Operators that compare texts with each other, next to plain Python."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SF, corpus, empty, frame
from tracelab import session
from tracelab.llm import common, decontamination, jaccard_join, preference_format, quality, repeats


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    out = [r for r in corpus(40) if r[1] is None or len(r[1]) < 6000]
    base = [word() for _ in range(220)]
    for k in range(60):  # near copies of one text, each with its own edits
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = word()
        out.append((10_000 + k, " ".join(copy), "near"))
    passage = " ".join(word() for _ in range(90))
    for k in range(12):  # one passage in different surroundings
        out.append((20_000 + k, " ".join(word() for _ in range(rng.randint(0, 60))) + " " + passage + " " + word() * (k % 3), "passage"))
    out.append((30_000, "ab" * 700, "period"))
    out.append((30_001, "é" * 150 + "x" + "é" * 150 + passage[:398], "short of it"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def cut(rows):
    """What stays without the bytes of repeated 400-byte strings."""
    raw = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(d[s : s + 400] for _, d in raw for s in range(len(d) - 399))
    want = Counter()
    for i, d in raw:
        gone = bytearray(len(d))
        for s in range(len(d) - 399):
            if seen[d[s : s + 400]] > 1:
                gone[s : s + 400] = b"\x01" * 400
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        want[i, len(d), sum(gone), runs, bytes(b for b, g in zip(d, gone, strict=True) if not g)] += 1
    return want


@pytest.mark.parametrize("gathered", [repeats.GATHERED, 3])
def test_repeats(spark, docs, rows, gathered, monkeypatch):
    monkeypatch.setattr(repeats, "GATHERED", gathered)  # with 3, most suffixes go the way of very large gatherings
    monkeypatch.setattr(repeats, "PER_TASK", 200)
    got = repeats.without_repeats(docs).collect()
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == cut(rows)
    assert sum(r.n_removed > 0 for r in got) > 30


def test_repeats_of_nothing(spark):
    assert repeats.without_repeats(empty(spark)).count() == 0


def test_long_texts_are_cut_without_a_seam(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (5000, 399, 400, 1200, 3, 0)]
    monkeypatch.setattr(repeats, "STRETCH", 700)
    windows = Counter()
    for data, ends, origins in repeats.stretches(texts):
        at, _, first, last = repeats.named_places(data, ends)
        begin = [0, *ends]
        for p, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
            k = next(k for k in range(len(ends)) if p < ends[k])
            n, offset = origins[k]
            for w in range(a, b + 1):
                assert begin[k] <= w and w + 400 <= ends[k] and w <= p <= w + 300
                windows[n, w - begin[k] + offset] += 1
    assert set(windows) == {(n, w) for n, t in enumerate(texts) for w in range(len(t) - 399)}


def test_maximal_repeats():
    before, after = [b"xyz", b"xyq", b"xr", b"m"], [b"abcd", b"abce", b"abq", b"z"]
    found = {(right, tuple(sorted(members.tolist())), int(left.min())) for right, members, left in repeats.maximal_repeats(before, after, 3)}
    assert found == {(3, (0, 1), 2), (2, (0, 1, 2), 1)}


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)}


def test_jaccard_join(spark, docs, rows):
    each = [(i, sets(t)) for i, t, _ in rows]
    parent = list(range(len(each)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (_, x) in enumerate(each):
        for b in range(a):
            y = each[b][1]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, s) in enumerate(each):
        ids[find(k)].append(i)
    want = Counter((i, len(s), min((j for j in ids[find(k)] if j is not None), default=None)) for k, (i, s) in enumerate(each))
    got = jaccard_join.near_duplicates(docs).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == want
    assert sum(r.component_id == 10_000 for r in got) > 40
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_gathering_keys_meet_every_similar_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (3, 12, 21, 40, 100, 400, 1500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            gone = rng.integers(0, len(a) // 10 + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, rng.integers(0, len(a) // 10 + 1), np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if shared < len(a) or shared < len(b):
                if 100 * shared >= 90 * (len(a) + len(b) - shared):
                    assert len(np.intersect1d(jaccard_join.gathering_keys(a, 90), jaccard_join.gathering_keys(b, 90)))


def test_rarest_keys_meet_every_similar_pair_however_common_keys_are():
    rng = np.random.default_rng(6)
    for n in (3, 12, 40, 400, 1500):
        for percent in (80, 90):
            for most in (1, 2, 6):
                a = np.unique(rng.integers(0, 2**64, n, np.uint64))
                gone = rng.integers(0, len(a) // 10 + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, rng.integers(0, len(a) // 10 + 1), np.uint64)]))
                shared = len(np.intersect1d(a, b))
                if (shared < len(a) or shared < len(b)) and 100 * shared >= percent * (len(a) + len(b) - shared):
                    common_keys = np.intersect1d(jaccard_join.gathering_keys(a, percent), jaccard_join.gathering_keys(b, percent))
                    one, two = jaccard_join.rarest_keys([a, b], percent, lambda k: np.where(np.isin(k, common_keys), 1 + k % np.uint64(most), 0).astype(np.int64))
                    assert len(np.intersect1d(one, two))


def test_a_passage_that_many_texts_share_gathers_none_of_them(spark, monkeypatch):
    """Before, each text met all others under the groups that lie inside the passage."""
    told = {}

    def kept(df, name):
        told[name] = session.materialise(df, name)
        return told[name]

    monkeypatch.setattr(jaccard_join, "materialise", kept)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, " ".join(f"w{k}-{j}" for j in range(260)) + " " + passage, None) for k in range(60)]
    copies = [(100 + k, rows[k][1] + " more", None) for k in range(5)]
    out = jaccard_join.near_duplicates(frame(spark, rows + copies), size=5, percent=80).collect()
    assert Counter((r.id, r.component_id) for r in out) == Counter([(k, k) for k in range(60)] + [(100 + k, k) for k in range(5)])
    assert told["members"].count() == 10


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 5])
def test_centres_meet_the_later_rows_of_their_gathering(spark, monkeypatch, block):
    """Blocks of a gathering, leaves and rows of other components, next to all pairs."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "STEP", 7)
    monkeypatch.setattr(jaccard_join, "LEAF", 4)
    rng = random.Random(8)
    rows = []
    for key in range(6):
        for r in range(1, 3 + 6 * key):
            n = rng.randint(60, 70) if rng.random() < 0.9 else 40_000
            rows.append((key, r, 1000 * key + r, rng.randint(0, 3), n, rng.randint(58, 70), [rng.randint(1, 3) for _ in range(jaccard_join.GROUPS)]))
    df = spark.createDataFrame(rows, "key long, r int, node long, comp long, n long, m long, point array<short>")
    want = Counter()
    for p in rows:
        for q in rows:
            if p[0] == q[0] and p[1] < q[1] and p[1] <= 9 and p[3] != q[3]:
                shared = min(p[5], q[5])
                if max(p[4], q[4]) <= jaccard_join.WIDE:
                    shared = min(shared, sum(map(min, p[6], q[6])))
                if 100 * shared >= 70 * (p[4] + q[4] - shared):
                    want[p[2], q[2]] += 1
    assert Counter((r.a, r.b) for r in jaccard_join._near_centres(df, 9, 70).collect()) == want and len(want) > 30


def test_repeated_hashes_pass_their_filter(spark):
    """All that are there twice, in one batch or far apart, and hardly any other; in few rows, whatever the number of parts."""
    rng = np.random.default_rng(3)
    once, twice = rng.integers(0, 2**63, 40_000).view(np.uint64) * np.uint64(2), rng.integers(0, 2**63, 3_000).view(np.uint64) * np.uint64(2) + np.uint64(1)
    near = twice[:5] ^ np.uint64(1 << 30)  # these differ from the first 34 bits on
    rows = [(int(h),) for h in np.concatenate([once, twice, twice, near]).view(np.int64)]
    for parts in (3, 400):
        bits = common.repeated_filter(spark.createDataFrame(rows, "h long").repartition(parts), lambda b: b.column(0).to_numpy().view(np.uint64))
        assert common.passing(twice, bits, common.block_probes).all()
        assert common.passing(once, bits, common.block_probes).mean() < 0.01 and not common.passing(near, bits, common.block_probes).any()
    assert not common.repeated_filter(spark.createDataFrame([], "h long"), lambda b: b.column(0).to_numpy().view(np.uint64)).any()


def test_sets_that_meet_in_many_gatherings_and_are_not_linked(spark, monkeypatch):
    """None is similar enough to another, so that all rounds compare them; copies and repeated rows among them are linked."""
    told = {}

    def kept(df, name):
        told[name] = session.materialise(df, name)
        return told[name]

    monkeypatch.setattr(jaccard_join, "materialise", kept)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    rows = [(90, " ".join(base), None)]
    for k in range(40):
        text = base.copy()
        for at in rng.sample(range(300), 9):
            text[at] = f"x{k}-{at}"
        rows.append((k, " ".join(text), None))
    again = [rows[3], rows[3], (200, rows[3][1], None), (201, rows[4][1].upper(), None)]
    out = jaccard_join.near_duplicates(frame(spark, rows + again)).collect()
    copies = {200: rows[3][0], 201: rows[4][0]}
    assert Counter((r.id, r.component_id) for r in out) == Counter((i, copies.get(i, i)) for i, _, _ in rows + again)
    assert told["sets"].count() == len(rows) and "hashes" not in told["sets"].columns  # elements are written once, with the members


def test_chains_join_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 103), (103, 101)], "a long, b long")
    got = {r.node: r.comp for r in jaccard_join.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    text = lambda n: [word() for _ in range(n)]
    items = [text(n) for n in (12, 14, 30, 60, 11)]
    docs, want = [], set()
    for k, item in enumerate(items):
        docs.append((k, text(20) + [w.upper() for w in item] + text(9)))
        changed = list(item)
        changed[len(item) // 2] = "other"
        docs.append((10 + k, text(5) + changed))
        if len(item) >= 12:
            want |= {(k, k), (10 + k, k)}
    docs += [(20, text(200)), (21, items[3][:9] + text(40)), (22, [w if n % 3 else "x" for n, w in enumerate(items[3])]), (23, items[2][5:18])]
    want |= {(23, 2)}
    table = spark.createDataFrame([(i, ", ".join(t), 1) for i, t in docs] + [(30, None, 1), (31, "", 1), (0, ", ".join(docs[0][1]), 1)], "doc_id long, text string, tokens long")
    bench = spark.createDataFrame([(k, " ".join(t), 1) for k, t in enumerate(items)] + [(9, None, 1), (8, "", 1)], "item_id long, text string, seeds long")
    found = decontamination.overlaps(table, bench).collect()
    assert {(r.id, r.item) for r in found} == want and len(found) == len(want)
    kept = decontamination.decontaminated(table, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want} | {30, 31} and kept.columns == table.columns
    assert decontamination.overlaps(table, bench.limit(0)).count() == 0 and decontamination.overlaps(table.limit(0), bench).count() == 0


def test_decontamination_wherever_words_are_replaced(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9)))
    text = lambda n: [word() for _ in range(n)]
    items = [text(13), text(12), text(60)]
    docs = []
    for item in items[:2]:  # all ways to replace two words, and some to replace three
        n = len(item)
        ways = [*itertools.combinations(range(n), 2), *itertools.islice(itertools.combinations(range(n), 3), 0, None, 9)]
        docs += [text(6) + [f"x{w}" if k in gone else w for k, w in enumerate(item)] + text(6) for gone in ways]
    for every in (3, 4, 5, 6):
        docs += [text(4) + [f"x{w}" if k % every == at else w for k, w in enumerate(items[2])] + text(4) for at in range(every)]

    def held(doc, item):
        width = min(13, len(item))
        return any(
            10 * sum(a == b for a, b in zip(doc[i : i + width], item[j : j + width], strict=True)) >= 8 * width
            for i in range(len(doc) - width + 1) for j in range(len(item) - width + 1)
        )

    want = {(d, k) for d, doc in enumerate(docs) for k, item in enumerate(items) if held(doc, item)}
    table = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = decontamination.overlaps(table, bench).collect()
    assert {(r.id, r.item) for r in found} == want and len(found) == len(want)
    assert {k for _, k in want} == {0, 1, 2} and len(want) >= 78 + 66 + 5 and len(want) < len(docs)
    with pytest.raises(ValueError):
        decontamination.overlaps(table, bench, share=0.7)


def test_quality_on_unseen_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    docs = docs.join(labels.select("doc_id"), "doc_id")
    verdict = quality.judged(docs, seen).withColumnRenamed("id", "doc_id")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    share = {r.good: r.kept for r in verdict.join(held, "doc_id").groupBy(good.alias("good")).agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert share[True] > 0.98 and share[False] < 0.2, share


def test_quality_without_labels_and_with_odd_rows(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, none, path=F.lit("p")).collect()
    assert len(got) == len(rows) and {round(r.p_text, 6) for r in got} == {0.5}
    one = spark.createDataFrame([(rows[0][0], 1, 0), (None, 0, 1), (rows[1][0], None, 0)], "doc_id long, quality int, toxic int")
    assert {round(r.p_text, 6) for r in quality.judged(docs, one, path=F.lit("p")).collect()} == {round(2 / 3, 6)}
    assert quality.judged(empty(spark), none, path=F.lit("p")).count() == 0
    kept = quality.kept(docs, none, path=F.lit("p"))
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 0.9)] * 400 + [("poor", "b", 0.1)] * 400 + [("small", "c", 0.1)]
    got = {r.host: r for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, p_text double")).collect()}
    assert got["poor"].p_path < 0.15 and got["big"].p_path > 0.85
    assert 0.1 < got["small"].p_host < 0.5 and got["small"].p_path > got["poor"].p_path


def test_preference_format(spark):
    schema = "pair long, turn long, role string, text string, part string"
    turns = lambda pair, said: [(pair, k, r, t, "x") for k, (r, t) in enumerate(said)]
    head = [("system", "be kind"), ("user", "hé"), ("assistant", "hello"), ("user", "more")]
    long = [("user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(150)]
    good = turns(1, [*head, ("assistant", "good")]) + turns(2, head) + turns(3, long) + [(4, 0, None, None, "x"), (None, 0, "user", "lost", "x"), (5, 0, "user", "only", "x")]
    bad = turns(1, [*head, ("assistant", "bad"), ("user", "why")]) + turns(2, head) + turns(3, [*long[:100], ("user", "stop")]) + [(4, 0, None, "", "x")]
    out = preference_format.format_pairs(spark.createDataFrame(good + good[:2], schema), spark.createDataFrame(bad, schema)).collect()
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: r.block):
        by[r.pair, r.part].append(r)
    show = lambda said: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in said)
    assert by[1, "prompt"][0].rendered == show(head) and by[1, "prompt"][0].trained == ""
    spans = lambda r: [r.rendered[int(a) : int(b)] for a, b in (s.split(":") for s in r.trained.split(",") if s)]
    assert spans(by[1, "chosen"][0]) == ["good<|end|>"] and spans(by[1, "rejected"][0]) == ["bad<|end|>"]
    assert by[1, "rejected"][0].rendered == show([("assistant", "bad"), ("user", "why")])
    assert set(p for k, p in by if k == 2) == {"prompt"} and set(p for k, p in by if k == 4) == {"prompt"} and set(p for k, p in by if k == 5) == {"chosen"}
    assert "".join(r.rendered for r in by[3, "prompt"]) == show(long[:100]) and len(by[3, "prompt"]) == 2
    assert [t for r in by[3, "chosen"] for t in spans(r)] == [f"t{k}<|end|>" for k in range(101, 150, 2)]
    nothing = spark.createDataFrame([], schema)
    assert preference_format.format_pairs(nothing, nothing).count() == 0


def test_answers_exchanged_keeps_whole_conversations(spark):
    said = {
        2: [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "two"), ("user", "thanks"), ("tool", "log")],
        3: [("user", "d"), ("assistant", "three")],
        4: [("user", "no answer"), ("user", "none")],
        5: [("user", "e"), ("assistant", "five"), ("user", "left over")],
    }
    table = spark.createDataFrame([(i, k, r, t) for i, ts in said.items() for k, (r, t) in enumerate(ts)], "conv_id long, turn long, role string, text string")
    out = {(r.pair, r.part): r for r in preference_format.format_pairs(*preference_format.answers_exchanged(table)).collect()}
    show = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
    spans = lambda r: [r.rendered[int(a) : int(b)] for a, b in (s.split(":") for s in r.trained.split(",") if s)]
    want = {
        (2, "prompt"): said[2][:3], (2, "chosen"): said[2][3:], (2, "rejected"): [("assistant", "three"), *said[2][4:]],
        (3, "prompt"): said[3][:1], (3, "chosen"): said[3][1:], (3, "rejected"): [("assistant", "two")],
        (4, "chosen"): said[4], (5, "prompt"): said[5][:1], (5, "chosen"): said[5][1:],
    }
    assert {k: r.rendered for k, r in out.items()} == {k: show(t) for k, t in want.items()}
    assert spans(out[2, "chosen"]) == ["two<|end|>"] and spans(out[2, "rejected"]) == ["three<|end|>"] and spans(out[4, "chosen"]) == []


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r.doc_id: r for r in docs.collect()}
    kept = []
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        kept.append({r.doc_id: r for r in docs.collect()})
    poor, lines, one, clean = kept
    verdict = {r.id: r.keep for r in quality.judged(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(poor) == {i for i, k in verdict.items() if k} and all(poor[i] == first[i] for i in poor)
    assert set(lines) == set(poor) and all(r.n_chars == len(r.text) for r in lines.values()) and any(lines[i].text != poor[i].text for i in lines)
    groups, each = [], [(i, sets(lines[i].text)) for i in sorted(lines)]
    for i, s in each:
        hit = [g for g in groups if s and any(100 * len(s & t) >= 90 * len(s | t) for _, t in g)]
        groups = [g for g in groups if g not in hit] + [sum(hit, []) + [(i, s)]]
    assert set(one) == {min(i for i, _ in g) for g in groups}
    assert set(clean) <= set(one)
    last = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(clean) and all(len(r.ids) == r.n_tokens for r in last)


def test_pipeline_keeps_one_of_five_word_near_copies(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 8)))
    base = [word() for _ in range(200)]
    texts = [base, [word() if k in (40, 80, 120, 160) else w for k, w in enumerate(base)]]
    for n in (4, 9, 30, 60, 120, 300):
        base = [word() for _ in range(n)]
        for share in (0, 0.01, 0.015, 0.02, 0.025, 0.04):
            gone = set(rng.sample(range(n), round(n * share)))
            texts.append([word() if k in gone else w for k, w in enumerate(base)])
        texts.append(base + [word() for _ in range(n // 5)])
    sets5 = [{tuple(t[k : k + 5]) for k in range(max(len(t) - 4, 1))} for t in texts]
    assert 100 * len(sets5[0] & sets5[1]) >= 80 * len(sets5[0] | sets5[1])
    groups = []
    for i, s in enumerate(sets5):
        hit = [g for g in groups if any(100 * len(s & sets5[j]) >= 80 * len(s | sets5[j]) for j in g)]
        groups = [g for g in groups if g not in hit] + [sum(hit, []) + [i]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.keep_one(spark, docs, SF).collect()) == sorted(min(g) for g in groups)


def test_pipeline_keeps_one_of_components_without_ids_and_of_one_id(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(22)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(100)]
    near = lambda t: " ".join([*t[:50], f"w{rng.randrange(10**6)}", *t[51:]])
    a, b, c, d, e = (text() for _ in range(5))
    groups = [
        [(None, " ".join(a)), (None, near(a)), (None, near(a))], [(None, " ".join(b)), (None, near(b))],
        [(5, " ".join(c)), (5, near(c)), (6, near(c)), (None, near(c))], [(5, " ".join(d)), (7, near(d))], [(8, " ".join(e)), (8, " ".join(e))],
        [(9, "")], [(10, None)], [(None, " ")],
    ]
    rows = [r for g in groups for r in g]
    got = pipeline.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF).collect()
    kept = [[r.doc_id for r in got if (r.doc_id, r.text) in g] for g in groups]
    assert kept == [[None], [None], [5], [5], [8], [9], [10], [None]] and len(got) == len(groups)
