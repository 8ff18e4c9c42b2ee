"""Operators on single texts and on lines, next to plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.cases import corpus, empty, frame
from tracelab.llm import fingerprints, line_dedup, piece_encoding, private_data, token_counts
from tracelab.llm.queries import tokenizer

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def test_line_dedup(spark, docs, rows):
    keyed = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    order = lambda i: 2**63 - 1 if i is None else i
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            holders[keyed(line)].add(order(i))
    want = Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(keyed(x)) < 10 or len(holders[keyed(x)]) < 2 or order(i) == min(holders[keyed(x)])]
        want[i, len(lines), len(lines) - len(keep), "\n".join(keep)] += 1
    got = line_dedup.drop_repeated_lines(docs).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert Counter(map(tuple, got)) == want
    assert any(r.n_dropped for r in got)
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def test_piece_encoding(spark, docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    want = Counter()
    for i, t, _ in rows:
        ids = lib.encode(t or "", num_threads=1)
        want[i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)), tuple(ids)] += 1
    out = piece_encoding.encode_decode(docs, tokenizer("piece_bpe_32k.model"), keep=("decoded", "ids"))
    got = Counter((r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in out.collect())
    assert got == want
    assert piece_encoding.encode_decode(empty(spark), tokenizer("piece_bpe_32k.model")).count() == 0


def test_piece_codec_on_random_texts():
    import random

    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_encoding.PieceCodec(piece_encoding.read_model(path))
    rng = random.Random(1)
    bits = ["a", "the", " ", "  ", "▁", "\n", "é", "日本", "😀", "1", "23", "<s>", "<0x41>", "ing", "\x00", " " * 17, "न्", "=", "　"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert own.encode(text) == lib.encode(text), repr(text)
        assert own.decode(own.encode(text)) == lib.decode(lib.encode(text)), repr(text)
    for _ in range(500):
        ids = [rng.randrange(32000) if rng.random() < 0.3 else rng.randrange(3, 259) for _ in range(rng.randint(1, 12))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_token_counts(spark, docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    size = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    want = Counter((i, len((t or "").encode()), size(t or ""), size(t or "") > 512) for i, t, _ in rows)
    got = token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json")).collect()
    assert Counter((r.id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    text = {i: t or "" for i, t, _ in rows if i is not None and i != rows[5][0]}
    for r in got:
        if r.id in text and r.n_tokens > 512 and len(text[r.id]) < 20_000:
            assert size(text[r.id][: r.cut_chars]) <= 512 < size(text[r.id][: r.cut_chars + 1])
    assert token_counts.count_tokens(empty(spark), tokenizer("byte_bpe_50k.json")).count() == 0


def test_counts_at_every_prefix(spark):
    import random

    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), token_counts.PrefixCounter(token_counts.read_vocabulary(path))
    size = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rng = random.Random(3)
    bits = ["a", "the", " ", "  ", "'", "'re", "'r", "re", "\n", "é", "日本", "😀", "23", "<|endoftext|>", "<|end", "\t", "!", " ", "\x1c", "½", "̀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    for text in texts:
        want = [size(text[:n]) for n in range(len(text) + 1)]
        limit = rng.randint(0, 5)
        assert own.prefixes(text) == want, repr(text)
        assert own.count(text, limit) == (want[-1], max(n for n, k in enumerate(want) if k <= limit)), repr(text)
    table = spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string")
    for r in token_counts.prefix_counts(table, path).collect():
        assert r.counts == own.prefixes(texts[r.id])


def personal(text):
    """Spans of the base kinds by their definition."""
    out = []
    luhn = lambda d: sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for n, (kind, pattern, good) in enumerate(kinds):
        out += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text) if good(m.group())]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_private_data(spark, docs, rows):
    slow = {t for _, t, _ in rows if t and t.startswith("a" * 50_000)}  # the plain expression is quadratic there
    want = Counter((i, ",".join(personal(t or "") if t not in slow else [])) for i, t, _ in rows)
    found = private_data.find(docs).select("row.doc_id", private_data.listed(private_data.F.filter("found", lambda s: ~s["kind"].isin("iban", "local_phone", "secret"))).alias("base"), "found").collect()
    assert Counter((r.doc_id, r.base) for r in found) == want
    kinds = Counter(s.kind for r in found for s in r.found)
    assert kinds["iban"] == 1 and kinds["local_phone"] == 2
    scores = {s.kind: s.score for r in found for s in r.found if s.kind in ("iban", "local_phone")}
    assert scores == {"iban": 100, "local_phone": 50}
    assert private_data.find(empty(spark)).count() == 0


def test_validators(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    lit = private_data.F.lit
    assert one(private_data.mod97(lit("GB82WEST12345698765432"))) and not one(private_data.mod97(lit("GB83WEST12345698765432")))
    assert one(private_data.luhn(lit("79927398713"))) and not one(private_data.luhn(lit("79927398710")))


def test_secrets(spark):
    """Every planted token is found; runs of one digit, long numbers and parts of words are not."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {
        (r.doc_id, m.start(1), m.end(1)) for r in table.collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "")
    }
    got = {
        (r.doc_id, s.start, s.end) for r in private_data.find(table).select("row.doc_id", "found").collect() for s in r.found if s.kind == "secret"
    }
    assert len(planted) >= 10 and planted <= got
    odd = ["token " + "a" * 40, "key " + "1" * 40, "secret x" + "0123456789abcdef" * 2, "0123456789abcdef" * 2 + " alone", "0123456789ABCDEF" * 2 + " is the password", "token " + "0123456789abcdef" * 9]
    frame = spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string")
    assert {r.doc_id: [(s.start, s.end) for s in r.found if s.kind == "secret"] for r in private_data.find(frame).select("row.doc_id", "found").collect()} == {
        0: [], 1: [], 2: [], 3: [], 4: [(0, 32)], 5: [],
    }


def test_masking(spark):
    table = spark.createDataFrame([(1, "write to a@b.cd now"), (2, None)], "doc_id long, text string")
    assert {r.masked for r in private_data.masked(table).select("masked").collect()} == {"write to <email> now", ""}


def test_fingerprints(spark, docs, rows):
    got = fingerprints.edited_likeness(docs).collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(t or "")
    order = sorted((i for i in texts if i is not None), reverse=True) + [None]
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    want = defaultdict(set)
    for i, t, _ in rows:
        t = t or ""
        third = len(t) // 3
        for head in texts[following[i]]:
            want[i].add((len(t), sha(t[: len(t) - third] + head[:third])))
    assert all((r.n_chars, r.edited_sha256) in want[r.id] for r in got)
    by_text = defaultdict(set)
    for r in got:
        if len(texts[r.id]) == 1:
            by_text[next(iter(texts[r.id]))].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in got if 400 < r.n_chars < 20_000]
    assert sum(r.near_edited for r in long) / len(long) > 0.5 > 0.1 > sum(r.near_next for r in long) / len(long)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.edited_likeness(empty(spark)).count() == 0


def test_sketch_estimates_containment(spark):
    import random

    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    table = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:4000] + [f"x{k}" for k in range(4000)]))], "doc_id long, text string")
    made = fingerprints.fingerprints(table)
    a, b = (set(r.sketch) for r in made.orderBy("row.doc_id").collect())
    assert abs(len(a) / 40_000 - 1 / 8) < 0.01 and abs(len(a & b) / len(b) - 0.5) < 0.06
    whole = fingerprints.merged(made.select(private_data.F.lit("all").alias("key"), "sketch"), "key").collect()
    assert {r.hash for r in whole} == a | b


def test_running_sums(spark):
    from tracelab.llm.common import running_sums

    F = private_data.F
    for n in (0, 1, 2, 255, 256, 257, 1000):
        got = spark.range(1).select(running_sums(F.expr(f"slice(sequence(1, 1001), 1, {n})"))).first()[0]
        assert got == [k * (k + 1) // 2 for k in range(n)]
