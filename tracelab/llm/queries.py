"""One query for each operator over its whole table, and the SQL that gives the same rows where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import (
    decontamination, exact_dedup, fingerprints, jaccard_join, line_dedup, phrases, piece_encoding, preference_format, private_data, quality, repeats, token_counts, vector_codes,
)
from tracelab.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL if there is one."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op3_piece_encoding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact encoding and decoding of every document."""
    docs = table(spark, sf_dir, "documents")
    return piece_encoding.encode_decode(docs, tokenizer("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and where 512 of them end."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json"), 512).withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
shared AS (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
    SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.first AS gone
    FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op9_line_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least two documents hold go from all but the first of them."""
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled sketches of every text and of its edited text."""
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP2_SQL = """
WITH chosen AS (SELECT conv_id AS pair, turn, role, text FROM conversations),
last AS (SELECT pair, max(turn) AS last, max_by(text, turn) AS answer FROM chosen WHERE role = 'assistant' GROUP BY pair),
rejected AS (
    SELECT t.pair, t.turn, t.role, CASE WHEN t.turn = l.last THEN o.answer ELSE t.text END AS text
    FROM chosen t JOIN last l ON t.pair = l.pair LEFT JOIN last o ON o.pair = xor(l.pair, 1)
    WHERE t.turn < l.last OR o.pair IS NOT NULL),
both_sides AS (
    SELECT coalesce(c.pair, r.pair) AS pair, coalesce(c.turn, r.turn) AS turn, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text
    FROM chosen c FULL JOIN rejected r ON c.pair = r.pair AND c.turn = r.turn),
differ AS (
    SELECT pair, min(turn) AS split FROM both_sides
    WHERE c_role IS DISTINCT FROM r_role OR c_text IS DISTINCT FROM r_text GROUP BY pair),
parts AS (
    SELECT b.pair, turn, 'prompt' AS part, c_role AS role, c_text AS text FROM both_sides b LEFT JOIN differ d ON b.pair = d.pair WHERE split IS NULL OR turn < split
    UNION ALL
    SELECT b.pair, turn, 'chosen', c_role, c_text FROM both_sides b JOIN differ d ON b.pair = d.pair WHERE turn >= split AND c_role IS NOT NULL
    UNION ALL
    SELECT b.pair, turn, 'rejected', r_role, r_text FROM both_sides b JOIN differ d ON b.pair = d.pair WHERE turn >= split AND r_role IS NOT NULL),
shown AS (SELECT *, turn // 64 AS block, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said FROM parts),
placed AS (
    SELECT *, coalesce(sum(length(said)) OVER (PARTITION BY pair, part, block ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + length(role) + 5 AS start FROM shown)
SELECT pair, part, block, count(*) AS n_turns, string_agg(said, '' ORDER BY turn) AS rendered,
       CASE WHEN part = 'prompt' THEN ''
            ELSE coalesce(string_agg(start || ':' || (start + length(text) + 7), ',' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') END AS trained
FROM placed GROUP BY pair, part, block
"""


@query("op2_preference_format", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations against themselves with another's last answer: prompt once, completions with masks."""
    return preference_format.format_pairs(*preference_format.answers_exchanged(table(spark, sf_dir, "conversations")))


@query("op5_private_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = private_data.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [k.name for k in private_data.KINDS if k.base]
    return found.select(
        "row.doc_id", *[count(k) for k in base],
        F.sha2(F.encode(private_data.listed(F.filter("found", lambda s: s["kind"].isin(base))), "UTF-8"), 256).alias("base_sha256"),
        private_data.listed(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"), (F.size("found") > 0).alias("personal"),
    )


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark, and which."""
    found = decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_same", "n_compared")


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "p_text", "p_host", "p_path", "p_keep", "keep")


OP4_SQL = """
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 399)) AS s, h FROM hexed WHERE length(h) >= 800),
keyed AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 800)) AS k FROM starts),
twice AS (SELECT k FROM keyed GROUP BY k HAVING count(*) >= 2),
marked AS (SELECT doc_id, s FROM keyed SEMI JOIN twice USING (k)),
edges AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 400 THEN 0 ELSE 1 END AS opens FROM marked),
numbered AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM edges),
runs AS (SELECT doc_id, n, min(s) AS a, max(s) + 400 AS b FROM numbered GROUP BY doc_id, n),
gaps AS (
    SELECT doc_id, n, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY n), 0) AS c, a AS d FROM runs
    UNION ALL
    SELECT doc_id, 1000000000, max(b), 1000000000 FROM runs GROUP BY doc_id),
kept AS (
    SELECT g.doc_id, string_agg(substr(h, 2 * c + 1, least(2 * (d - c), length(h))), '' ORDER BY n) AS k
    FROM gaps g JOIN hexed x ON x.doc_id = g.doc_id GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT x.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256, coalesce(n_removed, 0) > 0 AS repeated
FROM hexed x LEFT JOIN sums s ON s.doc_id = x.doc_id LEFT JOIN kept k ON k.doc_id = x.doc_id
"""


@query("op4_repeats", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 400-byte strings."""
    out = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated")
    )


OP10_SQL = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingled AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM worded),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM shingled),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c
    FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 90 * (n + m - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(r.m, s.doc_id)) AS component_id
FROM shingled s LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = s.doc_id
"""


@query("op10_jaccard_join", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with nearly the same three-word shingles."""
    out = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def _lloyd_sql(rounds: int = 4) -> str:
    """Rounds as one query after the other."""
    out = ["""kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
    SELECT vec_id, label, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) AS part FROM kept, range(4) t(p)),
b0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS c FROM parts
    WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))"""]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (
    SELECT vec_id, label, x.p, part, min((list_inner_product(part, part) - 2 * list_inner_product(part, c) + list_inner_product(c, c))::BIGINT * 256 + e) AS m
    FROM parts x JOIN b{r} b ON x.p = b.p GROUP BY vec_id, label, x.p, part)""")
        if r < rounds:
            out.append(f"""b{r + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (
        SELECT p, e, list(mean ORDER BY i) AS c FROM (
            SELECT p, m % 256 AS e, i, floor(sum(part[i]) / count(*)) AS mean FROM a{r}, range(1, 1000) t(i) WHERE i <= len(part) GROUP BY ALL) GROUP BY p, e) n
    ON b.p = n.p AND b.e = n.e)""")
    return "WITH " + ",\n".join(out) + f""",
coded AS (SELECT vec_id, label, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label),
book AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (
    SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, book
"""


@query("op11_vector_codes", _lloyd_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector under codebooks of four rounds."""
    return vector_codes.code_table(vector_codes.compress(table(spark, sf_dir, "embeddings")))


OP12_SQL = """
WITH texts AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
grouped AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM grouped
"""


@query("op12_exact_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of its equal texts every document gives way to."""
    found = exact_dedup.verdicts(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS p
    FROM worded, range(1, 5) t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 30),
cand AS MATERIALIZED (SELECT lang, k, p, c AS a, string_split(p, ' ') AS w FROM f WHERE k >= 2),
cuts AS (
    SELECT lang, p, k, a, j, array_to_string(list_slice(w, 1, j), ' ') AS x, array_to_string(list_slice(w, j + 1, k), ' ') AS y
    FROM cand, range(1, 4) t(j) WHERE j < k),
scores AS (
    SELECT c.lang, c.p, c.a, c.j, l.c AS l, r.c AS r, (2000000::HUGEINT * c.a) // (l.c + r.c) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = c.x AND l.k = c.j JOIN f r ON r.lang = c.lang AND r.p = c.y AND r.k = c.k - c.j),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inner_parts AS (
    SELECT lang, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p, max(a) AS a
    FROM cand, range(2, 4) s(n), range(1, 4) t(i) WHERE n < k AND i + n - 1 <= k GROUP BY ALL),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang)
SELECT x.lang, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, x.a DESC, x.p) AS rank, x.p AS phrase, x.a, l, r, n, score::BIGINT AS score
FROM lowest x JOIN words ON words.lang = x.lang LEFT JOIN inner_parts i ON i.lang = x.lang AND i.p = x.p
WHERE i.a IS NULL OR 100 * i.a < 80 * x.a
QUALIFY rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two to four words."""
    return phrases.collocations(table(spark, sf_dir, "documents"))
