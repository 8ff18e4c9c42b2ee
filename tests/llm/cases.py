"""Small tables with the rows that need a stated result: nulls, empty and long texts, repeats, clashing names."""

import random

import duckdb

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, key string, id long, count long, line string, fp long, sketch string, n_chars long"


def corpus(n=60):
    """Some given documents, then the odd ones."""
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT {n}").fetchall()
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4)))
    long = " ".join(word() for _ in range(30_000))
    more = [
        None, "", " ", "\n", "\n\n \n", "one", "one two", "a b c d e", "same line of text\nother\nSAME line of text \nsame line of text", "  same LINE of text\t\nshort\n",
        long, "1" * 50_000, "a" * 50_000 + "@", "a@" * 5_000, "9 " * 20_000, "日本語 のテキスト 😀 ▁ <|endoftext|> <s>   é" * 20, "\x00\x01 tab\there",
        "mail me: x.y@a.b.c_d@e.f, ip 10.0.0.256 and 1.2.3.4.5.6.7.8 host 0255.1.1.1", "card 4111 1111 1111 1111 or 4111111111111112 call +1 (988) 555-2485.",
        "iban DE89 3704 0044 0532 0130 00 phone 555-123-4567, tel (212) 555 1234", "+1 2+33 444 555 666 77 +", "12-34-56 78 1 2 3 4 5 6 7 8 9 0 1 2",
    ]
    first = max(r[0] for r in rows) + 7
    rows += [(first + i * 3, t, "odd") for i, t in enumerate(more)]
    rows += [rows[3], rows[3], (rows[5][0], "other text under one id", None), (None, "text without an id", "x"), (None, None, None)]
    rows += [(first + 1000, rows[1][1], "copy"), (first + 1001, (rows[1][1] or "") + " tail", "near")]
    return rows


def frame(spark, rows):
    """As a table whose other columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "k", 1, 2, "l", 3, "s", 4) for i, t, s in rows], SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
