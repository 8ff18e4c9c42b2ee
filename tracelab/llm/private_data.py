"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.quantile import let
from tracelab.llm.common import identified, running_sums

WINDOW = 40  # code points on either side of a span in which a context word counts
CONTEXT = 20  # what such a word adds to a score, in hundredths


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``pattern`` proposes; every text that it can match has one of ``needs`` in it; ``score`` in hundredths, with what a passed check adds;
    spans of a ``base`` kind stay at any score, others from 50 on.  Repeats are possessive where giving back cannot help, and a
    match starts where its first run does, so that long runs are read once.
    """

    name: str
    pattern: str
    needs: tuple[str, ...]
    words: str
    score: int
    base: bool = True
    check: str = ""
    checked: int = 0


PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",), "mail|contact|write|address", 60),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", (".",), "ip|server|host|address", 50, check="ip"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", (), "card|visa|credit|payment|account", 40, check="luhn", checked=40),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", ("+",), "phone|tel|call|mobile|fax", 50, check="phone"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", (), "iban|bank|account|konto", 40, False, "mod97", 40),
    Kind("local_phone", r"(?<![A-Za-z0-9+().-])(?<![0-9+().-] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", (), "phone|tel|call|mobile|fax", 30, False),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,128}+(?![A-Za-z0-9])", (), "token|key|secret|password|bearer|auth", 20, False, "mixed", 20),
)


def luhn(digits: Column) -> Column:
    """Whether a string of at most some dozens of digits passes the doubling checksum."""
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    each = F.transform(
        F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 1, doubled(d)).otherwise(d))
    )
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number, its first four signs put last and letters read as 10 to 35, leaves 1 when divided by 97."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    numbers = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).when(c.rlike("[0-9]"), F.ascii(c) - 48))
    step = lambda a, n: F.when(n.isNull(), a).when(n > 9, (a * 100 + n) % 97).otherwise((a * 10 + n) % 97)
    return F.aggregate(numbers, F.lit(0), step) == 1


def passes(kind: Kind, hit: Column) -> Column:
    """The validator of a kind on what its expression found."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.char_length(digits)
    if kind.check == "ip":
        return hit.rlike(rf"^(?:{PART}\.){{3}}{PART}$")
    if kind.check == "luhn":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind.check == "phone":
        return n.between(9, 15)
    if kind.check == "mod97":
        return mod97(F.regexp_replace(hit, " ", ""))
    if kind.check == "mixed":  # drawn digits repeat little: eight different ones at least, letters and numbers among them
        return hit.rlike("[0-9]") & hit.rlike("[A-Fa-f]") & (F.size(F.array_distinct(F.split(F.lower(hit), ""))) >= 8)
    return F.lit(True)


def spans(text: Column, kind: Kind, order: int) -> Column:
    """Accepted spans of a kind: an array of ``(start, order, end, kind, score)`` in code points.

    The expression cuts the text, so that a span starts where the pieces and spans before it end.
    """
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"), F.split(text, kind.pattern, -1).alias("pieces")
    )

    def placed(p: Column) -> Column:
        n = F.size(p["hits"])
        steps = F.zip_with(F.slice(p["pieces"], 1, n), p["hits"], lambda a, b: F.char_length(a) + F.char_length(b))
        starts = running_sums(steps)
        rows = F.arrays_zip(p["hits"].alias("hit"), F.slice(p["pieces"], 1, n).alias("piece"), F.slice(p["pieces"], 2, n).alias("behind"), starts.alias("from"))
        found = F.transform(F.filter(rows, lambda r: passes(kind, r["hit"])), made)
        return found if kind.base else F.filter(found, lambda s: s["score"] >= 50)

    def made(r: Column) -> Column:
        near = F.right(r["piece"], F.lit(WINDOW)).rlike(rf"(?i)\b(?:{kind.words})") | F.left(r["behind"], F.lit(WINDOW)).rlike(rf"(?i)\b(?:{kind.words})")
        start = (r["from"] + F.char_length(r["piece"])).cast("long")
        return F.struct(
            start.alias("start"), F.lit(order).alias("order"), (start + F.char_length(r["hit"])).alias("end"), F.lit(kind.name).alias("kind"),
            F.least(F.lit(100), F.lit(kind.score + kind.checked) + F.when(near, CONTEXT).otherwise(0)).alias("score"),
        )

    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string,score:int>>")
    found = let(parts, lambda p: F.when(F.size(p["hits"]) > 0, placed(p)).otherwise(none))
    may = F.lit(True)
    for sign in kind.needs:
        may = may & F.contains(text, F.lit(sign))
    if not kind.needs:
        may = text.rlike("[0-9]{2}|[0-9][ -][0-9]")
    return F.when(may, found).otherwise(none)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``(row, found)``: one row per input row with its spans by start, then kind in the order of ``kinds``.

    A null or empty text has no spans.  Per kind, spans do not overlap; a match that fails its validator is gone with all its
    characters.  Spans of different kinds may overlap.  A repeated row gives its spans again; an empty table gives an empty result.
    """
    base = identified(docs, id_col, text_col)
    each = [spans(F.col("text"), kind, i) for i, kind in enumerate(kinds)]
    return base.select("row", *[e.alias(f"k{i}") for i, e in enumerate(each)]).select(
        "row", F.sort_array(F.concat(*[F.col(f"k{i}") for i in range(len(each))])).alias("found")
    )


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, masked)``: texts with every found span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    found = find(docs, id_col, text_col).withColumn("text", F.coalesce(F.col("row").getField(text_col), F.lit("")))
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    cut = lambda text, a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    def step(text: Column, acc: Column, s: Column) -> Column:
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], cut(text, acc["at"], s["start"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at")
        ))

    body = let(F.col("text"), lambda t: F.aggregate(
        F.col("found"), state, lambda acc, s: step(t, acc, s),
        lambda acc: F.concat(acc["out"], cut(t, acc["at"], F.char_length(t).cast("long"))),
    ))
    return found.select("row", body.alias("masked"))
