"""Token counts by prefix dynamic programming.

A byte-level vocabulary encodes each pre-token by itself.  Within one, the last token of every prefix follows from the last
tokens of shorter prefixes: it is the one token ending there that fits behind its predecessor, which merging the two again decides.
With the last token comes the exact count at every prefix, so that a limit or a cut needs no further encoding.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracelab.llm.common import Memo, each_batch, identified

# fixed values: the pre-token pattern of byte-level vocabularies
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# the same pattern for texts without other letters, which plain classes match faster
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
CONTRACTED = {"'re", "'ve", "'ll"}
SHORT = 40


def read_vocabulary(path: str) -> dict:
    """``tokens``, ``merges`` and ``special`` of a byte-level vocabulary file; raises for any other kind."""
    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    model, pre = form["model"], form["pre_tokenizer"] or {}
    if form["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("a byte-level vocabulary without normaliser is needed")
    if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("a merge vocabulary is needed")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"tokens": model["vocab"], "merges": merges, "special": [t["content"] for t in form["added_tokens"]]}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others in order from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def split_text(text: str) -> list[str]:
    """Pre-tokens of a text."""
    return (ASCII if text.isascii() else PATTERN).findall(text)


class PrefixCounter:
    """Counts at every prefix, for one vocabulary."""

    def __init__(self, vocabulary: dict, cache: int = 250_000):
        self.tokens = {t: i for t, i in vocabulary["tokens"].items() if t not in vocabulary["special"]}
        self.text_of = {i: t for t, i in self.tokens.items()}
        self.rank = {pair: r for r, pair in enumerate(vocabulary["merges"])}
        self.letters = dict(enumerate(byte_letters()))
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary["special"], key=len, reverse=True)))) if vocabulary["special"] else None
        self.find = ahocorasick.Automaton()
        for t, i in self.tokens.items():
            self.find.add_word(t, (i, len(t) - 1))
        self.find.make_automaton()
        self.fits = Memo(self._fits, cache)
        self.tables = Memo(self._table, cache, lambda piece: len(piece) <= SHORT)

    def merged(self, text: str) -> list[str]:
        """The merge rule itself, for the short strings of a check: lowest rank first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            options = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
            if not options:
                break
            i = min(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, pair: int) -> bool:
        """Whether a token (second half) may follow another (first half, 0 for none, else its id plus one)."""
        last, token = pair >> 20, self.text_of[pair & 0xFFFFF]
        if not last:
            return self.merged(token) == [token]
        before = self.text_of[last - 1]
        return self.merged(before + token) == [before, token]

    def _table(self, piece: str):
        """Counts at the byte prefixes of a pre-token, from the empty one on."""
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        n, fits = len(raw), self.fits
        last, counts = [0] * (n + 1), [0] * (n + 1)
        for end, (token, reach) in self.find.iter(raw):
            start = end - reach
            if not last[end + 1] and (not start or last[start]) and fits[last[start] << 20 | token]:
                last[end + 1] = token + 1
                counts[end + 1] = counts[start] + 1
        return bytes(counts) if n < 256 else counts

    def _segments(self, text: str):
        """Stretches between special strings, each with the special string behind it or nothing."""
        at = 0
        for hit in self.special.finditer(text) if self.special else ():
            yield text[at : hit.start()], hit.group()
            at = hit.end()
        yield text[at:], ""

    def count(self, text: str, limit: int | None = None) -> tuple[int, int]:
        """Tokens of the text, and the code points of its longest prefix with at most ``limit`` tokens (the whole text without limit)."""
        done, chars, cut = 0, 0, 0
        for stretch, special in self._segments(text):
            pieces = split_text(stretch)
            sizes = [t[-1] for t in map(self.tables.__getitem__, pieces)]
            total = sum(sizes)
            if limit is not None and done <= limit:
                if done + total + bool(special) <= limit:
                    cut = chars + len(stretch) + len(special)
                elif special:
                    cut = chars + _last(self._prefixes(split_text(stretch + special[:-1])), limit - done)
                else:
                    # the cut is in the first piece that ends beyond the limit, or behind white space next to it
                    ends = list(accumulate(sizes))
                    k = bisect_right(ends, limit - done)
                    first = max(k - 2, 0)
                    before = (pieces[first - 1], ends[first - 1] - sizes[first - 1]) if first else ("", 0)
                    near = self._prefixes(pieces[first : k + 2], ends[first - 1] if first else 0, before)
                    cut = chars + sum(map(len, pieces[:first])) + _last(near, limit - done)
            done += total + bool(special)
            chars += len(stretch) + len(special)
        return done, (chars if limit is None else cut)

    def prefixes(self, text: str) -> list[int]:
        """The exact count at every code-point prefix, from the empty one to the whole text."""
        out, done = [], 0
        for stretch, special in self._segments(text):
            out += [done + n for n in self._prefixes(split_text(stretch + special[:-1]))]
            done = out[len(out) - 1 - len(special[:-1])] + bool(special)
        return out

    def _prefixes(self, pieces: list[str], done: int = 0, before: tuple[str, int] = ("", 0)) -> list[int]:
        """Counts at the code-point prefixes of pieces that follow ``done`` tokens; ``before``: the last piece and the count in front of it."""
        out = [done]
        for piece in pieces:
            table = self.tables[piece]
            if not piece.isascii():
                table = [0, *(table[n] for n in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece))]
            counts = [done + n for n in table[1:]]
            if piece in CONTRACTED:  # cut short, it is not a contraction: the quote and the letter stand alone
                counts[1] = done + self.tables["'"][-1] + self.tables[piece[1]][-1]
            before_text, before_done = before
            if before_text.isspace() and piece[0].isspace():  # white space up to here is one pre-token
                counts[0] = before_done + self.tables[before_text + piece[0]][-1]
            out += counts
            before = (piece, done)
            done += table[-1]
        return out


def _last(counts: list[int], limit: int) -> int:
    """The last position whose count is within the limit."""
    return max(i for i, n in enumerate(counts) if n <= limit)


_counters: dict[str, PrefixCounter] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit, cut_chars)`` for every row.

    ``cut_chars`` is the longest prefix, in code points, of at most ``limit`` tokens.  Special strings inside a text are one token each, as the
    vocabulary's library reads them by default.  A null or empty text has no tokens.  Texts are counted whole at any length; a
    repeated row gives its result again; an empty table gives an empty result; extra columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    names = ["id", "n_bytes", "n_tokens", "over_limit", "cut_chars"]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counters.get(vocabulary_path)
        if counter is None:  # once per Python worker
            _counters.clear()
            counter = _counters[vocabulary_path] = PrefixCounter(shared.value)
        made = [counter.count(text, limit) for text in batch.column(2).to_pylist()]
        columns = [
            batch.column(0), batch.column(1), pa.array([n for n, _ in made], pa.int64()),
            pa.array([n > limit for n, _ in made], pa.bool_()), pa.array([c for _, c in made], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    sized = identified(docs, id_col, text_col).selectExpr("id", "cast(octet_length(text) as bigint) as n_bytes", "text")
    return sized.mapInArrow(each_batch(count), "id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def prefix_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, counts)``: the stored table itself, one count for every code-point prefix of the text, the empty one first."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def table(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counters.get(vocabulary_path)
        if counter is None:
            _counters.clear()
            counter = _counters[vocabulary_path] = PrefixCounter(shared.value)
        counts = [counter.prefixes(text) for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int32()))], ["id", "counts"])

    return identified(docs, id_col, text_col).select("id", "text").mapInArrow(each_batch(table, 16), "id long, counts array<int>")
