"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

Merges never cross the place where a word mark follows another character, so a text is cut there.  Within a cut, an Aho-Corasick
automaton gives the longest piece at every position.  Pieces are taken greedily; a piece may follow another only if merging
their joined text again gives back just these two.  When nothing fits, the last piece is taken back and the position is marked
as failed in a bitfield, so that no position is tried twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from itertools import chain, pairwise

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelab.llm.common import Memo, identified, each_batch

MARK = "\u2581"  # inside, a space stands for it: the model does not tell them apart, and texts stay narrow
CUT = re.compile(" *[^ ]+| +")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SHORT = 40  # characters of a cut that is worth keeping


def read_model(path: str) -> list[tuple[str, float, int]]:
    """``(piece, score, kind)`` of a merge-type model; raises if it normalises texts or lacks what the method needs."""
    from sentencepiece import sentencepiece_model_pb2 as form

    model = form.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    if train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix or not plain:
        raise ValueError("a merge-type model with byte fallback and identity normalisation is needed")
    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    words = [p for p, _, kind in pieces if kind == NORMAL]
    if {kind for _, _, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("user-defined and unused pieces are not supported")
    if any(MARK in w.lstrip(MARK) for w in words) or set("".join(words)) - {w for w in words if len(w) == 1}:
        raise ValueError("pieces must start with their word marks and be made of single-character pieces")
    return pieces


class PieceCodec:
    """Encoder and decoder over the pieces of a model."""

    def __init__(self, pieces: list[tuple[str, float, int]], cache: int = 250_000):
        pieces = [(p.replace(MARK, " "), s, kind) for p, s, kind in pieces]
        self.pieces = [p if kind == NORMAL else None for p, _, kind in pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.surface = [p if kind == NORMAL else "" if kind == CONTROL else " \u2047 " for p, _, kind in pieces]
        self.digits = [str(i) for i in range(len(pieces))]
        self.size = [len(p) for p, _, _ in pieces]
        self.shorter = [self._shorter(p) if kind == NORMAL else -1 for p, _, kind in pieces]
        self.find = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.find.add_word(p, (i, len(p) - 1))
        self.find.make_automaton()
        self.unknown = re.compile("([^" + "".join(map(re.escape, (p for p in self.ids if len(p) == 1))) + "]+)")
        self.fits = Memo(self._fits, cache)
        self.cuts = Memo(self._encode_cut, cache, lambda cut: len(cut) <= SHORT)

    def _shorter(self, piece: str) -> int:
        """The longest piece that is a proper prefix; -1 if there is none."""
        return next((self.ids[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), -1)

    def _fits(self, pair: int) -> bool:
        """Whether merging the joined text of two pieces again gives back just these two."""
        first, second = self.pieces[pair >> 20], self.pieces[pair & 0xFFFFF]
        return self.merged(first + second) == [first, second]

    def merged(self, text: str) -> list[str]:
        """The merge rule itself, for the short strings of a check: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            options = [(-self.score[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.score]
            if not options:
                break
            i = min(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def backtracked(self, text: str) -> list[int]:
        """Piece ids of a text whose characters are all pieces."""
        n, size, shorter, fits = len(text), self.size, self.shorter, self.fits
        greedy = [i for _, (i, _) in self.find.iter_long(text)]
        if all(map(fits.__getitem__, [a << 20 | b for a, b in pairwise(greedy)])):
            return greedy  # longest matches throughout, and each fits the one before
        longest = [0] * n
        for end, (i, reach) in self.find.iter(text):  # ends ascend, so the longest match at a place comes last
            longest[end - reach] = i
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        at, last, piece = 0, -1, longest[0]
        while at < n:
            while piece >= 0:
                end = at + size[piece]
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or fits[last << 20 | piece]):
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                last, at = piece, end
                if at < n:
                    piece = longest[at]
            elif last < 0:
                raise ValueError("no encoding")
            else:
                failed[at >> 3] |= 1 << (at & 7)
                out.pop()
                at -= size[last]
                piece = shorter[last]
                last = out[-1] if out else -1
        return out

    def _encode_cut(self, cut: str) -> tuple[int, ...]:
        if self.unknown.search(cut) is None:
            return tuple(self.backtracked(cut))
        ids: list[int] = []
        for part in self.unknown.split(cut):
            if part and part[0] in self.ids:
                ids += self.backtracked(part)
            else:
                ids += map(self.bytes.__getitem__, part.encode("utf-8", "surrogatepass"))
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; none for an empty one."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.cuts.__getitem__, CUT.findall(" " + text.replace(MARK, " ")))))

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a list of ids: marks become spaces, the first one goes, byte pieces are read as UTF-8."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.surface.__getitem__, ids)).removeprefix(" ")
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append(self.surface[i])
        if run:
            out.append(_utf8(run))
        text = "".join(out)
        return text if ids[0] in self.byte_of else text.removeprefix(" ")


def _utf8(run: bytearray) -> str:
    """Valid characters as they are, every other byte as U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("\ufffd")
                at += 1
        return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` for every row, ``keep`` adds ``ids`` or ``decoded`` themselves.

    A null or empty text has no ids and decodes to the empty text.  Texts of any length are encoded whole; a repeated row gives its
    result again; an empty table gives an empty result; extra columns are not carried.  The model is read on the driver and shared: its
    size is that of a vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + list(keep)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codecs.get(model_path)
        if codec is None:  # once per Python worker
            _codecs.clear()
            codec = _codecs[model_path] = PieceCodec(shared.value)
        counts, hashes, plain, ids_out, texts_out = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            ids = codec.encode(text)
            decoded = codec.decode(ids)
            counts.append(len(ids))
            hashes.append(hashlib.sha256(",".join(map(codec.digits.__getitem__, ids)).encode()).hexdigest())
            plain.append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
            ids_out.append(ids if "ids" in keep else None)
            texts_out.append(decoded if "decoded" in keep else None)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(plain, pa.string())]
        more = {"ids": lambda: pa.array(ids_out, pa.list_(pa.int32())), "decoded": lambda: pa.array(texts_out, pa.string())}
        columns += [more[k]() for k in keep]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join({"ids": ", ids array<int>", "decoded": ", decoded string"}[k] for k in keep)
    return identified(docs, id_col, text_col).select("id", "text").mapInArrow(each_batch(encode), schema)
