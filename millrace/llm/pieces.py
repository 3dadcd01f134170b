"""SentencePiece models on the tokenizers library: encoding, decoding and a parity check.

The model file is a protocol buffer; its pieces, scores and settings are read here and rebuilt as a
tokenizers pipeline, which encodes and decodes. The pieces of a word, with the markers before it, don't
depend on its neighbours when no piece holds a marker after another character. Then each different word
is encoded once, in batches, its ids are compared with the sentencepiece library's and decoded again;
texts are joined from their words' ids. Other models are encoded, compared and decoded text by text.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.memory import lean, sliced

#: Place of the default model; a parameter everywhere.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words remembered by a task, and threads with which the libraries encode a batch there.
REMEMBERED, THREADS = 600_000, 2
#: Words longer than this are encoded anew each time, so that what is remembered stays small.
LONG_WORD = 200


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if b < 0x80:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = struct.unpack("<d" if kind == 1 else "<f", data[at : at + n])[0], at + n
        else:
            raise ValueError(f"wire type {kind} is not part of a model file")
        yield tag >> 3, value


@dataclass(frozen=True)
class PieceModel:
    """What a model file says: pieces in id order, and the settings that encoding needs."""

    pieces: tuple[tuple[str, float, int], ...]
    model_type: int
    byte_fallback: bool
    dummy_prefix: bool
    strip_spaces: bool
    escape_spaces: bool
    charsmap: bytes
    raw: bytes = field(repr=False)

    @property
    def unknown_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def by_word(self) -> bool:
        """Whether words can be encoded one by one."""
        return not self.strip_spaces and self.escape_spaces and self.dummy_prefix and not self.charsmap and not any(
            re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def parse_model(raw: bytes) -> PieceModel:
    """Read a SentencePiece model file."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f.get(1, b"").decode("utf-8"), f.get(2, 0.0), f.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    return PieceModel(
        tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(normalizer.get(3, 1)),
        bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)), normalizer.get(2, b""), raw)


def build_tokenizer(model: PieceModel):
    """A tokenizers pipeline equal to the model: normaliser, marker, scores or merges, byte fallback.

    The marker comes in front of what normalising leaves, if that is anything; where words are encoded one
    by one they bring theirs along."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = model.pieces[model.unknown_id][0]
    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown_id, model.byte_fallback)
    elif model.model_type == BPE:
        usable = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = sorted(
            ((-usable[p], ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for p in usable for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable))
        core = models.BPE(ids, [(a, b) for *_, a, b in merges], unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0)
    else:
        raise ValueError(f"model type {model.model_type}: only unigram and BPE models are supported")
    steps = []
    if model.charsmap:
        rules = normalizers.Precompiled(model.charsmap)
        if rules.normalize_str("\r") == rules.normalize_str("\n"):  # the rules see both together as one
            steps.append(normalizers.Replace("\r\n", "\n\n"))
        steps.append(rules)
    if model.strip_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix and not model.by_word:
        steps.append(normalizers.Prepend(" "))
    tok = Tokenizer(core)
    tok.normalizer = normalizers.Sequence(steps + ([normalizers.Replace(" ", MARK)] if model.escape_spaces else []))
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tok


class PieceCodec:
    """Encodes and decodes lists of texts; one in each Python process."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = parse_model(raw)
        self.tok, self.by_word = build_tokenizer(self.model), self.model.by_word
        self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.known: dict[str, bytes] = {}  # little-endian 32-bit ids
        self.differing: set[str] = set()  # words whose ids aren't the sentencepiece library's
        self.lossy: set[str] = set()  # words that their ids don't give back
        self.split = re.compile(f"{MARK}*[^{MARK}]*")
        self.silent = np.array([kind == CONTROL for *_, kind in self.model.pieces])
        self.unknown = np.array([kind == UNKNOWN for *_, kind in self.model.pieces])

    def _words(self, text: str) -> list[str]:
        """Words, each without the marker in front of it; more markers stay."""
        if "  " in text or text[0] == " " or MARK in text:
            # a marker in the text is a space to the model
            return [w[1:] for w in self.split.findall(MARK + text.replace(" ", MARK))[:-1]]
        return text.split(" ")

    def _learn(self, new: list[str]) -> None:
        """Encode words, compare their ids with the sentencepiece library's, and decode them."""
        ids = [e.ids for e in self.tok.encode_batch_fast([MARK + w for w in new], add_special_tokens=False)]
        shown = [w.replace(MARK, " ") if MARK in w else w for w in new]
        plain = self.other.encode(shown, num_threads=1)
        back = self.tok.decode_batch(ids, skip_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(ids), "<i4").tobytes()
        ends = (4 * np.cumsum([0, *map(len, ids)])).tolist()
        self.known.update(zip(new, map(flat.__getitem__, map(slice, ends, ends[1:]))))
        # the marker alone ends a text; by itself it can't be said to the library
        if ids != plain:
            self.differing.update(w for w, a, b in zip(new, ids, plain) if a != b and w)
        self.lossy.update(w for w, t, b in zip(new, shown, back) if b != " " + t)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool, bool]]:
        """(ids, parity, round trip) of each text; no ids for a null or empty one. Both are told word by
        word where words are encoded one by one, else on the whole text, whose ids then give back what the
        model's rules make of it."""
        if not self.by_word:
            whole = [t or "" for t in texts]
            ids = [e.ids for e in self.tok.encode_batch(whole, add_special_tokens=False)]
            plain, normal = self.other.encode(whole, num_threads=1), [self.other.normalize(t).replace(MARK, " ") for t in whole]
            back, lead = self.decode(ids), " " if self.model.dummy_prefix else ""
            return [(np.array(a, np.int32), a == b, c == n.removeprefix(lead)) for a, b, c, n in zip(ids, plain, back, normal)]
        cut = [self._words(t) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            self.differing.clear()
            self.lossy.clear()
        new = list(set(chain.from_iterable(cut)).difference(known))
        if new:
            self._learn(new)
        out = [(np.frombuffer(b"".join(map(known.__getitem__, ws)), "<i4"), not self.differing or self.differing.isdisjoint(ws),
                not self.lossy or self.lossy.isdisjoint(ws)) for ws in cut]
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        return out

    def decode(self, lists: list[list[int]]) -> list[str]:
        """The text of each list of ids, by the tokenizers library: markers are spaces, bytes are UTF-8,
        and the space that encoding put in front goes. Control pieces are silent, an unknown one is
        `` ⁇ ``; each byte of a run that isn't UTF-8 is U+FFFD."""
        parts, ends = [], [0]
        for ids in lists:
            ids = np.asarray(ids, np.int64)
            if len(ids):
                ids = ids[~self.silent[ids]]
                gaps = np.flatnonzero(self.unknown[ids])
                parts += [x.tolist() for x in np.split(np.delete(ids, gaps), gaps - np.arange(len(gaps)))]
            ends.append(len(parts))
        shown = self.tok.decode_batch(parts, skip_special_tokens=False)
        out = [" ⁇ ".join(shown[a:b]) for a, b in zip(ends, ends[1:])]
        return [t[1:] if self.model.dummy_prefix and t.startswith(" ") else t for t in out]


@lru_cache(2)
def codec(raw: bytes) -> PieceCodec:
    """The process's codec of a model file's content. Encoding threads are as many as a task may use, not as
    the machine has: idle ones cost time."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return PieceCodec(raw)


def encoded(text: Column, model: PieceModel) -> Column:
    """Struct (ids, n_tokens, ids_sha256, word_parity, round_trip) of each text.

    word_parity says whether the ids of each of its words are those of the sentencepiece library, and
    round_trip whether each of its words, decoded, comes back, markers in the text read as spaces. For a
    model whose words can't be encoded one by one, both are of the whole text, and what comes back is the
    text as the sentencepiece library normalises it.
    """
    fields = [("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("word_parity", pa.bool_()), ("round_trip", pa.bool_())]

    raw = model.raw

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(raw)
        for batch in sliced(batches, 128):
            flat, ends, hashes, same, back = [], [0], [], [], []
            for values, parity, round_trip in own.encode(batch.to_pylist()):
                flat.append(values)
                ends.append(ends[-1] + len(values))
                hashes.append(hashlib.sha256(values.astype("<i4").tobytes()).hexdigest())
                same.append(parity)
                back.append(round_trip)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
            yield pa.StructArray.from_arrays(
                [lists, pa.array(np.diff(ends), pa.int64()), pa.array(hashes), pa.array(same), pa.array(back)], fields=[pa.field(*f) for f in fields])

    kind = "struct<ids:array<int>,n_tokens:bigint,ids_sha256:string,word_parity:boolean,round_trip:boolean>"
    return F.arrow_udf(lean(run, codec), kind).asNondeterministic()(text)


def decoded(ids: Column, model: PieceModel) -> Column:
    """The text of each list of ids; null for a null list."""

    raw = model.raw

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(raw)
        for batch in batches:
            shown = own.decode([[] if x is None else x for x in batch.to_pylist()])
            yield pa.array([t if there else None for t, there in zip(shown, batch.is_valid().to_pylist())], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string").asNondeterministic()(ids)


def load_model(path: str = MODEL_FILE) -> PieceModel:
    with open(path, "rb") as f:
        return parse_model(f.read())


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: PieceModel | None = None) -> DataFrame:
    """One row per document: id, ids, n_tokens, ids_sha256 (of little-endian 32-bit ids), word_parity,
    round_trip. Null and empty texts have no ids. Repeated rows are each encoded. Other columns
    are not read."""
    rows = docs.select(F.col(id_col).alias("key"), encoded(F.col(text_col), model or load_model()).alias("code"))
    return rows.select(F.col("key").alias(id_col), "code.*")
