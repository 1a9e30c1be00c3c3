"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised as the model says: at each place the longest prefix in the compiled character map is replaced (a double-array
trie over UTF-8 bytes), any other character stays; then come the dummy prefix and the blank sign. For each byte of the result the
place in the source is recorded. The pieces that the library finds cover the normalised bytes one after the other, so their lengths
give their ends there, and the record gives the bytes of the source they stand for.

Defined results: a null text is empty; an empty text has the begin and end ids only. Null ids, repeated rows and very long texts are
ordinary rows. An empty table gives no rows. Other columns are left out unless they are asked for.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.catalogue import query, table
from tillsight.llm.text import bound_batches, slices
from tillsight.session import ship_with_tasks

ship_with_tasks(__name__)

BLANK = "▁".encode()


class CharacterMap:
    """The compiled character map of a model: a trie from byte strings to replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at this place, and what replaces it."""
        units, found = self.units, None
        if not units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node = step(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1]:self.texts.index(b"\0", found[1])]


class Normaliser:
    """Normalised bytes of a text, and for each of them (and the end) the byte of the source it comes from."""

    def __init__(self, spec):
        self.map = CharacterMap(spec["charsmap"])
        self.prefix, self.squeeze, self.escape = spec["prefix"], spec["squeeze"], spec["escape"]

    def __call__(self, source: bytes) -> tuple[np.ndarray, np.ndarray]:
        data, origin = self._mapped(source)
        if self.squeeze:
            # Of each run of blanks the first stays, and none at either end.
            blank = data == 32
            keep = ~blank
            keep[1:] |= blank[1:] & ~blank[:-1]
            last = np.flatnonzero(~blank)
            keep[(last[-1] + 1 if len(last) else 0):] = False
            end = origin[last[-1] + 1] if len(last) else origin[-1]
            data, origin = data[keep], np.append(origin[:-1][keep], end)
        if not len(data):
            return data, origin
        if self.prefix:
            data, origin = np.append(np.uint8(32), data), np.append(origin[:1], origin)
        if self.escape:
            size = np.where(data == 32, 3, 1)
            first = np.cumsum(size) - size
            wide = np.repeat(data, size)
            for k, value in enumerate(BLANK):
                wide[first[data == 32] + k] = value
            data, origin = wide, np.append(np.repeat(origin[:-1], size), origin[-1])
        return data, origin

    def _mapped(self, source: bytes) -> tuple[np.ndarray, np.ndarray]:
        if not self.map.units:
            return np.frombuffer(source, np.uint8), np.arange(len(source) + 1)
        out, origin, at = [], [], 0
        while at < len(source):
            found = self.map.longest(source, at)
            if found is None:
                lead = source[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = size, source[at:at + size]
            out.append(found[1])
            origin.append(np.full(len(found[1]), at))
            at += found[0]
        return (np.frombuffer(b"".join(out), np.uint8),
                np.concatenate([*origin, [len(source)]]) if origin else np.zeros(1, np.int64))


class Encoder:
    """The library's processor, the normaliser, and the length of each piece in normalised bytes."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if any(p.type == 4 for p in proto.pieces) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined symbols and blanks as suffixes are not supported")
        self.normalise = Normaliser({
            "charsmap": spec.precompiled_charsmap, "prefix": spec.add_dummy_prefix, "squeeze": spec.remove_extra_whitespaces,
            "escape": spec.escape_whitespaces})
        # Control pieces cover nothing, byte pieces one byte; the unknown piece's length depends on the text.
        self.length = np.array([-1 if p.type == 2 else 0 if p.type == 3 else 1 if p.type == 6 else len(p.piece.encode())
                                for p in proto.pieces], np.int64)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        return [np.array(ids, np.int64) for ids in found]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one byte of the source for each id; an empty span for begin and end."""
        data, origin = self.normalise(text.encode())
        length = self.length[ids]
        if (length < 0).any():
            pieces = self.library.encode(text, out_type="immutable_proto").pieces
            length = np.array([0, *(len(p.piece.encode()) for p in pieces), 0], np.int64)
        ends = np.cumsum(length)
        if ends[-1] != len(data):
            raise ValueError("the pieces do not cover the normalised text")
        return origin[ends - length], origin[ends]


_encoders: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    if model not in _encoders:
        _encoders[model] = Encoder(model)
    return _encoders[model]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_documents(docs: DataFrame, model: bytes, *carry: str, spans: bool = True, tokens: bool = True, digests: bool = False) -> DataFrame:
    """The columns ``carry`` and ``n_tokens``; ``ids``; ``begins, ends`` (bytes of the source); ``ids_sha256, decoded_sha256``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*carry, "n_tokens", "n_bytes"]
    fields = [*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "n_tokens long", "n_bytes long"]
    if tokens:
        names, fields = [*names, "ids"], [*fields, "ids array<int>"]
        if spans:
            names, fields = [*names, "begins", "ends"], [*fields, "begins array<int>", "ends array<int>"]
    if digests:
        names, fields = [*names, "ids_sha256", "decoded_sha256"], [*fields, "ids_sha256 string", "decoded_sha256 string"]

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        ends = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(shared.value)
        for part in slices(batches, "text", 1 << 20):
            texts = [t or "" for t in part["text"].to_pylist()]
            ids = tool.encode(texts)
            places = [tool.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            # Begin and end aside, the spans follow one another from the first byte to the last.
            covered = np.array([int((e - b).sum()) for b, e in places], np.int64)
            made = [part[c] for c in carry] + [pa.array(np.array([len(i) for i in ids], np.int64)), pa.array(covered)]
            if tokens:
                made.append(lists(ids))
                if spans:
                    made += [lists([p[0] for p in places]), lists([p[1] for p in places])]
            if digests:
                decoded = tool.library.decode([i.tolist() for i in ids])
                made.append(pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]))
                made.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]))
            yield pa.RecordBatch.from_arrays(made, names)

    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, "text"])]).mapInArrow(run, ", ".join(fields))


def decode_ids(frame: DataFrame, model: bytes, *carry: str) -> DataFrame:
    """The columns ``carry`` and ``text``, decoded from ``ids``; null ids give a null text."""
    bound_batches(frame.sparkSession)
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(shared.value)
        for part in batches:
            found = [None if i is None else tool.library.decode(i) for i in part["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in carry), pa.array(found, pa.string())], [*carry, "text"])

    fields = "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in carry)
    return frame.select(*carry, "ids").mapInArrow(run, fields + "text string")


def default_model(path: str | None = None) -> bytes:
    """The model at a path; without one, the public 32,000-piece model that is installed beside the library."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return read_model(path)


@query("op8_pieces")
def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return encode_documents(docs, default_model(), "doc_id", tokens=False, digests=True)
