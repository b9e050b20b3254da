"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here, field by field. From it the backend is rebuilt:
normaliser (precompiled map, white-space rules), word mark, scores and byte
fallback. Unigram files become a unigram backend with the file's scores; files of
merge type get their merges back from the pieces' ranks (a unigram backend would
not give their results). Batches are encoded by the library's threads.

Defined cases: null and empty texts give no ids; repeated rows are judged alone;
only id and text are read.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.runtime import ship

from .common import annotate, per_text, slices

MARK = "▁"


def _fields(data: bytes):
    """(number, wire type, value) of each field of a protobuf message."""
    i, n = 0, len(data)

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, kind, data[i : i + size]
            i += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield key >> 3, kind, data[i : i + size]
            i += size


def parse_model(path: str) -> dict:
    """What the backend needs of a model file. Piece types: 1 normal, 2 unknown, 3 control, 4 user, 6 byte."""
    return parse_bytes(read_model(path))


def parse_bytes(data: bytes) -> dict:
    out = {"pieces": [], "type": 1, "byte_fallback": False, "suffix": False, "charsmap": b"", "prefix": True, "collapse": True, "escape": True, "unk_surface": " ⁇ "}
    for number, _, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, 1
            for k, _, v in _fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            out["pieces"].append((piece, score, kind))
        elif number == 2:
            for k, _, v in _fields(value):
                if k == 3:
                    out["type"] = v
                elif k == 24:
                    out["suffix"] = bool(v)
                elif k == 35:
                    out["byte_fallback"] = bool(v)
        elif number == 3:
            for k, _, v in _fields(value):
                if k == 2:
                    out["charsmap"] = v
                elif k == 3:
                    out["prefix"] = bool(v)
                elif k == 4:
                    out["collapse"] = bool(v)
                elif k == 5:
                    out["escape"] = bool(v)
    return out


def build(model: dict):
    """The rebuilt tokenizer."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model["suffix"] or not model["escape"]:
        raise NotImplementedError("white space as suffix, or unescaped white space")
    pieces = model["pieces"]
    unk = next((i for i, p in enumerate(pieces) if p[2] == 2), None)
    if model["type"] == 1:
        core = models.Unigram([(p, s) for p, s, _ in pieces], unk, model["byte_fallback"])
    elif model["type"] == 2:
        vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
        rank = {p: (-s, i) for i, (p, s, kind) in enumerate(pieces) if kind == 1}
        merges = []
        for p, key in rank.items():
            local = [(rank[p[:k]][0], rank[p[k:]][0], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
            merges += [(key, (a, b), left, right) for a, b, left, right in local]
        merges.sort()
        core = models.BPE(vocab, [(a, b) for _, _, a, b in merges], byte_fallback=model["byte_fallback"], unk_token=pieces[unk][0] if unk is not None else None, fuse_unk=True)
    else:
        raise NotImplementedError("only unigram and merge models")
    tok = Tokenizer(core)
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["collapse"]:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex("^ | $"), "")]
    steps += [normalizers.Prepend(MARK)] * model["prefix"] + [normalizers.Replace(" ", MARK)]
    tok.normalizer = normalizers.Sequence(steps)
    inner = any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind == 1)
    if not inner:  # no piece runs over a word's start, so words can be encoded apart
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if model["prefix"] else []
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    tok.encode_special_tokens = True
    return tok


@lru_cache(maxsize=2)
def _built(data: bytes):
    """One tokenizer for a worker process. The library's threads are as many as an executor has cores here."""
    os.environ.setdefault("RAYON_NUM_THREADS", "2")
    return build(parse_bytes(data))


def read_model(path: str) -> bytes:
    """A model file's bytes, which are sent to the workers."""
    with open(path, "rb") as f:  # a resource of the driver, not an input table
        return f.read()


class Codec:
    """Encoding to ids and decoding back, by batches of whole texts."""

    def __init__(self, data: bytes):
        self.tok = _built(data)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. The library's results hold far more than ids, so they are asked for by small batches."""
        out: list[list[int]] = []
        for part in slices(texts, 400_000):
            got = self.tok.encode_batch_fast(part, add_special_tokens=False)
            out += [e.ids if t else [] for t, e in zip(part, got, strict=True)]
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.tok.decode(x, skip_special_tokens=False) for x in ids]


def digests(model: bytes):
    def maker():
        codec = Codec(model)

        def run(texts: list[str]) -> dict:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "text_sha256": [], "round_trip": []}
            for part in slices(texts, 400_000):  # ids of a small part at a time are held
                for text, ids in zip(part, codec.encode(part), strict=True):
                    back = codec.tok.decode(ids, skip_special_tokens=False)
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                    out["text_sha256"].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    out["round_trip"].append(back == text)
            return out

        return run

    return maker


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and the ids of the whole text."""
    model = read_model(model_path)

    def maker():
        codec = Codec(model)
        return lambda texts: {"ids": codec.encode(texts)}

    return annotate(docs, per_text(maker, "ids array<int>"), id_col, text_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of encoded: id and the text of its ids (null ids: empty text)."""
    model = read_model(model_path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(model)
        for s in batches:
            yield pd.Series(codec.decode([[] if x is None else [int(i) for i in x] for x in s]), dtype=object)

    ship(encoded.sparkSession)
    return encoded.select(F.col(id_col), run(F.col(ids_col)).alias("text"))


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: token count, digests of ids and of the text decoded again, and whether it is the same."""
    return annotate(docs, per_text(digests(read_model(model_path)), "n_tokens long, ids_sha256 string, text_sha256 string, round_trip boolean"), id_col, text_col)
