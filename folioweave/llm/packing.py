"""Concatenate and cut.

The token streams of all documents, each ended by one id, are laid end to end in the order of the table's partitions
and cut every 2048 ids. Pass one tokenises, keeps the ids as a table and totals them by partition; prefix sums over the
totals give each partition's global offset; pass two cuts each document at the multiples of the sequence length. A
document on such a boundary gets a record on either side. Only the last sequence can have padding.

Tokenising cuts texts where a pre-token must end whatever surrounds it, encodes each distinct part once in a task, and
joins ids; texts with rare white space go to the tokenizer whole.

Cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no pieces; a text of
any length is read whole and cut into as many pieces as it takes; columns of the names that pieces have (``ids``,
``doc_tokens``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, ``_part``, ``_at``) are replaced, all others but the text are kept.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.llm.common import materialise, slices, texts_as_bytes

LENGTH, END_ID = 2048, 1
#: Bound of the distinct parts whose ids a task remembers.
REMEMBERED = 500_000

#: White space that needs no look at its neighbours is space and line feed; with any other the whole text is encoded at once.
_ODD = r"[\x00-\x09\x0b-\x1f\x7f-\xa0\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"
#: Parts: a line end before text; Latin letters before white space or a sentence mark; sentence marks before white
#: space; else white space with what follows it.
_PARTS = re.compile("\n(?=\\S)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\\s.,;:!?]|\\Z)|[.,;:!?]+(?=\\s|\\Z)|\\s*\\S+|\\s+")


#: Parts that are one pre-token, and so are merged alone.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Ranks of a tokenizer's byte strings, if merging by them is the same as merging by its list: byte-level BPE, cut by
    the usual pattern, whose ids count its merges up after the 256 bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    odd = model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")
    if model["type"] != "BPE" or odd or spec["normalizer"] or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in shown]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}
    vocabulary, special = model["vocab"], {x["content"] for x in spec["added_tokens"]}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(vocabulary[c] > 255 for c in byte_of) or any(vocabulary[m] != 256 + k for k, m in enumerate(merged)):
        return None
    return {bytes(byte_of[c] for c in t): k for t, k in vocabulary.items() if t not in special}


class _Known(dict):
    """Ids of the parts met, made when they are first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, part: str) -> bytes:
        found = self[part] = self.make(part)
        return found


class Encoder:
    """Texts to the ids of a tokenizer, as little-endian bytes of ``kind``; one in a task.

    Distinct words are merged by the tokenizer's own ranks where these decide its merges, else, as are all other
    parts, by the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = "<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.known = _Known(self.one)
        ranks = merge_ranks(path)
        self.merge = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None

    def one(self, part: str) -> bytes:
        ids = self.merge(part) if self.merge and _WORD.fullmatch(part) else self.model.encode(part, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = pc.match_substring_regex(pa.array(texts, pa.string()), _ODD).to_pylist()
        ids_of = self.known.__getitem__
        out = [self.one(t) if o else b"".join(map(ids_of, _PARTS.findall(t))) for t, o in zip(texts, odd, strict=True)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return out


def token_table(docs: DataFrame, path: str, text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``docs`` without the text, materialised, with ``ids``, ``doc_tokens`` (with the end id), ``_part`` and ``_at``, the ids before in its partition."""
    new = [("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("_part", T.IntegerType()), ("_at", T.LongType())]
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in dict(new)]
    out = T.StructType([*kept, *(T.StructField(n, t, False) for n, t in new)])

    def run(batches):
        encoder, at, here = Encoder(path), 0, TaskContext.get().partitionId()
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in slices(batches, text):
            ids = [x + end for x in encoder.encode([t.decode("utf-8", "replace") for t in texts_as_bytes(batch.column(text))])]
            sizes = np.array([len(x) // len(end) for x in ids], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            columns = [*(batch.column(f.name) for f in kept), pa.array(ids, pa.binary()), pa.array(sizes), pa.array(np.full(len(ids), here, np.int32)), pa.array(starts)]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return materialise(docs.select(text, *(f.name for f in kept)).mapInArrow(run, out))


def pack(docs: DataFrame, path: str, text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs``: its other columns, ``doc_tokens``, and for each piece ``start``, ``length``, ``sequence_id``, ``offset``, ``ids_crc32`` and ``ids`` (little-endian unsigned 32-bit)."""
    tokens = token_table(docs, path, text, end_id)
    wide = "<u2" if _vocabulary(path) <= 1 << 16 else "<u4"
    totals = tokens.groupBy("_part").agg(F.sum("doc_tokens")).collect()  # one number for each partition
    order = sorted((r[0], r[1]) for r in totals)
    bases = dict(zip((p for p, _ in order), accumulate((n for _, n in order), initial=0), strict=False))
    sent = docs.sparkSession.sparkContext.broadcast(bases)
    new = [(n, T.LongType()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset")] + [("ids", T.BinaryType())]
    kept = [f for f in tokens.schema.fields if f.name not in ("_part", "_at", *dict(new))]
    out = T.StructType([*kept, *(T.StructField(n, t, False) for n, t in new)])

    def run(batches):
        bases = sent.value
        for batch in slices(batches, "ids"):
            rows, made = [], []
            base = batch.column("_part").to_pylist()
            at = batch.column("_at").to_pylist()
            for k, ids in enumerate(batch.column("ids").to_pylist()):
                ids = np.frombuffer(ids, wide).astype("<u4").tobytes()
                first = bases[base[k]] + at[k]
                n = len(ids) // 4
                cuts = [0, *range(length - first % length, n, length), n]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    part = ids[4 * a : 4 * b]
                    rows.append(k)
                    made.append((a, b - a, zlib.crc32(part), (first + a) // length, (first + a) % length, part))
            columns = list(zip(*made, strict=True))
            same = [batch.column(f.name).take(pa.array(rows)) for f in kept]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], names=out.names)

    return tokens.mapInArrow(run, out)


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()
