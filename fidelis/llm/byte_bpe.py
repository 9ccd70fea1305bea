"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Encoding: the vocabulary's ranks become a BPE model over the 256 stand-in characters of byte-level
tokenizers (byte-to-character mapping); each match of the split pattern is merged by itself.
Decoding looks ids up in the byte table and joins; a character split over several ids is whole again
in the joined bytes, and a slice that cuts a character shows as U+FFFD only in the text form.

Defined results: null text encodes as empty; empty text gives no ids; unknown ids raise; extra columns
stay, except those named like a result column, which are replaced; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fidelis.llm._util import slices, trimmed

#: The split pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of the pieces and ids kept in a worker at most, besides so many of a piece's own; texts with a piece of more
#: characters are encoded whole.
KEPT, EACH, LONG = 24 << 20, 220, 4096
_BESIDE, _BETWEEN = re.compile(r"\s | \s"), re.compile(r"(?<=\S) (?=\S)")


def byte_chars() -> list[str]:
    """The stand-in character of each byte: itself where printable in Latin-1, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in chars]
    chars |= {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def model_json(ranks: dict[bytes, int], pattern: str = PATTERN) -> str:
    """A tokenizers file: every split of a token into two tokens is a merge, in rank order."""
    chars = byte_chars()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                merges.append([shown[left], shown[right]])
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    as_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    model = {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
        "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True,
        "vocab": {shown[t]: r for t, r in ranks.items()}, "merges": merges,
    }
    return json.dumps(
        {
            "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, as_bytes]},
            "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
            "model": model,
        }
    )


def pieces(text: str) -> list[str]:
    """The text cut at each space that stands between two other characters; a match never spans such a
    cut, so each piece but the first begins with that space (left out here) and is encoded by itself."""
    return (_BETWEEN.split(text) if _BESIDE.search(text) else text.split(" ")) if text else []


class Coder:
    """Encodes and decodes; pieces that were met before come from a bounded store."""

    def __init__(self, model: str, table: list[bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.table = Tokenizer.from_str(model), table
        self.sizes = np.array([len(t) for t in table])
        self.later, self.older, self.size = {}, {}, 0

    def _learn(self, new: list[str], lead: str) -> dict[str, bytes]:
        """Packed ids of the pieces. Many go to the library as one text, which ends of bytes part again."""
        out = {}
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000] if lead else new[at : at + 1]
            ids = np.array(self.tokenizer.encode_batch_fast([lead + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(lead) + len(p.encode()) for p in part])
            cut = np.searchsorted(np.cumsum(self.sizes[ids]), ends, "left") + 1
            for p, a, b in zip(part, np.r_[0, cut[:-1]].tolist(), cut.tolist(), strict=True):
                out[p] = ids[a:b].tobytes()
        return out

    def pack(self, text: str | None) -> bytes:
        """The text's ids as little-endian 32-bit integers."""
        if not text:
            return b""
        head, *rest = pieces(text)
        if len(head) > LONG or any(len(p) > LONG for p in rest):
            whole = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            return np.array(whole, "<u4").tobytes()
        known = self.later
        if missing := [p for p in set(rest) if p not in known]:
            if self.size > KEPT // 2:
                # half of the store grows old; what is met again comes back from it
                self.older, self.later, self.size = known, {}, 0
                known, missing = self.later, list(set(rest))
            again = {p: ids for p in missing if (ids := self.older.get(p)) is not None}
            known |= again
            known |= self._learn([p for p in missing if p not in again], " ")
            self.size += EACH * len(missing) + 2 * sum(map(len, missing))
        start = np.array(self.tokenizer.encode_batch_fast([head], add_special_tokens=False)[0].ids, "<u4").tobytes() if head else b""
        return start + b"".join(map(known.__getitem__, rest))

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Each id's span in code points; ids that share a character share its span."""
        out, base = [], 0
        for i, piece in enumerate(pieces(text or "")):
            piece = f" {piece}" if i else piece
            got = self.tokenizer.encode_batch([piece], add_special_tokens=False)[0]
            out += [(base + a, base + b) for a, b in got.offsets]
            base += len(piece)
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _sent(df: DataFrame, path: str, pattern: str):
    """The model and byte table as a broadcast; both are as large as the vocabulary file allows."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return df.sparkSession.sparkContext.broadcast({"model": model_json(ranks, pattern), "table": table})


def _with(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in added]
    cols = kept + list(added.items())
    return pa.RecordBatch.from_arrays([c for _, c in cols], names=[n for n, _ in cols])


def _schema(df: DataFrame, added: list[T.StructField]) -> T.StructType:
    names = {f.name for f in added}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + added)


def _pass(df: DataFrame, column: str, added: list[T.StructField], sent, work) -> DataFrame:
    """work(coder, batch) -> new columns, over Arrow batches cut by the bytes of the text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = sent.value  # lives as long as the worker, and so does the coder
        coder = state.get("coder") or state.setdefault("coder", Coder(state.pop("model"), state["table"]))
        for batch in batches:
            for part in slices(batch, place) if text else (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                yield _with(part, work(coder, part))

    place, text = df.columns.index(column), df.schema[column].dataType == T.StringType()
    return df.mapInArrow(lambda batches: trimmed(run(batches)), _schema(df, added))


def encode(df: DataFrame, path: str, text: str = "text", offsets: bool = False, pattern: str = PATTERN) -> DataFrame:
    """Adds ids (array of int), and with offsets=True spans (array of start, end in code points)."""
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    pair = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    if offsets:
        added.append(T.StructField("spans", T.ArrayType(pair)))

    def work(coder: Coder, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column(text).to_pylist()
        out = {"ids": pa.array([np.frombuffer(coder.pack(t), "<i4") for t in texts], pa.list_(pa.int32()))}
        if offsets:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            out["spans"] = pa.array([[{"start": a, "end": b} for a, b in coder.spans(t)] for t in texts], kind)
        return out

    return _pass(df, text, added, _sent(df, path, pattern), work)


def decode(df: DataFrame, path: str, ids: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """Adds decoded (binary) and decoded_text (bytes that are no UTF-8 become U+FFFD); null ids give null."""
    added = [T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())]

    def work(coder: Coder, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        raw = [None if i is None else coder.decode(np.array(i, "<u4").tobytes()) for i in batch.column(ids).to_pylist()]
        text = [None if r is None else r.decode("utf-8", "replace") for r in raw]
        return {"decoded": pa.array(raw, pa.binary()), "decoded_text": pa.array(text, pa.string())}

    return _pass(df, ids, added, _sent(df, path, pattern), work)


def round_trip(df: DataFrame, path: str, text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Encodes and decodes again in one pass: ids_le (ids as little-endian 32-bit integers), n_tokens, decoded_sha256."""
    added = [
        T.StructField("ids_le", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def work(coder: Coder, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        packed = [coder.pack(t) for t in batch.column(text).to_pylist()]
        count = [len(p) // 4 for p in packed]
        digest = [hashlib.sha256(coder.decode(p)).hexdigest() for p in packed]
        return {"ids_le": pa.array(packed, pa.binary()), "n_tokens": pa.array(count, pa.int64()), "decoded_sha256": pa.array(digest, pa.string())}

    return _pass(df, text, added, _sent(df, path, pattern), work)
