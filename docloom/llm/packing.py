"""Packing: documents as token sequences of at most 2048, by first-fit decreasing.

A document's ids are cut at every ``length`` tokens, so that all pieces but its last are
full sequences. The pieces are dealt at random (a hash of id, start, checksum and the number
of the written row) into groups of about ``group_pieces``; each group is packed on its own by first-fit decreasing,
where a tournament tree over the bins' free room finds the leftmost bin that fits in
O(log n).

Cases: a null text is an empty one, whose only id is the separator. A null doc_id is kept.
Repeated rows are packed each on its own. Other columns are not read. An empty table gives
no rows. A text of any length is cut; no group grows with a document, since pieces, not
documents, are dealt, nor with rows that repeat id and text, since their numbers differ. A
text that holds the string of one of the vocabulary's added tokens has that token's id there,
as the tokenizers library gives it.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, materialise, table

LENGTH = 2048
SEPARATOR_ID = 1
GROUP_PIECES = 16384
#: The vocabulary of byte_bpe_50k.json as ranks; one gives the ids of the other.
VOCABULARY = "byte_bpe_50k"

_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """text -> ids. Made once a worker.

    The ids are those of the tokenizers library with the vocabulary's .json file and its
    defaults. The ranks file of the same vocabulary gives them at about five times the speed,
    with the .json file's added tokens as special ones. A text that its pattern matcher gives
    up on (a megabyte of blanks, say) goes to the library itself, and so does one that holds
    an added token with rules of its own (blanks taken with it, whole words alone).
    """
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        plain = {a["content"]: a["id"] for a in added}
        odd = [a["content"] for a in added if a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]]

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=plain)
        slow: list = []

        def encode(text: str) -> list[int]:
            try:
                if not any(a in text for a in plain):
                    return fast.encode_ordinary(text)
                if not any(a in text for a in odd):
                    return fast.encode(text, allowed_special="all")
            except (ValueError, RuntimeError):
                pass
            except BaseException as e:  # the matcher's panics aren't Exceptions
                if type(e).__name__ != "PanicException":
                    raise
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

        _ENCODERS[vocabulary] = encode
    return _ENCODERS[vocabulary]


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, separator: int = SEPARATOR_ID) -> DataFrame:
    """Every document's pieces, with the checksum of their ids."""

    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), binary(batch, "text"), strict=True):
                ids = np.array([*encode((text or b"").decode("utf-8", "replace")), separator], "<u4")
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    for column, value in zip(rows, (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECE)


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; the winner of the tournament is the largest free room."""
    order = np.argsort(-lengths, kind="stable")
    leaves = 1 << max(0, int(len(lengths) - 1).bit_length())
    free = [room] * (2 * leaves)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        node = 1
        while node < leaves:  # the left child if any bin below it has the room
            node = 2 * node if free[2 * node] >= need else 2 * node + 1
        bins[i], offsets[i] = node - leaves, room - free[node]
        free[node] -= need
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins, offsets


def pack(cut: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most length tokens. cut is read twice: give a written table.

    A column row_no tells rows apart that are equal in all others.
    """
    groups = max(1, -(-cut.count() // group_pieces))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32", "row_no"], kind="stable")
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(np.int64), length)
        return frame.assign(sequence_id=frame["pack_group"].to_numpy(np.int64) * (1 << 32) + bins, offset=offsets)[[*names, "sequence_id", "offset"]]

    names = [c for c in cut.columns if c != "row_no"]
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row_no"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(run, f"{PIECE}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES, vocabulary: str = VOCABULARY) -> DataFrame:
    cut = pieces(docs, length, vocabulary).withColumn("row_no", F.monotonically_increasing_id())
    return pack(materialise(cut, "pieces"), length, group_pieces)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
