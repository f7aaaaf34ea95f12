"""Id layout of the byte-level vocabulary and the model that merges define."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from textloom.functions.text import SPECIAL_TOKENS
from textloom.functions.tokens import MAX_VOCAB

# Fixed rule: bytes that print get ids in byte order first; the others follow, in byte order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHER = [b for b in range(256) if b not in set(_PRINTABLE)]
FIRST_BYTE_ID = len(SPECIAL_TOKENS)
BYTE_OF_ID = {FIRST_BYTE_ID + i: b for i, b in enumerate(_PRINTABLE + _OTHER)}
ID_OF_BYTE = {b: i for i, b in BYTE_OF_ID.items()}
FIRST_MERGE_ID = FIRST_BYTE_ID + 256

BOS_ID = SPECIAL_TOKENS.index("<|beginoftext|>")
EOS_ID = SPECIAL_TOKENS.index("<|endoftext|>")
UNKNOWN_ID = SPECIAL_TOKENS.index("<|unknown|>")


@dataclass
class BpeModel:
    """Merges in rank order: ``(left id, right id, new id, weighted count when chosen)``."""

    merges: list[tuple[int, int, int, int]] = field(default_factory=list)

    def token_bytes(self) -> list[bytes]:
        """Bytes of every token by id; special tokens stand for their own text."""
        table = [t.encode() for t in SPECIAL_TOKENS]
        table += [bytes([BYTE_OF_ID[FIRST_BYTE_ID + i]]) for i in range(256)]
        for left, right, new, _ in self.merges:
            if new == len(table):
                table.append(table[left] + table[right])
        return table

    def vocab_size(self) -> int:
        return len(self.token_bytes())

    def prefix(self, vocab_size: int) -> BpeModel:
        """The model of a smaller vocabulary: training it on the same words takes the same first merges."""
        merges, size = [], FIRST_MERGE_ID
        for merge in self.merges:
            if merge[2] == size:
                if size == vocab_size:
                    break
                size += 1
            merges.append(merge)
        return BpeModel(merges)

    def sha256(self) -> str:
        """Identity of the tokenizer, used in manifests and fingerprints."""
        payload = json.dumps([m[:3] for m in self.merges]).encode()
        return hashlib.sha256(payload).hexdigest()

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(rank, *m) for rank, m in enumerate(self.merges)]
        return spark.createDataFrame(
            rows, "rank int, left_id int, right_id int, new_id int, pair_count long"
        )

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, b.hex().upper()) for i, b in enumerate(self.token_bytes())]
        return spark.createDataFrame(rows, "id int, hex string")

    @classmethod
    def from_frame(cls, merges: DataFrame) -> BpeModel:
        """Read a stored merge table; its size is bounded by the uint16 vocabulary."""
        rows = merges.orderBy("rank").limit(MAX_VOCAB + 1).collect()
        if len(rows) > MAX_VOCAB:
            raise ValueError(f"more than {MAX_VOCAB} merges do not fit the uint16 format")
        return cls([(r.left_id, r.right_id, r.new_id, r.pair_count) for r in rows])
