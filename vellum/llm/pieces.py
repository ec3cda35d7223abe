"""SentencePiece encoding and decoding by a table of distinct chunks.

When no piece of the vocabulary holds a white-space marker after another character, merges never cross
the start of a marker run, so a text falls apart into chunks (markers, then other characters) that are
segmented alone. Every distinct chunk of a block of texts is segmented and decoded once by the library;
ids and bytes are joined back by position.

Nulls are empty texts; an empty text has the two border ids only. Ids, repeated rows and extra columns
do not matter: one row comes out for each row that goes in.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import blocks

MARK = "▁"
# markers at the very end stay with the chunk before them: alone, the library would take them for an empty text
_CHUNK = re.compile(rf"[ {MARK}]*[^ {MARK}]+(?:[ {MARK}]+\Z)?|[ {MARK}]+\Z")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ChunkCodec:
    """Encodes and decodes whole texts through a bounded table of distinct chunks."""

    def __init__(self, model_file: str, most_chunks: int = 200_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.most = most_chunks
        self.table: dict[str, tuple[bytes, bytes]] = {}
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", self.library.id_to_piece(i)) for i in range(self.library.get_piece_size()))
        # the rule above speaks of merges; normalisation has to leave texts as they are, too
        probe = "Aéé  　  Ａﬁ "
        self.apart &= self.library.decode(self.library.encode(probe)) == probe

    def _fill(self, wanted: set[str]) -> None:
        if len(self.table) + len(wanted) > self.most:  # the table is a cache of bounded size
            self.table.clear()
        new = [c for c in wanted if c not in self.table]
        # the library puts one marker before a text: a chunk's own first marker is left to it
        for chunk, ids in zip(new, self.library.encode([c[1:] for c in new], num_threads=1), strict=True):
            self.table[chunk] = (np.array(ids, dtype="<u4").tobytes(), (" " + self.library.decode(ids)).encode())

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids with borders as little-endian 32-bit integers, decoded text in UTF-8) of each text."""
        head, tail = (np.array([i], dtype="<u4").tobytes() for i in (self.begin, self.end))
        if not self.apart:
            found = self.library.encode(texts, num_threads=1)
            return [(head + np.array(i, dtype="<u4").tobytes() + tail, self.library.decode(i).encode()) for i in found]
        parts = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        self._fill(set().union(*parts))
        table, out = self.table, []
        for chunks in parts:
            rows = [table[c] for c in chunks]
            out.append((head + b"".join([r[0] for r in rows]) + tail, b"".join([r[1] for r in rows])[1:]))
        return out


def encode_documents(df: DataFrame, model_file: str, block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit, with borders) and decoded text (binary) of each row."""
    return _run(df, model_file, block_bytes, digests=False)


def encode_digests(df: DataFrame, model_file: str, block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text of each row."""
    return _run(df, model_file, block_bytes, digests=True)


def _run(df: DataFrame, model_file: str, block_bytes: int, digests: bool) -> DataFrame:
    def kernel(batches):
        codec = ChunkCodec(model_file)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in texts], dtype=np.int64)
            for a, b in blocks(sizes, block_bytes):
                rows = codec.encode([(x or b"").decode("utf-8", "replace") for x in texts[a:b].to_pylist()])
                columns = [ids[a:b], pa.array([len(i) // 4 for i, _ in rows], pa.int64())]
                if digests:
                    columns += [pa.array([hashlib.sha256(x[k]).hexdigest() for x in rows], pa.string()) for k in (0, 1)]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns += [pa.array([x[k] for x in rows], pa.binary()) for k in (0, 1)]
                    names = ["doc_id", "n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = SCHEMA if digests else "doc_id long, n_tokens long, ids binary, decoded binary"
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(kernel, schema)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Contract query: ids and decoded text of every document as digests."""
    import public_tokenizers

    from vellum.llm.common import table

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
