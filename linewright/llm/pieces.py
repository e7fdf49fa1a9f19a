"""Encoding and decoding with a SentencePiece model, by a table of distinct chunks.

In models whose pieces never hold a whitespace marker after another character, a text may
be cut before each run of markers, and the chunks segmented apart: no merge crosses a cut.
Each task keeps a table of the chunks that it has met, segments each of them once, and
joins ids and decoded text back by position. Chunks above ``LONGEST`` characters, as of texts
without blanks, are segmented where they occur and not kept; the table is emptied when its
chunks, ids and decoded texts take ``MOST_BYTES``. So a task's memory is bounded however rich
the vocabulary. A model of which a piece crosses a cut, or whose normaliser changes blanks so
that chunks apart give other ids than the text whole, is refused with an error.

Null texts are empty: begin and end id only, decoded to the empty text. Repeated rows keep
a row each; texts of any length are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import batch, keyed, slices

MOST_BYTES = 128 << 20
LONGEST = 128
ENTRY_BYTES = 400  # of a chunk in the table, besides its characters and ids, generously
MARK = "▁"
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
PIECE = re.compile(f"{MARK}*[^{MARK}]*", re.DOTALL)
# Texts of which some normalisers change the blanks.
PROBES = (
    "a", " a", "a ", "  a  b ", "a\tb\nc", "a\u3000b", "a\u00a0b", "\ufb01 \uff21", "a\u200bb",
    f"{MARK} a{MARK}{MARK}b", " ", "   ", "1  2", "e\u0301 x",
)


class ChunkTable:
    """Ids, as little-endian unsigned 32-bit integers, and decoded text of chunks."""

    def __init__(self, model: bytes, most: int = MOST_BYTES) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.most = most
        self.held = 0
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        self.begin = np.array([self.model.bos_id()], "<u4").tobytes()
        self.end = np.array([self.model.eos_id()], "<u4").tobytes()

    def check(self) -> None:
        """An error if a piece of the model crosses a cut, or its normaliser moves blanks."""
        for at in range(self.model.vocab_size()):
            if not PIECE.fullmatch(self.model.id_to_piece(at)):
                raise ValueError(f"piece {at} crosses a whitespace marker")
        for probe in PROBES:
            ids = self.model.encode(probe, add_bos=True, add_eos=True)
            if self.encode(probe) != (np.array(ids, "<u4").tobytes(), self.model.decode(ids)):
                raise ValueError(f"the model's normaliser changes the blanks of {probe!r}")

    def coded(self, chunks: list[str]) -> Iterator[tuple[str, bytes, str]]:
        """Each chunk with its ids and what these decode to."""
        # The model puts a marker before each text, here in place of the chunk's first.
        coded = self.model.encode([chunk[1:] for chunk in chunks], num_threads=1)
        for chunk, ids in zip(chunks, coded, strict=True):
            if len(chunk) == 1:  # a lone marker; the model adds none to the empty text
                ids = [self.model.piece_to_id(MARK)]
            yield chunk, np.array(ids, "<u4").tobytes(), " " + self.model.decode(ids)

    def learn(self, chunks: set[str]) -> dict[str, tuple[bytes, str]]:
        """Puts new chunks in the table; those too long for it come back."""
        new = [chunk for chunk in chunks if chunk not in self.ids]
        long = {}
        for chunk, ids, decoded in self.coded(new):
            if len(chunk) > LONGEST:
                long[chunk] = ids, decoded
                continue
            self.ids[chunk], self.decoded[chunk] = ids, decoded
            # A character takes four bytes at most.
            self.held += ENTRY_BYTES + len(ids) + 4 * (len(chunk) + len(decoded))
        return long

    def encode(self, text: str) -> tuple[bytes, str]:
        """All ids of a text, and the text that they decode to."""
        if not text:
            return self.begin + self.end, ""
        chunks = CHUNK.findall(" " + text)
        if self.held > self.most:
            self.ids.clear()
            self.decoded.clear()
            self.held = 0
        long = self.learn(set(chunks))
        if not long:
            ids = b"".join(map(self.ids.__getitem__, chunks))
            decoded = "".join(map(self.decoded.__getitem__, chunks))
        else:
            known = [long.get(c) or (self.ids[c], self.decoded[c]) for c in chunks]
            ids = b"".join(one for one, _ in known)
            decoded = "".join(one for _, one in known)
        return self.begin + ids + self.end, decoded[1:]


def encode(
    df: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, ids, decoded)``: the ids of every whole text as binary, four bytes each,
    with begin and end ids, and what the model decodes them to."""
    ChunkTable(model).check()
    rows = keyed(df, doc_id, text).select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model)
        for part in batches:
            schema = pa.schema(
                [
                    ("doc_id", part.schema.field(0).type),
                    ("ids", pa.binary()),
                    ("decoded", pa.string()),
                ]
            )
            for doc_ids, texts in slices([part]):
                coded = [chunks.encode(text.decode("utf-8", "replace")) for text in texts]
                yield batch(schema, doc_ids, [c[0] for c in coded], [c[1] for c in coded])

    return rows.mapInArrow(run, f"doc_id {id_type}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
