"""Token counts by overlap resynchronisation.

Ordinary texts are encoded in one piece.  A huge text is encoded as overlapping chunks with offsets and
spliced at a boundary that is proven stable: an ASCII letter or digit, a space, an ASCII letter or digit.
No pattern of the byte-level pre-tokeniser and no special string crosses the point before such a space,
and nothing left of it changes what follows, so when both chunks also show a token end there, the tokens
left of it in the first chunk and right of it in the second are those of the whole text.  When an overlap
holds no such point, it is doubled, up to the end of the text.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm import textkit

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int"
_STABLE = re.compile(r"[A-Za-z0-9](?= [A-Za-z0-9])")
_BATCH_CHARS = 1 << 20


def spliced_count(encode, text: str, chunk: int, overlap: int) -> tuple[int, int, int]:
    """(tokens, chunks, widenings) of ``text``; ``encode(str)`` gives an encoding with offsets."""
    total, at, skip, pieces, widened = 0, 0, 0, 0, 0
    while True:
        pieces += 1
        # Tokens of this piece that an earlier piece already counted end at or before `skip`.
        end = min(len(text), at + chunk)
        ends = [e for _, e in encode(text[at:end]).offsets]
        have = bisect_right(ends, skip) if skip else 0
        if end == len(text):
            return total + len(ends) - have, pieces, widened
        width = overlap
        while True:
            start = max(at, end - width)
            nxt = [e for _, e in encode(text[start : min(len(text), start + 2 * width)]).offsets]
            mine, theirs = set(ends), set(nxt)
            # Keep off the piece's own cut: its last token may be broken.
            stops = [m.end() for m in _STABLE.finditer(text, start, end - 1)]
            good = [p for p in stops if p - at in mine and p - start in theirs and p - at > skip]
            if good:
                break
            if width >= end - at:  # nothing stable in the piece: take a longer one
                break
            width, widened = width * 2, widened + 1
        if not good:
            chunk, widened, pieces = chunk * 2, widened + 1, pieces - 1
            continue
        cut = good[-1]
        total += bisect_right(ends, cut - at) - have
        at, skip = start, cut - start


class TokenCounts:
    """Counts of a ``tokenizers`` vocabulary file, which is opened on the executors."""

    def __init__(self, path: str, limit: int = 512, chunk: int = 1 << 16, overlap: int = 1 << 10):
        self.path, self.limit, self.chunk, self.overlap = path, limit, chunk, overlap

    def _batches(self, batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(self.path)
        tok.no_truncation()
        tok.no_padding()
        encode = lambda s: tok.encode(s, add_special_tokens=False)
        for batch in batches:
            texts = textkit.text_column(batch, "text")
            chars = pc.utf8_length(texts).to_pylist()
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            counts, pieces, widened = [0] * len(chars), [1] * len(chars), [0] * len(chars)
            lot: list[int] = []
            held = 0

            def flush(lot, texts=texts, counts=counts):
                for i, e in zip(lot, tok.encode_batch_fast([texts[i].as_py() for i in lot], add_special_tokens=False)):
                    counts[i] = len(e)

            for i, n in enumerate(chars):
                if n > self.chunk:
                    counts[i], pieces[i], widened[i] = spliced_count(encode, texts[i].as_py(), self.chunk, self.overlap)
                elif n:
                    lot.append(i)
                    held += n
                    if held >= _BATCH_CHARS:
                        flush(lot)
                        lot, held = [], 0
            if lot:
                flush(lot)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    n_bytes,
                    pa.array(counts, pa.int64()),
                    pa.array([c > self.limit for c in counts]),
                    pa.array(pieces, pa.int32()),
                    pa.array(widened, pa.int32()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
            )

    def __call__(self, docs: DataFrame) -> DataFrame:
        """One row per input row (repeated rows stay); null and empty texts count 0; a null id stays null."""
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return narrow.mapInArrow(self._batches, SCHEMA)
