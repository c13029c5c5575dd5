"""Token counts by batch encoding in Arrow functions that return lengths only.

Rows are encoded in batches of about ``BATCH_BYTES`` bytes, so one batch of
long texts costs no more memory than one of short texts.  A text longer than
``LONG_BYTES`` is split where the count is the same on both sides: at a single
space between two characters that are not white space.  The tokenizer (a
sentencepiece BPE model) writes a space as the first character of the next
word's pieces and puts the same mark before a text's first word, and none of
its pieces holds that mark after another character, so no piece spans such a
place.  The model's own settings are checked for this; if they differ, texts
are not split.

Cases: null and empty texts have 0 tokens and 0 bytes; a text without a safe
boundary is encoded whole; repeated rows are counted per row; an empty table
gives an empty result; input columns named like an output are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import chunks, text_bytes
from .common import without

BATCH_BYTES = 1 << 20
LONG_BYTES = 1 << 16
LIMIT = 4096
MARK = "▁"
_SAFE = re.compile(rf"(?<=[^\s{MARK}]) (?=[^\s{MARK}])")


def splits_safely(sp) -> bool:
    """Whether the model puts the mark before the first word, takes texts as
    they are, and has no piece with the mark behind another character."""
    as_is = sp.encode("a  b \n c", out_type=str) and "".join(sp.encode("a  b", out_type=str)) == f"{MARK}a{MARK}{MARK}b"
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return bool(as_is) and all(MARK not in p.lstrip(MARK) for p in pieces)


def split_long(text: str, limit: int = LONG_BYTES) -> list[str]:
    """Parts of about ``limit`` characters; the space at each cut is dropped,
    as the tokenizer puts it back before a part."""
    parts, at = [], 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if cut is None:
            break
        parts.append(text[at:cut.start()])
        at = cut.end()
    parts.append(text[at:])
    return parts


def token_counts(docs: DataFrame, model: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` less the text, plus ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    df = without(docs, "n_bytes", "n_tokens", "over_limit")
    at = [c.lower() for c in df.columns].index(text.lower())
    others = [i for i in range(len(df.columns)) if i != at]
    schema = T.StructType([*(df.schema.fields[i] for i in others), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        safe = splits_safely(sp)
        for batch in batches:
            _, offsets = text_bytes(batch.column(at))
            for i, j in chunks(offsets, BATCH_BYTES):
                owner, parts = [], []
                for k, t in enumerate(batch.column(at).slice(i, j - i).to_pylist()):
                    some = split_long(t) if t and safe and len(t) > LONG_BYTES else [t or ""]
                    parts += some
                    owner += [k] * len(some)
                tokens = np.zeros(j - i, np.int64)
                for a in range(0, len(parts), 64):  # ids are dropped as soon as they are counted
                    ids = sp.encode(parts[a:a + 64], num_threads=1)
                    np.add.at(tokens, owner[a:a + 64], [len(x) for x in ids])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in others), pa.array(np.diff(offsets[i:j + 1])),
                     pa.array(tokens), pa.array(tokens > limit)], names=schema.names)

    return df.mapInArrow(count, schema)
