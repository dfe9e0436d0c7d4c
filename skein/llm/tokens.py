"""Words and public tokenizers."""

from __future__ import annotations

import base64
import html
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")
_FENCE = re.compile(r"(?m)^[ \t]*(?:(?:[>#*+|\-–•]+|\d{1,3}[.)])[ \t]+)+")
_INLINE = re.compile(r"</?(?:a|abbr|b|code|del|em|font|i|ins|kbd|mark|s|small|span|strong|sub|sup|u)\b[^<>]*>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z!?][^<>]*>", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case; line prefixes, tags, entities and link targets are dropped first."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "](" in text:
        text = _LINK.sub("] ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(_FENCE.sub("", text).lower())


#: The split of the byte-level vocabularies into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoder(name: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS):  # noqa: ANN201
    """A byte-level BPE encoder of the vocabulary file `name`."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, column: str, out: str = "n_tokens", name: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """Replace `column` by `out`: its length in tokens; null and empty texts have 0 tokens."""
    kinds = StructType([*[x for x in df.schema.fields if x.name not in (column, out)], StructField(out, IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.schema.get_field_index(column)).to_pylist()]
            keep = [f.name for f in kinds.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keep], pa.array(n, pa.int32())], names=[*keep, out])

    return df.mapInArrow(run, kinds)
