"""Token counts: by white space, and by a public tokenizer whose vocabulary file is a parameter."""

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode white space (the White_Space property, which holds the no-break space), as a character class body (fixed values).
SPACE = r"\t\n\x0B\x0C\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PY_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Folder of the public vocabularies and the file used for sizes in tokens.
VOCABULARY = os.environ.get("QUILLON_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Pre-tokenizer of that vocabulary (fixed value, published with it).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def count_words(col):
    """Column: runs without Unicode white space."""
    return F.regexp_count(col, F.lit(f"[^{SPACE}]+"))


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    pattern = PATTERN
    try:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    except (ImportError, AttributeError):
        pass
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """(id, kept columns, n_tokens); null and empty texts have size 0."""
    types = dict(documents.dtypes)
    schema = ", ".join([f"{id_col} {types[id_col]}", *[f"{c} {types[c]}" for c in keep], "n_tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(sizes, pa.int64())], [id_col, *keep, "n_tokens"])

    return documents.select(id_col, *keep, text_col).mapInArrow(run, schema)
