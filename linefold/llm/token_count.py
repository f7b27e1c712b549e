"""Token counts of whole texts, exactly as the tokenizer library gives them.

Texts are split where splitting cannot change the tokens: at a single space between two
non-space characters (the pre-tokenizer starts a new word there, and the space goes to the
word on its right).  Pieces go to the library in batches of bounded bytes; equal pieces are
encoded once per worker.  Only lengths leave the Arrow function.

Defined cases: null or empty text has 0 bytes and 0 tokens; a text without a safe boundary
is encoded whole; rows are independent; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ship

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s\s|^\s|\s$")
MAX_CACHE = 400_000
MAX_PIECE_CACHED = 64


def splits_safely(path: str) -> bool:
    """Whether split_safe() keeps the tokens: byte-level words by the library's own pattern, nothing normalised or prefixed."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    return bool(plain and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens") or ()))


@functools.lru_cache(maxsize=4)
def load(path: str):
    """An encoder of piece lists to lengths, by the kind of file."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x) for x in t.encode_batch(texts, add_special_tokens=False)]


def split_safe(text: str) -> list[str]:
    """Pieces whose joined tokens are those of the text."""
    if not text:
        return []
    parts = _SAFE.split(text) if _ODD.search(text) else text.split(" ")
    return [parts[0], *(" " + p for p in parts[1:])]


def count_texts(texts: list[str], encode, cache: dict[str, int], batch_bytes: int = 1 << 20) -> list[int]:
    """Token counts; cache maps pieces to counts and is filled."""
    split = [split_safe(t) for t in texts]
    fresh = {p for pieces in split for p in set(pieces) if p not in cache}
    local: dict[str, int] = {}
    group: list[str] = []
    size = 0

    def flush() -> None:
        for p, n in zip(group, encode(group), strict=True):
            (cache if len(p) <= MAX_PIECE_CACHED else local)[p] = n

    for p in sorted(fresh, key=len):
        group.append(p)
        size += 4 * len(p)
        if size >= batch_bytes:
            flush()
            group, size = [], 0
    if group:
        flush()
    get = cache.get
    out = []
    for pieces in split:
        n = 0
        for p in pieces:
            k = get(p)
            n += local[p] if k is None else k
        out.append(n)
    if len(cache) > MAX_CACHE:
        cache.clear()
    return out


def count(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, batch_chars: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    tokenizer: the file's path, or the name of a file of the public_tokenizers package,
    which each worker then looks up for itself.
    """
    ship(docs.sparkSession)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    by_name = "/" not in tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if by_name:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        encode, cache, safe = load(str(path)), {}, splits_safely(str(path))
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            counts: list[int] = []
            group: list[str] = []
            size = 0
            for t in texts:
                group.append(t)
                size += len(t)
                if size >= batch_chars:
                    counts += count_texts(group, encode, cache) if safe else encode(group)
                    group, size = [], 0
            if group:
                counts += count_texts(group, encode, cache) if safe else encode(group)
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
