"""Token counts by the whole-token shortcut.

A sentencepiece BPE model without a normaliser turns blanks into U+2581 and merges adjacent pieces. If no vocabulary
string has U+2581 after another character, no merge crosses from a word into the blanks behind it, so a text falls into
independent pre-tokens: a run of blanks and the word behind it. check_model() proves this for the model at hand, and
whole_tokens() proves for each vocabulary string whether it encodes alone as one token. Pre-tokens among those count as
1 without any merging; all others are merged by the library, once for each distinct pre-token that a worker holds in
its cache.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Distinct pre-tokens a worker remembers, and the longest that it does. Only speed depends on them.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_model(model: str) -> None:
    """Raises unless pre-tokens are independent under this model."""
    sp = processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    if any(BLANK in p.lstrip(BLANK) for p in pieces) or BLANK not in pieces:
        raise ValueError("a vocabulary string joins a word with the blanks behind it: pre-tokens can't be counted alone")
    if sp.encode(" ﬁ  x", out_type=str)[-2:] != [BLANK, BLANK + "x"]:
        raise ValueError("the model normalises its input: pre-tokens can't be taken from the text as it is")


@cache
def whole_tokens(model: str) -> frozenset[bytes]:
    """The words that, behind one blank, are proven to encode as one token."""
    sp = processor(model)
    words = {i: p[1:] for i in range(sp.vocab_size()) if (p := sp.id_to_piece(i)).startswith(BLANK) and BLANK not in p[1:] and len(p) > 1}
    return frozenset(w.encode() for (i, w), ids in zip(words.items(), sp.encode(list(words.values())), strict=True) if ids == [i])


class PreTokens(dict):
    """Pre-token (its first blank taken off) -> number of tokens; counts what it doesn't hold yet."""

    def __init__(self, model: str):
        self.sp, self.whole = processor(model), whole_tokens(model)
        self.refill()

    def refill(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.whole, 1))

    def __missing__(self, word: bytes) -> int:
        n = len(self.sp.encode(word.decode())) if word else 1  # a lone blank at the end of a text
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.refill()
            self[word] = n
        return n

    def count(self, text: bytes) -> int:
        if not text:
            return 0
        if b"\xe2\x96\x81" in text:
            text = text.replace(b"\xe2\x96\x81", b" ")  # the library treats the sign as a blank
        words = text.split(b" ")
        if b"" not in words:
            return sum(map(self.__getitem__, words))
        total, blanks = 0, b""
        for word in words[:-1]:
            if word:
                total, blanks = total + self[blanks + word], b""
            else:
                blanks += b" "
        return total + self[blanks + words[-1]]


def count_tokens(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    Null texts count as empty: 0 bytes, 0 tokens. Null ids and repeated rows stay, a row for each. Other columns of docs
    are not read. Texts are never cut. An empty table gives an empty result.
    """
    model = model or default_model()
    check_model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PreTokens(model)
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(counts.count, texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kept = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
