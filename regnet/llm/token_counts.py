"""Token counts by map-side lookup of pre-token lengths; no shuffle.

Texts are cut into pre-tokens in the executors. Their token counts come from a broadcast table of the
vocabulary's whole words (bounded by the vocabulary, about 30,000 entries) and, on a miss, from the worker's own
bounded cache, filled by the tokenizer. In texts with characters for which Python's lower-casing or white space may
differ from the tokenizer's, or with "<|", the parts between white space that hold them are encoded by the tokenizer
itself, behind the same kind of cache, and all other parts are looked up; no token or special string of the tokenizer
holds white space, so counts are always its own.

Defined cases: null text counts as empty: 0 bytes, 0 tokens; repeated rows and null ids stay as they are; no rows
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
CACHE = 400_000
#: Characters for which NFC does nothing and lower-casing and classes are plain.
_SAFE = re.compile("[\t\n\r\x20-\x7e\xa1\xab\xbb\xbf\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: Fixed value: the tokenizer's own pre-token pattern, over lower-cased safe characters.
_PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z\xdf-\xf6\xf8-\xff0-9]+")

_GAP = re.compile("[\t\n\r ]+")


class Lengths(dict):
    """Lengths met by this worker; a miss asks the broadcast table, then the tokenizer."""

    def __init__(self, table: dict[str, int], tokenizer) -> None:
        super().__init__()
        self.table, self.tokenizer = table, tokenizer

    def __missing__(self, word: str) -> int:
        n = self.table.get(word)
        if n is None:
            n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


class Parts(Lengths):
    """Lengths of parts between white space, for texts that aren't safe as a whole."""

    def __init__(self, words: Lengths) -> None:
        super().__init__({}, words.tokenizer)
        self.words = words

    def __missing__(self, part: str) -> int:
        if _SAFE.fullmatch(part) and "<|" not in part:
            return sum(map(self.words.__getitem__, _PRE.findall(part.lower())))
        return super().__missing__(part)


def whole_word_lengths(model_json: str) -> dict[str, int]:
    """Token counts of the plain whole words of the vocabulary, by the tokenizer itself."""
    from tokenizers import Tokenizer

    tok, end = Tokenizer.from_str(model_json), "</w>"
    words = [v[: -len(end)] for v in json.loads(model_json)["model"]["vocab"] if v.endswith(end) and v.isascii()]
    words = [w for w in words if w and _PRE.fullmatch(w)]
    return {w: len(e.ids) for w, e in zip(words, tok.encode_batch(words, add_special_tokens=False), strict=True)}


def _count(model: object, table: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(model.value)
        words = Lengths(table.value, tok)
        look, look_part = words.__getitem__, Parts(words).__getitem__
        for b in batches:
            counts = []
            for text in b.column("text").to_pylist():
                if not text:
                    counts.append(0)
                elif _SAFE.fullmatch(text) and "<|" not in text:
                    counts.append(sum(map(look, _PRE.findall(text.lower()))))
                else:
                    counts.append(sum(map(look_part, _GAP.split(text))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of documents. tokenizer_path: a .json file of the tokenizers library."""
    sc = documents.sparkSession.sparkContext
    model = Path(tokenizer_path).read_text(encoding="utf-8")
    run = _count(sc.broadcast(model), sc.broadcast(whole_word_lengths(model)))
    docs = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = docs.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
