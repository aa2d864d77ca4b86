"""Token counts with a whole-token shortcut.

Offline, every vocabulary string that ends a word is given to the tokenizer alone; those that come back as the one token they
are, are proven. A text is then cut into pre-tokens, proven ones count 1 without any merging, and only the other
distinct pre-tokens of a batch are merged by the library. Their counts are remembered up to a bound.

The cut is made here for texts of a safe alphabet, where normalisation and the pre-tokenizer's classes are beyond doubt:
printable ASCII, Latin letters up to U+017E and common punctuation, and no special token's string. Any other text goes
to the library whole. Either way a count is what the library gives.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8

#: Letters, one ASCII digit, or a run of neither letters, digits nor blanks, after English contractions.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
#: Without digits like U+00B2 that are no decimal digits, without U+0130, whose lower case is two characters.
SAFE = re.compile("[\t\n\r\x20-~¡-©«-±´¶-¸»¿-įı-ž‐-‧€]*")
#: The settings under which PRE_TOKEN cuts as the tokenizer does.
_CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_NORMAL = ["NFC", "Replace", "Lowercase"]


@dataclass(frozen=True)
class TokenCount:
    """remembered: distinct merged pre-tokens that a worker keeps, about 100 bytes each."""

    limit: int = 2048
    remembered: int = 300_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary package keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The visible stand-ins of bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    out |= {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
    return out


def shortcut_allowed(spec: dict) -> bool:
    """Whether PRE_TOKEN says the same as this tokenizer's own steps on SAFE texts."""
    normal = (spec.get("normalizer") or {}).get("normalizers", [])
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return [x["type"] for x in normal] == _NORMAL and bool(steps) and steps[0] == _CUT and spec["model"].get("end_of_word_suffix") == "</w>" and spec.get("post_processor") is None


def prove_whole_tokens(text: str) -> list[str]:
    """Vocabulary strings that alone are encoded as the one token they are. text: the tokenizer's JSON."""
    from tokenizers import Tokenizer

    spec = json.loads(text)
    if not shortcut_allowed(spec):
        return []
    tokenizer, letters = Tokenizer.from_str(text), _byte_letters()
    words: dict[str, int] = {}
    for piece, number in tokenizer.get_vocab().items():
        if piece.endswith("</w>") and all(c in letters for c in piece[:-4]):
            try:
                word = bytes(letters[c] for c in piece[:-4]).decode()
            except UnicodeDecodeError:
                continue
            if SAFE.fullmatch(word) and PRE_TOKEN.fullmatch(word):
                words[word] = number
    given = list(words)
    return [w for w, e in zip(given, tokenizer.encode_batch(given, add_special_tokens=False), strict=True) if e.ids == [words[w]]]


class Counter:
    """Counts of one process."""

    def __init__(self, text: str, whole: list[str], remembered: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(text)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.shortcut = shortcut_allowed(spec)
        self.whole = dict.fromkeys(whole, 1)
        self.known, self.most = dict(self.whole), len(whole) + remembered

    def library(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        out, cuts, odd = [0] * len(texts), [], []
        new: set[str] = set()
        for at, text in enumerate(texts):
            if self.shortcut and SAFE.fullmatch(text) and not any(x in text for x in self.special):
                cut = PRE_TOKEN.findall(text.lower())
                cuts.append((at, cut))
                new.update(cut)
            else:
                odd.append(at)
        if len(self.known) > self.most:
            self.known = dict(self.whole)
        fresh = [x for x in new if x not in self.known]
        self.known.update(zip(fresh, self.library(fresh), strict=True))
        known = self.known.__getitem__
        for at, cut in cuts:
            out[at] = sum(map(known, cut))
        for at, n in zip(odd, self.library([texts[x] for x in odd]), strict=True):
            out[at] = n
        return out


_counters: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, p: TokenCount = TokenCount(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; a null text counts as empty, with 0 tokens.

    The vocabulary file is read by the driver and sent to the workers with the proven words: a few MB whatever the corpus
    holds. No shuffle; rows don't depend on one another.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((text, prove_whole_tokens(text)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, whole = sent.value
        key = hash((spec, p))
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(spec, whole, p.remembered)
        counter = _counters[key]
        for batch in batches:
            _, starts = utf8(batch.column(1))
            n: list[int] = []
            for i, j in slices(starts):
                n += counter.count([x or "" for x in batch.column(1).slice(i, j - i).to_pylist()])
            counts = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts[1:] - starts[:-1], pa.int64()), counts, pa.array([x > p.limit for x in n], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path()).withColumnRenamed("id", "doc_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op8_tokens": op8_tokens}
