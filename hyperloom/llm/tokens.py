"""Token counts by batch encoding in Arrow functions that return lengths only.

Each task streams Arrow batches, cuts them into groups of about ``GROUP_BYTES``
bytes and has the tokenizer library encode a group at a time; ids never leave the
function. Where the tokenizer drops white space before it looks for tokens, a
space or line feed is a safe boundary: no token and no normalisation crosses it.
There a text longer than a group is cut at such boundaries into parts of a group's
size, texts are counted as the sum over their pieces, each distinct piece of a
group is encoded once, and a bounded table remembers short pieces' counts. Pieces
are told apart without case and final marks where that can't change the count, and
pieces of letters only go to the library's model without its cutting of texts.
Other tokenizers get whole texts.

Defined cases: a null text counts as empty (0 tokens, 0 bytes); null ids and
repeated rows pass through; an empty table gives no rows; other columns are
ignored, whatever their names; texts may be of any length.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

LIMIT = 2048
GROUP_BYTES = 1 << 19
#: Pieces up to this many characters are remembered, and so many of them per worker.
SHORT, REMEMBERED = 32, 1_000_000
#: After a letter or number a piece's final run of these is cut off by tokenizers that cut at classes of characters.
MARKS = string.punctuation
#: Letters and numbers before this one stay one character when composed or put in lower case.
LAST_PLAIN = "\u0130"

_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Counts tokens of texts as the library of the file's kind gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[str, int] = {}
        self.splits = self.folds = False
        self.marks, self.letters = "", None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.splits = drops_space(spec)
            self.folds = self.splits and cuts_at_classes(spec)
            added = "".join(t["content"] for t in spec.get("added_tokens", []))
            if self.folds:
                self.marks = "".join(c for c in MARKS if c not in added)
            if self.folds and letters_to_bytes(spec):
                self.letters = model.model.tokenize

    def pieces(self, text: str) -> list[str]:
        """Parts between spaces, in lower case where the tokenizer does the same."""
        if self.folds and is_latin(text) and "<|" not in text:
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def encoded(self, pieces: list[str]) -> Iterator[tuple[str, int]]:
        """Pieces and their counts: letters of Latin-1 stay whole, and their bytes are what the model gets."""
        if self.letters is None:
            return zip(pieces, self.encode(pieces), strict=True)
        counts, rest = [], []
        for p in pieces:
            if not p.isalpha():
                rest.append(p)
            elif p.isascii():
                counts.append((p, len(self.letters(p.lower()))))
            elif is_latin(p):
                counts.append((p, len(self.letters(p.lower().encode().decode("latin-1").translate(BYTE_SIGNS)))))
            else:
                rest.append(p)
        return chain(counts, zip(rest, self.encode(rest), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return self.encode(texts)
        pieces = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = set().union(*pieces).difference(known)
        marked: list[tuple[str, str, str]] = []
        if self.marks:
            # "word,&" has the tokens of "word" and of ",&".
            for p in new:
                if len(p) <= SHORT and (base := p.rstrip(self.marks)) and len(base) < len(p) and base[-1].isalnum() and base[-1] < LAST_PLAIN:
                    marked.append((p, base, p[len(base) :]))
            new.difference_update(p for p, _, _ in marked)
            new.update({x for _, *both in marked for x in both}.difference(known))
        known.update(self.encoded(list(new)))
        for p, base, tail in marked:
            known[p] = known[base] + known[tail]
        counts = [sum(map(known.__getitem__, ps)) for ps in pieces]
        for p in new:
            if len(p) > SHORT:
                del known[p]
        return counts


def is_latin(text: str) -> bool:
    """Whether all is Latin-1: there lower case changes letters one by one, and composition nothing."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_signs() -> dict[int, int]:
    """The letters that byte-level tokenizers write for bytes: printable ones are themselves, others go from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(others)}


BYTE_SIGNS = _byte_signs()


def drops_space(spec: dict) -> bool:
    """Whether white space is removed before tokens are sought, so that no token spans it."""
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    keeps = first.get("pattern", {}).get("Regex", " ")
    added = spec.get("added_tokens", [])
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and " " not in keeps
        and r"\S" not in keeps
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in added)
    )


def cuts_at_classes(spec: dict) -> bool:
    """Whether case is folded first and runs of letters, numbers and other signs are cut from each other."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    pattern = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])[0].get("pattern", {}).get("Regex", "")
    classes = [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]
    return any(x.get("type") == "Lowercase" for x in steps) and pattern.split("|")[-3:] == classes and all(x.startswith("'") for x in pattern.split("|")[:-3])


def letters_to_bytes(spec: dict) -> bool:
    """Whether letters in lower case reach a byte-level model as their bytes, nothing added."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    simple = all(x.get("type") in ("NFC", "Lowercase") or (x.get("type") == "Replace" and x.get("pattern") == {"Regex": r"\s+"}) for x in steps)
    after = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])[1:]
    level = len(after) == 1 and after[0].get("type") == "ByteLevel" and not after[0].get("add_prefix_space", True) and not after[0].get("use_regex", True)
    return simple and level and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and not any(t["content"].isalpha() for t in spec.get("added_tokens", []))


def _counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def groups(sizes: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most ``most`` bytes, or of one text."""
    ends = np.cumsum(sizes)
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start, before = stop, int(ends[stop - 1])


def parts(text: str, size: int, most: int = GROUP_BYTES) -> Iterator[str]:
    """A text of ``size`` bytes in parts of about ``most`` bytes, cut at spaces and line feeds."""
    step, at = max(1, most * len(text) // max(size, 1)), 0
    while at < len(text):
        ends = [k for k in (text.find(" ", at + step), text.find("\n", at + step)) if k >= 0] if at + step < len(text) else []
        stop = min(ends, default=len(text))
        yield text[at:stop]
        at = stop + 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def count_tokens(docs: DataFrame, path: str, doc_id="doc_id", text="text", key: Column | None = None) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens), and key where one is given."""

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            sizes = batch.column("n_bytes").to_numpy()
            counts: list[int] = []
            for a, b in groups(sizes):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                if counter.splits and sizes[a] > GROUP_BYTES:
                    counts.append(sum(counter.count([part])[0] for part in parts(texts[0], int(sizes[a]))))
                else:
                    counts += counter.count(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int64())], [*kept, "n_tokens"])

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), *([] if key is None else [key.alias("key")]), t.alias("text"))
    kept = rows.columns[:-1]
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField("n_tokens", T.LongType())]))


def op3_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    df = count_tokens(table(spark, sf_dir, "documents"), path or default_path())
    return df.withColumn("over_limit", F.col("n_tokens") > LIMIT)
