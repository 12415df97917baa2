"""Canonical exact digests.

A text's canonical form is its compatibility normalisation, case folded, with
every run of white space folded to one space. The fingerprint is the 128-bit
xxhash of that form. Inside equal digests the canonical bytes are compared: the
grouping key is digest and bytes together, and where different forms share a digest,
every text of that digest gets a suffix to its fingerprint, from its own form alone.
So a fingerprint is a digest, or a digest and a suffix, for any number of collisions.

Only documents whose digest occurs again are compared. Their compressed canonical
bytes move, folded by task before; equal forms compress to equal bytes, so
comparing those is comparing the forms.

Defined cases: a null text counts as empty, and all empty texts are equal; rows
with equal ids are ordered by their text's hash; a row without an id has itself
as its next document; an empty table gives no rows; a single document is its own
next one; very long texts are treated whole; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, slices, table

#: Shared digests up to this many are broadcast to the scan, more are joined by shuffle.
MOST_BROADCAST_DIGESTS = 500_000
ROWS_PER_RANGE, MOST_RANGES = 500, 20_000
#: The compressed texts are most of what this operator writes to disk.
LEVEL = 3


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    s = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(s.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes, bits: int = 128) -> str:
    """``bits`` under 128 keep the low bits only, to provoke collisions in tests."""
    return xxhash.xxh3_128_hexdigest(form) if bits == 128 else f"{xxhash.xxh3_128_intdigest(form) & ((1 << bits) - 1):032x}"


def suffix(form: bytes) -> str:
    return hashlib.sha256(form).hexdigest()[:32]


def exact_groups(docs: DataFrame, doc_id="doc_id", text="text", bits: int = 128) -> DataFrame:
    """One row per canonical form among documents that share a digest: digest, form (compressed), first doc_id, n_docs.

    Digests alone show which buckets hold several documents; only those
    documents' forms move to be compared.
    """

    def add_digest(batches):
        for batch in slices(batches):
            found = [digest(canonical(t), bits) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], ["doc_id", "text", "digest"])

    def add_form(batches):
        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        for batch in slices(batches):
            forms = [zip_.compress(canonical(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(forms, pa.binary())], ["doc_id", "digest", "form"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    digests = rows.mapInArrow(add_digest, f"doc_id {kind}, text string, digest string")
    shared = durable(digests.groupBy("digest").count().where("count > 1").select("digest"))
    few = shared.limit(MOST_BROADCAST_DIGESTS + 1).count() <= MOST_BROADCAST_DIGESTS
    same = digests.join(F.broadcast(shared) if few else shared, "digest", "left_semi").select("doc_id", "text", "digest")
    forms = same.mapInArrow(add_form, f"doc_id {kind}, digest string, form binary")
    return forms.groupBy("digest", "form").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"))


def collisions(docs: DataFrame, doc_id="doc_id", text="text", bits: int = 128) -> DataFrame:
    """The digests that different forms share."""
    return durable(exact_groups(docs, doc_id, text, bits).groupBy("digest").count().where("count > 1").select("digest"))


def with_suffixes(marks: DataFrame, column: str, shared: DataFrame) -> DataFrame:
    """``column`` is a digest and a suffix, of which the suffix stays for ``shared`` digests only."""
    few = shared.limit(MOST_BROADCAST_DIGESTS + 1).count() <= MOST_BROADCAST_DIGESTS
    side = shared.select(F.col("digest").alias("shared_digest"))
    own = F.substring_index(column, "-", 1)
    both = marks.join(F.broadcast(side) if few else side, own == F.col("shared_digest"), "left")
    return both.withColumn(column, F.when(F.col("shared_digest").isNull(), own).otherwise(F.col(column))).drop("shared_digest")


def fingerprint_with_next(docs: DataFrame, doc_id="doc_id", text="text", bits: int = 128) -> DataFrame:
    """Fingerprints of each text and of its edited text (see op5).

    A document needs the next one in id order. The texts move once, compressed,
    to ranges of ids whose bounds are ids of the table; the rows at a range's
    lower bound also go to the range before, where they are the last row's next.
    """
    shared = collisions(docs, doc_id, text, bits)
    some = not shared.isEmpty()
    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    probs = [k / ranges for k in range(1, ranges)]
    found = ids.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", probs, max(10_000, 10 * ranges)).alias("b") if probs else F.array().alias("b")).first()
    if found["low"] is None:
        bounds = np.array([0], dtype=np.int64)
    else:
        bounds = np.unique(np.array([found["low"], *(found["b"] or [])], dtype=np.int64))
    last = len(bounds) - 1

    def deal(batches):
        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        for batch in slices(batches):
            doc, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            part, head, i_d, tie, z = [], [], [], [], []

            def put(p, h, d, t, b):
                part.append(p), head.append(h), i_d.append(d), tie.append(t), z.append(b)  # noqa: B023

            for d, t in zip(doc, texts, strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                b, h = zip_.compress(raw), xxhash.xxh3_64_intdigest(raw) >> 1
                if d is None:
                    put(last + 1 + h % (last + 1), 0, None, h, b)
                    continue
                k = int(np.searchsorted(bounds, d, side="right")) - 1
                put(k, 0, d, h, b)
                if d == bounds[k]:
                    put(k - 1 if k else last, 1, d, h, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array(head, pa.int32()), pa.array(i_d, pa.int64()), pa.array(tie, pa.int64()), pa.array(z, pa.binary())], ["part", "head", "doc_id", "tie", "z"]
            )

    def mark(form: bytes) -> str:
        return f"{digest(form, bits)}-{suffix(form)}" if some else digest(form, bits)

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def edit(batches):
        unzip = zstandard.ZstdDecompressor()
        now = None  # (part, doc_id, text, form) that waits for its next

        def done(cur, nxt, form):
            t = cur[2]
            k = len(t) // 4
            edited = t[: len(t) - k] + nxt[:k]
            e = canonical(edited)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return cur[1], len(t), sha, mark(cur[3]), mark(e), float(cur[3] == e), float(cur[3] == form)

        for batch in slices(batches):
            out = []
            for part, head, d, z in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if head and (now is None or now[0] != part):
                    continue
                t = unzip.decompress(z).decode("utf-8", "surrogatepass") if z else ""
                form = canonical(t)
                if now is not None and now[0] == part:
                    out.append(done(now, t, form))
                now = None if head else (part, d, t, form)
                if now is not None and d is None:
                    out.append(done(now, t, form))
                    now = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if now is not None:  # not reached while every range ends in a head
            raise AssertionError("a range has no next document")

    dealt = ids.mapInArrow(deal, "part long, head int, doc_id long, tie long, z binary")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "head", "doc_id", "tie")
    out = dealt.mapInArrow(edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    if some:
        for column in ("fingerprint", "edited_fingerprint"):
            out = with_suffixes(out, column, shared)
    return out.select(*schema.names)


def op5_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents"))
