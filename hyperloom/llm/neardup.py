"""Near duplicates by ProbMinHash over weighted word shingles.

1. A text's lower-case words give five-word shingles; a shingle that occurs n
   times weighs 1 + log2(n). Texts with the same words are one exact class, so
   everything below works on one representative of each.
2. ProbMinHash: every shingle is a Poisson process whose rate is its weight, each
   arrival falls into one of ``SLOTS`` slots, and a slot keeps its first arrival.
   Processes stop once they are later than every slot's first arrival. Two texts
   agree in a slot with the probability Jaccard similarity of their weighted sets.
   A text with repeated shingles has a second sketch of weight 1, whose slots agree
   with the Jaccard similarity of the sets, by which links are decided.
3. Banding: ``BANDS`` groups of ``ROWS`` slots are bucket keys. First each member
   of a bucket is compared with hubs only: the least member, the one whose buckets
   are the fullest (the original of a group of edited copies) and, in some buckets,
   one drawn at random. Then every pair of a bucket that these links leave in
   different classes is compared too: members travel in blocks with the sets of
   their shingle hashes, all pairs of two blocks are compared inside one task, and
   only a spanning forest of the links found comes out.
4. Verification: a hub pair whose signatures agree too little (``least_agree``) is
   dropped, every other pair is compared by the exact Jaccard similarity of its
   shingle sets. Texts are fetched once, for documents in shared buckets only.
5. Links of at least ``LEAST`` make classes by connected components.

Defined cases: a null or empty text has no shingle and is its own class; a text
of one to four words is one shingle of all its words; null ids take part, and a
class's id is its least id (null if all are null); repeated rows are exact copies
of each other; an empty table gives no rows; very long texts are compared whole;
other columns, whatever their names, may be carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import durable, slices, table

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
RANDOM_HUB_EVERY = 3
#: Members of a block; two blocks are compared with each other inside one task.
BLOCK = 512
#: Sets of more shingles than this travel as a sample by hash, that the texts then confirm.
SAMPLE = 1024
#: Estimates from samples this far below the threshold, over five deviations, still go on.
SLACK = 0.1
#: Columns of the incidence matrix at a time.
WIDTH = 4096
#: Keys, copies and pairs up to this many are broadcast (three numbers each), more are joined by shuffle.
MOST_BROADCAST_ROWS = 1_000_000
REMEMBERED = 1_000_000

U = np.uint64
GOLDEN, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


class Shingler:
    """Word and shingle hashes; a bounded table remembers the words'."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        return text.lower().split()

    def shingles(self, words: list[str]) -> np.ndarray:
        n = len(words)
        if not n:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
        k = min(WORDS, n)
        out = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            out = (out + h[j : n - k + 1 + j]) * MIX1 + GOLDEN
        return mix(out)


def signature(elements: np.ndarray, weights: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The element of the first arrival in every slot."""
    first = np.full(slots, np.inf)
    who = np.zeros(slots, dtype=np.uint64)
    e, rate, t, j = elements, weights, np.zeros(len(elements)), 0
    while len(e):
        # As many arrivals of each process at once as will roughly fill the slots.
        m = max(1, -(-2 * slots // len(e)))
        steps = (np.arange(j + 1, j + m + 1, dtype=np.uint64) * GOLDEN)[:, None]
        bits = mix(e[None, :] + steps)
        gaps = -np.log(((bits >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        times = t + np.cumsum(gaps, axis=0)
        at = (mix(bits ^ MIX2) % U(slots)).astype(np.int64)
        flat_t, flat_at = times.ravel(), at.ravel()
        np.minimum.at(first, flat_at, flat_t)
        won = flat_t == first[flat_at]
        who[flat_at[won]] = np.broadcast_to(e, times.shape).ravel()[won]
        t, j = times[-1], j + m
        alive = t < first.max()
        e, rate, t = e[alive], rate[alive], t[alive]
    return who


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 63-bit key per band."""
    x = np.full(BANDS, U(1))
    for column in sig.reshape(BANDS, ROWS).T:
        x = mix(x * GOLDEN + column)
    return (mix(x + np.arange(BANDS, dtype=np.uint64)) >> U(1)).astype(np.int64)


def least_agree(least: float, slots: int = SLOTS, chance: float = 1e-8) -> int:
    """Pairs that agree in fewer slots have similarity ``least`` with less than ``chance`` only."""
    below = 0.0
    for k in range(slots + 1):
        below += comb(slots, k) * least**k * (1 - least) ** (slots - k)
        if below > chance:
            return k
    return slots


def few(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """``df``, which is written already, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def sketched(docs: DataFrame, doc_id="doc_id", text="text", carry: bool = False) -> DataFrame:
    """(near_id, near_key, near_exact, near_sig, near_bands, rid), one per document: near_key is
    the text's digest, near_exact that of its words. With ``carry`` also ``row``, all columns
    of ``docs``; without it no text is stored."""

    def run(batches):
        shingler = Shingler()
        for batch in slices(batches):
            exact, sigs, bands = [], [], []
            for t in batch.column("near_text").to_pylist():
                words = shingler.words(t or "")
                exact.append(xxhash.xxh3_128_digest(" ".join(words)) if words else None)
                if not words:
                    sigs.append(None), bands.append(None)
                    continue
                e, n = np.unique(shingler.shingles(words), return_counts=True)
                # Links are of sets: agreement is that of weight 1, and repeated shingles add the weighted keys.
                sig = signature(e, np.ones(len(e)))
                sigs.append((mix(sig) & U(0xFFFF)).astype(np.uint16).tobytes())
                keys = band_keys(sig).tolist()
                if len(e) < n.sum():
                    weighted = band_keys(signature(e, 1.0 + np.log2(n))).tolist()
                    keys += [w for w, k in zip(weighted, keys, strict=True) if w != k]
                bands.append(keys)
            cols = [batch.column(c) for c in kept] + [pa.array(exact, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "near_exact", "near_sig", "near_bands"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col(f"row.`{doc_id}`").alias("near_id"), F.col(f"row.`{text}`").alias("near_text"))
    rows = rows.withColumn("near_key", text_key("near_text"))
    kept = ["row", "near_id"] if carry else ["near_id", "near_key"]
    rows = rows.select(*kept, "near_text")
    added = T.StructType().add("near_exact", "binary").add("near_sig", "binary").add("near_bands", T.ArrayType(T.LongType()))
    out = rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), *added.fields]))
    return durable(out.withColumn("rid", F.monotonically_increasing_id()))


def text_key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def carried_texts(sketch: DataFrame, text: str) -> Callable[[DataFrame], DataFrame]:
    """From (rid) to (rid, near_text), for a sketch that carries its rows."""
    return lambda rids: sketch.select("rid", F.col(f"row.`{text}`").alias("near_text")).join(few(rids), "rid", "left_semi")


def scanned_texts(sketch: DataFrame, docs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """From (rid) to (rid, near_text), by a second scan of docs (near_id, near_text) for rows of the same id and digest."""

    def texts(rids: DataFrame) -> DataFrame:
        keys = durable(sketch.select("rid", "near_id", "near_key").join(few(rids), "rid", "left_semi"))
        keys = keys.withColumnsRenamed({"near_id": "k_id", "near_key": "k_key"})
        rows = docs.withColumn("near_key", text_key("near_text")).join(few(keys), F.col("near_key").eqNullSafe(F.col("k_key")) & F.col("near_id").eqNullSafe(F.col("k_id")))
        # Repeated rows have the same id and text.
        return rows.groupBy("rid").agg(F.first("near_text").alias("near_text"))

    return texts


def shared_buckets(reps: DataFrame) -> DataFrame:
    """From (rid, near_bands): (rid, key, crowd) of the buckets with two members or more; crowd: the sum of its buckets' sizes."""
    rows = reps.select("rid", F.explode("near_bands").alias("key"))
    sizes = durable(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = durable(rows.join(few(sizes), "key"))
    crowds = durable(rows.groupBy("rid").agg(F.sum("n").alias("crowd")))
    return durable(rows.drop("n").join(few(crowds), "rid"))


def candidate_pairs(shared: DataFrame) -> DataFrame:
    """From ``shared_buckets``: distinct pairs (a, b), a > b, of bucket members and their hubs."""
    drawn = F.struct(F.xxhash64("rid", "key").alias("h"), F.col("rid"))
    hubs = shared.groupBy("key").agg(F.min("rid").alias("low"), F.max(F.struct("crowd", "rid")).alias("full"), F.max(drawn).alias("drawn"))
    # Written first, as below: a join of two shuffles can split a large bucket, one with an aggregate's output can't.
    drawn_rid = F.when(F.col("key") % RANDOM_HUB_EVERY == 0, F.col("drawn.rid"))
    hubs = durable(hubs.select("key", F.array("low", "full.rid", drawn_rid).alias("hubs")))
    both = shared.join(hubs, "key").select("rid", F.explode("hubs").alias("hub")).where("hub IS NOT NULL AND hub <> rid")
    return both.select(F.greatest("rid", "hub").alias("a"), F.least("rid", "hub").alias("b")).distinct()


def agreeing(pairs: DataFrame, sigs: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs whose signatures agree in ``least_agree`` slots or more; sigs: (rid, near_sig)."""
    bound = least_agree(least)

    def run(batches):
        for batch in slices(batches):
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, SLOTS) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= bound))

    left = pairs.join(sigs.withColumnsRenamed({"rid": "a", "near_sig": "sig_a"}), "a")
    both = left.join(sigs.withColumnsRenamed({"rid": "b", "near_sig": "sig_b"}), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(rid, level, hashes): a text's shingle hashes that begin with ``level`` zero bits, about SAMPLE of them; level 0 has all."""

    def run(batches):
        shingler = Shingler()
        for batch in slices(batches):
            levels, sets = [], []
            for t in batch.column(1).to_pylist():
                e = np.unique(shingler.shingles(shingler.words(t or "")))
                level = max(0, (-(-len(e) // SAMPLE) - 1).bit_length())
                levels.append(level), sets.append(at_level(e, level).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.int32()), pa.array(sets, pa.binary())], ["rid", "level", "hashes"])

    return texts.select("rid", "near_text").mapInArrow(run, "rid long, level int, hashes binary")


def at_level(hashes: np.ndarray, level: int) -> np.ndarray:
    return hashes[hashes >> U(64 - level) == 0] if level else hashes


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common, by products of incidence matrices."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    found, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[column] > 1
    place = np.cumsum(times > 1) - 1
    owner, column = owner[several], place[column[several]]
    out = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        a, b = np.searchsorted(column, (low, low + WIDTH))
        part = np.zeros((m, WIDTH), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1.0
        out += part @ part.T
    return out


def block_links(rid, comp, level, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of a left and a right row in different components that are similar: a spanning
    forest of those decided by whole sets, and all that samples leave possible."""
    root: dict[int, int] = {}

    def top(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for lv in sorted(set(level.tolist())):
        rows = np.flatnonzero((level == lv) | (level == lv - 1))
        parts = [at_level(sets[k], lv) for k in rows]
        size = np.array([len(x) for x in parts], dtype=np.float32)
        common = common_counts(parts)
        least_here = least - SLACK if lv else least
        # In whole numbers where sets are whole.
        similar = common >= least_here * (size[:, None] + size[None, :] - common) - 1e-3
        similar &= (comp[rows][:, None] != comp[rows][None, :]) & (np.maximum(level[rows][:, None], level[rows][None, :]) == lv)
        similar &= left[rows][:, None] & right[rows][None, :]
        for x, y in zip(*(v.tolist() for v in np.nonzero(similar)), strict=True):
            p, q = rows[x], rows[y]
            if not lv:
                a, b = top(int(comp[p])), top(int(comp[q]))
                if a == b:
                    continue
                root[max(a, b)] = min(a, b)
            out.append((max(int(rid[p]), int(rid[q])), min(int(rid[p]), int(rid[q]))))
    return out


def open_pairs(shared: DataFrame, texts: DataFrame, comp: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b), a > b, of members of one bucket that are similar but in different
    components, or a forest that joins them; comp: (node, component), a node that isn't there is its own."""

    def cross(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rid, own, level, at = (t[c].to_numpy() for c in ("rid", "comp", "level", "block"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in t["hashes"].to_pylist()]
        found = block_links(rid, own, level, sets, at == t["i"][0].as_py(), at == t["j"][0].as_py(), least)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    rows = shared.select("rid", "key").join(few(comp.withColumnRenamed("node", "rid")), "rid", "left")
    rows = durable(rows.select("rid", "key", F.coalesce("component", "rid").alias("comp")))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "rid")).alias(f"h{k}") for k in (1, 2)]
    split = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), *marks)
    # Two members have been compared, one of them is the hub; buckets of the same members are compared once.
    split = split.where("n > 2 AND low <> high").groupBy("n", "h1", "h2").agg(F.min("key").alias("key"))
    split = durable(split.select("key", F.ceil(F.col("n") / block).alias("blocks")))
    rows = durable(rows.join(few(split), "key"))
    used = durable(rows.select("rid").distinct())
    sets = durable(shingle_sets(texts.join(few(used), "rid", "left_semi")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), "blocks"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "rid", "comp").join(sets, "rid")
    return rows.groupBy("key", "i", "j").applyInArrow(cross, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, similarity) for the pairs whose exact shingle sets are similar; texts: (rid, near_text), written already."""

    def run(batches):
        shingler = Shingler()
        last: tuple[int, np.ndarray] | None = None
        for batch in slices(batches):
            out = []
            for a, b, s, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if last is None or last[0] != b:
                    last = b, np.unique(shingler.shingles(shingler.words(t)))
                x, y = np.unique(shingler.shingles(shingler.words(s))), last[1]
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                sim = common / (len(x) + len(y) - common)
                if sim >= least:
                    out.append((a, b, sim))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["a", "b", "similarity"])

    # The members' texts stay where they are if the pairs are few; only then the hubs' come to them.
    left = texts.withColumnsRenamed({"rid": "a", "near_text": "text_a"}).join(few(pairs), "a")
    both = left.join(texts.withColumnsRenamed({"rid": "b", "near_text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def classes(sketch: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float = LEAST) -> DataFrame:
    """(rid, near_id, root, is_exact_copy) for every row of ``sketched``."""
    exact = sketch.where("near_exact IS NOT NULL").groupBy("near_exact").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"))
    exact = few(durable(exact.where("copies > 1").select("near_exact", "rep")))
    reps = sketch.where("near_exact IS NOT NULL").join(exact, "near_exact", "left").where("rep IS NULL OR rep = rid")
    shared = shared_buckets(reps.select("rid", "near_bands"))
    used = durable(shared.select("rid").distinct())
    texts = durable(texts_of(used))
    pairs = durable(agreeing(candidate_pairs(shared), sketch.select("rid", "near_sig").join(few(used), "rid", "left_semi"), least))
    links = durable(verified(pairs, texts, least))
    comp = durable(connected_components(links))
    more = durable(verified(durable(open_pairs(shared, texts, comp, least)), texts, least))
    if not more.isEmpty():
        tree = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
        comp = durable(connected_components(tree.unionByName(more.select("a", "b"))))
    rows = sketch.select("rid", "near_id", "near_exact").join(exact, "near_exact", "left").withColumn("rep", F.coalesce("rep", "rid"))
    rows = rows.join(few(comp.withColumnRenamed("node", "rep")), "rep", "left")
    return rows.select("rid", "near_id", F.coalesce("component", "rep").alias("root"), (F.col("rid") != F.col("rep")).alias("is_exact_copy"))


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", least: float = LEAST) -> DataFrame:
    """Rows (doc_id, class_id, is_exact_copy, class_size), one per document. ``docs`` is read twice."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("near_id"), F.col(f"`{text}`").alias("near_text"))
    sketch = sketched(docs, "near_id", "near_text")
    rows = durable(classes(sketch, scanned_texts(sketch, docs), least))
    ids = rows.groupBy("root").agg(F.min("near_id").alias("class_id"), F.count("*").alias("class_size"))
    # Most classes have one member, whose row says it all.
    ids = few(durable(ids.where("class_size > 1")))
    rows = rows.join(ids, "root", "left")
    class_id = F.when(F.col("class_size").isNull(), F.col("near_id")).otherwise(F.col("class_id"))
    return rows.select(F.col("near_id").alias("doc_id"), class_id.alias("class_id"), "is_exact_copy", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, doc_id="doc_id", text="text", least: float = LEAST) -> DataFrame:
    """``docs`` with one document of each class: that of the least id."""
    sketch = sketched(docs, doc_id, text, carry=True)
    rows = durable(classes(sketch, carried_texts(sketch, text), least))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("near_id").isNull().alias("n"), F.col("near_id"), F.col("rid"))).alias("f")).select(F.col("f.rid").alias("rid"))
    gone = few(durable(rows.join(first, "rid", "left_anti").select("rid")))
    return sketch.join(gone, "rid", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
