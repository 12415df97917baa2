"""Rule-bitmask ledger of quality rules, DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the raw
measurements and one integer whose bit k says that rule k failed. A policy is a
named, versioned bit mask: applying it, changing it or asking what one rule
costs needs only the ledger, never the texts again.

Defined cases: a null text counts as empty (no words, so ``few_words`` fails);
null ids stay null and repeated rows are judged one by one; an empty table gives
an empty ledger; other columns of the input are never touched, whatever their
names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, fresh, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaim"]

#: bit k -> name; the conditions are in rule_bits(). Append only: bits are stored.
RULES = ["few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "shouting", "exclaiming", "word_length", "few_letters"]
BIT = {name: 1 << k for k, name in enumerate(RULES)}


def mask_of(names: list[str]) -> int:
    return reduce(lambda m, n: m | BIT[n], names, 0)


#: name@version -> mask
POLICIES: dict[str, int] = {
    "base@1": mask_of(["few_words", "repeated_windows"]),
    "web@1": mask_of(["few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "shouting", "exclaiming"]),
    "strict@1": mask_of(RULES),
}
DEFAULT_POLICY = "web@1"


def with_ledger(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """``docs`` plus the struct column ``out`` of all measurements and ``rule_bits``."""
    w, h, win, pairs, pos = (fresh(docs, f"{out}__{x}") for x in ("words", "hash", "win", "pairs", "pos"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.withColumn(w, words(F.col(f"`{text}`")))
    df = df.withColumn(h, F.transform(F.col(w), lambda x: F.xxhash64(x)))
    # A window is three neighbouring word hashes; its hash stands for its text.
    df = df.withColumn(
        win,
        F.when(
            F.size(h) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - 3),
                lambda i: F.xxhash64(F.col(h)[i], F.col(h)[i + 1], F.col(h)[i + 2]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Only texts with some repeated window pay for sorting (hash, position).
    df = df.withColumn(
        pairs,
        F.when(
            F.size(F.array_distinct(F.col(win))) < F.size(win),
            F.sort_array(F.transform(F.col(win), lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
        ),
    )
    same = lambda k, e: F.coalesce(F.get(F.col(pairs), k)["h"] == e["h"], F.lit(False))
    df = df.withColumn(
        pos,
        F.sort_array(F.transform(F.filter(F.col(pairs), lambda e, k: same(k - 1, e) | same(k + 1, e)), lambda e: e["p"])),
    )
    # The union of [p, p + 2] over ascending starts p: each adds what its predecessor left.
    cover = F.aggregate(
        F.transform(F.col(pos), lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(F.col(pos), k - 1)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE))
    low = fresh(df, f"{out}__m")
    df = df.withColumn(
        low,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.coalesce(F.length(F.translate(t, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long").alias("n_letters"),
            F.length(F.regexp_replace(t, "[^!]+", "")).cast("long").alias("n_exclaim"),
        ),
    )
    fields = [F.col(low)[m].alias(m) for m in MEASURES]
    return df.withColumn(out, F.struct(*fields, rule_bits(lambda m: F.col(low)[m]).alias("rule_bits"))).drop(w, h, win, pairs, pos, low)


def rule_bits(measure) -> Column:
    """The failure bits, from a function that gives each measurement's column."""
    m = {name: measure(name) for name in MEASURES}
    fails = {
        "few_words": m["n_words"] < 50,
        "repeated_windows": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbol_heavy": 10 * m["n_symbols"] > 3 * m["n_words"],
        "duplicate_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "shouting": 2 * m["n_upper"] > m["n_letters"],
        "exclaiming": 2 * m["n_exclaim"] > m["n_words"],
        "word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]),
        "few_letters": 2 * m["n_letters"] < m["word_chars"],
    }
    bits = [F.when(fails[name], F.lit(BIT[name])).otherwise(F.lit(0)) for name in RULES]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, the measurements, ``rule_bits``."""
    df = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return with_ledger(df, "ledger").select("doc_id", "ledger.*")


def passes(bits: Column, policy: str = DEFAULT_POLICY) -> Column:
    return bits.bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policy(led: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Add ``base_failed`` and ``kept`` (false if the base rules or the policy reject)."""
    base = ~passes(F.col("rule_bits"), "base@1")
    return led.withColumn("base_failed", base).withColumn("kept", ~base & passes(F.col("rule_bits"), policy))


def ablation(led: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of the policy: failures, rejections by it alone, and documents kept without it.

    One aggregation by the bit pattern (at most 2 ** rules rows) answers all of it.
    """
    mask = POLICIES[policy]
    by_bits = led.groupBy(F.col("rule_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in RULES if BIT[name] & mask])
    rows = by_bits.select("bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return rows.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("rejected_alone"),
        F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("kept_without_rule"),
    )


def keep_clean(docs: DataFrame, policy: str = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns unchanged."""
    name, row = fresh(docs, "ledger"), fresh(docs, "ledger_row")
    # The row number keeps the optimiser from moving the filter below the ledger's
    # steps, which would write out every measurement again inside the condition.
    led = with_ledger(docs, name, text).withColumn(row, F.monotonically_increasing_id())
    bits = F.col(name)["rule_bits"]
    kept = led.filter((F.col(row) >= 0) & passes(bits, "base@1") & passes(bits, policy))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    led = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_bits")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), hit AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         length(regexp_replace(t, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(t, '\P{L}+', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaim
  FROM w LEFT JOIN cov USING (rid)
), r AS (
  SELECT *, ((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
           | (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
           | (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
           | (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
           | (CASE WHEN 2 * n_upper > n_letters THEN 16 ELSE 0 END)
           | (CASE WHEN 2 * n_exclaim > n_words THEN 32 ELSE 0 END)
           | (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 64 ELSE 0 END)
           | (CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END))::BIGINT AS rule_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (rule_bits & 3) <> 0 AS base_failed, (rule_bits & 63) = 0 AS kept, rule_bits
FROM r
"""
