"""Secret scan with corpus-wide ownership frequency, DataFrame functions only.

Candidates are found per text by pattern. What one text cannot tell, the corpus
can: a credential that many owners paste is an example out of some manual, one
that a single owner has, and that looks random, is probably live. Candidate
hashes are therefore counted by distinct repositories and distinct owners: from
``EXAMPLE_OWNERS`` owners with ``EXAMPLE_REPOS`` repositories on, a value is a widely
copied example; one that is in many repositories of few owners is theirs.

Kinds, in this order: ``assign`` (a named value), ``access`` (access key ids),
``hex`` (long hexadecimal runs) and ``vendor`` (keys with a vendor's prefix,
signed web tokens, private key headers). Positions are code points, ends
exclusive. The engine has no function for match positions, but pieces between
matches and matches alternate, so running sums of their lengths are positions.

Defined cases: a null text counts as empty (no spans, the digest of an empty
string); a null owner counts as one owner named ``?``; repeated rows are scanned
one by one but the same owner counts once; texts may be very long and have very
many matches, in linear time; an empty table gives no rows; other columns, whatever
their names, are ignored by the scan and kept by the redaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, running_sums, table

# The patterns of the base kinds and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VENDOR = (
    r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|[sr]k_live_[0-9A-Za-z]{16,}|xox[abprs]-[0-9A-Za-z-]{10,}"
    r"|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
)
KINDS = ["assign", "access", "hex", "vendor"]
LEAST_VALUE = 6

#: Values that are placeholders by their own look.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234|password|secret"
#: From this many distinct owners and repositories a value is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 5
#: Code points of the parts in which a text is cut for redaction.
PART = 1024

SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"


def _spans(t: Column, kind: str) -> Column:
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "vendor": VENDOR}[kind]
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(t, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    between = F.transform(F.split(t, pattern, -1), lambda x: F.length(x).cast("long"))
    steps = F.zip_with(found, F.slice(between, F.lit(2), F.size(found)), lambda m, gap: F.length(m) + gap)
    starts = running_sums(F.slice(steps, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), F.get(between, F.lit(0)))
    rows = F.transform(
        F.arrays_zip(starts.alias("s"), found.alias("m"), value.alias("v")),
        lambda z: F.struct(
            z["s"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            (z["s"] + F.length(z["m"])).alias("end"),
            z["v"].alias("value"),
        ),
    )
    if kind == "assign":
        rows = F.filter(rows, lambda r: F.length(r["value"]) >= LEAST_VALUE)
    return F.when(t.rlike(pattern), rows).otherwise(F.array().cast(SPAN))


def spans(text: Column) -> Column:
    """All spans of a text as sorted array<struct<start, rank, end, value>>."""
    t = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[_spans(t, kind) for kind in KINDS]))


def looks_live(value: Column) -> Column:
    """The value's own look: long enough, of varied characters, no placeholder."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 6
    return (F.length(value) >= 12) & varied & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER)


def candidates(docs: DataFrame, doc_id="doc_id", text="text", owner="source", repo=("source", "lang")) -> DataFrame:
    """One row per document: its id, owner, repository and spans with hashed values."""
    have = set(docs.columns)
    own = F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("?")) if owner in have else F.lit("?")
    rep = F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("?")) for c in repo if c in have] or [F.lit("?")])
    df = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), own.alias("owner"), rep.alias("repo"), F.xxhash64(f"`{text}`").alias("text_hash"), spans(F.col(f"`{text}`")).alias("found"))
    hashed = F.transform(
        F.col("found"),
        lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), looks_live(s["value"]).alias("live_look")),
    )
    return df.select("doc_id", "owner", "repo", "text_hash", hashed.alias("found"))


def ownership(cands: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Per candidate hash: distinct owners, distinct repositories, rows and ``is_example``.

    Duplicates fold together before each shuffle, so a value that a third of all
    rows hold costs each task one row.
    """
    rows = cands.select("owner", "repo", F.explode("found").alias("s")).select(F.col("s.hash").alias("hash"), "owner", "repo")
    by_repo = rows.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    out = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_rows"))
    return out.withColumn("is_example", (F.col("n_owners") >= example_owners) & (F.col("n_repos") >= example_repos))


def classified(cands: DataFrame, key: list[str], example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per span: ``key`` columns, start, rank, end, class (live, example, weak), n_owners and n_repos."""
    rows = cands.select(*key, F.explode("found").alias("s")).select(*key, "s.*")
    # Written first: a join of two shuffles can split a value that very many rows hold.
    own = durable(ownership(cands, example_owners, example_repos).select("hash", "is_example", "n_owners", "n_repos"))
    kind = F.when(F.col("is_example"), "example").when(F.col("live_look"), "live").otherwise("weak")
    return rows.join(own, "hash", "left").select(*key, "start", "rank", "end", kind.alias("class"), "n_owners", "n_repos")


def _between(parts: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of the text whose parts of PART code points are given."""
    first, last = F.floor(start / PART).cast("int"), F.floor(end / PART).cast("int")
    at = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    head = F.substring(at(first), (start % PART + 1).cast("int"), F.when(first == last, (end - start).cast("int")).otherwise(PART))
    middle = F.array_join(F.slice(parts, first + 2, last - first - 1), "")
    return F.when(first == last, head).otherwise(F.concat(head, middle, F.substring(at(last), F.lit(1), (end % PART).cast("int"))))


def redact(docs: DataFrame, doc_id="doc_id", text="text", owner="source", repo=("source", "lang"), mask="[SECRET]") -> DataFrame:
    """``docs`` with every span that is no widely copied example replaced by ``mask``.

    Columns and rows stay; a column ``n_chars`` follows the new text. Only texts
    with candidates take part in a shuffle.
    """
    key, bad, k_id, k_hash, parts = (fresh(docs, x) for x in ("text_hash", "bad_spans", "bad_id", "bad_hash", "text_parts"))
    t = F.col(f"`{text}`")
    some = F.coalesce(t, F.lit("")).rlike("|".join([ASSIGN, ACCESS, HEX, VENDOR]))
    cands = durable(candidates(docs.filter(some), doc_id, text, owner, repo))
    bad_rows = classified(cands, ["doc_id", "text_hash"]).filter(F.col("class") != "example").select("doc_id", "text_hash", "start", "end").distinct()
    # Spans may overlap: what stays before each begins where the furthest end so far is.
    earlier = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    bad_rows = bad_rows.withColumn("from", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    per_text = bad_rows.groupBy("doc_id", "text_hash").agg(F.struct(F.sort_array(F.collect_list(F.struct("start", "end", "from"))).alias("all"), F.max("end").alias("last")).alias("spans"))
    per_text = per_text.select(F.col("doc_id").alias(k_id), F.col("text_hash").alias(k_hash), F.col("spans").alias(bad))
    hit = docs.filter(some).withColumn(key, F.xxhash64(t)).join(per_text, F.col(f"`{doc_id}`").eqNullSafe(F.col(k_id)) & (F.col(key) == F.col(k_hash)), "left")
    hit = hit.withColumn(parts, F.when(F.col(bad).isNotNull(), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))))
    kept = F.transform(
        F.col(bad)["all"],
        lambda s: F.when(s["start"] >= s["from"], F.concat(_between(F.col(parts), s["from"], s["start"]), F.lit(mask))).otherwise(F.lit("")),
    )
    new = F.concat(F.array_join(kept, ""), _between(F.col(parts), F.col(bad)["last"], F.length(t).cast("long")))
    hit = hit.withColumn(text, F.when(F.col(bad).isNull(), t).otherwise(new))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.when(F.col(bad).isNull(), F.col("n_chars")).otherwise(F.length(t).cast(docs.schema["n_chars"].dataType)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.filter(~some).select(*columns).unionByName(hit.select(*columns))


def _joined(found: Column, most: int) -> Column:
    text = lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(F.filter(found, lambda s: s["rank"] <= most), text), ",")


def scan(docs: DataFrame, doc_id="doc_id", text="text", owner="source", repo=("source", "lang")) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans, counts by class,
    and the most owners and repositories that one of its values has."""
    cands = durable(candidates(docs, doc_id, text, owner, repo).withColumn("row", F.monotonically_increasing_id()))
    classes = [F.count_if(F.col("class") == c).alias(f"n_{c}") for c in ("live", "example", "weak")]
    by_class = classified(cands, ["row"]).groupBy("row").agg(*classes, F.max("n_owners").alias("max_owners"), F.max("n_repos").alias("max_repos"))
    count = lambda k: F.size(F.filter("found", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    rows = cands.select("row", "doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("found"), 2), 256).alias("base_sha256"), _joined(F.col("found"), 3).alias("spans"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    added = [zero(c) for c in ("n_live", "n_example", "n_weak", "max_owners", "max_repos")]
    return rows.join(by_class, "row", "left").select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", *added)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: s.replace("'", "''")
    part = """
  SELECT rid, {rank} AS rank, len(m) AS n, unnest(range(1, len(m) + 1)) AS i, m, v, b FROM (
    SELECT rid, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS v,
           regexp_split_to_array(t, '{p}') AS b FROM d WHERE regexp_matches(t, '{p}'))"""
    parts = "\n  UNION ALL".join(part.format(rank=k, p=quote(p), g=2 if k == 0 else 0) for k, p in enumerate([ASSIGN, ACCESS, HEX, VENDOR]))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '?') AS owner, coalesce(source, '?') || '/' || coalesce(lang, '?') AS repo, coalesce(text, '') AS t FROM documents
), raw AS ({parts}
), pos AS (
  SELECT rid, rank, v[i] AS v,
         list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS l
  FROM raw
), span AS (
  SELECT rid, rank, v, s::BIGINT AS s, (s + l)::BIGINT AS e FROM pos WHERE rank > 0 OR length(v) >= {LEAST_VALUE}
), own AS (
  SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT [owner, repo]) AS n_repos FROM span JOIN d USING (rid) GROUP BY v
), cls AS (
  SELECT span.*, (['assign', 'access', 'hex', 'vendor'])[rank + 1] || ':' || s || ':' || e AS txt,
         n_owners, n_repos,
         CASE WHEN n_owners >= {EXAMPLE_OWNERS} AND n_repos >= {EXAMPLE_REPOS} THEN 'example'
              WHEN length(v) >= 12 AND len(list_distinct(string_split(v, ''))) >= 6 AND regexp_matches(v, '[0-9]')
                   AND NOT regexp_matches(v, '{PLACEHOLDER}') THEN 'live' ELSE 'weak' END AS c
  FROM span JOIN own USING (v)
), g AS (
  SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (rank = 3) AS n_vendor,
         string_agg(txt, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(txt, ',' ORDER BY s, rank) AS spans,
         count(*) FILTER (c = 'live') AS n_live, count(*) FILTER (c = 'example') AS n_example, count(*) FILTER (c = 'weak') AS n_weak,
         max(n_owners) AS max_owners, max(n_repos) AS max_repos
  FROM cls GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_vendor, 0) AS n_vendor,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_weak, 0) AS n_weak,
       coalesce(max_owners, 0) AS max_owners, coalesce(max_repos, 0) AS max_repos
FROM d LEFT JOIN g USING (rid)
"""


OP6_SQL = _sql()
