"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F

from hyperloom.llm import chat, fingerprint, html, mixing, neardup, packing, quality, secrets, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, rid long, length int, ledger string, bucket string, rate double, copy int"
KEY = "password = hunter2hunter2Z"
LONG = " ".join(f"word{i} and again some more" for i in range(4000))


def rows(*texts):
    return [(i, t, "en", "s", None if t is None else len(t), "x", 1, 2, "y", "z", 0.5, 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    data = rows(None, "", "   \n\t ", LONG, "same text here", "same text here", f"see {KEY} now")
    data += [(4, "same text here", None, None, None, None, None, None, None, None, None, None), (None, "no id at all", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, none):
    out = quality.apply_policy(quality.ledger(docs)).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r for r in out}
    assert by[0].n_words == by[1].n_words == by[2].n_words == 0 and by[0].base_failed and not by[0].kept
    assert by[3].n_words == 20000 and by[3].n_repeat_words == 4 * 4000
    assert quality.ledger(none).count() == 0 and quality.keep_clean(none).columns == none.columns
    assert quality.ablation(quality.ledger(docs)).count() == 6


def test_ablation_counts(spark):
    led = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (64,)], "rule_bits long")
    got = {r.rule: (r.failed, r.rejected_alone, r.kept_without_rule) for r in quality.ablation(led).collect()}
    assert got["few_words"] == (3, 2, 4) and got["symbol_heavy"] == (1, 1, 3) and got["shouting"] == (0, 0, 2)


def test_repeat_words_of_overlapping_windows(spark):
    def brute(t):
        w, seen, cover = t.split(), {}, set()
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                cover.update(p + k for p in at for k in range(3))
        return len(cover)

    texts = ["a a a a a", "a b c a b c a", "a b c d", "a b", "x a b c y a b c z b c y"]
    got = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.n_repeat_words for r in sorted(got)] == [brute(t) for t in texts]


def test_secrets(docs, none):
    out = secrets.scan(docs).collect()
    assert len(out) == docs.count() and sum(r.n_assign for r in out) == 1
    assert {r.spans for r in out} == {"", f"assign:4:{4 + len(KEY)}"}
    assert secrets.scan(none).count() == 0 and secrets.redact(none).columns == none.columns
    red = secrets.redact(docs)
    assert red.columns == docs.columns and red.count() == docs.count()
    assert [r.text for r in red.where("doc_id = 6").collect()] == ["see [SECRET] now"]


def test_secret_spans_against_regex(spark):
    import re

    texts = ["token=abc password=abcdef", "secret=token:abcdefgh", "é" * 5 + "AKIA" + "B" * 16 + " AKIA" + "C" * 3, "0" * 23 + "g" + "a" * 24, 'API_KEY: "abcdefg" apikey=zzzzzz', "Passwd='q/w+e=r.t-y_u'"]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        a = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        a += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        a += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        order = ["assign", "access", "hex"]
        assert got[i].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(a, key=lambda x: (x[1], order.index(x[0]))))


def test_many_matches_in_one_text(spark):
    """Linear: 100,000 matches and redactions in seconds, with positions beyond the 16-bit characters."""
    import time

    text = "\U0001f600 token=abc123xyz789 " * 100_000
    df = spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string")
    began = time.time()
    r = secrets.scan(df).first()
    assert r.n_assign == 100_000 and r.spans.startswith("assign:2:20,assign:23:41") and r.spans.endswith(f"assign:{21 * 99_999 + 2}:{21 * 99_999 + 20}")
    assert secrets.redact(df).first().text == "\U0001f600 [SECRET] " * 100_000
    assert time.time() - began < 90


def test_wide_in_repositories_but_of_one_owner_is_no_example(spark):
    value = "token = a9f8e7d6c5b4a3f2e1d0b9c8"
    data = [(i, f"x {value}", "one", f"l{i}") for i in range(20)] + [(100 + i, "y token = b9f8e7d6c5b4a3f2e1d0b9c8", f"s{i % 3}", f"l{i}") for i in range(6)]
    rows = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(data, "doc_id long, text string, source string, lang string")).collect()}
    assert rows[0].n_live > 0 and rows[0].n_example == 0 and (rows[0].max_owners, rows[0].max_repos) == (1, 20)
    assert rows[100].n_example > 0 and rows[100].n_live == 0 and (rows[100].max_owners, rows[100].max_repos) == (3, 6)


def test_redaction_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, f"a {KEY} b", "s", "en", 5, 6, 7, 8)], "doc_id long, text string, source string, lang string, k_id int, k_hash int, bad_id int, text_hash int")
    assert [tuple(r) for r in secrets.redact(df).collect()] == [(1, "a [SECRET] b", "s", "en", 5, 6, 7, 8)]


def test_redaction_joins_overlaps_and_spares_examples(spark):
    shared = "token = " + "abcdef0123456789abcdef0123"
    data = [(i, f"x {shared} y", f"s{i}", "en") for i in range(5)] + [(9, 'a token = "9f8e7d6c5b4a39f8e7d6c5b4a3" b', "s", "en")]
    red = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(data, "doc_id long, text string, source string, lang string")).collect()}
    assert red[0] == f"x {shared} y" and red[9] == 'a [SECRET]" b'


def test_chat(spark):
    data = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 300, "ann", "late"), (2, 0, "system", "alone"), (None, None, None, "x"), (1, 2, "bob", None)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in data], "conv_id long, turn long, role string, text string, rendered string, block int, names string")
    out = {(r.conv_id, r.perspective, r.block): r for r in chat.rotate(df).collect()}
    assert set(out) == {(1, "ann", 0), (1, "ann", 2), (1, "bob", 0), (1, "bob", 2), (None, "unknown", -1)}
    r = out[1, "ann", 0]
    assert r.rendered == "<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>assistant\nhi <\\|im_end|><|im_end|>\n" + 2 * "<|im_start|>user name=bob\n<|im_end|>\n"
    assert [r.rendered[s.start : s.end] for s in r.mask] == ["hi <\\|im_end|><|im_end|>"]
    assert len(out[1, "bob", 0].mask) == 2 and out[1, "bob", 2].mask == []
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_blocks_do_not_change_the_dialogue(spark):
    """Null turns, one turn number in very many rows, long texts: parts of any size give the same dialogue and mask."""
    data = [(1, None if i % 7 == 0 else i % 5, f"r{i % 3}", f"t{i}" * (3000 if i == 8 else 1)) for i in range(200)] + [(2, 1, "r1", "alone")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")

    def whole(rows):
        out = {}
        for r in sorted(rows, key=lambda r: (r.conv_id, r.perspective, r.block, r.part)):
            text, mask = out.get((r.conv_id, r.perspective), ("", []))
            assert r.offset == len(text) and r.n_turns <= 200
            out[r.conv_id, r.perspective] = text + r.rendered, mask + [tuple(s) for s in r.mask]
        return out

    got = whole(chat.rotate(df, block=2, most=6).collect())
    assert got == whole(chat.rotate(df).collect()) and len(got) == 4
    assert all(text[s:e].endswith("<|im_end|>") and "user" not in text[s:e] for text, mask in got.values() for s, e in mask)
    assert len(got[1, "r0"][1]) == 67


def test_chat_tells_speakers_apart_by_their_roles(spark):
    data = [(1, k, role, "x") for k, role in enumerate(["ann lee", "ann_lee", "ann~20lee", "system ", "a<|>\tb"])]
    out = chat.rotate(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == 5 and all(len(r.mask) == 1 for r in out)
    assert {r.perspective for r in out} == {"ann~20lee", "ann_lee", "ann~7E20lee", "system~20", "a~3C~7C~3E~09b"}


def test_chat_escape_round_trip(spark):
    texts = ["<|", "<\\|", "a<\\\\|b<|c", "<||", "\\<|", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e")))
    assert all(r.u == r.t and "<|" not in r.e for r in df.collect())


def test_mixing(docs, none):
    out = mixing.replicate(docs, total=40.0)
    assert out.columns == [*docs.columns, "rate_1", "n_copies", "copy_1", "order_key"] and out.count() > 0
    assert mixing.replicate(none).count() == 0
    assert mixing.replicate(docs, weights=docs.sparkSession.createDataFrame([("s", 1.0)], "source string, weight double")).where("source IS NULL").count() == 0


def test_mixing_meets_target_rates(spark):
    data = [(i, "t", "big" if i % 10 else "small") for i in range(5000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r.source: r["count"] for r in mixing.replicate(df, alpha=0.0, total=6000.0).groupBy("source").count().collect()}
    assert abs(got["big"] - 3000) < 250 and abs(got["small"] - 3000) < 250
    again = mixing.replicate(df, alpha=0.0, total=6000.0).groupBy("source").count().collect()
    assert got == {r.source: r["count"] for r in again}


def test_poisson_inverse(spark):
    import math

    grid = [(u / 200, r) for u in range(200) for r in (0.0, 0.3, 1.0, 7.5)]
    got = spark.createDataFrame(grid, "u double, r double").select("u", "r", mixing.poisson_inverse(F.col("u"), F.col("r")).alias("k")).collect()
    for x in got:
        k, cdf = 0, math.exp(-x.r)
        while cdf <= x.u:
            k += 1
            cdf += math.exp(-x.r) * x.r**k / math.factorial(k)
        assert x.k == k


def test_tokens(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    by = {r.doc_id: r for r in tokens.count_tokens(docs, path).collect()}
    assert by[0].n_tokens == by[1].n_tokens == by[2].n_tokens == 0 and by[0].n_bytes == 0 and by[3].n_bytes == len(LONG)
    assert tokens.count_tokens(none, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokens_of_odd_texts(spark, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    texts = ["a b c\u0085d", "x <|endoftext|> y<|startoftext|>", "é ́a", "ΑΣ ΟΔΟΣ", "1234 5678\r\n\x1c\x1ft", "日本語のテキスト", "don't we'll 's", "z" * 5000, "a  b   c", "İstanbul"]
    whole = tokens.Counter(path)
    whole.splits = False
    want = whole.count(texts)
    got = tokens.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert [r.n_tokens for r in sorted(got)] == want


def test_fingerprint(docs, none):
    out = fingerprint.fingerprint_with_next(docs).collect()
    assert len(out) == docs.count()
    marks = {}
    for r in out:
        marks.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert marks[0] == marks[1] == marks[2] and marks[4] == marks[5]
    assert fingerprint.fingerprint_with_next(none).count() == 0
    assert fingerprint.fingerprint_with_next(docs.where("doc_id = 3")).first().near_next == 1.0


def test_colliding_digests_stay_apart(spark):
    texts = [f"text number {i % 30}" for i in range(60)]
    out = fingerprint.fingerprint_with_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bits=3).collect()
    by = {r.doc_id: r.fingerprint for r in out}
    assert len(set(by.values())) == 30 and all(by[i] == by[i + 30] for i in range(30))


def test_fingerprints_have_one_form_at_any_number_of_collisions(spark, monkeypatch):
    """A suffix comes from a text's own form, whether collisions are broadcast or joined by shuffle."""
    texts = [f"text number {i % 1500}" for i in range(1600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = []
    for most in (500_000, 0):
        monkeypatch.setattr(fingerprint, "MOST_BROADCAST_DIGESTS", most)
        got.append({r.doc_id: (r.fingerprint, r.edited_fingerprint) for r in fingerprint.fingerprint_with_next(df, bits=9).collect()})
    assert got[0] == got[1] and len({x for x, _ in got[0].values()}) == 1500
    forms = {fingerprint.canonical(t) for t in texts}
    sharing = {}
    for f in forms:
        sharing.setdefault(fingerprint.digest(f, 9), []).append(f)
    for d, (x, _) in got[0].items():
        f = fingerprint.canonical(texts[d])
        alone = len(sharing[fingerprint.digest(f, 9)]) == 1
        assert x == fingerprint.digest(f, 9) + ("" if alone else "-" + fingerprint.suffix(f))
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint_with_next(df).collect()}
    assert all(len(x) == 32 for x in plain.values())


def test_near_duplicates(docs, none):
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r.class_id for r in out}
    assert by[4] == by[5] == 4 and by[0] == 0 and by[1] == 1 and by[2] == 2
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("text = 'same text here'").count() == 1
    assert kept.count() == docs.count() - 2 and neardup.keep_one(none).count() == 0


def test_near_copies_in_a_large_group(spark):
    import random

    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    data = [(0, " ".join(base))]
    for k in range(1, 300):
        w = list(base)
        w[rng.randrange(200)] = f"new{k}"
        data.append((k, " ".join(w)))
    data.append((999, " ".join(f"other{i}" for i in range(200))))
    out = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {v for k, v in out.items() if k < 300} == {0} and out[999] == 999


def test_packing(docs, none):
    out = packing.pack(docs).collect()
    assert len(out) == docs.count() and packing.pack(none).count() == 0
    assert {r.length for r in out if r.doc_id in (0, 1, 2)} == {0}
    alone = [r for r in out if r.doc_id == 3][0]
    assert alone.slot == 0 and alone.bucket_limit >= alone.length == 20000


def test_bins_hold_their_lengths(spark):
    got = spark.range(0, 3_000_000, 997).select("id", packing.bin_top(F.col("id")).alias("top")).collect()
    assert all(r.id <= r.top and r.top - r.id <= max(0, r.id) / 64 for r in got)


def test_toxicity(spark, docs, none):
    bad = [(100 + i, f"this is number {i}. You are a grumblefrog{i % 3} indeed. End.", 1) for i in range(40)] + [(200 + i, f"this is number {i}. You are a good friend indeed. End.", 0) for i in range(120)]
    labelled = spark.createDataFrame(bad, "doc_id long, text string, toxic int")
    model = toxicity.train(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic"))
    out = {r.doc_id: r for r in toxicity.score(docs.withColumn("score", F.lit(1)), model).collect()}
    assert len(out) == docs.select("doc_id").distinct().count() and out[0].score < 0.01 and out[1].score < 0.01
    unseen = spark.createDataFrame([(1, "We met. He said grumblefrog9 to me. Fine."), (2, "We met. He was good.")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(unseen, model).collect()}
    assert got[1] > 0.5 > 0.1 > got[2]
    assert [r.sentence.strip() for r in toxicity.locate(unseen, model).collect()] == ["He said grumblefrog9 to me."]
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.train(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic").limit(0))
    assert toxicity.score(unseen, empty).count() == 2


def test_toxicity_of_long_neutral_texts(spark):
    """Ten thousand sentences that say nothing of toxicity don't add up, with a model or without labels."""
    bad = [(100 + i, f"this is number {i}. You are a grumblefrog{i % 3} indeed. End.", int(i < 40)) for i in range(40)] + [(200 + i, f"this is number {i}. You are a good friend indeed. End.", 0) for i in range(120)]
    labelled = spark.createDataFrame(bad, "doc_id long, text string, toxic int")
    long = spark.createDataFrame([(1, " ".join(f"Sentence {i} is number nine{i}." for i in range(10_000))), (2, None)], "doc_id long, text string")
    for labels in (labelled, labelled.where("toxic = 0")):
        model = toxicity.train(labelled.select("doc_id", "text"), labels.select("doc_id", "toxic"))
        got = {r.doc_id: r for r in toxicity.score(long, model).collect()}
        assert got[1].n_sentences == 10_000 and got[1].score < 0.1 and got[2].score == 0


def test_toxicity_gradient_and_noisy_or_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    owner, y, weight = np.array([0, 0, 1, 2, 2, 2, 3]), np.array([1, 0, 0, 1]), np.array([1.0, 2.0, 0.5, 3.0])
    z = rng.normal(-2, 2, 7)
    got = toxicity.slopes(z, owner, y, weight)
    for k in range(7):
        up, down = z.copy(), z.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert abs(got[k] - (toxicity.loss(up, owner, y, weight) - toxicity.loss(down, owner, y, weight)) / 2e-6) < 1e-5
    p = 1 / (1 + np.exp(-z))
    assert abs(toxicity.noisy_or(z) - (1 - np.prod(1 - p))) < 1e-12 and toxicity.noisy_or([]) == 0


def test_toxicity_scores_against_a_plain_version(spark):
    import re

    import numpy as np

    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 2, toxicity.DIMENSIONS).astype(np.float32), -3.0)
    texts = ["One two. Three four! One two.", "", None, "a\nb", "word " * 300, "No end"]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for d, t in enumerate(texts[:4]):
        p = 1.0
        for part in dict.fromkeys(x.strip().lower() for x in re.findall(r"[^.!?\n]+[.!?]*", t or "")):
            ws = set(re.findall(r"\w+", part))
            if ws:
                logit = -3.0 + sum(float(model.weights[toxicity.features(w)].sum()) for w in ws)
                p *= (1 - 1 / (1 + np.exp(-logit))) / (1 - 1 / (1 + np.exp(3.0)))
        assert abs(got[d] - max(0, 1 - p)) < 1e-6


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x " * (10_000 if i == 3 else 10)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MOST_BYTES", 210)
    got = toxicity._sample(docs, labels).collect()
    assert sorted(r.y for r in got) == [0] * 10 + [1] * 10 and 3 not in {r.doc_id for r in got}


PAGE = """<html><head><title>T</title><style>x</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav>Menu</nav>
<div class="cookie-notice">We use cookies</div><div class="wrap"><div class="post-body p12"><h2>Head &amp; tail</h2><p>First para with <b>bo</b>ld and <a href="/x">a link</a>.<p>Second&nbsp;one
line.<script>var p = "</p>";</script></p><!-- gone --></div><div class="comments"><p>Nice post, I liked it very much indeed!</p></div></div>
<aside>Side</aside><form>Search <input></form><footer>Foot</footer></body></html>"""


def test_html(spark):
    data = [(1, "http://h.org/1", PAGE), (2, "http://H.org:80/2", PAGE.replace("p12", "p34")), (3, "http://h.org/3", None), (4, None, ""), (5, "x", "<p>only text"), (6, "http://z", "<div title='a"), (1, "http://h.org/1", PAGE)]
    df = spark.createDataFrame([(*r, "t", "p") for r in data], "page_id long, url string, html string, text string, path string")
    out = html.extract(df).collect()
    by = {r.page_id: r.text for r in out}
    assert len(out) == 7 and by[3] == by[4] == ""
    assert by[1] == by[2] == "Head & tail First para with bold and a link. Second one line."
    assert by[5] == "only text"
    assert html.extract(df.limit(0)).count() == 0


def test_html_consensus_overrides_a_misleading_page(spark):
    page = lambda main, side: f"<body><div class='m'><p>{main}</p></div><div class='q'><p>{side}</p></div></body>"
    data = [(i, "http://a/x", page("long article text " * 9, "short")) for i in range(5)] + [(9, "http://a/y", page("brief news", "a very long quiz " * 30))]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert out[9] == "brief news"


def star(n, seed=0, words=400, edits=6):
    """An original and n copies with own edits: about 0.86 to the original, 0.74 to each other."""
    import random

    rng = random.Random(seed)
    text = [f"w{seed}x{k}" for k in range(words)]
    copies = []
    for c in range(n):
        copy = list(text)
        for at in range(edits):
            copy[(at * words // edits) + rng.randrange(8, words // edits - 8)] = f"e{seed}c{c}x{at}"
        copies.append(" ".join(copy))
    return [*copies[: n // 2], " ".join(text), *copies[n // 2 :]]


def test_star_of_edited_copies_is_one_class(spark):
    from hyperloom.llm import neardup

    docs = spark.createDataFrame(list(enumerate(star(300))), "doc_id long, text string").coalesce(1)
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == 301 and {r.class_id for r in rows} == {0}


@pytest.mark.parametrize("sample", [1024, 64])
def test_open_pairs_join_all_similar_members_of_a_bucket(spark, monkeypatch, sample):
    """With small blocks, and with samples of sets: components and pairs together are those of brute force."""
    import itertools

    from hyperloom.llm import neardup

    monkeypatch.setattr(neardup, "SAMPLE", sample)
    texts = star(60) + star(20, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "near_id long, near_text string")
    sketch = neardup.sketched(docs, "near_id", "near_text")
    shared = neardup.shared_buckets(sketch.select("rid", "near_bands"))
    text_of = {r.rid: texts[r.near_id] for r in sketch.collect()}
    written = spark.createDataFrame(list(text_of.items()), "rid long, near_text string")
    one = {rid: rid if rid % 3 else -1 for rid in text_of}
    comp = spark.createDataFrame(list(one.items()), "node long, component long")
    got = {(r.a, r.b) for r in neardup.open_pairs(shared, written, comp, block=8).collect()}
    sets = {rid: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for rid, t in text_of.items() for w in [t.split()]}
    similar = lambda a, b, least: len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    buckets = {}
    for r in shared.collect():
        buckets.setdefault(r.key, set()).add(r.rid)
    want = {(max(p), min(p)) for m in buckets.values() if len(m) > 2 for p in itertools.combinations(m, 2) if one[p[0]] != one[p[1]] and similar(*p, 0.8)}

    def joined(pairs):
        parent = dict(one) | {-1: -1}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        return {rid: find(rid) for rid in one}

    assert max(map(len, buckets.values())) > 16 and want
    assert joined(got if sample == 1024 else got & want) == joined(want)
    assert all(similar(*p, 0.8 if sample == 1024 else 0.6) for p in got)


def test_agreement_bound():
    from math import comb

    from hyperloom.llm import neardup

    for least in (0.5, 0.8, 0.9):
        k = neardup.least_agree(least)
        assert sum(comb(120, j) * least**j * (1 - least) ** (120 - j) for j in range(k)) <= 1e-8


def test_token_groups_are_of_bytes_and_long_texts_are_cut_at_spaces():
    import numpy as np

    sizes = np.array([3, 4, 100, 1, 1, 0, 9])
    got = list(tokens.groups(sizes, 8))
    assert [k for a, b in got for k in range(a, b)] == list(range(7)) and all(sizes[a:b].sum() <= 8 or b == a + 1 for a, b in got)
    assert list(tokens.groups(np.array([], dtype=np.int64))) == []
    text = "日本 語の\nテキスト " * 50 + "end"
    cut = list(tokens.parts(text, len(text.encode()), 40))
    assert len(cut) > 20 and max(len(x.encode()) for x in cut) <= 60
    assert [w for x in cut for w in x.split()] == text.split()


def test_token_counts_of_marked_and_long_pieces(spark, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(tokens, "GROUP_BYTES", 64)
    texts = ["Word, word. word! it's. It'll? a.b., ...", "x" * 500 + ". " + "Y" * 40 + ",", "A1, 1. 2; é, É. <|ENDOFTEXT|>, <|endoftext|>.", "ß. İ, ŒUVRE; word\n\nword, " * 40]
    counter = tokens.Counter(path)
    whole = counter.encode(texts)
    assert counter.folds and [sum(counter.count([p])[0] for p in tokens.parts(t, len(t.encode()), 64)) for t in texts] == whole
    assert counter.count(texts) == whole


def test_limits_are_exact_for_few_lengths_and_binned_for_many(spark):
    lengths = spark.range(0, 30_000, 10).select(F.col("id").alias("length"))
    exact = packing.length_histogram(lengths)
    assert exact == [(k, 1) for k in range(0, 30_000, 10)]
    binned = packing.length_histogram(lengths, most=1000)
    assert len(binned) < 3000 and sum(n for _, n in binned) == 3000


def test_registered_packing_counts_tokens(spark, tmp_path):
    import corpus_pipeline
    from hyperloom.llm import tokens

    texts = [None, "", "one two three", "日本語の文章" * 700, "日本語の文章" * 700]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, tokens.default_path()).collect()}
    assert want[3] > 1000
    for out in (packing.op10_pack_buckets(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        assert {r.doc_id: r.length for r in out.collect()} == want


def test_poisson_inverse_of_great_rates(spark):
    """Against sums of exact terms, at small, middle and great rates."""
    from fractions import Fraction
    from math import exp, lgamma, log

    rates = [0.5, 7.5, 15.9, 16.1, 20.0, 60.0, 167.0, 200.0, 250.0, 900.0, 5000.0]
    us = [0.0, 1e-9, 0.001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1 - 1e-9]
    grid = spark.createDataFrame([(u, r) for r in rates for u in us], "u double, r double")

    def inverse(u, r):
        k, cdf = 0, Fraction(exp(-r))
        while cdf <= u:
            k += 1
            cdf += Fraction(exp(k * log(r) - r - lgamma(k + 1)))
        return k

    for row in grid.select("u", "r", mixing.poisson_inverse(F.col("u"), F.col("r")).alias("k")).collect():
        if row.u == 0 and row.r > 200:
            continue  # decided by terms below 1e-16
        assert row.k == inverse(row.u, row.r), row
    many = spark.range(20000).select(mixing.poisson_inverse(mixing.uniform(F.col("id").cast("string"), 1), F.lit(60.0)).alias("k"))
    mean, var = many.agg(F.avg("k"), F.var_samp("k")).first()
    assert abs(mean - 60) < 0.4 and abs(var - 60) < 4


def test_repeated_passages_do_not_hide_a_pair(spark):
    """Sets are nearly equal, but a fifth of the shingles of one text repeats 1,000 times."""
    from hyperloom.llm import neardup

    rows = []
    for k in range(12):
        w = [f"p{k}w{i}" for i in range(400)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:320] + w[320:] * 1000))]
    out = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {d: d - d % 2 for d, _ in rows}
