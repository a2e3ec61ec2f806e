"""Operators against brute force, library results, exact round trips, and rows at the edges."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from tilewright.llm import byte_bpe, components, impact_topk, mixing, multiset_hash, ordering, parity_join, pu_quality, queries, secrets, shingles, token_frames, url_lm, warc_audit
from tilewright.llm.shared import filesystem, fresh_path, text_bytes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def docs(spark, texts, source="s"):
    return table(spark, [(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)])


def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text, and a clashing column of every result."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "a b c d e f g h", "en", "s", 15),
        (1, "a b c d e f g h", "en", "s", 15),
        (2, None, None, None, None),
        (3, "", "en", "s", 0),
        (4, " \n\t ", "en", None, 4),
        (None, "a b c d e f g h", "en", "t", 15),
        (None, None, "en", "t", None),
        (5, long, "en", "t", len(long)),
        (6, "é漢字🎉 token = \"0123456789abcdef0123456789abcdef01234567\"", "fr", "t", 60),
    ]
    df = table(spark, rows)
    for name in ("size", "key", "rank", "score", "spans", "part", "h1", "target", "slice", "verdict", "ids", "row_id"):
        df = df.withColumn(name, F.lit("x"))
    return df


SQL = sorted(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", SQL)
def test_sql(name, spark, sf, duck):
    assert_same(queries.QUERIES[name](spark, sf), duck, queries.ORACLE_SQL[name])


# 1


def test_url_parts(spark):
    urls = ["HTTP://A.Example.COM/en/7x?q#f", "http://net/de/", "xhttp://b.net:80/de/8", None, "no scheme/com/en/", "http://com/en/1", "http://acom/en/1", "http://org?x", "://org/es/a#b", ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_lm.judge_urls(pages, queries.URL_RULES).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7")
    assert got[1] == ("net", "/de/", "net/de/")
    assert got[2] == ("b.net:80", "/de/8", None)
    assert got[3] == ("", "", None) and got[4] == ("", "", None) and got[9] == ("", "", None)
    assert got[5][2] == "com/en/" and got[6] == ("acom", "/en/1", None)
    assert got[7] == ("org", "", None) and got[8] == ("org", "/es/a", "org/es/")


def test_grams_of_wide_characters(spark):
    got = url_lm._grams(spark.createDataFrame([(1, "é🎉a"), (2, ""), (3, "x")], "id long, lm string"), ["id"]).collect()
    assert sorted((r["id"], r["g"]) for r in got) == [(1, "\x02\x02\x02é"), (1, "\x02\x02é🎉"), (1, "\x02é🎉a"), (3, "\x02\x02\x02x")]


def test_url_models_tell_apart(spark):
    rows = [(i, f"http://site{i}.com/{'good/news' if i % 2 else 'bad/spam'}/{i}") for i in range(400)] + [(1000, "http://other.com/x/good/news/7"), (1001, "http://other.com/x/bad/spam/8")]
    rules = [("allow", "com", "/good"), ("block", "com", "/bad")]
    got = {r["page_id"]: r["verdict"] for r in url_lm.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).where("page_id >= 1000").collect()}
    assert got == {1000: "allow", 1001: "block"}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_lm.judge_urls(empty, rules).count() == 0
    assert url_lm.judge_urls(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), rules).first()["verdict"] == "allow"


# 2


def spans_by_definition(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secret_spans():
    r = random.Random(4)
    bits = ["token", "ToKeN", "api_key", "apikey", "secret", "paſſword", "Kpassword", " ", "  ", ":", "=", '"', "'", "AKIA", "ABCDEFGH1234", "abcdef0123456789", "é", "xyz", "secret=", "a.b/c+d", "\n"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert [(s, k, e) for s, k, e, _ in secrets.find_spans(t) if k < 3] == spans_by_definition(t)


def test_ownership(spark):
    shared, own = "Zx9Kq2Lm8Np4Rs6Tv1Wy3", "Qa1Ws2Ed3Rf4Tg5Yh6Uj7"
    rows = [(1, f"key {shared} end", "en", "a", 0), (2, f"key {shared} end", "en", "b", 0), (3, f"key {own} end", "en", "a", 0), (4, f"key {own} end", "fr", "a", 0), (5, None, None, None, None)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(table(spark, rows)).collect()}
    assert got == {1: "", 2: "", 3: f"owned:4:{4 + len(own)}", 4: f"owned:4:{4 + len(own)}", 5: ""}
    wide = "Rw4Et5Yu6Io7Pa8Sd9Fg0"  # one owner, but three repositories
    some = [(10 + i, f"key {wide} end", lang, "a", 0) for i, lang in enumerate(["en", "fr", None])]
    assert {r["spans"] for r in secrets.find_secrets(table(spark, some)).collect()} == {""}
    assert {r["spans"] for r in secrets.find_secrets(table(spark, some[:2])).collect()} == {f"owned:4:{4 + len(wide)}"}
    red = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact_secrets(table(spark, [*rows, (6, 'x token = "abcdefgh" y', "en", "a", 22)])).collect()}
    assert red[3][0] == "key <owned> end" and red[1][0] == f"key {shared} end" and red[5] == (None, None)
    assert red[6] == ('x <assign>" y', 13)


@pytest.mark.parametrize("most", [0, 200_000])
def test_redaction_by_row(spark, monkeypatch, most):
    """Texts that share a doc_id or have none, copies, and columns of any name: each text is cut at its own spans."""
    monkeypatch.setattr(secrets, "MAX_BROADCAST_ROWS", most)
    r = random.Random(3)
    token = lambda: "aB1cD2" + "".join(r.choice("abcDEF123") for _ in range(20))
    tokens = [token() for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [r.choice(["plain words", "token = 12345678", tokens[r.randrange(12)], "é🎉", "\n"]) for _ in range(r.randint(0, 6))]
        rows.append((r.choice([None, 1, 1, 2, i]), " ".join(parts), r.choice(["en", "fr", "de", None]), r.choice(["a", "b"]) if i % 3 else "a", 5))
    rows += [rows[0], (None, None, None, None, None), (7, "", "en", "a", 0)]
    held = {}
    for _, t, lang, source, _ in rows:
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t or ""):
            held.setdefault(m[0], set()).add((source, lang))
    live = {v for v, where in held.items() if len({s for s, _ in where}) == 1 and len(where) <= 2}

    def cut(t):
        if not t:
            return t
        out, at = "", 0
        for s, k, e, v in secrets.find_spans(t):
            if e > at and (k < 3 or v in live):
                out, at = out + t[at:max(s, at)] + (f"<{secrets.KINDS[k]}>" if s >= at else ""), e
        return out + t[at:]

    df = table(spark, rows).withColumn("text_key", F.lit("x")).withColumn("live_values", F.lit(1)).withColumn("value", F.lit(2))
    got = secrets.redact_secrets(df)
    assert got.columns == df.columns
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=repr) == sorted(((d, cut(t)) for d, t, *_ in rows), key=repr)
    assert live and len(live) < len(held)
    assert sorted((x["doc_id"], x["text"]) for x in secrets.redact_secrets(df.drop("n_chars").where("doc_id = 2")).collect()) is not None


def test_long_text_spans():
    t = " ".join("0123456789abcdef0123456789abcdef aB1cD2eF3gH4iJ5kL6mN7" for _ in range(20_000))
    spans = secrets.find_spans(t)  # linear: base spans and runs are merged
    assert len(spans) == 40_000 and sum(k == 3 for _, k, _, _ in spans) == 20_000


# 3


def sentence_counts(text):
    return Counter(s for p in (text or "").split("\n") if p.strip() for s in p.split(". "))


def true_likeness(a, b):
    x, y = sentence_counts(a), sentence_counts(b)
    return 2 * sum((x & y).values()) / sum((x + y).values()) if x or y else 1.0


def test_likeness_counts_repeats():
    r = random.Random(6)
    v = lambda t: multiset_hash.vector(multiset_hash.paragraphs(t))
    pairs = [("x\n" * 65536, "x\n" * 65537), ("a line\n" * 100 + "\n".join(f"p{i}" for i in range(50)), "a line\n" * 100 + "\n".join(f"q{i}" for i in range(50))), ("", "\n \n")]
    for _ in range(200):
        base = [f"word{r.randrange(50)}" for _ in range(r.randint(1, 200))]
        other = [x if r.random() < 0.7 else f"other{r.randrange(50)}" for x in base]
        pairs.append(("\n".join(base), "\n".join(other)))
    off = [abs(true_likeness(a, b) - multiset_hash.likeness(v(a), v(b))) for a, b in pairs]
    assert max(off) < 0.3 and sum(off) / len(off) < 0.06 and off[0] < 0.001 and off[1] < 0.15 and off[2] == 0


def test_multiset_hash():
    r = random.Random(1)
    lines = [" ".join(r.choice("abcdefgh") * 3 for _ in range(9)) + "." for _ in range(40)]
    whole = multiset_hash.vector(lines)
    mixed = multiset_hash.vector(r.sample(lines, 40))
    assert multiset_hash.render(whole) == multiset_hash.render(mixed)
    step = multiset_hash.insert(multiset_hash.delete(whole, lines[:5]), lines[:5])
    assert multiset_hash.likeness(step, whole) == 1.0
    assert multiset_hash.render(multiset_hash.vector(lines + lines[:1])) != multiset_hash.render(whole)
    back = multiset_hash.parse(multiset_hash.render(whole))
    assert (back[0] == whole[0]).all() and (back[1] == whole[1]).all()
    half = multiset_hash.vector(lines[:20] + [x[::-1] + "z" for x in lines[:20]])
    assert 0.3 < multiset_hash.likeness(whole, half) < 0.7
    nothing = multiset_hash.vector([])
    assert multiset_hash.likeness(nothing, nothing) == 1.0 and multiset_hash.likeness(nothing, whole) == 0.0


@pytest.mark.parametrize("n", [1, 2, 37])
def test_edited_texts(spark, n):
    r = random.Random(n)
    texts = ["".join(r.choice("ab é🎉\n") for _ in range(r.randint(0, 30))) for _ in range(n)]
    ids = r.sample(range(1000), n)
    got = {x["doc_id"]: x for x in multiset_hash.edited_likeness(table(spark, [(i, t, None, None, None) for i, t in zip(ids, texts)])).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    assert len(got) == n
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        h = len(t) // 2
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()
        edited = t[: len(t) - h] + nxt[:h]
        for column, text in (("fingerprint", t), ("edited_fingerprint", edited)):
            words, counters = multiset_hash.parse(got[i][column])
            parts = [p for p in text.split("\n") if p.strip()]
            for k in range(8):
                assert int(words[k]) == sum(int.from_bytes(hashlib.blake2b(p.encode(), digest_size=64).digest()[8 * k : 8 * k + 8], "little") for p in parts) % 2**64
            assert int(words[8]) == sum(sentence_counts(text).values()) and len(counters) == multiset_hash.COUNTERS
        assert abs(got[i]["near_next"] - true_likeness(t, nxt)) < 0.35 and abs(got[i]["near_edited"] - true_likeness(t, edited)) < 0.35
        assert (got[i]["near_next"] == 1) == (true_likeness(t, nxt) == 1)


def test_edited_texts_against_sql(spark, sf, duck):
    """The two columns of the query that SQL can express, over the whole table."""
    sql = """with d as (select doc_id, coalesce(text, '') as t, coalesce(lead(coalesce(text, '')) over w, first_value(coalesce(text, '')) over w) as n from documents window w as (order by doc_id desc))
    select doc_id, length(t) as n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(n, 1, length(t) // 2)) as edited_sha256 from d"""
    assert_same(queries.op3_multiset_fingerprint(spark, sf).select("doc_id", "n_chars", "edited_sha256"), duck, sql)


# 4


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    alphabet = [*"abcdefg the ing's TLL 019 \n\t\r\x0b\x85\xa0 é漢字🎉\x1c-.!?"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 70))) for _ in range(800)] + ["a" * 900, "ab" * 700, " " * 600, "x" * 513, "", "the" * 200]
    bpe = byte_bpe.codec(path, P.PATTERN)
    for t, ids in zip(texts, bpe.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()
    tokens = byte_bpe.encode(docs(spark, texts[:50] + [None]), path, P.PATTERN)
    back = {x["doc_id"]: x["text"] for x in byte_bpe.decode(tokens, path, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts[:50] + [None])}


def test_long_pieces():
    """Against the library on pieces far beyond LONGEST, and with one merge a round against many."""
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.codec(path, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(5)
    pieces = ["".join(r.choice(s) for _ in range(n)) for s in ("abc", "etaoinshr", "ab", "é漢字x") for n in (513, 2000, 9000)] + ["a" * 5001, "the" * 3000, " " + "x" * 4000]
    pieces += ["".join(r.choice(["ation", "ing", "er", "tion", "s", "Q", "in"]) for _ in range(1500)) for _ in range(4)]
    for piece in pieces:
        assert bpe.merge_long(piece.encode()).tolist() == enc._encode_single_piece(piece.encode())


# 5


@pytest.mark.parametrize("seed,spread", [(0, 1.0), (1, 0.05), (2, 30.0)])
def test_top_k(spark, seed, spread):
    r = np.random.default_rng(seed)
    v = np.round(r.normal(size=(300, 8)) * spread, 2).astype(np.float32)
    v[50:120] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = impact_topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in impact_topk.top_k(df, F.col("vec_id") % 7 == 0, 5, block=64, query_block=16).collect())
    m = np.floor(256 * v.astype(float)).astype(int)
    want = []
    for q in range(0, 300, 7):
        s = m @ m[q]
        order = [i for i in sorted(range(300), key=lambda i: (-s[i], i)) if i != q][:5]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(order)]
    assert got == sorted(want)


def test_top_k_takes_segments_until_proof():
    r = np.random.default_rng(5)
    v = np.floor(256 * r.normal(size=(4000, 16)))
    v[:20] = np.floor(v[20] * 3 + r.normal(size=(20, 16)))  # a few stand out
    index = impact_topk.Index(np.arange(4000), v)
    known, s = index.top(v[0], 0, 5), v @ v[0]
    want = sorted((-int(s[i]), i) for i in range(1, 4000))[:5]
    assert known == want and 0 < index.taken < 0.8 * index.segments
    low = impact_topk.Index(np.arange(4000, 4500), np.ones((500, 16)))
    assert low.top(v[0], 0, 5, known) == known and low.taken == 0  # no vector of the block can reach what is known


@pytest.mark.parametrize("size", [1e4, 1e6, 1e9, 1e30])
def test_top_k_of_large_components(spark, size):
    r = np.random.default_rng(4)
    v = r.normal(size=(120, 6)) * size
    v[3:9] = v[2]
    df = impact_topk.integer_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in impact_topk.top_k(df, F.col("vec_id") % 10 == 0, 5, block=32, query_block=8).collect())
    m = [[math.floor(256 * x) for x in row] for row in v.tolist()]
    want = []
    for q in range(0, 120, 10):
        s = [sum(a * b for a, b in zip(m[q], row)) for row in m]
        order = sorted((i for i in range(120) if i != q), key=lambda i: (-min(s[i], 2**63 - 1), i) if size < 1e9 else (-s[i], i))[:5]
        want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, s[i]))) for k, i in enumerate(order)]
    if size < 1e9:
        assert got == sorted(want)
    else:  # beyond a long's range only the shown scores are alike
        assert [(q, k, s) for q, k, _, s in got] == [(q, k, s) for q, k, _, s in sorted(want)]


def test_top_k_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (None, [1.0, 1.0]), (7, [-1e30, 1.0]), (5, [1.0])]
    df = impact_topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = [(x["rank"], x["vec_id"], x["score"]) for x in impact_topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 5, 65536), (2, 5, 65536), (3, 6, 0), (4, 7, -(2**63))]
    other = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "vec_id long, embedding array<float>").selectExpr("*", "1 as size", "2 as v", "3 as cb", "4 as qb", "5 as copy", "6 as rank", "7 as score")
    assert impact_topk.top_k(impact_topk.integer_vectors(other, "vec_id", "embedding"), F.col("vec_id") == 2).count() == 5
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert impact_topk.top_k(impact_topk.integer_vectors(none, "vec_id", "embedding"), F.col("vec_id") == 0).count() == 0


# 6


def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = pu_quality.score(d, pu_quality.train(d, labels)).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    good = [r for r in rows if r["quality"] == 1]
    assert right > 0.9 and sum(r["predicted"] for r in good) / len(good) > 0.93


def test_risk_and_slope():
    """Against the risk by its definition, and its slope by differences."""
    r = np.random.default_rng(1)
    p, u, w, prior = r.normal(size=(30, 5)), r.normal(size=(40, 5)), r.normal(size=5), 0.3

    def risk(w):
        loss = lambda x, y: 1 / (1 + math.exp(y * float(x @ w)))
        rp, rn = sum(loss(x, 1) for x in p) / 30, sum(loss(x, -1) for x in p) / 30
        return prior * rp, sum(loss(x, -1) for x in u) / 40 - prior * rn

    up, down, slope_up, slope_down = pu_quality.risk_and_slope(w, p, u, prior)
    assert (up, down) == pytest.approx(risk(w))
    for i in range(5):
        step = np.eye(5)[i] * 1e-6
        a, b = risk(w + step), risk(w - step)
        assert ((a[0] - b[0]) / 2e-6, (a[1] - b[1]) / 2e-6) == pytest.approx((slope_up[i], slope_down[i]), abs=1e-6)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.9])
def test_prior_and_posterior_without_negative_labels(prior):
    r = np.random.default_rng(2)
    draw = lambda n, mean: r.normal(mean, 1, n)
    p = draw(3000, 3.0)
    mine = r.random(3000) < prior
    u = np.where(mine, draw(3000, 3.0), draw(3000, -3.0))
    assert abs(pu_quality.estimate_prior(p, u) - prior) < 0.05
    places, chances = pu_quality.posterior(p, u, prior)
    assert (np.diff(places) >= 0).all() and (np.diff(chances) >= -1e-12).all() and chances.min() >= 0 and chances.max() <= 1
    told = np.interp(u, places, chances)
    assert ((told >= 0.3) == mine).mean() > 0.98 and abs(told.mean() - prior) < 0.05
    # the rising function of least risk, by trying steps: one threshold can't do better
    risk = lambda f: (f(u) ** 2).mean() / 2 - prior * f(p).mean()
    best = risk(lambda x: np.interp(x, places, chances))
    assert all(risk(lambda x, t=t, c=c: np.where(x >= t, c, 0.0)) >= best - 1e-3 for t in np.linspace(-5, 5, 41) for c in (0.2, 0.5, 0.9, 1.0))


def test_quality_of_repeated_ids(spark):
    """A doc_id that a third of all rows share is one row of the sample."""
    rows = [(1, f"text number {i} of many", "en", "s", 1) for i in range(300)] + [(i, "some words " * (i % 9), "en", "s", 1) for i in range(2, 100)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 100)], "doc_id long, quality int, toxic int")
    got = pu_quality.score(table(spark, rows), pu_quality.train(table(spark, rows), labels, sample=50))
    assert got.count() == 398


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in pu_quality.score(odd_docs(spark), pu_quality.train(odd_docs(spark), none)).collect()} == {0.5}
    only = spark.createDataFrame([(1, 1, 0), (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert pu_quality.score(odd_docs(spark), pu_quality.train(odd_docs(spark), only)).count() == 9


# 7


def sets_of(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_definition(texts):
    sets = [sets_of(t) for t in texts]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        moved = False
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    moved = True
        if not moved:
            return sets, root


def near_copies(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    line = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(n):
        base = [word() for _ in range(r.choice([0, 3, 4, 5, 8, 9, 20, 60, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                if copy:
                    copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if r.random() < 0.3 else " \n".join(copy))
        if r.random() < 0.4:
            texts.append(line + " " + " ".join(word() for _ in range(r.randint(1, 40))))
    return texts + ["", None, " \t", "one", "ONE", "one two", "one two three four five"]


@pytest.mark.parametrize("seed", [0, 1])
def test_parity_join_equals_definition(spark, seed):
    texts = near_copies(seed, 45)
    sets, root = components_by_definition(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.similar_documents(docs(spark, texts)).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_parity_join_splits_hot_keys(spark, monkeypatch):
    """Small blocks and a low bar for trying the closest first give the same components."""
    texts = near_copies(7, 30)
    _, root = components_by_definition(texts)
    monkeypatch.setattr(parity_join, "KEY_BLOCK", 4)
    monkeypatch.setattr(parity_join, "STAR_BLOCK", 3)
    monkeypatch.setattr(parity_join, "MAX_BROADCAST_ROWS", 0)
    got = {r["doc_id"]: r["component_id"] for r in parity_join.similar_documents(docs(spark, texts)).collect()}
    assert got == dict(enumerate(root))


def test_sketch_bounds_difference():
    r = np.random.default_rng(2)
    for _ in range(300):
        pool = np.unique(r.integers(0, 2**63, 400, dtype=np.uint64))
        a, b = (np.sort(r.choice(pool, r.integers(4, 300), replace=False)) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        x, y = (parity_join.sketch_of(s) for s in (a, b))
        to = 8 * min(len(x), len(y))
        fold = [parity_join._folded(int.from_bytes(s, "little"), 8 * len(s), to) for s in (x, y)]
        assert (fold[0] ^ fold[1]).bit_count() <= apart
        same = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert not same or parity_join._could_link(len(a), x, len(b), y)


def test_sets_of_few_classes_share_a_key(monkeypatch):
    """With far too few classes all of them may differ; such documents still meet."""
    monkeypatch.setattr(parity_join, "classes_of", lambda band: 3)
    r = np.random.default_rng(8)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**64, 60, dtype=np.uint64))
        b = np.unique(np.concatenate([r.permutation(a)[4:], r.integers(0, 2**64, 5, dtype=np.uint64)]))
        assert set(parity_join.keys_of(a).tolist()) & set(parity_join.keys_of(b).tolist())


def test_linked_sets_share_a_key():
    r = np.random.default_rng(3)
    for _ in range(1500):
        n = int(r.choice([5, 9, 20, 31, 32, 33, 47, 48, 70, 72, 110, 300, 1000]))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        most = len(a) // 5
        drop = int(r.integers(0, most + 1))
        b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**64, int(r.integers(0, max(1, len(a) // 4))), dtype=np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) and len(np.setxor1d(a, b)):
            assert set(parity_join.keys_of(a).tolist()) & set(parity_join.keys_of(b).tolist())


def test_shingle_sets_on_bytes():
    texts = near_copies(5, 20) + ["x" * 5000 + " b c d e f", "a\x0bb\x0cc\rd\te f", "É é à b c d", "a b c d e a b c d e f"]
    for i in range(len(texts)):
        texts[i] = (texts[i] or "")[: 10**6]
    got = list(shingles.shingle_sets(*text_bytes(pa.array(texts))))
    assert [len(s) for s in got] == [len(sets_of(t)) for t in texts]


def test_components(spark):
    r = random.Random(9)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {i: i for i in range(400)}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {i for e in links for i in e}
    assert {i: got.get(i, i) for i in nodes} == {i: root[i] for i in nodes}


# 8


def test_targets_fill_up(spark):
    rows = [("a", 10), ("b", 1000), ("c", 5), (None, 100)]
    t = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    weights = {"a": 1, "b": 2, "c": 3, None: 1}
    total, target = 1115, {}
    free = dict(rows)
    left = float(total)
    while True:  # by rounds: what the cap cuts off is shared again
        unit = left / sum(weights[s] for s in free)
        over = [s for s in free if unit * weights[s] > 3 * free[s]]
        if not over:
            target |= {s: unit * weights[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * free.pop(s)
            left -= target[s]
    assert {s: v[1] for s, v in t.items()} == pytest.approx(target)


def test_mix_takes_its_targets(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 60))), "en", r.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(600)]
    got = mixing.mix(table(spark, rows)).collect()
    again = mixing.mix(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    by = {}
    for x in got:
        assert 0 <= x["taken"] <= 3 * x["size"]
        s = by.setdefault(x["source"], [0, 0, x["target"], x["source_size"]])
        s[0] += x["taken"]
        s[1] += x["size"]
    for taken, size, target, source_size in by.values():
        assert size == source_size and abs(taken - target) <= 0.5
    copies = mixing.repeat_documents(table(spark, rows)).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert all(abs(c["n"] - by[c["source"]][2]) <= 30 for c in copies)


def test_slices_are_even(spark):
    """No slice of a source takes much more than its share, whatever the weights of the rows."""
    for w in (1.0, 0.5, 0.3, 0.07, 0.05):
        key = -np.log((np.arange(100_000) + 0.5) / 100_000) / w
        place = np.floor(sum(1 - np.exp(-key * x) for x in mixing.SPREAD) / len(mixing.SPREAD) * mixing.SLICES)
        assert np.bincount(place.astype(int)).max() <= 7 * 100_000 / mixing.SLICES


def test_mix_of_repeated_and_null_ids(spark):
    rows = [(None, f"w {'x ' * i}", "en", "a", 0) for i in range(30)] + [(5, f"v {'y ' * (i % 7)}", "en", "b", 0) for i in range(30)] + [(i, "one two three", "en", "c", 0) for i in range(100, 120)] + [(None, None, None, None, None)]
    df = table(spark, rows).selectExpr("*", "1 as copies", "2 as each_copy", "3 as mixed_id", "4 as mixed_rank", "5 as mixed_size", "6 as slice", "7 as mixed", "8 as range_")
    got = mixing.repeat_documents(df)
    assert got.columns == df.columns
    words = {}
    for x in got.collect():
        words[x["source"]] = words.get(x["source"], 0) + len((x["text"] or "").split())
    t = {x["source"]: x["target"] for x in mixing.targets(df.select("source", mixing.word_count(F.col("text")).alias("size"))).collect()}
    assert all(abs(words[s] - t[s]) <= 31 for s in t)
    assert mixing.repeat_documents(df.where("false")).count() == 0


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(r.choice("abcdefgh") * r.randint(1, 3) + str(i), r.randrange(100)) for i in range(300)] + [(None, 5)]
    got = mixing.running(spark.createDataFrame(rows, "k string, n long"), [F.asc_nulls_last("k")], {"sum": F.col("n"), "place": F.lit(1)}).collect()
    total = 0
    for i, x in enumerate(sorted(got, key=lambda x: (x["k"] is None, x["k"]))):
        assert (x["sum"], x["place"]) == (total, i)
        total += x["n"]


# 9


def test_encoder_equals_library(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(2)
    alphabet = [*"abcde the ing'sTLL019 \n\t\r\x0b\x85\xa0 ÀÉßö×÷é漢字🎉\x1c_-.!?<|>́İſΣǅªʰ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(4000)] + ["", " ", "\n", "it's. they're!", "K.K!", "İ.", "x" * 3000 + ".", "hi <|endoftext|> there", "a<|endoftext|>b"]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert any(49407 in x for x in want)
    for remembered in (token_frames.REMEMBERED, 50):  # the second forgets again and again
        monkeypatch.setattr(token_frames, "REMEMBERED", remembered)
        e = token_frames.Encoder(path)
        for i in range(0, len(texts), 100):
            assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts[i : i + 100])] == want[i : i + 100]
    library.encode_special_tokens = True
    plain = token_frames.Encoder(path, special_as_text=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in plain.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_bytes_decide_where_hashes_collide(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(token_frames, "word_hashes", lambda data, first, end: (end - first).astype(np.uint64) // np.uint64(4))
    r = random.Random(7)
    texts = [" ".join("".join(r.choice("abcdeé1!") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 30))) for _ in range(300)]
    e = token_frames.Encoder(path)
    for i in range(0, 300, 20):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts[i : i + 20])] == [x.ids for x in library.encode_batch(texts[i : i + 20], add_special_tokens=False)]


def test_frames(tmp_path):
    import zstandard

    name = tmp_path / "a.zst"
    rows = [(None, b""), (3, np.arange(5, dtype="<u4").tobytes()), (3, b""), (9, np.arange(70_000, dtype="<u4").tobytes())]
    with open(name, "wb") as f:
        assert token_frames.write_frames(f, [(d, *token_frames.frame_of(raw, token_frames.packer())) for d, raw in rows]) == (4, 70_005)
    files, path = filesystem(str(name))
    with files.open_input_file(path) as f:
        frames = token_frames.FrameFile(f)
        assert frames.doc_ids == [None, 3, 3, 9]
        assert [frames.read(i) for i in (3, 0, 1, 2)] == [rows[i][1] for i in (3, 0, 1, 2)]
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True)
    assert whole.decompress(name.read_bytes()) == b"".join(x for _, x in rows)
    data = bytearray(name.read_bytes())
    data[int(frames.offsets[1]) + 12] ^= 1
    name.write_bytes(bytes(data))
    with files.open_input_file(path) as f:
        with pytest.raises((ValueError, zstandard.ZstdError)):
            token_frames.FrameFile(f).read(1)


def test_token_files(spark):
    path = P.path("word_bpe_49k.json")
    texts = ["One two, three!", None, "", "four  five", "six"]
    ids = [40, 7, 3, 99, 12]
    got = token_frames.write_and_read(table(spark, [(i, t, None, None, None) for i, t in zip(ids, texts)]), path).collect()
    e, at = token_frames.encoder(path, 1), 0
    for x, (i, t) in zip(sorted(got, key=lambda x: x["doc_id"]), sorted(zip(ids, texts))):
        raw = e.encode([t or ""])[0]
        assert (x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"]) == (i, at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4


# 10


def test_merkle_descent():
    r = random.Random(3)
    for n in (1, 2, 3, 7, 64, 100):
        leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
        bad = sorted(r.sample(range(n), min(n, 3)))
        other = [hashlib.sha256(x).digest() if i in bad else x for i, x in enumerate(leaves)]
        a, b = (warc_audit.unpack_tree(warc_audit.pack_tree(warc_audit.levels(x))) for x in (leaves, other))
        assert warc_audit.differing_leaves(a, b)[0] == bad
        assert warc_audit.differing_leaves(a, a) == ([], 1)
    a, b = (warc_audit.unpack_tree(warc_audit.pack_tree(warc_audit.levels(x))) for x in ([bytes([i]) * 32 for i in range(256)], [bytes([i if i != 9 else 0]) * 32 for i in range(256)]))
    assert warc_audit.differing_leaves(a, b)[1] <= 17  # one branch: two nodes a level


def test_warc_files(spark):
    import gzip

    pages = spark.createDataFrame([(2, "http://a/b", "<p>é</p>"), (1, None, None), (None, "http://c\r\nX: y", ""), (2, "http://a/b", "<p>é</p>")], "page_id long, url string, html string").withColumn("part", F.lit("x"))
    base = fresh_path(spark, "warc-test")
    manifest = warc_audit.write_archive(pages, base)
    rows = manifest.orderBy("part", "seq").collect()
    assert len(rows) == 4
    for x in rows:
        files, name = filesystem(x["path"])
        with files.open_input_file(name) as f:
            data = gzip.decompress(f.read_at(x["length"], x["offset"]))
        assert len(data) == x["n_bytes"] and hashlib.sha256(data).hexdigest() == x["record_sha256"]
        assert data.startswith(b"WARC/1.0\r\n") and b"\r\nX: y" not in data
    assert {r["status"] for r in warc_audit.audit(manifest, base).collect()} == {"ok"}
    assert {r["status"] for r in warc_audit.audit(manifest, base + "-nowhere").collect()} == {"missing"}
    warc_audit.replicate(manifest, base + "-copy", F.col("page_id") == 1)
    assert sorted((str(r["page_id"]), r["status"]) for r in warc_audit.audit(manifest, base + "-copy").collect()) == [("1", "corrupt"), ("2", "ok"), ("2", "ok"), ("None", "ok")]


# Rows at the edges, for every operator on documents.

BPE = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
RUNS = {
    "secrets": lambda d: secrets.find_secrets(d),
    "redact": lambda d: secrets.redact_secrets(d),
    "multiset": lambda d: multiset_hash.edited_likeness(d),
    "fingerprints": lambda d: multiset_hash.fingerprints(d),
    "bpe": lambda d: byte_bpe.round_trip_digests(d, *BPE),
    "encode": lambda d: byte_bpe.encode(d, *BPE),
    "quality": lambda d: pu_quality.score(d, pu_quality.train(d, d.select("doc_id", F.lit(1).alias("quality")))),
    "join": lambda d: parity_join.similar_documents(d),
    "mix": lambda d: mixing.mix(d),
    "frames": lambda d: token_frames.write_and_read(d, P.path("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows(spark, name):
    d = odd_docs(spark)
    assert RUNS[name](d).count() == 9
    assert RUNS[name](d.where("false")).count() == 0


def test_odd_rows_in_order(spark):
    got = multiset_hash.edited_likeness(odd_docs(spark)).select("doc_id", "n_chars").collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got)[-2:] == [("None", 0), ("None", 15)]
    joined = {(r["doc_id"], r["component_id"]) for r in parity_join.similar_documents(odd_docs(spark)).collect()}
    assert joined == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (None, None)}
    kept = parity_join.drop_similar(odd_docs(spark)).select("doc_id").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "4", "5", "6", "None", "None"]


def test_ranges(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("doc_id"))
    bounds = ordering.id_bounds(df, "doc_id", 7)
    got = df.withColumn("b", ordering.bucket(F.col("doc_id"), bounds)).collect()
    assert all(r["b"] == sum(x <= r["doc_id"] for x in bounds) for r in got)
    assert ordering.id_bounds(df.where("false"), "doc_id", 7) == []


def test_pipeline(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] and 4 <= len(corpus_pipeline.STAGES) <= 5
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "token_ids"] and out.count() > 50


def test_pipeline_stages_take_odd_rows(spark, sf):
    import corpus_pipeline

    d = odd_docs(spark)
    for name in ("rank", "copies", "each_copy", "mixed_id", "mixed_rank", "mixed_size", "text_key", "live_values", "kind", "x", "h2"):
        d = d if name in d.columns else d.withColumn(name, F.lit("x"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, d, sf)
        rows = got.collect()
        assert i == 4 or got.columns == d.columns
        assert stage(spark, d.where("false"), sf).count() == 0
        if i == 1:
            assert len(rows) == 8
        if i == 2:
            assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in d.collect())


def test_warc_prunes_whole_branches(spark, monkeypatch):
    """Of many files one is damaged: only it goes down its tree."""
    pages = spark.range(0, 4000).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat('x', cast(id % 50 as int)) as html")
    monkeypatch.setattr(warc_audit, "RECORDS", 100)
    base = fresh_path(spark, "warc-many")
    manifest = warc_audit.write_archive(pages, base)
    files = manifest.select("part").distinct().count()
    assert files >= 35
    warc_audit.replicate(manifest, base + "-copy", F.expr("page_id in (1500, 1501)"))
    theirs = {r["part"]: warc_audit.unpack_tree(r["tree"]) for r in warc_audit.replica_trees(manifest, base + "-copy").collect()}
    mine = {r["part"]: warc_audit.unpack_tree(r["tree"]) for r in manifest.where("tree is not null").collect()}
    bad = [p for p in mine if mine[p][0] != theirs[p][0]]
    assert len(mine) == files and 1 <= len(bad) <= 2
    assert sum(warc_audit.differing_leaves(mine[p], theirs[p])[1] for p in bad) <= 40
    assert sorted(r["page_id"] for r in warc_audit.audit(manifest, base + "-copy").where("status <> 'ok'").collect()) == [1500, 1501]


def test_null_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(warc_audit, "RECORDS", 50)
    monkeypatch.setattr(token_frames, "DOCUMENTS", 50)
    pages = spark.range(0, 600).selectExpr("if(id < 200, null, id) as page_id", "'u' as url", "repeat('x ', cast(id as int)) as html")
    manifest = warc_audit.write_archive(pages, fresh_path(spark, "warc-null"))
    assert manifest.count() == 600 and max(r["count"] for r in manifest.groupBy("part").count().collect()) < 150
    assert manifest.orderBy("part", "seq").where("page_id is null").agg(F.max("part")).first()[0] < manifest.where("page_id is not null").agg(F.min("part")).first()[0]
    d = pages.selectExpr("page_id as doc_id", "html as text")
    got = token_frames.write_and_read(d, P.path("word_bpe_49k.json")).orderBy("start").collect()
    assert len(got) == 600 and got[0]["start"] == 0
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))
    assert [r["doc_id"] for r in got] == [None] * 200 + list(range(200, 600))


def test_very_long_rows(spark):
    """A URL and a page of a million characters, and repeated ones."""
    long = "http://a.com/" + "x/y" * 300_000
    pages = spark.createDataFrame([(1, long, "<p>" + "z" * 1_000_000), (1, long, "<p>" + "z" * 1_000_000), (2, "http://b.org/es/", "")], "page_id long, url string, html string")
    got = url_lm.judge_urls(pages, queries.URL_RULES).collect()
    assert len(got) == 3 and {len(r["path"]) for r in got if r["page_id"] == 1} == {900_001}
    assert {r["status"] for r in warc_audit.archive_and_audit(pages, F.expr("page_id = 2")).collect()} == {"ok", "corrupt"}


def test_kept_tables_are_removed(spark):
    from tilewright.llm.shared import drop, keep

    df = keep(spark.range(5), "gone")
    files, path = filesystem(df.inputFiles()[0].rpartition("/")[0])
    assert files.get_file_info(path).is_file is False and files.get_file_info(path).type.name == "Directory"
    drop(df)
    assert files.get_file_info(path).type.name == "NotFound"
