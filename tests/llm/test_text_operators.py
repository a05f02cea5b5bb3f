"""Operators on single texts: brute force, exact round trips and held-out accuracy."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmint.llm import bpe, langid, licenses, pii, urlfilter

ODD = ["", None, " ", "\n\n", "a", "é" * 30, "x" * 30000, "Ünï çödé \U0001f600\U00031350 12٣", "nul\0 in\0\0", "it's we'll 'S\x85\x0b  y", "1" * 500 + " " * 40 + "."]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", i) for i, t in enumerate(ODD + ODD[:2])] + [(None, "a null id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_tokens long")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_bpe_as_tiktoken(odd, docs):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (odd.select("doc_id", "text", "n_tokens"), docs.select("doc_id", "text")):
        want = sorted((str(r["doc_id"]), len(i := enc.encode_ordinary(r["text"] or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.collect())
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(df, digests=True).collect())
        assert got == want
    whole = bpe.encode(odd.select("doc_id", "text")).filter("doc_id = 7").first()
    assert bytes(whole["decoded"]).decode() == ODD[7] and whole["ids"] == enc.encode_ordinary(ODD[7])
    assert bpe.encode(odd.limit(0), digests=True).count() == 0


def test_bpe_long_words(spark):
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    for word in (b"ab" * 200, b"a" * 999, bytes(range(97, 123)) * 20):
        short = bpe._encode_long(word, ranks)
        assert b"".join(sorted(ranks, key=ranks.get)[i] for i in short) == word
    assert bpe._encode_long(b"internationalisation", ranks) == bpe.encode_word(b"internationalisation", ranks)


def test_language_held_out(docs):
    learn = docs.filter(~langid.held_out(F.col("doc_id")))
    model = langid.fit(learn)
    got = langid.predict(docs.filter(langid.held_out(F.col("doc_id"))), model)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_language_odd(spark, odd, docs):
    got = {r["doc_id"]: r for r in langid.predict(odd, langid.fit(docs)).collect()}
    for i, t in enumerate(ODD):
        letters = bool(t) and any(map(str.isalpha, t))
        assert (got[i]["lang_pred"] == "und") == (not letters) and (letters or got[i]["score"] == 0)
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.stage(spark, odd, "").columns == odd.columns


def test_language_in_pieces(docs, monkeypatch):
    model = langid.fit(docs.limit(50))
    text = " ".join(r["text"] for r in docs.limit(20).collect())
    whole = sum(len(b) for held in langid._pieces([text]) for b, _ in langid._sparse(held))
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert sum(len(b) for held in langid._pieces([text]) for b, _ in langid._sparse(held)) == whole
    assert model[1].shape[1] == 1 << langid.BITS


def brute_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(spark, odd, docs):
    extra = [(1, "Under the MIT license under the mit LICENSE, cc-by/nc"), (2, "SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND (MIT OR Apache-2.0)"), (3, "under\xa0the mit license")]
    for df in (spark.createDataFrame(extra, "doc_id long, text string"), odd.select("doc_id", "text", "score"), docs.select("doc_id", "text")):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in licenses.scan_licenses(df).collect():
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licenses(texts[r["doc_id"]])
            assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    got = licenses.scan_licenses(spark.createDataFrame(extra, "doc_id long, text string")).filter("doc_id = 2").first()
    assert got["labels"] == "apache-2.0,gpl-2.0-only,mit" and got["restriction"] == 1


def test_licence_expressions():
    value = lambda t: licenses.evaluate(licenses.postfix(t)[0])
    assert (value("MIT"), value("GPL-3.0 OR MIT"), value("GPL-3.0 AND MIT"), value("MIT OR GPL-3.0 AND CC-BY-NC-4.0")) == (0, 0, 2, 0)
    assert value("(MIT OR GPL-3.0) AND CC-BY-NC-4.0") == 3 and value("GPL-2.0 WITH Classpath-exception-2.0") == 1
    for bad in ("", "(MIT", "AND MIT", "MIT OR"):
        assert not licenses.postfix(bad)[1]


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (kind == 0, kind == 1 and all(int(p) < 256 for p in m[0].split(".")), kind == 2 and 14 <= len(digits) <= 19 and luhn, kind == 3 and 10 <= len(digits) <= 15)[kind]:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_personal_data_base(docs):
    texts = [r["text"] for r in docs.collect()] + [t or "" for t in ODD] + [
        "a@b.c@d.e x@@y.z @a.b a@b", "1.2.3.4.5.6.7.8 1.2.3.400 0001.2.3.4 1.2.3", "4111 1111-1111 1111 4111111111111112 4111--1111", "+1 (988) 555-2485 +12 +1-2-3 ++441234567890(",
        "a.b+c@x-y.co.uk, é@x.y", "7" * 300, "1." * 50, "a@b.c.d@e.f",
    ]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t[:80]


def test_personal_data_field(spark, docs, odd):
    model = pii.fit(docs)
    text = "call +1 (988) 555-2485 now. later again (988) 555-2485 thanks"
    df = spark.createDataFrame([(1, text, "x"), (2, "nothing 12 here", "x"), (3, None, "x")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(df, model).collect()}
    assert got[1]["base"] == "phone:5:22" and got[1]["spans"] == "phone:5:22,phone:40:54" and got[2]["spans"] == got[3]["spans"] == ""
    assert pii.find_personal_data(odd, None).filter("base <> spans").count() == 0
    assert pii.fit(docs.limit(0)) is None


def test_messages_make_alike_tokens_agree():
    unary = np.log(np.array([[0.02, 0.98], [0.55, 0.45], [0.5, 0.5]]))
    skip = np.eye(2) * 2.5
    alone, _ = pii.beliefs(unary, [])
    tied, (pairs,) = pii.beliefs(unary, [(np.array([[0, 1]]), skip)])
    assert alone[1].argmax() == 0 and tied[1].argmax() == 1 and np.allclose(tied[2], alone[2])
    # On a tree the marginals are exact.
    joint = np.exp(unary[0][:, None] + unary[1][None, :] + skip)
    assert np.allclose(pairs[0], joint / joint.sum(), atol=1e-3) and np.allclose(tied[1], (joint / joint.sum()).sum(axis=0), atol=1e-3)


def test_messages_go_along_a_document():
    """A hundred mentions of one number: what one of them tells reaches all."""
    text = " x ".join(["555-24850"] * 100)
    spans = pii.tokens(text)
    chain, skip = pii.graph(text, spans)
    unary = np.zeros((100, 2))
    unary[50] = -8, 0
    p, _ = pii.beliefs(unary, [(np.array(skip), np.eye(2) * 3)])
    assert not chain and (p[:, 1] > 0.9).all()


def test_urls(spark):
    model = urlfilter.fit(urlfilter.labelled_urls(spark))
    urls = [None, "no scheme", "http://A.Example.COM/en/71?x", "https://example.com/en/7", "https://m.example.com/en/8#a", "ftp://x.net/de/", "http://example.net/de/8", "http://notexample.net/de/8", "http://x.org?/es/", "http://x.org/es/1", "a://b://c", "http://free-casino-bets.example/", "http://www.meadow.example/", "http://" + "a" * 5000, "http://com/en/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df, model).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 1, 2, 8, 10)] == [("", ""), ("", ""), ("a.example.com", "/en/71"), ("x.org", ""), ("b:", "//c")]
    assert [got[i]["rule"] for i in range(2, 10)] == ["example.com/en/7", "example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "net/de/", None, "org/es/"]
    assert [got[i]["verdict"] for i in (0, 2, 4, 5, 6, 9, 11, 12, 14)] == ["allow", "allow", "block", "allow", "block", "block", "block", "allow", "block"]
    examples = urlfilter.filter_urls(urlfilter.labelled_urls(spark), model, rules=())
    assert examples.filter((F.col("blocked") == 1) != (F.col("verdict") == "block")).count() == 0
