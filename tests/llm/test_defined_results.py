"""Empty tables, repeated and null ids, clashing names and hard inputs of every operator and stage."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parchmint.llm import bpe, embeddings, jaccard, langid, licenses, linededup, minhash, mixing, pii, urlfilter

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("k", "s", "rank", "row", "whole", "rest", "scale", "last", "below", "want", "more", "at", "size", "u", "d", "t", "pos", "h1", "h2", "salt", "cell", "n", "keys", "words", "block", "shard", "score", "rep", "key", "component", "found", "copies", "h", "kept", "n_lines", "lang_pred")


@pytest.fixture(scope="module")
def clashing(spark):
    """Two alike rows, a null id, a null text; and extra columns with the names that the operators use inside."""
    line = "one line of more than twenty letters"
    rows = [(1, f"{line}\nand more of it", "en", "a", 1), (1, f"{line}\nand more of it", "en", "a", 1), (2, line, "en", "b", 2), (None, line, "en", None, 3), (4, None, None, "a", 4), (5, line + "\nother", "en", "b", 5)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES)).cache()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns(spark, clashing, name, stage):
    got = stage(spark, clashing, "")
    rows = got.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == clashing.columns and rows
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    else:
        assert len(rows) == 6
    assert stage(spark, clashing.limit(0), "").count() == 0


def test_operators_over_clashing_and_empty(spark, clashing):
    model = langid.fit(clashing)
    url = clashing.withColumn("url", F.lit("http://a.example/x"))
    for made in (
        lambda df: langid.predict(df, model), lambda df: licenses.scan_licenses(df), lambda df: linededup.dedup_lines(df), lambda df: mixing.mix_sources(df),
        lambda df: pii.find_personal_data(df, pii.fit(df)), lambda df: bpe.encode(df), lambda df: jaccard.jaccard_components(df), lambda df: minhash.near_duplicates(df),
        lambda df: urlfilter.filter_urls(url.limit(df.count()), urlfilter.fit(urlfilter.labelled_urls(spark))),
    ):
        assert made(clashing).count() == 6
        assert made(clashing.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1.2, "x"), (2, [1.0, 0.0], 1.7, "x"), (3, [1.0, 0.01], 1.2, "x"), (3, [0.0, 1.0], 1.2, "x")], "vec_id long, embedding array<float>, label double, rep string")
    got = sorted((r for r in map(tuple, embeddings.near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept").collect())), key=lambda r: r[:2])
    assert got == [(1, 1, 1, True), (2, 0, 2, True), (3, 0, 3, True), (3, 1, 1, False)]
    assert embeddings.near_vectors(vectors.limit(0)).count() == 0


def test_restriction_has_no_order(spark):
    texts = ["SPDX-License-Identifier: MIT\nalso cc by nc", "SPDX-License-Identifier: (MIT AND", "SPDX-License-Identifier: see file", "SPDX-License-Identifier: GPL-3.0 AND\nall rights reserved", "SPDX-License-Identifier: GPL-3.0 OR MIT"]
    got = [licenses.scan(t, licenses.automaton()) for t in texts]
    assert [(r[5], r[7]) for r in got] == [("cc-by-nc,mit", 3), ("mit", 0), ("", None), ("gpl-3.0,proprietary", 3), ("gpl-3.0,mit", 0)]


def test_ids_are_known_as_a_whole():
    """Versions and marks count, not first letters; what isn't known stays as unknown; prose after a tag isn't an id."""
    tag = "SPDX-License-Identifier: "
    want = {
        "Artistic-2.0": ("artistic-2.0", 0), "NPOSL-3.0": ("nposl-3.0", 3), "GPL-3.0-or-later": ("gpl-3.0-or-later", 2), "LGPL-2.1+": ("lgpl-2.1+", 1), "mitigation": ("unknown:mitigation", 3),
        "bsdiff */": ("unknown:bsdiff", 3), "Public notice": ("", None), "mitigation of risk": ("", None), "MIT OR Foo-1.0": ("mit,unknown:foo-1.0", 0), "GPL-9.0": ("unknown:gpl-9.0", 3), "": ("", None), "LicenseRef-own": ("licenseref-own", 3),
    }
    for text, found in want.items():
        r = licenses.scan(tag + text, licenses.automaton())
        assert (r[5], r[7]) == found and (r[6] > 0) == bool(found[0]), text


@pytest.mark.parametrize("name", ["__text", "__url", "__words", "__plan", "__d", "__f", "__s", "__size", "__row", "__u", "__t", "__bits", "__in_text", "a.b"])
def test_no_name_of_another_column_clashes(spark, name):
    df = spark.createDataFrame([(i, f"http://h{i}.net/a", f"line of some length {i}\nthe very same line for all\na@b.example {i}", "s", f"own {i}") for i in range(4)], "doc_id long, url string, text string, source string, x string")
    df = df.withColumnRenamed("x", name)
    for made in (
        licenses.scan_licenses(df), linededup.dedup_lines(df), mixing.mix_sources(df), pii.find_personal_data(df, None), urlfilter.filter_urls(df, ({}, 0.0)),
    ):
        assert sorted(r[name] for r in made.collect()) == [f"own {i}" for i in range(4)]


def test_bitmaps_hold_what_stays(spark):
    n = 300
    texts = ["\n".join(f"shared line number {j} of all documents" if j in (3, 70, 299) else f"{i} own line number {j} of this one" for j in range(n)) for i in range(4)]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got[3]["keep_bits"] is None and got[3]["kept"] == texts[3]
    for i in range(3):
        assert [(w["word"], ~w["bits"]) for w in got[i]["keep_bits"]] == [(0, 1 << 3), (1, 1 << 6), (4, 1 << 43)]
        assert got[i]["n_dropped"] == 3 and got[i]["kept"] == "\n".join(line for j, line in enumerate(texts[i].split("\n")) if j not in (3, 70, 299))


def test_bpe_in_pieces(spark, monkeypatch):
    """Blocks, pieces of texts and shards of any size give what the library gives."""
    import public_tokenizers
    import tiktoken

    for name, value in (("BLOCK_BYTES", 3000), ("BLOCK_WORDS", 200), ("PIECE", 500), ("TOGETHER", 50)):
        monkeypatch.setattr(bpe, name, value)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in (0, 1, 5, 400, 3, 2000)] + ["a\0b c", "\0", None]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    for r in bpe.encode(df).collect():
        assert r["ids"] == want[r["doc_id"]] and bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode()
    for r in bpe.encode(df, digests=True).collect():
        assert r["ids_sha256"] == hashlib.sha256(np.array(want[r["doc_id"]], "<u4").tobytes()).hexdigest()


def test_jaccard_cells_by_bytes(spark, monkeypatch):
    """Near copies of long texts: cells are bounded by their bytes, parted by pivots or dealt out as chunks."""
    monkeypatch.setattr(jaccard, "CELL_BYTES", 20_000)
    rng = np.random.default_rng(2)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(300)]
        for _ in range(15):
            copy = list(base)
            copy[int(rng.integers(300))] = f"new{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(copy)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 15 for i in range(60)}


def test_language_brute_force(spark):
    """Counts, log probabilities and posteriors as a plain loop over all n-grams gives them."""
    rows = [("the cat and the hat", "en"), ("der hund und die katze", "de"), ("the dog", "en"), ("ein hut", "de"), ("le chat et le chien", "fr")]
    langs, logp = langid.fit(spark.createDataFrame(rows, "text string, lang string"))

    def grams(text):
        codes = [ord(c) for c in " " + re.sub("[^a-zà-ÿ]+", " ", text.lower()) + " "]
        for n in langid.ORDERS:
            for i in range(len(codes) - n + 1):
                h = 0
                for k in range(n):
                    h = ((h ^ codes[i + k]) + k + 1) * 0xD6E8FEB86659FD93 % (1 << 64)
                    h ^= h >> 32
                yield h % (1 << langid.BITS)

    counts = np.full((3, 1 << langid.BITS), langid.ALPHA)
    for text, lang in rows:
        for b in grams(text):
            counts[["de", "en", "fr"].index(lang), b] += 1
    assert langs == ["de", "en", "fr"] and np.allclose(logp, np.log(counts / counts.sum(axis=1, keepdims=True)))
    for r in langid.predict(spark.createDataFrame([("the hut",), ("katze le",)], "text string"), (langs, logp)).collect():
        z = sum(logp[:, b] for b in grams(r["text"]))
        assert r["lang_pred"] == langs[int(z.argmax())]


def test_urls_brute_force(spark, sf_dir):
    """Host, path, rule and score of every page as plain Python gives them."""
    weights, intercept = urlfilter.fit(urlfilter.labelled_urls(spark))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    for r in urlfilter.filter_urls(pages, (weights, intercept)).collect():
        rest = (r["url"] or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path, host = re.match("[^?#]*", rest[len(host) :])[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else "block" if r["score"] >= urlfilter.THRESHOLD else "allow")


def test_added_spans_of_planted_forms(spark):
    """Matches in forms that the patterns miss: most are added, nothing else is. Fitted and judged on different documents."""
    docs = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").collect()]
    model = pii.train(*pii._examples(docs[:6000]))
    hits = wanted = wrong = 0
    for n, text in enumerate(docs[6000:]):
        if not (base := pii.base_spans(text)):
            continue
        text, truth = pii.masked(text, base, 10_000 + n)
        base = pii.base_spans(text)
        added = pii._added([text], [base], model)[0]
        planted = [t for t, known in zip(truth, pii.met([(s, e) for s, _, e in truth], base), strict=True) if not known]
        hits += sum(any(a < e and s < b and k == kind for a, k, b in added) for s, kind, e in planted)
        wrong += sum(not any(a < e and s < b and k == kind for s, kind, e in planted) for a, k, b in added)
        wanted += len(planted)
    print(f"planted {wanted}, found {hits}, wrong {wrong}")
    assert hits >= 0.6 * wanted > 0 and wrong <= 0.05 * hits
    assert sum(map(len, pii._added(docs, [pii.base_spans(t) for t in docs], model))) <= 20


def test_pipeline_against_brute_force(spark, tmp_path):
    """Rows that each stage must keep, from a plain account of lines and shingles; the tokens of what is left."""
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    shared = "this very line stands in many documents"
    rows = [(i, " ".join(words[i * 9 : i * 9 + 60]) + f"\n{shared}", "en", f"s{i % 2}", 0) for i in range(12)]
    rows += [(100, rows[3][1], "en", "s0", 0), (101, rows[3][1].replace("worda", "worda", 1), "en", "s1", 0), (102, "12345 67890", "en", "s0", 0), (103, None, None, "s1", 0)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    lines = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            lines.setdefault(line, set()).add(d)
    kept = {}
    for d, t, *_ in rows:
        if t and any(map(str.isalpha, t)):
            text = "\n".join(x for x in t.split("\n") if len(x) < 20 or len(lines[x] - {102, 103}) < 3 or d == max(lines[x] - {102, 103}))
            if text:
                kept[d] = text
    groups = {}
    for d in sorted(kept):
        groups.setdefault(kept[d], d)
    want = set(groups.values())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= want and len({r["doc_id"] for r in got}) >= 0.5 * len(want)
    for r in got:
        assert r["decoded_sha256"] == hashlib.sha256(kept[r["doc_id"]].encode()).hexdigest()


def test_url_weights_equal_plain_gradient_steps(spark):
    """The regression's weights by numpy: the dual steps over the matrix of common features, and the score of urls from them."""
    rows = urlfilter.parsed(urlfilter.labelled_urls(spark)).select("host", "path", "blocked", urlfilter.features(F.col("host"), F.col("path")).alias("f")).distinct().collect()
    y = np.array([float(r["blocked"]) for r in rows])
    sets = [set(r["f"]) for r in rows]
    norm = np.sqrt([max(len(s), 1) for s in sets])
    gram = np.array([[len(a & b) / (p * q) + 1 for b, q in zip(sets, norm, strict=True)] for a, p in zip(sets, norm, strict=True)])
    a = np.zeros(len(y))
    for _ in range(urlfilter.STEPS):
        a = a * (1 - urlfilter.RATE * urlfilter.PENALTY) + urlfilter.RATE * (y - 1 / (1 + np.exp(-gram @ a)))
    want = {}
    for s, p, c in zip(sets, norm, a, strict=True):
        for b in s:
            want[b] = want.get(b, 0.0) + c / p
    weights, intercept = urlfilter.fit(urlfilter.labelled_urls(spark))
    assert set(weights) == set(want) and all(abs(weights[b] - w) < 1e-9 for b, w in want.items()) and abs(intercept - a.sum()) < 1e-9
    urls = spark.createDataFrame([("http://free-casino.example/x",), ("https://library.example/books",), ("nothing",), (None,)], "url string")
    for r in urlfilter.filter_urls(urls, (weights, intercept)).collect():
        f = urlfilter.parsed(spark.createDataFrame([(r["url"],)], "url string")).select(urlfilter.features(F.col("host"), F.col("path"))).first()[0]
        assert abs(r["score"] - (1 / (1 + np.exp(-(sum(want.get(b, 0.0) for b in f) / np.sqrt(max(len(f), 1)) + a.sum()))) if f else 0.0)) < 1e-9
