from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import prose
from timberline.llm import bpe_codec, decontaminate, license_scan, lm_score, minhash_dedup, quality_classifier, substring_dedup, url_filter, vp_search, warc_store
from timberline.llm.textkit import split_words

DOCS = "doc_id long, text string"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def in_sql(sql, columns, **tables):
    """Rows of the stated SQL over the given tables, counted."""
    import duckdb

    with duckdb.connect() as db:
        for name, df in tables.items():
            db.register(name, df.toArrow())
        return Counter(db.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


# ------------------------------------------------------------------ words
def test_words_are_split_as_bytes_split():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\té\x1c\xa0") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", None]
    w = split_words(pa.array(texts))
    raw = w.data.tobytes()
    got = [[raw[a:b] for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [(t or "").encode().split() for t in texts]
    flat = [x for g in got for x in g]
    assert len(set(flat)) == len(set(w.hashes().tolist()))


# ------------------------------------------------------------------ licences
def value(said, allowed=license_scan.PERMISSIVE):
    """Python's own parser as the brute-force version: names are looked up, and an
    exception is dropped with its ``with``."""
    names = lambda m: m[0] if m[0] in ("and", "or") else str(m[0].removesuffix("+") in allowed)
    return eval(re.sub(r"[a-z0-9.+-]+", names, re.sub(r" with [a-z0-9.-]+", "", said.lower())))


def test_expressions():
    program, said = license_scan.parse(b"MIT OR (Apache-2.0 AND GPL-2.0 WITH Classpath-exception-2.0) or")
    assert program == ["mit", "apache-2.0", "gpl-2.0", "classpath-exception-2.0", "with", "and", "or"] and said == "mit or ( apache-2.0 and gpl-2.0 with classpath-exception-2.0 )"
    assert license_scan.evaluate(license_scan.parse(b"MIT OR GPL-3.0")[0]) is True and license_scan.evaluate(license_scan.parse(b"MIT AND GPL-3.0")[0]) is False
    for bad in (b"", b"(MIT", b")MIT", b"and MIT", b"prose", b"with MIT"):
        assert license_scan.parse(bad) == ([], "") and license_scan.evaluate([]) is None
    for text, whole in ((b"MIT. The rest of this line, is prose here", "mit"), (b"MIT OR prose", "mit"), (b"MIT Apache-2.0", "mit"), (b"(MIT) -->", "( mit )"), (b"mit with the", "mit"), (b"GPL-2.0+, and", "gpl-2.0+")):
        assert license_scan.parse(text)[1] == whole


def random_expression(rng, depth=0):
    if depth > 3 or rng.random() < 0.4:
        name = rng.choice(["MIT", "GPL-2.0+", "ISC", "LGPL-2.1-only", "Zlib", "GPL-3.0"])
        return name + rng.choice(["", "", " WITH GCC-exception-3.1"])
    inside = f" {rng.choice(['and', 'OR'])} ".join(random_expression(rng, depth + 1) for _ in range(rng.randint(2, 4)))
    return f"({inside})" if rng.random() < 0.6 else inside


def test_expressions_equal_brute_force():
    rng = random.Random(24)
    for _ in range(500):
        said = random_expression(rng)
        program, whole = license_scan.parse(said.encode() + rng.choice([b"", b". Prose", b" as said", b" and", b" (MIT", b" */"]))
        assert whole == " ".join(re.findall(r"[()]|[^ ()]+", said.lower()))
        assert license_scan.evaluate(program) == value(said)
        assert set(license_scan.operands(program)) == {t.removesuffix("+") for t in re.findall(r"[a-z0-9.+-]+", re.sub(r" with \S+", "", whole)) if t not in ("and", "or")}


def test_license_scan(spark, odd):
    rng = random.Random(25)
    texts = ["Under the MIT License. MIT-License", "apache\nLICENSE general public license", "emit license", "// SPDX-License-Identifier: MIT OR Zlib\nint x;", None]
    got = [r.asDict() for r in license_scan.license_scan(docs(spark, texts)).orderBy("doc_id").collect()]
    assert [(g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) for g in got] == [(6, 2, 2, 4, "mit"), (5, 2, 0, 2, "apache,gpl"), (2, 0, None, None, ""), (8, 0, None, None, ""), (0, 0, None, None, "")]
    assert got[3]["labels"] == "mit,zlib" and got[3]["permissive"] is True
    lines = ["SPDX-License-Identifier: MIT. The rest of this line, is prose here", "spdx-license-identifier: unknown", "* SPDX-License-Identifier: (MIT OR GPL-2.0-only) */ x", "SPDX-License-Identifier:", "the MIT license", "SPDX-License-Identifier: LicenseRef-Own.1. and", "SPDX-License-Identifier: MIT WITH MIT"]
    texts += lines + ["\n".join(rng.choice([*lines, "x y", f"SPDX-License-Identifier: {random_expression(rng)}{rng.choice(['', '.', ' text', ')'])}"]) for _ in range(rng.randint(0, 4))) for _ in range(150)]
    texts += [("the MIT license and the Apache License " * 300), lines[0], lines[0]]
    df = docs(spark, texts).unionByName(odd.select("doc_id", "text"))
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive"]
    mine = Counter(tuple(r) for r in license_scan.license_scan(df).select(*columns).collect())
    assert mine == in_sql(license_scan.ORACLE_SQL, columns, documents=df)
    by_text = {r.doc_id: r for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert by_text[5].labels == "mit" and by_text[6].labels == "" and by_text[6].permissive is None and by_text[len(texts) - 3].n_base == 600
    assert license_scan.license_scan(none(spark)).count() == 0
    long = license_scan.scan_text(b"the MIT license and the Apache License " * 50_000)
    assert (long["n_words"], long["n_base"], long["first_word"], long["last_word"]) == (350_000, 100_000, 1, 349_998)


# ------------------------------------------------------------------- vectors
@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (1.5, 0.9)])
def test_nearest(spark, monkeypatch, factor, least):
    monkeypatch.setattr(vp_search, "LEAST_ROWS", 50)
    monkeypatch.setattr(vp_search, "MOST_ROWS", 50)
    monkeypatch.setattr(vp_search, "STREAM_ROWS", 7)  # shards of several tasks
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:160] = x[100]  # a common vector
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(900, None, "z"), (901, [0.0] * 8, "z"), (902, [float("nan")] * 8, "z"), (903, [None] + [1.0] * 7, "z"), (None, [1.0] * 8, "z"), (904, [1.0, 2.0], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in vp_search.vp_search(df, df.where("vec_id % 20 = 0"), 20, factor).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    found = total = 0
    for q in range(0, 900, 20):
        score = vp_search.inner(x.astype(float), x[q].astype(float))
        want = sorted((i for i in range(900) if i != q), key=lambda i: (-score[i], i))[:20]
        mine = [i for _, i, _ in sorted(got[q])]
        found, total = found + len(set(want) & set(mine)), total + 20
        if factor == 1.0:
            assert mine == want and [s for _, _, s in sorted(got[q])] == [score[i] for i in want]
    assert found / total >= least and len(got) == 45
    assert vp_search.vp_search(df.limit(0), df.limit(0)).count() == 0
    asked = df.where("vec_id % 20 = 0")
    assert vp_search.vp_search(df, asked.union(asked), 20, factor).count() == 45 * 20 and vp_search.vp_search(df.limit(5), df.limit(3)).count() == 12


def test_cells_that_cannot_be_nearer_are_not_visited():
    """Of clustered vectors few cells are visited, and the bound never exceeds the truth."""
    rng = np.random.default_rng(29)
    centre = rng.normal(size=(40, 16)) * 5
    x = centre[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.1
    x /= np.sqrt((x**2).sum(1))[:, None]
    norm = float((x**2).sum(1).max()) ** 0.5
    cells = vp_search.Cells.of(x[:1000], 16, norm)
    cell, d = cells.place(vp_search.further(x, norm))
    bounds = {int(c): np.stack([d[cell == c].min(0), d[cell == c].max(0)], 1) for c in np.unique(cell)}
    q, _ = vp_search.asked_points(x[:50], norm)
    low = cells.least_distance(q, bounds)
    true = np.sqrt(((q[:, None, :] - vp_search.further(x, norm)[None]) ** 2).sum(2))
    for c in bounds:
        assert (low[:, c] <= true[:, cell == c].min(1) + 1e-6).all()
    tau = np.sort(true, 1)[:, 20]
    assert len(bounds) >= 8 and (low[:, sorted(bounds)] <= tau[:, None]).mean() < 0.5


@pytest.mark.parametrize("rows_by,query_by", [(1.0, 1e-12), (1e-7, 1e-7), (1e5, 1e5), (1.0, 1e9)])
def test_nearest_is_exact_at_any_scale(rows_by, query_by):
    rng = np.random.default_rng(18)
    x = rng.normal(size=(1500, 16)) * rows_by
    x[rng.permutation(1500)[:300]] = x[3]  # copies, more than k
    ids = rng.permutation(1500)
    asked = np.concatenate([rng.normal(size=(20, 16)) * query_by, x[3:4] / rows_by * query_by])
    got = vp_search.VPTree(x, ids, float((x**2).sum(1).max()) ** 0.5).search(asked, np.arange(-21, 0), 20, 1.0)
    for i, q in enumerate(asked):
        score = vp_search.inner(x, q)
        want = np.lexsort((ids, -score))[:20]
        mine = got[0] == i - 21
        assert got[1][mine].tolist() == ids[want].tolist() and got[2][mine].tolist() == score[want].tolist()


# ------------------------------------------------------------------- quality
def test_quality_held_out_accuracy(spark, odd):
    rng = random.Random(6)
    good = [prose(rng, rng.randint(5, 200)) for _ in range(200)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, rng.randint(20, 100)).split()) for _ in range(100)]
    texts = good + bad
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_classifier(docs(spark, texts), labels).collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == int(r.doc_id < 200) for r in out) / len(out) >= 0.97
    assert quality_classifier.quality_classifier(odd, labels).count() == odd.count()
    kept = quality_classifier.keep_good(odd, labels)
    assert kept.columns == odd.columns
    alone = quality_classifier.quality_classifier(docs(spark, texts[:3]), labels.limit(0)).collect()
    assert {r.score for r in alone} == {0.5} and quality_classifier.quality_classifier(none(spark), labels).count() == 0


# ------------------------------------------------------------------ substrings
def test_substrings_equal_brute_force(spark, odd):
    rng = random.Random(7)
    passages = [prose(rng, n) for n in (34, 35, 36, 60, 200)]
    texts = [" ".join(rng.choice([prose(rng, rng.randint(0, 50)), rng.choice(passages)]) for _ in range(rng.randint(0, 5))) for _ in range(150)]
    base = prose(rng, 300).split()
    for _ in range(30):  # near copies, whose factors end anywhere
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(300)] = rng.choice("xyz")
        texts.append(" ".join(w[rng.randint(0, 50) :]))
    texts += ["ab " * 100, None, "", texts[0], texts[0], "q " * 35]
    got = substring_dedup.digests(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == substring_dedup.brute_force(texts)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(odd).collect())
    rows = odd.select("doc_id", "text").collect()
    assert got == Counter((r.doc_id, *x) for r, x in zip(rows, substring_dedup.brute_force([r.text for r in rows])))
    cut = substring_dedup.cut_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count() and substring_dedup.digests(none(spark)).count() == 0


def test_factors_are_copies_and_the_parse_is_greedy(spark):
    """Each factor's words stand at its source, which is another place; a document that
    is pieced together has one factor for each piece."""
    rng = random.Random(31)
    sources = [prose(rng, 400).split() for _ in range(4)]
    sources[3][200:260] = sources[3][100:160]  # a document's own repeat
    made = sources[0][20:120] + sources[1][100:190] + prose(rng, 12).split() + sources[2][5:340] + ["z"] + sources[3][:34]
    texts = [" ".join(w) for w in (*sources, made)]
    scratch = substring_dedup.Scratch(spark, "test")
    df = docs(spark, texts)
    rid = {r._rid: r._text.split() for r in substring_dedup._keyed(df).collect()}
    got = {}
    for r in substring_dedup.indexed_places(df, scratch).collect():
        columns = [np.array([getattr(p, c) for p in r.places]) for c in ("start", "windows", "source", "there")]
        got[r.rid] = substring_dedup.factors(*columns)
        for at, size, source, there in got[r.rid]:
            assert size >= 35 and (source, there) != (r.rid, at) and rid[r.rid][at : at + size] == rid[source][there : there + size]
    (mine,) = (f for i, f in got.items() if rid[i] == made)
    assert [(at, size) for at, size, _, _ in mine] == [(0, 100), (100, 90), (202, 335)]


def test_anchors_of_long_slices_go_piece_by_piece():
    gram = np.random.default_rng(32).integers(0, 50, 500, dtype=np.uint64) << np.uint64(40)
    assert (substring_dedup._anchors(gram, 64) == substring_dedup._anchors(gram)).all()


# ------------------------------------------------------------------------ URLs
def test_urls(spark):
    urls = ["http://a.com/en/1", "https://EXAMPLE.com/en/76?x", "http://command/en/", "http://x.net/de/8", "http://q.example.net/de/8", "ftp://o.org/es/", None, "no scheme", "http://com/en", "http://a.co/ads/1", "http://h?x://b.com/en/"]
    df = spark.createDataFrame([(i, u, "w") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df).orderBy("page_id").collect()]
    assert got == [
        ("a.com", "/en/1", "com/en/", "block"), ("example.com", "/en/76", "example.com/en/7", "allow"), ("command", "/en/", None, "allow"),
        ("x.net", "/de/8", "net/de/", "block"), ("q.example.net", "/de/8", "example.net/de/8", "block"), ("o.org", "/es/", "org/es/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("com", "/en", None, "allow"), ("a.co", "/ads/1", None, "block"), ("h", "", None, "allow"),
    ]
    assert url_filter.url_filter(df.limit(0)).count() == 0


def test_long_rule_lists_equal_brute_force(spark, monkeypatch):
    rng = random.Random(26)
    host = lambda: ".".join(rng.choice(["a", "bb", "shop", "x-y", "news"]) for _ in range(rng.randint(1, 3))) + rng.choice([".com", ".net", ""])
    path = lambda: "".join("/" + rng.choice(["en", "de", "a.b", "q7", "Ads"]) for _ in range(rng.randint(0, 4))) + rng.choice(["", "/", "/7"])
    stated = {}
    while len(stated) < 400:
        h, p = host(), path()
        stated[h + p] = url_filter.Rule(rng.choice(["allow", "block"]), h, p)
    rules = tuple(stated.values())
    urls = [f"http://{host()}{path()}{rng.choice(['', '?u=/en/', '#f'])}" for _ in range(2000)] + [None, "", "x", "http://a.com/en/" + "en/" * 50_000, "http://shop.com/banner/x"] * 2
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string").repartition(3)

    def best(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(((len(r.name), r.name, r.verdict) for r in fits), default=(0, None, "allow"))[1:]

    runs = []
    for most in (256, 1000):
        monkeypatch.setattr(url_filter, "MOST_LITERALS", most)
        runs.append({r.page_id: r for r in url_filter.url_filter(df, rules=rules).collect()})
    monkeypatch.setattr(url_filter, "MOST_LITERALS", 256)
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    runs.append({r.page_id: r for r in url_filter.url_filter(df, rules=rules).collect()})
    for got in runs:
        assert got == runs[0] and len(got) == len(urls)
        for r in got.values():
            rule, verdict = best(r.host, r.path)
            assert r.rule == rule and (r.verdict == verdict if rule else r.verdict == ("block" if r.method_rule else "allow"))
    columns = ["page_id", "host", "path", "rule", "verdict", "method_rule"]
    assert Counter(tuple(r) for r in url_filter.url_filter(df).select(*columns).collect()) == in_sql(url_filter.ORACLE_SQL, columns, pages=df)
    bare = spark.createDataFrame([("block", "", "/", "", [])], url_filter.RULE_FIELDS)
    with pytest.raises(Exception, match="literal token"):
        url_filter.url_filter(df, rules=bare).collect()


# -------------------------------------------------------------- language model
def test_lm_base_equals_brute_force(spark, odd):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 80)).title() for _ in range(120)] + ["", None, "unseen-word"]
    got = {r.doc_id: r for r in lm_score.lm_scores(docs(spark, texts)).collect()}
    tokens = {i: (t or "").lower().encode().split() + [None] for i, t in enumerate(texts)}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1}
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score < 0
    assert lm_score.lm_scores(odd).count() == odd.count() and lm_score.lm_scores(none(spark)).count() == 0


def test_lm_score_equals_brute_force(spark, monkeypatch):
    """Counts by dictionaries, the weights from them, and the mixture word by word;
    with many chunks."""
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 2000)
    rng = random.Random(27)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(300)]
    texts += texts[:40] + ["", None]
    got = {r.doc_id: r for r in lm_score.lm_scores(docs(spark, texts).repartition(5)).collect()}
    code = {i: zlib.crc32(str(i).encode()) for i in range(len(texts))}
    train = {i for i in code if code[i] % 5 != 1}
    deleted = {i for i in train if code[i] // 5 % lm_score.DELETED_FOLDS == 0}
    said = {i: ["<", *(t or "").split(), ">"] for i, t in enumerate(texts)}

    def counts(ids):
        return Counter(w for i in ids for w in said[i]), Counter(p for i in ids for p in zip(said[i], said[i][1:]))

    words, pairs = counts(train)
    rest_words, rest_pairs = counts(train - deleted)
    n, v = sum(words.values()) - words["<"], len(words) - 1
    rest_n = sum(rest_words.values()) - rest_words["<"]
    cells = Counter()
    for i in deleted:
        for h, w in zip(said[i], said[i][1:]):
            c = rest_words[h]
            two = rest_pairs[h, w] / c if c else 0.0
            cells[int(lm_score.context_bucket(np.array([c]))[0]), int(lm_score._bin(np.array([two]))[0]), int(lm_score._bin(np.array([rest_words[w] / rest_n]))[0])] += 1
    weights = lm_score.learn_weights(sorted((*k, m) for k, m in cells.items()), 1 / (v + 1))
    for i in said:
        total = 0.0
        for h, w in zip(said[i], said[i][1:]):
            a, b, g = weights[int(lm_score.context_bucket(np.array([words[h]]))[0])]
            total += np.log10(a * (pairs[h, w] / words[h] if words[h] else 0.0) + b * words[w] / n + g / (v + 1))
        assert got[i].score == pytest.approx(total, rel=1e-9)


@pytest.mark.parametrize("entries", [20, 100, 1000])
def test_lm_totals_pass_32_bits_in_slices(monkeypatch, entries):
    monkeypatch.setattr(lm_score, "SLICE_ENTRIES", entries)
    h = np.sort(np.random.default_rng(3).integers((1 << 64) - (1 << 62), 1 << 64, 99, dtype=np.uint64, endpoint=False))
    many = np.full((99, 2), 2**32 - 1, np.uint32)
    rows = [(3, 0, k, 7, lm_score.planes(h), lm_score.planes(many.reshape(-1))) for k in range(3)]
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), lm_score._ASK)], schema=lm_score._ASK)
    summed = lm_score._sum_range(2)(table)
    assert (lm_score._totals(summed.filter(pa.compute.equal(summed["chunk"], 1)), 0, 99, 7) == 3 * (2**32 - 1)).all()
    assert len(set(summed["slice"].to_pylist())) == max(1, -(-297 // entries))


def test_lm_mixture_sums_to_one_and_em_improves():
    rng = np.random.default_rng(0)
    words, seq = 30, rng.integers(0, 30, 3000)
    pair, ctx, uni = Counter(zip(seq, seq[1:])), Counter(seq[:-1]), Counter(seq[1:])
    weights = np.tile([0.5, 0.4, 0.1], (lm_score.CONTEXT_BUCKETS, 1))
    n = sum(uni.values())
    _, p = lm_score.token_scores(np.array([uni[w] for w in range(words)] + [0]), np.array([pair[0, w] for w in range(words)] + [0]), np.full(words + 1, ctx[0]), n, words, weights)
    assert (10**p).sum() == pytest.approx(1.0)
    learned = lm_score.learn_weights([(5, 0, 40, 10), (5, 90, 60, 500)], 1e-3)
    assert learned[5].sum() == pytest.approx(1) and learned[5][0] > 0.5


# ------------------------------------------------------------------------ WARC
def test_warc(spark, tmp_path):
    big, small = "p" * 5000, "s" * 10
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, small), (4, "u", small), (5, "u", None), (6, "u", "é" * 600), (None, "u", "z" * 2000), (9, "u", big), (6, "u", "é" * 600), (10, "u", "v" * 3_000_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_store.warc_round_trip(df).collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        want.append((i or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if h == big and i != 9 else "response", 9 if h == big and i != 9 else None))
    assert got == sorted(want, key=lambda x: x[:4])
    assert warc_store.warc_round_trip(df.limit(0)).count() == 0


def test_normaliser_takes_many_members_and_tells_cut_files():
    import gzip
    import io

    records = [b"".join(warc_store.record_blocks(i, "u", bytes([65 + i]) * i * 100_000, None)) for i in range(20)]
    whole = gzip.compress(b"".join(records[:9])) + gzip.compress(b"".join(records[9:]))
    out = io.BytesIO()
    index = list(warc_store.normalise_archive(io.BytesIO(whole), out))
    places = [(e["offset"], e["length"]) for e in index]
    assert [b"".join(r) for r in warc_store.read_members(out, places)] == records
    assert [warc_store.read_record(r)["payload_bytes"] for r in warc_store.read_members(out, places)] == [i * 100_000 for i in range(20)]
    assert max(len(b) for b in warc_store.inflated(io.BytesIO(whole))) <= warc_store.BLOCK
    joined = b"".join(records)
    assert [k for k, _ in warc_store.record_events(joined[i : i + 7] for i in range(0, len(joined), 7))].count("end") == 20
    for bad in (joined[:-3], joined + b"x", records[3][:-4] + b"abcd"):
        with pytest.raises(ValueError):
            list(warc_store.record_events(iter([bad])))


def test_warc_folder_without_a_scheme_is_the_file_systems(spark, tmp_path):
    assert warc_store.qualified(spark, f"{tmp_path}/a") == f"file://{tmp_path}/a" == warc_store.qualified(spark, f"file:{tmp_path}/a")


# ------------------------------------------------------------- decontamination
def test_benchmark_items_are_found_with_edits(spark, odd):
    rng = random.Random(9)
    items = [prose(rng, n) for n in range(15, 60)]
    texts, want = [], set()
    for i, item in enumerate(items):
        w = item.split()
        for k in rng.sample(range(len(w)), int(0.15 * len(w)) if i % 2 else 0):
            w[k] = "edited"
        if i % 4 == 3:
            w.insert(3, "inserted")
        texts.append(prose(rng, 100) + ". " + " ".join(w).title() + "! " + prose(rng, 100))
        want.add((i, i))
    texts += [prose(rng, 300) for _ in range(50)] + [" ".join(items[0].split()[:6])]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "?!"), (None, "abc")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs(spark, texts), bench).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    clean = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns and decontaminate.drop_contaminated(odd, bench).count() == odd.count()
    assert decontaminate.contaminations(odd, bench.limit(0)).count() == 0 and decontaminate.contaminations(none(spark), bench).count() == 0


def item_words(texts):
    return split_words(pa.array(texts, pa.string()), lower=True, breaks=decontaminate.WORD_BREAKS)


def test_texts_shorter_than_a_seed_hold_no_item():
    items = decontaminate.prepare([1, 2], [prose(random.Random(14), n) for n in (15, 40)])
    for texts in (["word"], ["two words"], ["one", None, ""], [None]):
        assert decontaminate.find(item_words(texts), items) == []


def recall_of_edited_copies(items, sizes, per_size=40):
    """Found shares by size, of copies with substitutions, insertions and deletions at the threshold."""
    rng, out = random.Random(15), {}
    for n in sizes:
        mine = [i for i, t in enumerate(items) if len(t.split()) == n][:per_size]
        texts = []
        for i in mine:
            w = items[i].split()
            for k in sorted(rng.sample(range(n), decontaminate.edits_allowed(n)), reverse=True):
                w[k : k + 1] = rng.choice([["edited"], [], [w[k], "inserted"]])
            texts.append(prose(rng, 30) + " " + " ".join(w) + " " + prose(rng, 30))
        made = decontaminate.prepare(list(range(len(items))), items)
        got = {(r, made.ids[i].as_py()) for r, i, *_ in decontaminate.find(item_words(texts), made)}
        out[n] = sum((r, i) in got for r, i in enumerate(mine)) / len(mine)
    return out


def test_short_items_hide_no_misses_of_long_ones(monkeypatch):
    rng = random.Random(16)
    items = [prose(rng, 3) for _ in range(2100)] + [prose(rng, n) for n in (20, 55) for _ in range(40)]
    assert min(recall_of_edited_copies(items, (20, 55)).values()) >= 0.95
    monkeypatch.setattr(decontaminate, "MAX_REPEATS", 1)  # too few: windows are verified without keys
    assert min(recall_of_edited_copies(items, (20, 55)).values()) == 1.0


def least_edits(item, text):
    """Edit distance of the item to the nearest part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("part", [1 << 18, 5])
def test_items_equal_an_exhaustive_search(monkeypatch, part):
    monkeypatch.setattr(decontaminate, "PART_WINDOWS", part)
    rng = random.Random(28)
    common = prose(rng, 6)
    items = [prose(rng, rng.randint(1, 45)) for _ in range(25)] + [f"{common} {prose(rng, 20)}" for _ in range(15)]
    texts = ["", "one", common, prose(rng, 60)]
    for k in range(80):
        w = rng.choice(items).split()
        for i in sorted(rng.sample(range(len(w)), min(len(w), rng.randint(0, int(0.3 * len(w)) + 1))), reverse=True):
            w[i : i + 1] = rng.choice([["edited"], [], [w[i], "inserted"]])
        texts.append(f"{prose(rng, rng.randint(0, 20))} {' '.join(w)} {common} {prose(rng, rng.randint(0, 20))}")
    made = decontaminate.prepare(list(range(len(items))), items)
    got = {(r, made.ids[i].as_py()): d for r, i, _, _, d in decontaminate.find(item_words(texts), made)}
    want = {}
    for r, t in enumerate(texts):
        for i, item in enumerate(items):
            d = least_edits(item.split(), t.split())
            if d <= decontaminate.edits_allowed(len(item.split())):
                want[r, i] = d
    assert set(got) <= set(want) and all(want[k] <= d for k, d in got.items())
    assert len(want) > 60 and len(got) >= 0.98 * len(want)


def test_items_without_an_id_are_found(spark):
    rng = random.Random(17)
    item, other = prose(rng, 20), prose(rng, 25)
    df = docs(spark, [f"a {item} b", other, prose(rng, 50)])
    bench = spark.createDataFrame([(None, item), (None, None), (None, "?!"), (3, other)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminations(df, bench).collect()} == {(0, None), (1, 3)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()] == [2]


# ------------------------------------------------------------------------ BPE
def test_bpe_equals_the_tokenizer(spark, odd):
    rng = random.Random(10)
    made = bpe_codec.codec(bpe_codec.vocabulary_path())
    texts = [prose(rng, 400) for _ in range(5)] * 3 + ["".join(rng.choice("aB1 \n\té́😀'sß.,<|>x\xa0\x85") for _ in range(5000)) for _ in range(20)]
    texts += ["<|startoftext|>A<|ENDOFTEXT|> b", "it's we'll A.B,C!! x1,y2...z", "", None, "Σίσυφος ΣΑΣ " * 99, "a" * 5000]
    rows = {r.doc_id: r for r in bpe_codec.bpe_encode(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = made.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert list(rows[i].ids) == ids and rows[i].n_tokens == len(ids)
        assert rows[i].decoded == made.tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe_codec.bpe_encode(odd, with_ids=False).count() == odd.count() and bpe_codec.bpe_encode(none(spark)).count() == 0


@pytest.mark.parametrize("most", [40, 8_000])
def test_chunks_are_reused_and_joins_agree(monkeypatch, most):
    """Slices that share passages at any offset, through stores that overflow or don't."""
    monkeypatch.setattr(bpe_codec, "MAX_CHUNKS", most)
    monkeypatch.setattr(bpe_codec, "MAX_WORDS", 10 * most)
    rng = random.Random(30)
    made = bpe_codec.Codec(bpe_codec.vocabulary_path())
    passages = [prose(rng, 600).replace(" b", ", b").replace(" k", ".\nK") for _ in range(3)] + ["".join(rng.choice("aB1 \té,.'") for _ in range(6000))]
    chunks = 0
    for _ in range(12):
        texts = ["".join(p[rng.randint(0, 40) :] + rng.choice(["", " ", "x", ",", "é"]) for p in rng.sample(passages, 3)) for _ in range(8)] + ["", passages[0]]
        data, at = bpe_codec.column_bytes(pa.array(texts))
        chunks += len(bpe_codec.chunk_ends(data, at))
        for t, ids, decoded in zip(texts, *made.encode(data, at)):
            want = made.tokenizer.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == made.tokenizer.decode(want, skip_special_tokens=False)
    assert made.encoded_chunks < chunks * (0.15 if most > 1000 else 0.9)


# -------------------------------------------------------------- near duplicates
def hashed_words(texts):
    words = split_words(pa.array(texts, pa.string()))
    low = (words.hashes() >> np.uint64(32)).astype(np.uint32)
    return [low[i:j] for i, j in zip(words.first[:-1], words.first[1:])]


def classes(texts, threshold=minhash_dedup.THRESHOLD):
    rows = hashed_words(texts)
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or minhash_dedup.similarity(rows[i], rows[j]) >= threshold:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark, monkeypatch, odd):
    monkeypatch.setattr(minhash_dedup, "SMALL", 2)
    monkeypatch.setattr(minhash_dedup, "BLOCK_WORDS", 500)
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    base = prose(rng, 150).split()
    for _ in range(60):  # a group in which not all are linked with all
        w = list(base)
        for k in rng.sample(range(150), rng.randint(0, 6)):
            w[k] = rng.choice(["x", "y", "z"])
        texts.append(" ".join(w))
    texts += [texts[0]] * 20 + ["", None, "a b", "a b", "one two three four five"]
    from timberline.llm import components

    monkeypatch.setattr(components, "FEW_EDGES", 20)
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)
    kept = {r.doc_id for r in minhash_dedup.keep_one_each(docs(spark, texts)).collect()}
    assert kept == set(got.values())
    kept = minhash_dedup.keep_one_each(odd)
    assert kept.columns == odd.columns and minhash_dedup.near_duplicates(odd).count() == odd.count()
    assert kept.where("doc_id in (6, 7)").count() == 1 and minhash_dedup.near_duplicates(none(spark)).count() == 0


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_equal_union_find(spark, tmp_path, monkeypatch, few):
    from timberline.llm import components
    from timberline.llm.scratch import Scratch

    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = random.Random(35)
    pairs = [(k, k + 1) for k in range(0, 40)] + [tuple(rng.sample(range(50, 120), 2)) for _ in range(45)] + [(200, k) for k in range(201, 240)]
    up = {n: n for p in pairs for n in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    edges = spark.createDataFrame(pairs + pairs[:5], "a long, b long")
    got = components.connected_components(edges, Scratch(spark, "cc")).collect()
    assert len(got) == len(up) and {r.node: r.label for r in got} == up
    assert components.connected_components(edges.limit(0), Scratch(spark, "cc")).count() == 0


def test_components_join_the_links_of_a_group_once(spark, monkeypatch):
    from timberline.llm import components
    from timberline.llm.scratch import Scratch

    monkeypatch.setattr(components, "FEW_EDGES", 20)
    rng = random.Random(21)
    nodes = rng.sample(range(1 << 40), 1200)
    pairs = {(a, b) for g in range(3) for a in nodes[g * 300 : g * 300 + 300] for b in rng.sample(nodes[g * 300 : g * 300 + 300], 8) if a != b}
    pairs |= {(a, b) for a, b in zip(nodes[900:], nodes[901:])}  # a path
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    scratch = Scratch(spark, "cc")
    edges = scratch.save(spark.createDataFrame(sorted(pairs), "a long, b long"), "edges")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = {r.node: r.label for r in components.connected_components(edges, scratch).collect()}
    assert got == {x: top(x) for x in up}
    made = 0
    for k in range(before, store.executionsCount()):
        run = store.executionsList(k, 1).apply(0).executionId()
        told, plan = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (plan.apply(i) for i in range(plan.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and told.contains(m.accumulatorId()):
                    made += int(told.apply(m.accumulatorId()).replace(",", ""))
    assert len(pairs) < made < 4 * len(pairs)


def test_unlike_texts_stay_under_no_id_and_under_one_id(spark):
    rng = random.Random(13)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [(None, a), (None, a + " tail"), (None, b), (7, c), (7, d), (7, d), (8, e), (None, e)]
    df = spark.createDataFrame(rows, DOCS)
    kept = sorted(((r.doc_id or 0, r.text) for r in minhash_dedup.keep_one_each(df).collect()))
    assert len(kept) == 5 and (0, b) in kept and {(7, c), (7, d), (8, e)} < set(kept) and ((0, a) in kept) != ((0, a + " tail") in kept)
    labels = defaultdict(set)
    for r in minhash_dedup.near_duplicates(df).collect():
        labels[r.label].add((r.class_id, r.node))
    assert sorted((len(x), *{i or 0 for i, _ in x}) for x in labels.values()) == [(1, 0), (1, 7), (1, 7), (1, 8), (2, 0)]


def test_alignment_is_sensitive_to_order():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, 400).astype(np.uint32)
    assert minhash_dedup.similarity(a, a) == 1 and minhash_dedup.similarity(a, np.concatenate([a[200:], a[:200]])) < minhash_dedup.THRESHOLD
    b = np.delete(a, [5, 50, 300])
    assert minhash_dedup.similarity(a, b) == pytest.approx(397 / 400)
    same = np.zeros(3000, np.uint32)
    assert minhash_dedup.similarity(same, same[:2900]) == pytest.approx(2900 / 3000)


def test_alignment_equals_the_full_table():
    def table(a, b, band):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j] + 1 if x == y and abs(i - j) <= band else 0, row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(21)
    for t in range(400):
        v = rng.randint(1, 12)
        a = [rng.randrange(v) for _ in range(rng.randint(1, 150))]
        b = list(a) if t % 2 else [rng.randrange(v) for _ in range(rng.randint(1, 150))]
        for _ in range(rng.randint(0, 20)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[b[k], rng.randrange(v)], [rng.randrange(v)], [] if len(b) > 1 else [0]])
        band = abs(len(a) - len(b)) + rng.randint(0, 30)
        assert minhash_dedup.aligned(np.array(a, np.uint32), np.array(b, np.uint32), band) == table(a, b, band)


def test_recall_of_near_copies_against_all_pairs(spark):
    """Pairs with up to a fifth of their words changed, whose alignment reaches 0.8."""
    rng = random.Random(22)
    texts = []
    for k in range(300):
        w = prose(rng, rng.randint(50, 300)).split()
        texts.append(" ".join(w))
        for i in rng.sample(range(len(w)), int(len(w) * 0.2 * (k % 10 + 1) / 10)):
            w[i] = f"new{rng.random()}"
        texts.append(" ".join(w))
    rows = hashed_words(texts)
    linked = [k for k in range(0, 600, 2) if minhash_dedup.similarity(rows[k], rows[k + 1]) >= minhash_dedup.THRESHOLD]
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs(spark, texts)).collect()}
    found = [got[k] == got[k + 1] for k in linked]
    assert len(linked) == 300 and sum(found) / len(found) >= 0.9
    assert all(got[k] in (k, k - 1) for k in got)  # nothing else is linked


def test_links_of_a_large_class_grow_with_its_texts():
    rng = random.Random(23)
    base = prose(rng, 60).split()
    rows = []
    for k in range(1500):
        w = list(base)
        for i in rng.sample(range(60), 6):
            w[i] = f"x{rng.randrange(40)}"
        rows.append({"node": b"%05d" % k, "label": b"%05d" % k, "words": hashed_words([" ".join(w)])[0].tobytes()})
    other = [{"node": b"y%d" % k, "label": b"y", "words": hashed_words([prose(rng, 60)])[0].tobytes()} for k in range(50)]
    kind = pa.list_(pa.struct([("node", pa.binary()), ("label", pa.binary()), ("words", pa.binary())]))
    for x, y in ((rows, rows), (rows[:700], rows[700:] + other)):
        (found,) = minhash_dedup._compare_blocks(iter([pa.RecordBatch.from_arrays([pa.array([x], kind), pa.array([y], kind)], names=["x", "y"])]))
        assert 0 < found.num_rows < len({r["label"] for r in x + y})


# ------------------------------------------------------------------- pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    good = [prose(rng, 120) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 80).split()) for _ in range(40)]
    passage, item = prose(rng, 60), prose(rng, 30)
    texts = good + bad + [good[0], good[1] + " tail", good[2] + " " + item, prose(rng, 80) + " " + passage, prose(rng, 80) + " " + passage]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = set(range(60, 100)) | {100, 101, 102}
    assert set(got) == set(range(105)) - gone
    made = bpe_codec.codec(bpe_codec.vocabulary_path())
    cut = " ".join(texts[103].split()[:80])
    assert got[103].n_tokens == len(made.tokenizer.encode(cut, add_special_tokens=False).ids)


def write_tables(spark, folder, documents, labels, benchmark):
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage by a plain version: every text is scored, all pairs are aligned, all
    windows counted, all places tried, and the tokenizer is asked itself."""
    import corpus_pipeline

    rng = random.Random(33)
    good = [prose(rng, rng.randint(30, 160)) for _ in range(70)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, rng.randint(30, 90)).split()) for _ in range(40)]
    passages, items = [prose(rng, n) for n in (36, 60, 90)], [prose(rng, n) for n in (3, 18, 40)]
    texts = good + bad
    for k in range(30):  # near copies
        w = rng.choice(good).split()
        for i in rng.sample(range(len(w)), len(w) // 20):
            w[i] = f"other{k}"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, rng.randint(40, 70))}\n{rng.choice(passages)} {prose(rng, rng.randint(40, 70))}" for _ in range(12)]
    for item in items:
        w = item.split()
        texts.append(f"{prose(rng, 50)} {' '.join(w)} {prose(rng, 40)}")
        texts.append(f"{prose(rng, 50)} {' '.join(w[: len(w) // 2] + ['put'] * (len(w) > 5) + w[len(w) // 2 :])} {prose(rng, 40)}")
    texts += ["", None, "A, b! <|endoftext|>", texts[0]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(i < 70), 0) for i in range(110)]
    write_tables(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), labels, list(enumerate(items)))

    learned = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    model = quality_classifier.fit([(texts[i].encode(), q) for i, q in learned], sum(q for _, q in learned) / len(learned))
    a, b = quality_classifier._compressor(model.good), quality_classifier._compressor(model.bad)
    left = {i: t or "" for i, t in enumerate(texts) if model.score(quality_classifier.difference((t or "").encode(), a, b, model.prior)) >= 0.7}
    ids = list(left)
    left = {ids[k]: left[ids[k]] for k, top in enumerate(classes([left[i] for i in ids])) if k == top}
    count = Counter(tuple(w[i : i + 35]) for w in (t.encode().split() for t in left.values()) for i in range(len(w) - 34))
    for k, t in left.items():
        w = t.encode().split()
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        left[k] = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else t
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    holds = lambda t: any(least_edits(split(x), split(t)) <= decontaminate.edits_allowed(len(split(x))) for x in items)
    left = {k: t for k, t in left.items() if not holds(t)}
    made = bpe_codec.codec(bpe_codec.vocabulary_path()).tokenizer
    want = set()
    for k, t in left.items():
        e = made.encode(t, add_special_tokens=False).ids
        want.add((k, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(made.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    got = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == want and 60 < len(want) < 100


def test_pipeline_takes_odd_and_empty_tables(spark, tmp_path, odd):
    import corpus_pipeline

    rng = random.Random(34)
    labels = [(i, i % 2, 0) for i in range(1, 9)]
    write_tables(spark, tmp_path / "odd", odd, labels, [(1, prose(rng, 20)), (None, None)])
    stage = odd
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path / "odd"))
        assert stage.columns == odd.columns
    assert corpus_pipeline.run(spark, str(tmp_path / "odd")).count() <= odd.count()
    write_tables(spark, tmp_path / "none", odd.limit(0), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    write_tables(spark, tmp_path / "bare", odd, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "bare")).count() == 0
