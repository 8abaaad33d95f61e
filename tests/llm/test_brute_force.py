"""The operators that SQL can't express, against slow versions written from their definitions."""

import math
import re

import numpy as np
import pytest

from nearfield.llm import language, learning, quality_model, quality_rules, secrets_scan, simhash, toxicity
from nearfield.llm.queries import queries


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def grams(text):
    low = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower())
    return {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}


@pytest.mark.parametrize("cells", [1 << 25, 3000])
def test_language_is_kernel_ridge_regression(documents, cells, monkeypatch):
    """The kernel and its regression from sets of n-grams, with the landmark matrix whole or in parts."""
    monkeypatch.setattr(language, "DENSE_CELLS", cells)
    rows = sorted((r.text, r.lang) for r in documents.filter("length(text) < 1500").limit(60).collect() if r.lang)
    model = language.fit(rows, landmarks_per_language=3)
    sets = [grams(t) for t, _ in rows]
    marks = [next(i for i, s in enumerate(sets) if len(s) == len(p) and set(language.ngrams(rows[i][0]).tolist()) == set(model.vocabulary[p].tolist())) for p in model.landmarks]
    k = np.array([[len(a & sets[m]) / math.sqrt(len(a) * len(sets[m])) for m in marks] for a in sets])
    y = np.array([[float(lang == x) for x in model.languages] for _, lang in rows])
    weight = 1 / (y @ y.sum(0))
    weight *= len(rows) / weight.sum()
    left = k.T @ (weight[:, None] * k) + language.RIDGE * len(rows) * k[marks] + 1e-8 * np.eye(len(marks))
    want = k @ np.linalg.solve(left, k.T @ (weight[:, None] * y))
    names, scores = language.predict([t for t, _ in rows], model)
    assert names == [model.languages[i] for i in want.argmax(1)]
    assert np.allclose(scores, np.clip(want.max(1), 0, 1), atol=2e-3)


def test_many_languages_are_learned():
    rows = [(f"{chr(0x4E00 + k)}{chr(0x4E01 + k)}{chr(0x4E02 + k)} text", f"lang{k:04d}") for k in range(0, 1500, 3)]
    model = language.fit(rows)
    assert len(model.languages) == 500 and len(model.landmarks) == 500
    assert language.predict([rows[490][0]], model)[0] == [rows[490][1]]


def test_quality_network_is_a_convolution():
    rng = np.random.default_rng(0)
    net = quality_model.ByteNetwork(quality_model.initial(rng))
    p = net.p
    for text in ("", "abc", "Some text, with 123 bytes & marks.\n" * 9, "é" * 70):
        raw = text.encode()
        n = max(1, math.ceil(len(raw) / quality_model.BLOCK)) * quality_model.BLOCK
        codes = [*raw, *[256] * (n + quality_model.TAPS - 1 - len(raw))]
        out = np.array([sum(p["embed"][codes[i + t]] @ p["filters"][t] for t in range(quality_model.TAPS)) for i in range(n)])
        blocks = np.maximum(out.reshape(-1, quality_model.BLOCK, quality_model.FILTERS).max(1) + p["bias"], 0)
        chunks = [np.maximum(blocks[i], blocks[i + 1]) for i in range(len(blocks) - 1)] or [blocks[0]]
        features = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0), [math.log1p(len(blocks)) / 4]])
        logit = np.maximum(features @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"]
        assert math.isclose(net.scores([text])[0], 1 / (1 + math.exp(-logit[0])), rel_tol=1e-4)


def test_toxicity_against_all_terms(spark):
    """Each word held against each term by the table of edits instead of the automaton."""
    from tests.llm.test_models import edits

    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(documents, labels)
    assert model.automaton is not None
    a = model.automaton

    def best(word):
        found = []
        for k, term in enumerate(a.terms):
            lengths = [len(word)] if k < a.n_words else range(max(0, len(term) - 1), min(len(word), len(term) + 1) + 1)
            if abs(len(word) - len(term)) <= 2 or k >= a.n_words:
                found += [(e, k >= a.n_words, k) for n in lengths for e in [edits(word[:n], term)] if e <= a.edits(k)]
        return min(found, default=None)

    words = sorted({w for r in documents.limit(25).collect() for w in toxicity.WORD.findall((r.text or "").lower())})[:400] + ["idoit", "worhtless", "scvm"]
    for w in words:
        got, want = a.match(w), best(w)
        assert (got and got[0]) == (want and want[0]), w
    slow = toxicity.ToxicityModel(a, model.worth, model.weights, model.constant)
    text = "You are a worthless idoit, they said: “stupid moron” and more of it"
    x = slow.features(text)
    hits = [(i, m.start(), m.end(), a.match(m.group())) for i, m in enumerate(toxicity.WORD.finditer(text.lower()))]
    places = [h for h in hits if h[3]]
    strengths, told = [], 0
    for n, (i, s, e, (k_edits, k)) in enumerate(places):
        near = sum(0 < abs(j - i) <= toxicity.CONTEXT for j, *_ in (places[max(0, n - 1) : n] + places[n + 1 : n + 2]))
        reported = any(toxicity.WORD.findall(text.lower())[j] in toxicity.REPORTING for j in range(max(0, i - toxicity.CONTEXT), i))
        quoted = "“" in text[:s] and "”" not in text[:s]
        told += quoted or reported
        worth = model.worth.get((k_edits, k), 0.0)
        strengths.append(worth * (0.4 if quoted or reported else 1) + 0.5 * near * (worth > 0))
    strengths.sort(reverse=True)
    want = [1, strengths[0], sum(strengths[:3]) / 3, math.log1p(sum(v > 1 for v in strengths)), math.log1p(1000 * len(places) / (len(hits) + 20)), told / len(places)]
    assert np.allclose(x, want) and math.isclose(model.score(text), 1 / (1 + math.exp(-float(np.dot(want, model.weights)))), rel_tol=1e-9)


def test_base_spans_and_candidates_against_brute_force(documents):
    texts = [r.text or "" for r in documents.collect()] + ["token=abcdef1 " * 50 + "AKIA" + "A1" * 9, "password: " + "x" * 3, "0123456789abcdef" * 4 + "g"]
    for t in texts:
        want = []
        for m in re.finditer(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?(?=([A-Za-z0-9+/_.=-]+))\1""", t):
            if len(m.group(1)) >= 6 and m.group().isascii():
                want.append((m.start(), 0, m.end()))
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
        base = secrets_scan.base_spans(t)
        assert base == sorted(want)
        free = [m.span() for m in secrets_scan.CANDIDATE.finditer(t) if not any(s < m.end() and m.start() < e for s, _, e in base)]
        assert secrets_scan.candidates(t, base) == free


def test_planted_keys_in_real_texts_are_found(documents):
    """Keys of common formats, drawn anew, at random places of real texts that have no base finding."""
    net = secrets_scan.train(documents)
    rng = np.random.default_rng(77)
    texts = [r.text for r in documents.collect() if r.text and 200 < len(r.text) < 5000 and not secrets_scan.base_spans(r.text)][:120]
    before = secrets_scan.scan(texts, net)
    assert sum(bool(s) for s in before) <= 0.01 * len(texts)
    found = total = 0
    for k, (a, key, b, label) in enumerate(secrets_scan.generated(rng)):
        if label and k < 4 * len(texts) and "/" not in key:
            t = texts[k % len(texts)]
            at = t.find(" ", int(rng.integers(0, len(t))))
            text = t[:at] + " " + a.lstrip() + key + b + t[at:] if at >= 0 else t + " " + key
            start = text.index(key)
            spans = secrets_scan.scan([text], net)[0]
            found += any(s <= start and start + len(key) <= e for s, _, e in spans)
            total += 1
    assert total > 100 and found / total > 0.9, (found, total)


def test_unsure_tokens_teach_nothing():
    key = "Zx9Qw3Er7Ty1Ui5Op0As8Df2Gh6Jk4L"
    texts = [f"some words and {key[k % 20:]}{key[:k % 20]} more" for k in range(400)]
    net = secrets_scan.fit(texts)
    assert sum(bool(s) for s in secrets_scan.scan(texts, net)) >= 0.9 * len(texts)


def test_labels_that_disagree_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e"), (4, None)], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (4, 1)], "doc_id long, y int")
    assert sorted(learning.sample_labelled(docs, known, "y", 10)) == [("a", 1), ("b", 1), ("d", 0)]
    assert learning.sample_labelled(docs, known.limit(0), "y", {1: 3, 0: 3}) == []
    many = spark.range(4000).selectExpr("id AS doc_id", "cast(id % 400 AS string) AS y", "'t' AS text")
    assert len({y for _, y in learning.sample_labelled(many, many, "y", 4)}) > 380


def test_the_order_of_rules_is_stable(documents):
    rules = quality_rules.own_rules(quality_rules.F.col("text"), measures=False)
    same = [quality_rules.Rule(r.name, r.rejects, c, r2) for r, c, r2 in zip(rules, (1.0, 1.1, 0.9, 8.0, 0.001), (0.5, 0.2, 0.1, 0.9, 0.0), strict=True)]
    jitter = [quality_rules.Rule(r.name, r.rejects, r.cost * 1.02, r.rejection) for r in same]
    assert [r.name for r in quality_rules.in_order(same)] == [r.name for r in quality_rules.in_order(jitter)]
    idle = quality_rules.Rule("idle", quality_rules.F.lit(False))
    planned = quality_rules.plan_cascade(documents, [*rules, idle])
    cost = {r.name: r.cost for r in planned}
    assert cost["idle"] < 0.2 * max(cost.values())


def test_components_that_do_not_converge_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError):
        simhash.components(edges, max_rounds=1)


def test_a_hot_key_and_long_texts_are_linked(spark):
    """Many fingerprints under one key, through one DataFrame: none of their links is lost."""
    fps = sorted({int(x) for x in np.random.default_rng(3).integers(0, 1 << 21, 1500)})
    classes = spark.createDataFrame([(f << 43,) if f << 43 < 1 << 63 else ((f << 43) - (1 << 64),) for f in fps], "fp long")
    got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.components(simhash.links(classes, 256)).collect()}
    left, groups = set(fps), []
    while left:
        group, front = set(), [left.pop()]
        while front:
            x = front.pop()
            group.add(x)
            near = {x ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(21) for b in range(21) for c in range(21)} | {x ^ (1 << a) for a in range(21)} | {x ^ (1 << a) ^ (1 << b) for a in range(21) for b in range(21)}
            near &= left
            left -= near
            front += near
        groups.append(group)
    assert sorted(map(len, groups)) == sorted([*np.unique([*got.values()], return_counts=True)[1].tolist(), *[1] * (len(fps) - len(got))])
    long = " ".join(f"w{i}" for i in range(60000))
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, "else")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.link_documents(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {1, 3}


ODD = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "no id, some words of it"), (4, "token = abcdef123456 " * 9), (5, "long words here " * 9000)]


@pytest.mark.parametrize("name", sorted(queries()))
def test_odd_and_empty_tables(spark, tmp_path, name):
    """Nulls, empty, long and repeated rows, and columns with clashing names: a row for each row; none for an empty table."""
    for k, rows in enumerate((ODD, [])):
        at = f"{tmp_path}/{k}"
        df = spark.createDataFrame([(i, t, None, None, None, "x", 1.5, True, 7, [1]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _range string, score double, kept boolean, size int, minima array<int>")
        df.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        assert queries()[name](spark, at).count() == len(rows)
