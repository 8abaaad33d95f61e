"""Cases in which an operator once did less than the whole job."""

import numpy as np
import pytest

from nearfield.llm import pii, quality_rules, secrets_scan, toxicity


KEY = b"a key of the tests"


@pytest.fixture(scope="module")
def network():
    return secrets_scan.fit([])


def key(n, seed=1):
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    return "".join(letters[i] for i in np.random.default_rng(seed).integers(62, size=n))


def test_long_secrets_and_keys_within_paths_are_found(network):
    token = "eyJ" + key(900) + "." + key(300, 2)
    path = "www.example.com/report/section/chapter/summary/index/" + key(36) + "/table/module/final/release/summary/page1.html"
    harmless = "www.example.com/" + "/".join(["report", "section", "chapter2", "summary"] * 40)
    for secret in (token, path):
        text = f"see {secret} now"
        assert secrets_scan.redact_text(text, secrets_scan.scan([text], network)[0]) == f"see {secrets_scan.MASK} now"
    assert secrets_scan.scan([f"see {harmless} now"], network) == [[]]


def test_windows_cover_a_candidate():
    for n in (16, 40, 41, 60, 61, 1000):
        spans = list(secrets_scan.pieces(5, 5 + n))
        assert set().union(*(range(a, b) for a, b in spans)) == set(range(5, 5 + n)) and all(b - a <= secrets_scan.INSIDE for a, b in spans)


def test_threshold_keeps_the_recall_when_it_binds():
    """A network that learned nothing gives all findings about the share of positives, here far below 0.5."""
    texts = [f"see some-word-{i}-of-many-words" for i in range(6000)]
    net = secrets_scan.fit(texts, epochs=0)
    codes, more, y, of = secrets_scan.labelled_pieces(texts)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    q = np.maximum.reduceat(net.probability(codes, more), first)
    assert np.mean(q[y[first] == 1] >= net.threshold) > secrets_scan.MIN_RECALL - 0.05


def test_sample_is_drawn_from_all_rows(spark, monkeypatch):
    rows = [(i, f"first source {i}") for i in range(600)] + [(i, f"other source {i} token = abcdef{i}") for i in range(600, 900)]
    seen = []
    monkeypatch.setattr(secrets_scan, "fit", seen.extend)
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    secrets_scan.train(table, 100)
    assert len(seen) == 100 and sum("other" in t for t in seen) == 50
    assert len({t for t in seen if "first" in t and int(t.split()[2]) >= 300}) > 10
    seen.clear()
    secrets_scan.train(table.filter("doc_id < 620"), 100)
    assert len(seen) == 100 and sum("other" in t for t in seen) == 20
    seen.clear()
    secrets_scan.train(table.limit(0), 100)
    assert seen == []


def test_names_are_found_whole_and_wherever_they_are_mentioned():
    text = "Mr John Smith paid. Later John Smith's card and SMITH failed; Mr Smith called."
    new = pii.replace(text, KEY)[0]
    smith, john = (pii.surrogate("name", x, KEY) for x in ("Smith", "John"))
    assert new == f"Mr {john} {smith} paid. Later {john} {smith}'s card and {smith.upper()} failed; Mr {smith} called."
    for t, names in (
        ("Mr John Ronald Tolkien spoke", ["John", "Ronald", "Tolkien"]), ("Dr. J. Smith spoke", ["Smith"]), ("Dr. J.R.R. Tolkien spoke", ["Tolkien"]), ("Prof. Dr. Müller spoke", ["Müller"]),
        ("Mr and Mrs Smith spoke", ["Smith"]), ("Frau Prof. Dr. med. Anna von Müller spoke", ["Anna", "Müller"]), ("Mr Don Johnson spoke", ["Don", "Johnson"]), ("Herr von Bülow spoke", ["Bülow"]),
    ):
        new = pii.replace(t, KEY)[0]
        assert not any(n in new.split() for n in names) and len(new) == len(t) and new.endswith(" spoke") and new.split()[0] == t.split()[0], new
    assert pii.replace("Dr. J. Smith", KEY)[0].startswith("Dr. ") and "J." not in pii.replace("Dr. J. Smith", KEY)[0]
    assert [e.value for e in pii.detect("I met Mr Smith. He left. Prof. Dr. The end")] == ["Smith"]


def test_ipv6():
    values = ["2001:db8::8a2e:370:7334", "fe80::1", "2001:0DB8:85A3:0000:0000:8A2E:0370:7334", "::ffff:10.0.0.255"]
    for v in values:
        new, found = pii.replace(f"from {v}, then", KEY)
        assert [(e.kind, e.value) for e, _ in found] == [("ip", v)] and v not in new and pii._valid("ip", found[0][1])
    assert pii.detect("at 12:30:45 std::vector a::b 1:2:3") == []
    assert len({pii.surrogate("ip", f"fe80::{k:x}", KEY) for k in range(4096)}) == 4096


def test_mentions_are_in_the_table(spark):
    df = spark.createDataFrame([(1, "Mr John Smith. John came.")], "doc_id long, text string")
    row = pii.pseudonymize_checked(df).first()
    assert row.n_entities == 2 and row.kinds == "name:3:13,name:15:19" and "John" not in row.text


def test_quotations_of_several_words_are_seen():
    inside = lambda t: [t[a + 1 : b] for a, b in toxicity.quotations(t)]
    assert inside('he: "you are a worthless idiot" and left') == ["you are a worthless idiot"]
    assert inside("a “you fool, ‘you’ idiot” b „du Narr“ c «sot que tu es» d »Narr«") == ["you fool, ‘you’ idiot", "du Narr", "sot que tu es", "Narr"]
    assert inside("it’s 5\" wide, don’t; “never closed") == [] and inside('a "b c d" e "f g"') == ["b c d", "f g"]
    words = ["idiot", "worthless"]
    m = toxicity.ToxicityModel(toxicity.LexiconAutomaton(words, []), {(0, 0): 2.0, (0, 1): 2.0})
    assert m.features('note: "you are a worthless idiot" here')[-1] == 1.0
    assert m.features('note: "you" are a worthless idiot "here"')[-1] == 0.0


def test_the_filter_keeps_clean_texts_of_all_scripts(spark):
    tamil = "தமிழ் மொழி மிகவும் பழமையான மொழிகளில் ஒன்றாகும் இது பலரால் பேசப்படுகிறது".split()
    thai = "ภาษาไทยเป็นภาษาที่ไม่มีการเว้นวรรคระหว่างคำ"
    rows = [(1, " ".join(f"{a} {b} 2026" for a in tamil for b in tamil)), (2, " ".join(thai[k % 9 :] + thai[: k % 11] + thai[k % 7 : 20] for k in range(90)))]
    rows.append((3, " ".join(f"averyverylongword{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in quality_rules.filter_documents(df).collect()} == {1, 2}
