import hashlib
import random
import re
from collections import Counter

import pytest

from tapeforge.llm import decontaminate, pii, quality, toxicity, url_filter

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, s):
    digits = [int(c) for c in re.sub("[^0-9]", "", s)]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if fits(k, m.group())]


ODD = [None, "", "no data", "a@b.c_d@e.com", "a@b.com.x@y.org", "a@b.c.c." + "d." * 3000 + "com", "é📞 x@y.de 1.2.3.4.5.6.7.8",
       "256.1.1.1 001.02.0003.000000255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111234",
       "+1 (938) 555-1226. +44 20 7946 0958 +1 +12 34", "+1 " + " " * 5000, "a" * 60000, "9 " * 20000,
       " ".join(f"u{i}@h{i}.com" for i in range(1500)), "mail john (at) host (dot) com or call (212) 555-0101", "host 10[.]1[.]2[.]3"]


def test_pii_base_spans_match_the_expressions(docs_of):
    rnd = random.Random(7)
    alphabet = ["a", "1", "4111111111111111", ".", "@", " ", "-", "+", "(", "com", "255", "\n", "é", "x@y.de"]
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(25)) for _ in range(300)]
    got = {r.doc_id: r for r in pii.find(docs_of(texts)).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_pii_redaction(docs_of):
    texts = ["mail a@b.com, or 4111 1111 1111 1111!", None, "", "clean text", "x@1.2.3.4"] + [f"n{i} u{i}@h.com" for i in range(20)]
    got = {r.doc_id: r.text for r in pii.redact(docs_of(texts)).collect()}
    assert got[0] == "mail [EMAIL], or [CARD]!" and got[1] is None and got[2] == "" and got[3] == "clean text"
    assert got[4] == "[EMAIL]" and got[7] == "n2 [EMAIL]"
    assert pii.redact(docs_of([])).count() == 0 and pii.find(docs_of([])).count() == 0
    clash = docs_of(texts).selectExpr("doc_id", "text", "lang AS _found", "digest AS _all", "start AS _cut")
    out = pii.redact(clash)
    assert out.columns == clash.columns and {(r._found, r._all, r._cut) for r in out.collect()} == {("en", "x", 7)}


def test_em_learns_who_is_right():
    # the third voter is noise, the others are right nine times of ten
    rnd, counts = random.Random(8), Counter()
    for _ in range(20000):
        y = 1 if rnd.random() < 0.5 else -1
        counts[tuple(rnd.choice((-1, 1)) if k == 2 else (y if rnd.random() < 0.9 else -y) for k in range(4))] += 1
    post, accuracy = pii._em(counts)
    assert all(abs(accuracy[v] - 0.9) < 0.02 for v in ("strict", "check", "context")) and abs(accuracy["gazetteer"] - 0.5) < 0.03
    assert post[1, 1, -1, 1] > 0.99 and post[-1, -1, 1, -1] < 0.01


def test_em_counts_coinciding_voters_once():
    """Two voters that always say the same must not outvote two independent ones that are right more often."""
    rnd, counts = random.Random(9), Counter()
    for _ in range(30000):
        y = 1 if rnd.random() < 0.4 else -1
        same = y if rnd.random() < 0.7 else -y
        counts[(y if rnd.random() < 0.9 else -y, same, same, y if rnd.random() < 0.85 else -y)] += 1
    post, accuracy = pii._em(counts)
    assert abs(accuracy["strict"] - 0.9) < 0.03 and abs(accuracy["context"] - 0.85) < 0.03
    assert abs(accuracy["check"] - 0.7) < 0.03 and accuracy["check"] == accuracy["gazetteer"]
    assert post[1, -1, -1, 1] > 0.9 and post[-1, 1, 1, -1] < 0.1


def test_reserved_addresses():
    def reserved(a):
        return re.match(pii.RESERVED, a) is not None

    assert all(map(reserved, ("0.1.2.3", "10.9.8.7", "127.0.0.1", "169.254.3.4", "172.16.0.1", "172.31.255.1", "192.168.1.1", "224.0.0.1",
                              "231.1.1.1", "240.0.0.1", "255.255.255.255")))
    assert not any(map(reserved, ("1.2.3.4", "100.1.1.1", "172.15.0.1", "172.32.0.1", "192.167.1.1", "22.5.1.1", "223.1.1.1", "25.1.1.1")))


PLANTED = ["mail me at john (at) example (dot) org please", "contact: jane.doe [at] mail [dot] example [dot] com", "call (212) 555-0101 now",
           "phone 415-555-2671", "server 10[.]1[.]2[.]3 down", "host 2001:db8:85a3:0:0:8a2e:370:7334 is up", "login from 93(.)184(.)216(.)34"]
DECOYS = ["order 212-555-0101 shipped", "version 1[.]2[.]3[.]4", "invoice id 415-555-2671", "build 10[.]0[.]1[.]7"]


def test_pii_adds_planted_spans(docs_of):
    """Obfuscated forms are added where their context speaks for them; the base columns don't change."""
    rnd = random.Random(14)
    texts = PLANTED * 30 + DECOYS * 30 + [f"mail u{i}@h{i}.com or call +1 212 555 {i:04d} to reach host {rnd.randint(1, 99)}.2.3.{i % 250}" for i in range(300)]
    rows = {r.doc_id: r for r in pii.find(docs_of(texts)).collect()}
    found = [len([s for s in rows[i].spans.split(",") if s]) - sum((rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone)) for i in range(len(texts))]
    hits, wrong = sum(f > 0 for f in found[:len(PLANTED) * 30]), sum(f > 0 for f in found[len(PLANTED) * 30:])
    assert hits >= 60 and wrong <= 0.05 * hits, (hits, wrong)  # two of the seven forms, none of the decoys
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()


def gst(doc, item, least):
    """Greedy string tiling word by word: the longest unmarked common run first, then by position."""
    a, b, out = [0] * len(doc), [0] * len(item), []
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and not a[p + n] and not b[q + n] and doc[p + n] == item[q + n]:
                    n += 1
                if n > best[2]:
                    best = (p, q, n)
        if best[2] < least:
            return out
        out.append(best)
        for k in range(best[2]):
            a[best[0] + k] = b[best[1] + k] = 1


def test_tiling_matches_brute_force():
    import numpy as np

    rnd = random.Random(9)
    for trial in range(60):
        item = [rnd.randint(1, 6) for _ in range(rnd.randint(1, 30))]
        doc = [rnd.randint(1, 6) for _ in range(rnd.randint(1, 40))]
        got = decontaminate.tiles(np.array(doc), np.array(item), 3)
        assert sorted(t[2] for t in got) == sorted(t[2] for t in gst(doc, item, 3)), (doc, item)
        for p, q, n in got:
            assert doc[p:p + n] == item[q:q + n]


def test_decontamination_catches_reordered_passages(spark, docs_of):
    rnd = random.Random(10)
    w = [f"w{i}" for i in range(3000)]
    item = rnd.sample(w, 40)
    other = " ".join(rnd.sample(w, 300))
    texts = [other, other + " " + " ".join(item[20:] + ["x"] + item[:20]).upper() + ".", " ".join(item[:15]), None, "",
             ", ".join(item), "the " * 50000, " ".join(item) * 3]
    bench = spark.createDataFrame([(1, " ".join(item), 0), (2, "too short", 0), (3, None, 0), (1, " ".join(item), 0)], "item_id long, text string, doc_id int")
    got = decontaminate.matches(docs_of(texts), bench).collect()
    assert sorted({r.doc_id for r in got}) == [1, 5, 7] and all(r.item_id == 1 and r.coverage >= 0.9 for r in got) and len(got) == 6
    kept = decontaminate.remove_contaminated(docs_of(texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 6] and kept.columns[-1] == "digest"
    none = bench.limit(0)
    assert decontaminate.matches(docs_of(texts), none).count() == 0 and decontaminate.remove_contaminated(docs_of(texts), none).count() == 8
    assert decontaminate.matches(docs_of([]), bench).count() == 0
    few = " ".join(w[:3])
    short = spark.createDataFrame([(7, few), (8, "..."), (9, w[5])], "item_id long, text string")
    texts = [f"{other} {few}", f"{w[0]} {w[1]} x {w[2]}", few.upper(), w[5], None]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs_of(texts), short).collect() if r.doc_id or r.item_id == 7) == [
        (0, 7), (2, 7), (3, 9)]
    clash = docs_of(texts).withColumnRenamed("digest", "_digest")
    assert decontaminate.remove_contaminated(clash, short.where("item_id = 7")).columns == clash.columns
    small = decontaminate.blocks(bench, 100)
    assert sum(len(b) for b in small) == 3


@pytest.mark.parametrize("block_bytes", [200, 8_000_000])
def test_decontamination_matches_brute_force(spark, docs_of, block_bytes, monkeypatch):
    """Seeds, blocks and tiling together against tiling every pair word by word."""
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block_bytes,))
    rnd = random.Random(13)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [" ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 4, 5, 9, 20]))) for _ in range(12)]
    docs = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30))) for _ in range(30)]
    docs += [f"{docs[k]} {items[k]} {docs[k + 1]}" for k in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            a, b = text.split(), item.split()
            share = sum(t[2] for t in gst(a, b, min(5, len(b)))) / len(b)
            if share >= 0.5:
                want[d, i] = share
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.matches(docs_of(docs), bench).collect()}
    assert got == pytest.approx(want) and len(want) > 12


def test_quality_counts_and_verdict(docs_of):
    prose = "This is a plain sentence of ordinary words that nobody would remove. " * 2
    lines = [f"{prose} Number {i} differs from the others in one way or another." for i in range(6)]
    junk = "\n".join(f"Home | News {i} | Shop | Help | Login | About | Terms | More" for i in range(12))
    texts = ["\n".join(lines), junk, "\n".join([*lines, "All rights reserved."]), None, "", "a b a b a b " * 40, "ä\u00a0ö x", "x y z", "a\n\nb\na\n \na\n "]
    got = {r.doc_id: r for r in quality.measure(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k:k + 3])] > 1}
        r = got[i]
        lines_of = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines_of) - len(set(lines_of)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.kept and r.base_failed)
    assert not got[1].kept and not got[3].kept
    assert quality.measure(docs_of([])).count() == 0
    rules = quality.DEFAULT
    assert [quality.failing_rule(line, False, rules) for line in (
        "Essh.$$$", "---- ++++ ....", "Startseite", "Tous droits réservés 2024", "see https://a.example/b/c/d/e and", "na " * 12 + "x",
        "Kurz.", "¿Qué?", "Ein ganz gewöhnlicher Satz, mit Komma.", "日本語の文です。")] == [
        "punctuation", "punctuation", "navigation", "boilerplate", "navigation", "stutter", None, None, None, None]
    many = " ".join(f"w{i}" for i in range(100))
    cleaned = quality.clean(docs_of([many + "\nAll rights reserved.", junk])).collect()
    assert [r.text for r in cleaned] == [many]


RULES = [url_filter.Rule(*r.split()) for r in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/")]


def test_url_rules_and_trees(spark):
    rows = [(1, "https://A.Example.ORG/es/1?q#f"), (2, "http://example.org/en/12"), (3, "http://example.org"), (4, "x://myexample.org/es/"),
            (5, "HTTP://b.COM/fr/x"), (6, None), (7, ""), (8, "no scheme.org/"), (9, "http://é.net/a?b=1&c=2://d"), (9, "http://é.net/a"),
            (10, "http:///p"), (11, "http://org/x")] + [(100 + i, f"http://s{i}.example.org/es/{i}") for i in range(40)]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, probability string")
    got = {r.page_id: r for r in url_filter.verdicts(pages, RULES).collect()}
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 4, 5, 11)] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("org/", "allow")]
    assert got[3].rule is None and (got[3].host, got[3].path) == ("example.org", "")
    assert (got[1].host, got[1].path) == ("a.example.org", "/es/1") and (got[9].host, got[10].path) == ("é.net", "/p")
    assert all((got[i].host, got[i].path, got[i].rule) == ("", "", None) for i in (6, 7, 8))
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.verdicts(pages.limit(0), RULES).count() == 0
    assert url_filter.verdicts(pages.where("page_id = 6"), RULES).first().verdict == "allow"


def test_url_trees_learn(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        bad = i % 2
        tail = "".join(rnd.choice("0123456789abcdef") for _ in range(24)) if bad else rnd.choice(["news", "about", "docs"])
        rows.append((f"http://h{i % 17}.net/{tail}", f"h{i % 17}.net", f"/{tail}", bad))
    df = spark.createDataFrame(rows, "url string, host string, path string, blocked int")
    model = url_filter.learn(df.where("url not like '%7%'"))
    scored = url_filter.block_probability(df, model).collect()
    assert sum((r.probability >= 0.5) == bool(r.blocked) for r in scored) >= 390


@pytest.fixture(scope="module")
def toxic_texts():
    rnd = random.Random(12)
    words = ["".join(rnd.choice("aeioutnrsl") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(900):
        t = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        if y := int(rnd.random() < 0.3):
            for _ in range(3):
                t.insert(rnd.randrange(len(t)), rnd.choice(["grumblefink", "scoundrelly", "blighterous"]))
        texts.append(" ".join(t))
        labels.append(y)
    return texts, labels


def test_toxicity_on_held_out_texts(toxic_texts, docs_of):
    texts, labels = toxic_texts
    model = toxicity.fit(texts[:600], labels[:600])
    p = model.scores(texts[600:])
    right = sum((s >= 0.3) == y for s, y in zip(p, labels[600:]))
    assert right >= 0.97 * 300
    odd = model.scores([None, "", " ", "x", "grumblefink " * 20000])
    assert ((odd >= 0) & (odd <= 1)).all() and odd[0] == odd[1] == odd[2]
    docs = docs_of([(5, texts[0]), (5, texts[0]), (None, None), (6, "")])
    assert sorted(str(r.doc_id) for r in toxicity.score(docs, model).collect()) == ["5", "5", "6", "None"]
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.reject(docs, model, 2.0).count() == 4 and toxicity.reject(docs, model, 0.0).count() == 0


def test_toxicity_learns_from_tables(spark, docs_of, toxic_texts):
    texts, labels = toxic_texts
    rows = [(i, 1, y) for i, y in enumerate(labels)] + [(0, 1, 1 - labels[0]), (None, 1, 1), (10**6, 1, 1), (1, 1, None)]
    model = toxicity.learn(docs_of(texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), fit_docs=200)
    assert b"grumble" in model.toxic and b"grumble" not in model.ordinary
    assert len(model.ordinary) > 0.5 * len(model.toxic)  # both begin with the words frequent in both
    again = docs_of([(0, f"copy {i}") for i in range(50)] + [(i, t) for i, t in enumerate(texts) if i])
    assert toxicity.learn(again, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), fit_docs=200).toxic
    assert toxicity.learn(docs_of(texts), spark.createDataFrame([], "doc_id long, quality int, toxic int")).scores(["x"])[0] == 0.5
    assert 0.9 < toxicity.fit(["a b"] * 9, [1] * 9).scores(["x"])[0] <= 1
