"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapeforge.llm import spelling


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(ch.lower() if ch.isascii() else ch for ch in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    out, near = {}, {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def corpus():
    rnd = random.Random(21)
    base = ["".join(rnd.choice("abcdeÉé×") for _ in range(rnd.randint(6, 14))) for _ in range(60)]
    base += ["prefixed" + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 3))) for _ in range(60)]  # a crowded block
    rows = []
    for i in range(150):
        picked = []
        for _ in range(rnd.randint(0, 200)):
            w = base[min(int(rnd.expovariate(0.06)), len(base) - 1)]
            if rnd.random() < 0.1:
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1:], w[:at] + "z" + w[at:], w[:at] + "q" + w[at + 1:]])
            picked.append(rnd.choice([w, w.title()]))
        rows.append((i, rnd.choice([" ", ", ", "1", "\n", " ł"]).join(picked)))
    common = "chained"
    chain = [(common, 600), ("chainedx", 60), ("chainedxy", 6), ("aaaaaaaa", 40), ("aaaaaaa", 3), ("abababab", 2)]
    rows += [(1000 + k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    return rows + [(None, "nullish words nullish"), (3, "repeated rows repeated"), (3, "repeated rows repeated"), (4, None), (5, ""),
                   (6, "w" * 100_000), (7, "w" * 100_000), (8, "w" * 99_999 + " " + "w" * 99_999)]


@pytest.mark.parametrize("tile", [8, spelling.TILE])
def test_variants_match_all_pairs(spark, docs_of, tile, monkeypatch):
    rows = corpus()
    want = brute(brute_words(rows))
    monkeypatch.setattr(spelling.near_words, "__defaults__", (tile,))
    got = spelling.variants(docs_of(rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = got.collect()
    assert len(got) == len(want)
    assert {r.word: tuple(r)[1:] for r in got} == want
    assert sum(w[3] for w in want.values()) > 300 and want["chainedxy"][1] == "chained"


def test_variants_of_nothing(docs_of):
    assert spelling.variants(docs_of([])).count() == 0
    assert spelling.variants(docs_of([None, "", "short words only"])).count() == 0


@pytest.mark.parametrize("cells", [64, 1 << 22])
def test_dense_tiles_find_single_edits(cells, monkeypatch):
    monkeypatch.setattr(spelling, "_TILE_CELLS", cells)
    rnd = random.Random(22)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(7, 9))) for _ in range(120)})
    found = Counter()
    for length in (7, 8, 9, 10):
        for by_prefix in (True, False):
            rows = spelling.Rows()
            keys = {}
            for w in words:
                if len(w) in (length, length - 1):
                    key = w[:length // 2] if by_prefix else w[len(w) - (length - length // 2):]
                    rows.add(w, 1, keys.setdefault(key, len(keys)), length, by_prefix)
            i, j = spelling.single_edits(rows, rows)
            found.update((rows.words[a], rows.words[b]) for a, b in zip(i.tolist(), j.tolist()))
    assert found == Counter((a, b) for a in words for b in words if one_edit(a, b))
    assert np.array(list(found.values())).max() == 1
