import random

import numpy as np
import pytest
import xxhash

from tapeforge.llm import components, line_dedup, near_copies, simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(fps))]
    return [min((ids[j] for j in range(len(fps)) if roots[j] == r and ids[j] is not None), default=None) for r in roots]


def test_near_duplicates_match_brute_force(docs_of):
    rnd = random.Random(4)
    base = [" ".join(rnd.choice("aa bb cc dd ee ff É ß gg.".split()) for _ in range(rnd.randint(1, 400))) for _ in range(40)]
    texts = [*base, *base[:9], None, "", " \t\n", "One", "one two", "ONE two", "x " * 30000]
    for t in base[:25]:
        w = t.split()
        w[rnd.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(3, "dup row"), (3, "dup row"), (None, base[0]), (None, "alone")]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([str(r[0]) for r in rows], [f"{f:016x}" for f in fps], map(str, brute_components([r[0] for r in rows], fps))))
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = simhash.keep_one(docs_of(rows))
    assert kept.columns == ["doc_id", "text", "lang", "start", "digest"]
    ids = sorted(map(str, (r.doc_id for r in kept.collect())))
    assert len(ids) == len({c for *_, c in want if c != "None"}) + 1 and "None" in ids
    assert {i for i in ids if i != "None"} == {c for *_, c in want if c != "None"}


def test_near_duplicates_of_nothing(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.keep_one(docs_of([])).count() == 0


def near_fingerprints(n, seed):
    rnd = random.Random(seed)
    fps = {rnd.getrandbits(64) for _ in range(n)}
    for f in list(fps)[:n // 2]:
        for k in (1, 2, 3):
            g = f
            for b in rnd.sample(range(64), k):
                g ^= 1 << b
            fps.add(g)
    return np.array(sorted(fps), np.uint64)


def test_bit_planes_find_every_close_pair():
    fps = near_fingerprints(120, 5)
    for run in (np.zeros(len(fps), int), np.sort(np.arange(len(fps)) % 9)):
        i, j = simhash.close_pairs(fps, run)
        want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps))
                if run[a] == run[b] and (int(fps[a]) ^ int(fps[b])).bit_count() <= 2}
        assert set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("tile", [4, 4096])
def test_links_connect_what_brute_force_connects(spark, tile):
    fps = near_fingerprints(150, 6)
    rows = [(int(np.int64(f.view(np.int64))),) for f in fps] + [(k,) for k in range(40)]  # the last share three quarters
    distinct = spark.createDataFrame(rows, "fp long").distinct()
    got = {r.node: r.root for r in components.components(simhash.links(distinct, tile), "u", "v").collect()}
    values = [r[0] for r in sorted(set(rows))]
    want = brute_components(values, [v % 2**64 for v in values])
    assert [got.get(v, v) for v in values] == want


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5000, 5000), (7, None), (1050, 1049)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(df, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1051), 1000)}


def test_line_dedup_keeps_the_first_and_the_offsets(docs_of):
    line = " ".join(f"word{i}" for i in range(14))
    rows = [(4, f"Intro\n  {line.upper()} \nEnd"), (2, f"{line}\nshort line"), (9, f"short line\n{line}\n{line.replace(' ', '  ')}"),
            (9, f"short line\n{line}\n{line.replace(' ', '  ')}"), (None, line), (5, None), (6, ""), (7, "y " * 100000), (8, f"Some other words here. {line}. And more | {line} | of it")]
    got = line_dedup.repeats(docs_of(rows)).collect()
    texts = dict(rows)
    assert {r.first_doc_id for r in got} == {2} and sorted(str(r.doc_id) for r in got) == ["4", "8", "8", "9", "9", "9", "9", "None"]
    for r in got:
        assert " ".join(texts[r.doc_id][r.start:r.end].lower().split()).strip(".") == line
    plain = docs_of([r for r in rows if r[0] is not None and r[0] != 9])
    cleaned = {r.doc_id: r.text for r in line_dedup.remove(plain, line_dedup.repeats(plain)).collect()}
    assert cleaned[4] == "Intro\n   \nEnd" and cleaned[2] == texts[2] and cleaned[5] is None and cleaned[6] == ""
    assert line_dedup.repeats(docs_of([])).count() == 0


def test_line_dedup_units():
    text = "A b c.\n\nD e f g h i j k l m n.  O p q r s t u v w x y.\nlast"
    assert [text[a:z] for a, z, _, _ in line_dedup.units(text, "paragraph", 1, False)] == [text[:6], text[8:]]
    both = [(text[a:z], line) for a, z, line, _ in line_dedup.units(text, "line", 5, True)]
    assert both == [(text[8:54], None), ("D e f g h i j k l m n.", 8), ("O p q r s t u v w x y.", 8)]


def brute_shingles(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").split() if w]
    k = min(5, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


@pytest.mark.parametrize("limits", [{}, {"tile_sets": 3, "tile_shingles": 900, "bucket": 8}])
def test_stage_keeps_one_of_edited_copies(docs_of, limits):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(3, 300))) for _ in range(30)] + [None, "", " \n"]
    for t in texts[:30] * 4:
        w = t.split()
        for _ in range(rnd.randint(0, 1 + len(w) // 60)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        texts.append(" ".join(w[:len(w) - rnd.randint(0, len(w) // 20)]).title())
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(3, "dup row"), (3, "dup row"), (None, texts[0]), (None, "alone")]
    sets = [brute_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    edited = 0
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                edited += sets[i] != sets[j]
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((d is None, d))
    assert edited > 50
    kept = near_copies.keep_one(docs_of(rows), **limits)
    assert kept.columns == ["doc_id", "text", "lang", "start", "digest"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(min(g)[1]) for g in groups.values())


def test_stage_keeps_one_of_nothing(docs_of):
    assert near_copies.keep_one(docs_of([])).count() == 0
    assert near_copies.keep_one(docs_of([None, "", " "])).count() == 1


def test_stage_keeps_clashing_columns(spark):
    rows = [(1, "a b c", "x", 1.5, [1]), (2, "a b c", "y", 2.5, None), (3, None, None, None, [2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _null double, _h array<int>")
    by_bits = simhash.keep_one(docs)
    assert by_bits.columns == docs.columns and by_bits.count() == 2
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id != 2)


@pytest.mark.parametrize("radius", [0, 2, 7, 8, 20, 31])
def test_carry_save_counters_find_every_close_pair(radius):
    fps = near_fingerprints(60, 9)
    rnd = random.Random(radius)
    far = [int(f) ^ sum(1 << b for b in rnd.sample(range(64), k)) for f in fps[:40].tolist() for k in (radius, radius + 1)]
    fps = np.array([*fps.tolist(), *far], np.uint64)
    for run in (np.zeros(len(fps), int), np.sort(np.arange(len(fps)) % 9)):
        i, j = near_copies.close_pairs(fps, run, radius)
        want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps))
                if run[a] == run[b] and (int(fps[a]) ^ int(fps[b])).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want and len(want) == len(i)


def test_large_groups_are_linked_like_small_ones(spark):
    """One group of several clusters, in tiles of four sets: what all pairs connect is connected, and nothing else."""
    rnd = random.Random(10)
    sets = []
    for c in range(6):
        base = [rnd.getrandbits(63) for _ in range(40)]
        for k in range(15):
            sets.append(np.unique(np.array(base[:40 - k // 2] + [rnd.getrandbits(63) for _ in range(k % 5)], np.uint64)))
    i, j = near_copies.similar(sets)
    parent = list(range(len(sets)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in zip(i.tolist(), j.tolist()):
        parent[find(a)] = find(b)
    want = {}
    for k in range(len(sets)):
        want.setdefault(find(k), set()).add(k)
    rows = spark.createDataFrame([(k, len(s), bytearray(s.tobytes())) for k, s in enumerate(sets)], "node long, n long, shingles binary")
    groups = rows.selectExpr("node div 1000 as grp", "node")
    found = near_copies.links(groups, rows, tile_sets=4)
    got = {}
    for r in components.components(found, "u", "v").collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(w) for w in want.values() if len(w) > 1)


@pytest.mark.parametrize("joint", ["\n", ". "])
def test_line_dedup_finds_passages_of_short_units(docs_of, joint):
    passage = [" ".join(f"{'abcdefghijkl'[i]}{k}" for k in range(n)) for i, n in enumerate((4, 5, 6, 3, 7, 12, 2, 9, 1, 8, 4, 5))]
    text = joint.join(passage)
    rows = [(1, f"First words\n{text}"), (2, f"Of another one{joint}{text}{joint}and its end"), (3, "yes sir\n" * 40), (4, "short line\nlast"),
            (5, "short line\nlast")]
    docs = docs_of(rows)
    found = line_dedup.repeats(docs)
    cleaned = {r.doc_id: r.text for r in line_dedup.remove(docs, found).collect()}
    assert [w for w in cleaned[2].replace(".", " ").split()] == "Of another one and its end".split()
    assert all(cleaned[d] == t for d, t in rows if d in (1, 4, 5))
    left = cleaned[3].split("\n")
    assert 7 <= left.count("yes sir") < 14
    texts = dict(rows)
    for r in found.where("doc_id = 2").collect():
        assert r.first_doc_id == 1 and len(texts[2][r.start:r.end].split()) >= 13
