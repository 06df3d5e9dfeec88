"""The pipeline on a small table against plain Python forms of its filtering stages."""

import os
import subprocess
import sys

import __spark_entry__ as entry
import corpus_pipeline
from tapeforge.llm import decontaminate, queries
from test_near_copies import brute_shingles

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute_keep_one(rows):
    """The doc_ids that stay when every pair of documents is compared by five-word shingles."""
    sets = [brute_shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 4 * len(sets[i]) <= 5 * len(sets[j]) and 4 * len(sets[j]) <= 5 * len(sets[i]) and (
                    5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted(least.values())


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.toxicity_model(docs, spark, SF)
    rows = [r for r in docs.collect() if model.scores([r.text])[0] < corpus_pipeline.TOXIC_FROM]
    first = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert sorted(r.doc_id for r in first.collect()) == sorted(r.doc_id for r in rows) and first.columns == docs.columns
    second = corpus_pipeline.drop_near_copies(spark, first, SF)
    assert sorted(r.doc_id for r in second.collect()) == brute_keep_one(rows) and second.columns == docs.columns
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    items = [b" " + b" ".join(decontaminate.words(r.text)) + b" " for r in bench]
    third = corpus_pipeline.drop_contaminated(spark, second, SF)
    left = {r.doc_id for r in third.collect()}
    for r in second.collect():
        text = b" " + b" ".join(decontaminate.words(r.text)) + b" "
        if any(i in text for i in items):
            assert r.doc_id not in left
    assert len(left) > 0.9 * second.count()
    fourth = corpus_pipeline.mask_personal_data(spark, third, SF)
    assert fourth.columns == docs.columns and fourth.count() == len(left)
    assert fourth.where("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.][A-Za-z]'").count() == 0
    last = corpus_pipeline.pack(spark, fourth, SF)
    assert {r.doc_id for r in last.collect()} == left


def test_odd_tables_pass_every_stage(spark):
    """Null and empty texts, repeated and null doc_ids, clashing columns, no rows: defined results, no crash."""
    rows = [(1, "Some words in a row of more than five. Mail a@b.com"), (1, "Some words in a row of more than five. Mail a@b.com"), (2, None),
            (3, ""), (None, "Another text that nothing else resembles here at all"), (4, "long " * 30_000)]
    schema = "doc_id long, text string, n_chars long, _id string, _digest string, _found int, node long, root string"
    for some in (rows, []):
        docs = spark.createDataFrame([(*r, 5, "x", "y", 1, 2, "z") for r in some], schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), schema)
        ids = sorted(str(r.doc_id) for r in docs.collect())
        assert ids == (["1", "2", "4", "None"] if some else [])  # 3 is a copy of 2: neither has words
        assert all("a@b.com" not in (r.text or "") for r in docs.collect())
        packed = corpus_pipeline.pack(spark, docs, SF)
        assert packed.select("doc_id").distinct().count() == len(ids)


SHIPPED = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from tapeforge.session import local_session
spark = local_session("elsewhere", cpus=2, shuffle_partitions=4, memory="4g")
for name in ("op7_decontamination", "op10_toxicity", "pipeline"):
    print(name, entry.queries()[name](spark, {sf!r}).count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A driver whose workers can't import the package: another folder, no PYTHONPATH."""
    repo = os.path.dirname(os.path.abspath(entry.__file__))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SHIPPED.format(repo=repo, sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True,
                          timeout=900)
    assert done.returncode == 0 and done.stdout.count("\n") >= 3, done.stderr[-3000:]


def test_registered():
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())
    assert [n for n in sorted(queries.QUERIES) if n.startswith("op")] == sorted(n for n in entry.queries() if n.startswith("op"))
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "pii", "best-fit packing"]


def test_near_copies_are_judged_by_five_words(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:50], "x", *words[51:120], "y", *words[121:]]), " ".join(words[:100])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 2]
