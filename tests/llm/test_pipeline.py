import random
import zlib

import numpy as np
import public_tokenizers
from test_decontaminate import ITEMS
from test_decontaminate import plain as plain_leaks
from test_mixing import plain_targets
from test_near_copies import plain_classes
from tokenizers import Tokenizer

import corpus_pipeline as cp
from planloom.llm import language, mixing
from planloom.llm.common import shrink_heaps, temporary
from planloom.llm.language import has_letter


def corpus():
    rng = random.Random(8)
    stems = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "lü"]}
    rows = []
    for i in range(260):
        lang = rng.choice(["aa", "bb"])
        words = ["".join(rng.choices(stems[lang], k=rng.randint(2, 5))) for _ in range(rng.randint(25, 90))]
        rows.append((i, " ".join(words), lang, rng.choice(["s0", "s0", "s0", "s1", None]), len(words)))
    for i in range(260, 290):
        t = rows[rng.randrange(200)][1]
        rows.append((i, rng.choice([t, t.replace(" ", "\n", 2), t + " " + t.split()[0]]), "aa", "s1", 1))
    rows += [(300, None, "aa", "s0", 0), (301, "12 34", "bb", "s1", 1), (302, rows[3][1] + " " + ITEMS[0][1], "aa", "s0", 9), (303, rows[9][1] + "\n" + ITEMS[4][1], "bb", None, 9), (304, "Ωμέγα ψι χι " * 20, None, "s0", 60)]
    return rows


def test_stages_match_brute_force(spark, tmp_path):
    rows = corpus()
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append(docs.collect())
    # the model's own decision, and no clean document lost
    known = {r.doc_id for r in language.identify(spark.createDataFrame(rows, docs.schema)).collect() if r.lang_pred != "und" and r.score >= language.LEAST_SCORE}
    want = [r for r in rows if r[0] in known]
    assert sorted(r.doc_id for r in kept[0]) == [r[0] for r in want]
    assert not {300, 301} & known and {r[0] for r in rows if has_letter(r[1])} - known <= {304}
    # near copies: a similarity of 0.8 or more of the sets of five-word shingles
    roots = plain_classes([r[1] for r in want])
    want = [r for k, r in enumerate(want) if roots[k] == k]  # rows ascend by doc_id
    assert sorted(r.doc_id for r in kept[1]) == [r[0] for r in want] and len(want) < 280
    bad = {i for i, *_ in plain_leaks(want, ITEMS)}
    want = [r for r in want if r[0] not in bad]
    assert {302, 303} & bad == {302, 303} and sorted(r.doc_id for r in kept[2]) == [r[0] for r in want]
    size = {}
    for r in want:
        size[r[3]] = size.get(r[3], 0) + len(r[1].split())
    targets = plain_targets(size)
    mixed = kept[3]
    assert {tuple(r) for r in mixed} <= set(want)
    for s in size:
        assert abs(sum(len(r.text.split()) for r in mixed if r.source == s) - targets[s]) <= 30
    planned = {r.doc_id: r.taken // r.size for r in mixing.mix(spark.createDataFrame(want, docs.schema)).collect() if r.size}
    assert all(sum(r.doc_id == i for r in mixed) == n for i, n in planned.items())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, expected = 0, []
    for r in sorted(mixed, key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in cp.STAGES[-1][1](spark, docs, folder).collect())
    assert got == sorted(expected)
    assert sorted(tuple(r) for r in cp.run(spark, folder).collect()) == got


def test_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = cp.run(spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0


def test_nothing_that_can_be_told(spark, tmp_path):
    """Nulls in every column, and rows that the first stage drops."""
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(None, None, None, None, None), (1, "12 34", "aa", None, 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert cp.run(spark, folder).count() == 0


def test_executors_heaps_shrink_between_stages(spark):
    # here the executor is the driver's JVM
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    heap = jvm.java.lang.Runtime.getRuntime().totalMemory
    old = lambda: sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName() and b.getName() != "Copy")
    spark.range(1_000_000).selectExpr("id", "uuid() AS u").orderBy("u").write.format("noop").mode("overwrite").save()
    held = heap()
    shrink_heaps(spark)
    assert heap() < held
    collections = old()
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert dict(cp.STAGES)["tokens"](spark, docs, "").count() == 1
    assert old() > collections
    context.setJobGroup("scope", "")
    with temporary(spark):
        pass
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("scope") for s in tracker.getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert [s.numTasks for s in stages] == [1]
