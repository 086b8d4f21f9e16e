"""The pipeline on planted cases: what must go goes, and clean documents stay."""

import random

import corpus_pipeline as cp
import __spark_entry__ as entry


def test_stages(spark, tmp_path):
    r = random.Random(3)
    en, de = [f"the{i}ing" for i in range(300)], [f"sch{i}ung" for i in range(300)]
    text = lambda v, n: " ".join(r.choices(v, k=n))
    rows = [(i, text(en if i % 2 else de, 120), "en" if i % 2 else "de", "s", 0) for i in range(1, 81)]
    leak, passage = text(en, 25), text(en, 60)
    rows[10] = (11, text(en, 60) + " " + leak + " " + text(en, 60), "en", "s", 0)
    rows[20] = (21, rows[4][1], "en", "s", 0)  # a copy of 5
    rows[30] = (31, rows[6][1] + " extra", "en", "s", 0)  # nearly 7
    rows[40], rows[50] = (41, text(en, 90) + " " + passage, "en", "s", 0), (51, text(en, 90) + " " + passage, "en", "s", 0)
    rows += [(200, None, None, "s", None), (201, "12 !!", None, "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = [], docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({x.doc_id for x in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == columns, name
    everyone = set(range(1, 81))
    assert kept[0] == everyone
    assert kept[1] == kept[2] == everyone - {21, 31}
    assert kept[3] == kept[4] == everyone - {21, 31, 11}
    after = {x.doc_id: x.text for x in spark.read.parquet(f"{tmp_path}/2").collect()}
    before = {x[0]: x[1] for x in rows}
    assert passage in after[41] and passage not in after[51] and all(after[i] == before[i] for i in after if i != 51)
    assert {x.doc_id for x in cp.run(spark, str(tmp_path)).collect()} == kept[4]
    assert "pipeline" in entry.queries()


ODD = "_lang _score _rejected _letter _own _times _text _id _n_words _n_hit _items _longest _matches _row _size _h c i t s b h n sig class node root owner label side kept_text component_id".split()


def test_stages_take_clashing_names_nulls_and_repeated_ids(spark):
    r = random.Random(5)
    text = lambda n: " ".join(f"the{r.randrange(200)}ing" for _ in range(n))
    rows = [(i, text(60), "en") for i in range(1, 61)]
    rows += [(1, rows[0][1], "en"), (2, text(60), "en"), (None, text(60), "en"), (None, rows[2][1], None), (70, None, "en"), (71, "", None)]
    odd = [f"{n} string" for n in ODD]
    docs = spark.createDataFrame([(*x, "s", 0, *ODD) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(odd))
    bench = spark.createDataFrame([(1, text(20))], "item_id long, text string")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/odd"
    bench.write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    sizes = []
    for k, (name, stage) in enumerate(cp.STAGES):
        new = stage(spark, docs, folder)
        new.write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert docs.columns == new.columns and docs.columns[5:] == ODD, name
            assert docs.select(*ODD).distinct().count() == 1
        sizes.append(docs.count())
    assert sizes[0] == 64 and sizes[1] == 62  # without text; the second rows of 1 and 2
    again = {k: spark.read.parquet(f"{folder}/1").where(f"doc_id = {k}").count() for k in (1, 2)}
    assert again == {1: 1, 2: 1} and spark.read.parquet(f"{folder}/1").where("doc_id is null").count() == 2
    empty = docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0, name


def test_near_copies_of_four_fifths_go(spark):
    r = random.Random(8)
    text = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a, b, c = text(200), text(200), text(200)
    edited = [f"x{i}" if i in (50, 120) else w for i, w in enumerate(a)]  # 186 of 206 five-word shingles
    rows = [(1, a), (2, edited), (3, b), (4, b + text(35)), (5, c), (6, c + text(70))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    three = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in rows}
    share = lambda s, i, j: len(s[i] & s[j]) / len(s[i] | s[j])
    assert share(sets, 1, 2) >= 0.8 and 0.8 <= share(sets, 3, 4) < 0.9 and share(three, 3, 4) < 0.9 and share(sets, 5, 6) < 0.8
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in cp.jaccard_join(spark, docs, "").select("doc_id").collect()} == {1, 3, 5, 6}
