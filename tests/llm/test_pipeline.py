from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from condfuse.llm import mixing, queries
from tests.conftest import SF_SMALL
from tests.llm.cases import CLASH, DOCS, odd_documents, odd_frame, prose, runs_removed, smallest_reachable
from tests.llm.test_dedup import brute_fingerprint
from tests.llm.test_place import check_packing
from tests.oracle_check import compare, duck


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 40, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect())


def documents():
    """Odd rows, a passage of over 50 words in several documents, and near copies."""
    rows = odd_documents()
    passage = prose(77, 70, line=70)
    rows += [(400 + k, f"{prose(500 + k, 60)}\n{passage}\n{prose(600 + k, 30)}", "en", "s3", 1) for k in range(5)]
    near = prose(88, 600, line=600).split()
    for k in range(6):
        near[100 * k] = f"changed{k}"
        rows.append((450 + k, " ".join(near), "fr", "s4", 1))
    return rows


def test_stages_against_brute_force(spark, folder):
    rows = documents()
    docs = odd_frame(spark, rows)
    kept = cp.keep_languages(spark, docs, folder)
    assert kept.columns == docs.columns
    want = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    assert rows_of(kept) == Counter((r[0], r[1], r[2], r[3]) for r in want)

    # line dedup: ids that are null or used twice are not compared with themselves
    lines = cp.drop_common_lines(spark, kept, folder)
    assert lines.columns == docs.columns
    plain = {r[0]: r[1] for r in want if r[0] is not None and r[0] != 5}
    plain[5] = rows[5][1]
    cut = runs_removed(plain, 50)
    got = {(r.doc_id, r.text, r.n_chars) for r in lines.collect()}
    for d, t in cut.items():
        assert (d, t, 1 if t == plain[d] else len(t)) in got
    passage = prose(77, 70, line=70)
    assert sum(passage in (t or "") for _, t, _ in got) == 1 and (400, rows_text(rows, 400), 1) in got

    # SimHash: one of each group, the smallest id
    current = lines.select("doc_id", "text").collect()
    single = cp.drop_near_copies(spark, lines, folder)
    assert single.columns == docs.columns
    fps = [brute_fingerprint(r.text) for r in current]
    low = smallest_reachable([r.doc_id for r in current], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    want_ids = Counter((r.doc_id, r.text) for r, c in zip(current, low) if r.doc_id == c)
    assert Counter((r.doc_id, r.text) for r in single.collect()) == Counter(set(want_ids))

    # mixing: the rows as often as the mix says
    mixed = cp.mix_sources(spark, single, folder)
    assert mixed.columns == docs.columns
    weights = mixing.quality_weights(spark.read.parquet(f"{folder}/labels.parquet"))
    plan = {(r.doc_id, r.text_hash): r.copies for r in mixing.mix(single, weights).collect()}
    times = Counter((r.doc_id, r.h) for r in mixed.select("doc_id", F.xxhash64("text").alias("h")).collect())
    assert times == Counter({k: c for k, c in plan.items() if c})

    # packing: every remaining row, by the ids of its whole text
    final = [(r.doc_id, r.text) for r in mixed.collect()]
    used, least = check_packing(cp.pack_sequences(spark, mixed, folder).collect(), final, 2048)
    assert used <= least + 2


def rows_text(rows, doc_id):
    return next(r[1] for r in rows if r[0] == doc_id)


def test_run_equals_the_stages(spark, folder):
    spark.createDataFrame(documents(), DOCS).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(cp.run(spark, folder)) == key(docs)


def test_mix_repeated_rows_share_their_copies(spark, folder):
    rows = [(1, "a b c", "en", "s", 1)] * 5 + [(k, f"word{k} more words", "en", "t", 1) for k in range(2, 30)]
    df = spark.createDataFrame(rows, DOCS)
    mixed = cp.mix_sources(spark, df, folder)
    copies = sum(r.copies for r in mixing.mix(df, mixing.quality_weights(spark.read.parquet(f"{folder}/labels.parquet"))).collect())
    assert mixed.count() == copies


def test_languages_fill_what_is_missing(spark, folder):
    """A null lang becomes the predicted one; known ones stay; no clean document goes."""
    from tests.llm.test_text import labelled

    rows = [(d, t, None if d % 5 == 0 else g, s, n) for d, t, g, s, n in labelled(300)] + [(900, "12 34", None, "s", 1), (901, None, "en", "s", 1)]
    truth = {d: g for d, _, g, *_ in labelled(300)}
    got = {r.doc_id: r.lang for r in cp.keep_languages(spark, odd_frame(spark, rows), folder).collect()}
    assert got.keys() == truth.keys() and all(got[d] == g for d, g in truth.items() if d % 5)
    filled = [d for d in truth if d % 5 == 0]
    assert sum(got[d] == truth[d] for d in filled) >= 0.95 * len(filled)


def test_nothing_is_lost_where_no_document_is_labelled(spark, folder):
    rows = [(d, t, None, s, n) for d, t, _, s, n in odd_documents()]
    got = cp.keep_languages(spark, odd_frame(spark, rows), folder)
    want = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    assert rows_of(got) == Counter((r[0], r[1], None, r[3]) for r in want) and len(want) > 40


def test_one_document_of_each_near_group(spark, folder):
    """Also where ids are null or used twice."""
    base = prose(5, 600, line=600)
    near = lambda k: base[:k].upper() + base[k:]  # noqa: E731  other texts of one fingerprint

    rows = [(7, near(1), "en", "s", 1), (7, "quite another text", "en", "s", 1), (9, near(2), "en", "s", 1), (None, near(3), "en", "s", 1), (None, near(3), "en", "s", 1),
            (7, near(4), "en", "t", 1), (None, prose(6, 300), "en", "s", 1), (None, prose(6, 300), "en", "u", 1), (None, "words without a twin", None, None, None)]
    got = [(r.doc_id, r.text) for r in cp.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), folder).collect()]
    assert len(got) == 4 and {t for _, t in got} >= {"quite another text", prose(6, 300), "words without a twin"}
    assert sum(d == 7 and t in (near(1), near(4)) for d, t in got) == 1


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stage_of_nothing(spark, folder, name, stage):
    assert stage(spark, spark.createDataFrame([], DOCS), folder).count() == 0


@pytest.mark.parametrize("name,stage", cp.STAGES[:-1])
def test_other_columns_pass_through(spark, folder, name, stage):
    out = stage(spark, odd_frame(spark), folder)
    for c in CLASH:
        assert out.where(F.col(c) != f"own {c}").count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    r = compare(spark, duck(SF_SMALL), name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF_SMALL)
    assert r["cols"] and r["values"], r


def test_bytes_that_are_no_utf8(spark, folder):
    """Broken texts pass every operator on documents."""
    df = odd_frame(spark).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("ff41fe20c3")).cast("string"), F.col("text"))).otherwise(F.col("text")))
    df = df.select(*[c for c in df.columns if c not in CLASH])
    df.write.parquet(f"{folder}/documents.parquet")
    n = df.count()
    for name, query in queries.QUERIES.items():
        if name not in ("op2_warc", "op10_vectors", "op11_codes", "op12_whitening"):
            got = query(spark, folder).count()
            assert got == n or (name == "op9_pack" and got >= n), name
    assert cp.run(spark, folder).count() > 0
