from __future__ import annotations

import datetime
import hashlib
import math
import random
import re
import types
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolake.functions import dates, quality, text
from chronolake import config, session
from chronolake.operators import asof, chunking, contracts, evaluation, lake, parsing, ranking, retrieval, structure
from chronolake.plans import catalogue, legal
from chronolake.session import checkpoint_dir, cut
from chronolake.sources import files, hooks, tables

D = datetime.date


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_words_keep_vietnamese_letters_and_drop_marks(spark):
    df = spark.createDataFrame([(1, "Điều 5, m² cát_vàng!"), (2, ""), (3, None)], "id int, t string")
    got = dict(df.select("id", text.tokens(F.col("t"))).collect())
    assert got == {1: ["điều", "5", "m²", "cát_vàng"], 2: [], 3: None}


def test_fold_and_strip(spark):
    df = spark.createDataFrame([(" Đường Ưng ",)], "t string")
    assert df.select(text.fold(text.strip_space(F.col("t")))).first()[0] == "duong ung"


def test_fold_of_any_text_in_any_form(spark):
    said = ["ĐƯỜNG ỨNG", "Ngày mồng một", "Müller, Łódź, façade", "έργο", "московский", "điều\xa03 ３Ａ", "оng", "⚖\ufe0f½", "", None]
    forms = [(t and unicodedata.normalize(form, t),) for t in said for form in ("NFC", "NFD")]
    df = spark.createDataFrame(forms, "t string")
    plain = ["duong ung", "ngay mong mot", "muller, łodz, facade", "εργο", "московскии", "dieu\xa03 ３ａ", "оng", "⚖½", "", None]
    assert [r[0] for r in df.select(text.fold(F.col("t"))).collect()] == [t for t in plain for _ in range(2)]


def test_every_document_is_folded(spark, folder):
    asked = spark.read.parquet(f"{folder}/documents.parquet")
    got = catalogue.QUERIES["folded_documents"](spark, folder)
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in asked.select("doc_id").collect())
    assert got.filter("folded is null").count() == asked.filter("text is null").count()


@pytest.mark.parametrize("n, pieces", [(0, 0), (1, 1), (511, 1), (512, 1), (513, 2), (960, 2), (961, 3), (1408, 3)])
def test_windows_count(spark, n, pieces):
    df = spark.createDataFrame([(" ".join(map(str, range(n))),)], "t string").select(text.space_tokens(F.col("t")).alias("w"))
    got = df.select(text.windows(F.col("w"), 512, 64)).first()[0]
    assert len(got) == pieces
    if n:
        assert got[-1].split()[-1] == str(n - 1)


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b", "a", "b"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(text.ngrams(F.col("w"), 2)).collect()] == [[], ["a b", "b a"], []]


def test_citations(spark):
    answer = "Theo 1/2020/QH14.\nNGUỒN: 45/2019/QH14, 1/2020/NĐ-CP"
    df = spark.createDataFrame([(answer,)], "t string")
    got = df.select(text.cited_docs(F.col("t")), text.without_citations(F.col("t"))).first()
    assert got[0] == ["45/2019/QH14", "1/2020/NĐ-CP"] and got[1] == "Theo 1/2020/QH14."


def test_dates(spark):
    asked = ["Tại ngày 05/07/2022?", "2021-02-03", "ngày 7 tháng 8 năm 2019", "30/02/2020", "không có"]
    df = spark.createDataFrame([(x,) for x in asked], "t string")
    assert [r[0] for r in df.select(dates.event_date(F.col("t"))).collect()] == [D(2022, 7, 5), D(2021, 2, 3), D(2019, 8, 7), None, None]
    odd = spark.createDataFrame([("112/3/2024",), ("1-2-2003",), ("7 tháng 8 năm 2019",), ("x 1.2.2003 2021-02-03",)], "t string")
    assert [r[0] for r in odd.select(dates.event_date(F.col("t"))).collect()] == [None, None, None, D(2021, 2, 3)]
    said = spark.createDataFrame([("Ngày 1/1/2000. Luật này có hiệu lực từ ngày 2/3/2004",), ("có hiệu lực pháp luật từ 1/1/2000",)], "t string")
    assert [r["effective_from"] for r in parsing.effect_rules(said, [], "t").collect()] == [D(2004, 3, 2)]
    mention = spark.createDataFrame([("đến 05.7.2022",), ("ngày 5 tháng 7 năm 2022",), ("2022-07-05",), ("15/7/2022",), (None,)], "t string")
    assert [r[0] for r in mention.select(dates.mentions_date(F.col("t"), F.lit(D(2022, 7, 5)))).collect()] == [True, True, True, False, False]
    signed = spark.createDataFrame([("Hà Nội, ngày 3 tháng 4 năm 2005. TP. Hồ Chí Minh, ngày 1 tháng 1 năm 2001",), ("Hà Nội, ngày 31 tháng 2 năm 2005",), ("ngày 1 tháng 1 năm 2001",)], "t string")
    assert [r[0] for r in signed.select(dates.issued_date(F.col("t"))).collect()] == [D(2005, 4, 3), None, None]
    strict = spark.createDataFrame([("2020-01-02",), (" ",), ("None",), (None,)], "t string")
    assert [r[0] for r in strict.select(dates.strict_date(F.col("t"))).collect()] == [D(2020, 1, 2), None, None, None]
    with pytest.raises(Exception, match="CANNOT_PARSE|CAST_INVALID"):
        spark.createDataFrame([("2/1/2020",)], "t string").select(dates.strict_date(F.col("t"))).collect()


def test_bases(spark):
    asked = [("Luật đã thực sự có hiệu lực chưa?", "status"), ("Luật hết hiệu lực khi nào?", "effective"), ("Luật quy định những nội dung gì?", "issued"), ("Ai ký?", "effective"), (None, "effective")]
    df = spark.createDataFrame([(a,) for a, _ in asked], "q string")
    assert [r[0] for r in df.select(dates.date_basis(F.col("q"))).collect()] == [b for _, b in asked]
    rows_ = spark.createDataFrame([("issued", "đã có hiệu lực", None), (None, "đã có hiệu lực", "amendment_retrieval"), (None, "x", "amendment_retrieval"), (None, "x", "temporal")], "b string, q string, c string")
    assert [r[0] for r in rows_.select(dates.sample_basis(F.col("b"), F.col("q"), F.col("c"))).collect()] == ["issued", "status", "issued", "effective"]
    with pytest.raises(Exception, match="unknown date basis"):
        rows_.select(dates.sample_basis(F.lit("maybe"), F.col("q"), F.col("c"))).collect()


def interval_rows(spark):
    return spark.createDataFrame(
        [(1, D(2020, 1, 1), D(2020, 2, 1)), (2, D(2020, 1, 1), None), (3, None, D(2020, 2, 1)), (4, D(2020, 3, 1), D(2020, 1, 1))],
        "id int, effective_from date, effective_to date",
    )


@pytest.mark.parametrize("at, ids", [("2020-01-01", [1, 2]), ("2020-01-31", [1, 2]), ("2020-02-01", [2]), ("2019-12-31", [])])
def test_intervals_are_half_open(spark, at, ids):
    found = asof.as_of(interval_rows(spark), F.lit(at).cast("date"))
    assert sorted(r["id"] for r in found.collect()) == ids


def test_counts_by_sweep_equal_the_join(spark):
    asked = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 2, 1),), (D(2019, 1, 1),), (D(2021, 1, 1),)], "t date")
    got = {r["t"]: r["n_valid"] for r in asof.counts_at(interval_rows(spark), asked).collect()}
    for t, n in got.items():
        assert n == asof.as_of(interval_rows(spark), F.lit(t)).count()


def test_in_force_is_three_valued(spark):
    got = interval_rows(spark).orderBy("id").select(dates.in_force(F.col("effective_from"), F.col("effective_to"), F.lit(D(2020, 1, 5)))).collect()
    assert [r[0] for r in got] == [True, True, None, False]


def test_supersession_takes_the_least_end(spark):
    p = spark.createDataFrame([("d", "1", D(2020, 1, 1), None), ("d", "2", D(2020, 1, 1), D(2020, 5, 1))], "logical_doc_id string, provision_path string, effective_from date, effective_to date")
    r = spark.createDataFrame([("d", "1", D(2020, 4, 1)), ("d", "1", D(2020, 3, 1)), ("d", "*", D(2020, 6, 1)), ("e", "2", D(2000, 1, 1))], "logical_doc_id string, target_path string, effective_to date")
    got = {x["provision_path"]: x["valid_to"] for x in asof.superseded(p, r, F.lit("2020-02-01").cast("date")).collect()}
    assert got == {"1": D(2020, 3, 1), "2": D(2020, 5, 1)}


def test_asof_join_across_buckets(spark):
    ts = datetime.datetime
    v = spark.createDataFrame([(1, 10, ts(2020, 1, 1), ts(2021, 1, 1)), (1, 11, ts(2021, 1, 1), None), (2, 12, ts(2020, 1, 1), ts(2020, 1, 1))], "k int, v int, valid_from timestamp, valid_to timestamp")
    e = spark.createDataFrame([(1, ts(2020, 6, 1)), (1, ts(2021, 1, 1)), (1, ts(2019, 1, 1)), (2, ts(2020, 1, 1)), (1, ts(2025, 1, 1))], "k int, ts timestamp")
    assert sorted(r["v"] for r in asof.asof_join(e, v, "k", "ts").collect()) == [10, 11, 11]


def test_quality_metrics(spark):
    df = spark.createDataFrame([("ab�\u0000",), ("",), (None,), ("Đường",), ("|a|b|\n|c|\n",)], "t string")
    t = F.col("t")
    got = df.select(quality.null_ratio(t), quality.diacritic_density(t), quality.broken_cells(t)).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.6, 0.0), (0.0, 0.0, pytest.approx(1 / 3))]


def test_table_checks(spark):
    tables = '[{"rows": 1, "columns": 1, "cells": [{"row": 1, "column": 0, "rowspan": 1, "colspan": 2, "value": "x"}]}]'
    df = spark.createDataFrame([(tables,), ("[]",), (None,)], "j string").select(F.from_json("j", quality.TABLES).alias("t"))
    assert [tuple(r) for r in df.select(quality.missing_headers(F.col("t")), quality.bad_spans(F.col("t"))).collect()] == [(True, 1), (False, 0), (False, 0)]


def test_contract_splits(spark):
    df = spark.createDataFrame([("1/2020/QH14", "t", D(2020, 1, 1), D(2019, 1, 1), None), ("x", " ", D(2020, 1, 1), D(2020, 1, 1), D(2020, 1, 1)), ("1/2020/QH14", "t", None, None, None)], "logical_doc_id string, title string, issued_date date, effective_from date, effective_to date")
    checked = contracts.checkpoint(df, schema=contracts.field_codes(["title"]), temporal=contracts.temporal_codes())
    good, bad = contracts.split(checked)
    assert good.count() == 1
    assert rows(bad.select("codes")) == [(["DOC_ID_INVALID", "INVALID_END_DATE", "MISSING_TITLE"],), (["INVALID_START_DATE"],)]


TREE = "provision_id string, logical_doc_id string, parent_provision_id string, level string, provision_number string, provision_path string, title string"


def test_tree(spark):
    df = spark.createDataFrame(
        [("a", "d", None, "article", "1", "1", "T"), ("b", "d", "a", "clause", "2", "1.2", None), ("c", "d", "b", "point", "x", "1.x", None), ("o", "d", "zz", "clause", "1", "9.1", None), ("w", "d", "b", "clause", "3", "1.2.3", None)],
        TREE,
    )
    assert {r["provision_id"]: r["codes"] for r in structure.tree_issues(df).collect()} == {"c": ["PATH_INVALID"], "o": ["PARENT_MISSING"], "w": ["PARENT_LEVEL_INVALID"]}
    assert {r["provision_id"]: (r["root_id"], r["depth"]) for r in structure.ancestors(df).collect()}["c"] == ("a", 3)
    rules = spark.createDataFrame([("r1", "d", "*", "explicit_date", D(2020, 1, 1), None, None), ("r2", "d", "1.2", "external_trigger", None, None, "luật")], "rule_id string, logical_doc_id string, target_path string, mode string, effective_from date, effective_to date, trigger_reference string")
    state = {r["provision_id"]: (r["mode"], r["effective_from"], r["trigger_reference"]) for r in structure.resolve_effectivity(df, rules).collect()}
    assert state["a"] == ("inherit", D(2020, 1, 1), None)
    assert state["b"] == ("external_trigger", None, "luật") == state["c"]
    assert state["o"][0] == "unknown"


def test_rule_issues(spark):
    rules = spark.createDataFrame([("r1", "d", "*", "explicit_date", None, None, None), ("r2", "d", "7", "explicit_date", D(2020, 1, 1), None, None), ("r3", "d", "*", "explicit_date", D(2020, 1, 1), None, None)], "rule_id string, logical_doc_id string, target_path string, mode string, effective_from date, effective_to date, trigger_reference string")
    p = spark.createDataFrame([("d", "1")], "logical_doc_id string, provision_path string")
    got = {r["rule_id"]: r["codes"] for r in structure.rule_issues(rules, p).collect()}
    assert got == {"r1": ["FIELD_MISSING", "RULES_CONFLICT"], "r2": ["TARGET_UNKNOWN"], "r3": ["RULES_CONFLICT"]}


def test_headings_keep_the_first(spark):
    df = spark.createDataFrame([("d", 1, 1, "x\nĐiều 1. A\nĐiều 2. B"), ("d", 1, 2, "## Điều 1. again\n**Điều 3. C**"), ("d", 1, 3, None)], "logical_doc_id string, part_no int, physical_page int, raw_text string")
    got = [(r["number"], r["physical_page"], r["next_number"]) for r in structure.headings(df).orderBy("physical_page", "line_no").collect()]
    assert got == [("1", 1, "2"), ("2", 1, "3"), ("3", 2, None)]
    assert [r["page_start"] for r in structure.page_offsets(df).orderBy("physical_page").collect()] == [0, 23, 55]


def test_overlap_clips(spark):
    spans = spark.createDataFrame([("d", 0, 10), ("d", 10, 20)], "k string, span_start int, span_end int")
    pages = spark.createDataFrame([("d", 5, 10), ("d", 10, 30)], "k string, page_start int, page_end int")
    assert rows(structure.overlap(spans, pages, "k").select("from_", "to_")) == [(10, 20), (5, 10)]


def test_chunks_have_own_ids(spark):
    j = '[{"physical_file_id": "f", "global_page": 1, "text": " a b "}, {"physical_file_id": "f", "global_page": 1, "text": "c"}, {"text": null}, {"text": "d"}]'
    df = spark.createDataFrame([("p", "d", j), ("p", "d", j), ("q", "d", "[]"), ("r", "d", None)], "provision_id string, logical_doc_id string, page_segments_json string")
    made = chunking.chunks(df)
    assert sorted(r["chunk_id"] for r in made.collect()) == ["d:p:1:0:0", "d:p:1:1:0", "d:p:unknown:3:0"]
    assert rows(chunking.provenance_issues(made)) == [("d:p:unknown:3:0", ["CHUNK_PROVENANCE_INVALID"])]
    with pytest.raises(ValueError):
        chunking.chunks(df, 64, 64)


def test_upsert_and_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(lake.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(lake.upsert(old, new.filter("false"), ["k"])) == rows(old)
    assert rows(lake.same_keys(old, new, "k")) == [(1, "left"), (3, "right")]
    assert rows(lake.orphans(new, old, ["k"])) == [(3, "d")]
    assert rows(lake.merge_sets(new, old, "k", ["v"])) == [(1, "a"), (2, "b"), (3, "d")]


def test_dense_equals_brute_force_in_blocks(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 8)).astype(np.float32)
    v[7] = 0
    v[9] = v[8]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for row in retrieval.dense(df, df.filter("vec_id % 10 = 0"), 4, block=4).collect():
        got.setdefault(row["sample_id"], []).append((row["rank_no"], row["vec_id"]))
    w = v.astype(np.float64)
    norm = np.linalg.norm(w, axis=1, keepdims=True)
    w = w / np.where(norm == 0, 1, norm)
    for i in range(0, 60, 10):
        scores = np.round(w @ w[i], 6)
        assert [x for _, x in sorted(got[i])] == sorted(range(60), key=lambda j: (-scores[j], j))[:4]
    assert retrieval.dense(df, df.filter("false"), 4).count() == 0


def test_bm25_ties_and_missing(spark):
    t = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", None), ("d", "")], "id string, text string")
    q = spark.createDataFrame([("s", "x x"), ("n", "zzz"), ("e", None)], "sample_id string, question string")
    got = retrieval.bm25(t, q, 5, "id").orderBy("rank_no").collect()
    assert [(r["sample_id"], r["id"]) for r in got] == [("s", "a"), ("s", "b")]


REFS = "array<struct<logical_doc_id:string,provision_id:string,provision_path:string>>"
CHUNKS = "array<struct<chunk_id:string,logical_doc_id:string,provision_id:string,provision_path:string,text:string,effective_from:date,effective_to:date>>"


def test_scores(spark):
    chunks = [("c1", "1/2020/QH14", "p1", "1", "x ấy", D(2020, 1, 1), D(2021, 1, 1)), ("c2", "2/2020/QH14", "p2", "2", "z", None, None)]
    samples = [
        # two labels, one by id and one by path, one of them found; a cited document that is none of theirs
        ("a", "m", chunks, "x a\u0302\u0301y w\nNguồn: 9/2020/QH14; 1/2020/QH14", [("1/2020/QH14", "p1", "9"), ("2/2020/QH14", None, "3")], [], [], ["z"], D(2020, 6, 1), "effective", 1.0),
        # labelled by chunk only; no citation
        ("b", "m", chunks, "_ ?", [], ["c2", "c9"], [], ["1/2020/QH14"], D(2021, 1, 1), "effective", None),
        # nothing to judge
        ("c", "m", [], " ", [], [], [], [], None, "effective", 3.0),
        ("d", "m", chunks, None, [], [], [], [], D(2020, 6, 1), "status", 3.0),
    ]
    df = spark.createDataFrame(samples, f"sample_id string, model string, chunks {CHUNKS}, answer string, gold_provisions {REFS}, gold_chunks array<string>, gold_citations array<string>, gold_docs array<string>, t_event date, basis string, latency_ms double")
    scored = evaluation.evaluate(df, 5)
    got = {r["sample_id"]: tuple(r[m] for m in evaluation.METRICS) for r in scored.collect()}
    assert got == {"a": (0.5, 1.0, 0.5, 0.5, 1.0, 2 / 3), "b": (0.5, 0.0, 0.5, None, 0.0, 0.0), "c": (None, None, 0.0, None, None, None), "d": (None, None, 0.5, None, None, None)}
    first = evaluation.evaluate(df.filter("sample_id = 'b'"), 1).first()
    assert first["recall"] == 0.0 and first["coverage"] == 1.0
    whole = evaluation.summary(scored).first()
    assert (whole["recall"], whole["recall_judged"], whole["invalid_citations_judged"], whole["latency_ms"], whole["samples"]) == (0.5, 2, 1, 2.3, 4)
    known = spark.createDataFrame([("1/2020/QH14", "p1", "1"), ("2/2020/QH14", "p2", "2")], "logical_doc_id string, provision_id string, provision_path string")
    have = spark.createDataFrame([("c2",)], "chunk_id string")
    assert rows(evaluation.missing_labels(df, known, have)) == [("a", "3", "PATH_UNKNOWN"), ("a", "p1", "PROVISION_UNKNOWN"), ("b", "c9", "CHUNK_UNKNOWN")]
    m = spark.createDataFrame([("m", "QUARANTINE", "QUARANTINE"), ("m", "QUARANTINE", "PASSED"), ("c", "PASSED", "PASSED")], "mutation_type string, expected string, actual string")
    assert rows(evaluation.detection(m)) == [("c", 0, None), ("m", 2, 0.5)]
    assert rows(evaluation.confusion(m)) == [(1, 1, 0, 1)]
    assert rows(evaluation.detection_rate(m)) == [(2, 0.5)] and rows(evaluation.detection_rate(m.filter("mutation_type = 'c'"))) == [(0, None)]


def test_files_and_hooks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    got = files.hashed_files(spark, str(tmp_path)).collect()
    assert [r["file_hash"] for r in got] == ["2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"]
    (tmp_path / "q.json").write_text('{"samples": [{"id": "1"}, {"id": "2"}]}')
    assert files.json_records(spark, str(tmp_path / "q.json"), "samples array<struct<id:string>>", "samples").count() == 2
    hooks.register("reader", "none", lambda it: it)
    assert hooks.hook("reader", "none") and pytest.raises(KeyError, hooks.hook, "reader", "other")
    with pytest.raises(ValueError):
        files.hashed_files(spark, str(tmp_path), algorithm="crc")


def test_checkpoint_folder_comes_from_the_session(spark):
    assert cut(spark.range(3)).count() == 3
    assert checkpoint_dir(spark)


def test_stream_equals_batch(spark, folder, tmp_path):
    from chronolake.streaming import ingest

    events = spark.read.parquet(f"{folder}/events.parquet")
    source = ingest.stream(spark, folder, events.schema, "events.parquet")
    ingest.ingest(source, lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"), ["event_id"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("event_id").distinct().count()


def test_every_query_has_rows_of_a_stable_schema(spark, folder):
    import __spark_entry__ as entry
    from chronolake.plans.catalogue import QUERIES, SQL

    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert all(q(spark, folder).columns for q in QUERIES.values())


# --- parsing --------------------------------------------------------------------------------------------------------------

PAGES = "logical_doc_id string, part_no int, physical_page int, global_page int, physical_file_id string, file_path string, raw_text string, markdown_content string"


def test_articles_and_provisions(spark):
    pages = [
        ("d", 1, 1, 1, "f", "p", "LUẬT\nĐiều 1. Phạm vi\nMở đầu.\n1. Một\na) chữ a\nb) chữ b\n2) Hai", None),
        ("d", 1, 2, 2, "f", "p", "tiếp hai\n1. lặp lại\n## Diu 2a. Khác\nHết.", None),
        ("d", 2, 1, 3, "g", "q", None, "<!-- x -->còn nữa\nĐiều 1. lặp"),
        ("e", 1, 1, 1, "h", "r", None, None),
    ]
    found = parsing.articles(spark.createDataFrame(pages, PAGES))
    got = {r["article_number"]: r for r in found.collect()}
    assert set(got) == {"1", "2a"} and got["1"]["title"] == "Phạm vi" and got["2a"]["title"] == "Khác"
    assert got["1"]["content"] == "Mở đầu.\n1. Một\na) chữ a\nb) chữ b\n2) Hai\n\ntiếp hai\n1. lặp lại"
    assert got["2a"]["content"] == "Hết.\n\ncòn nữa\n\nĐiều 1. lặp" and (got["2a"]["first"]["global_page"], got["2a"]["last"]["global_page"]) == (2, 3)
    tree = {r["provision_path"]: r for r in parsing.provisions(found).collect()}
    assert set(tree) == {"1", "1.1", "1.1.a", "1.1.b", "1.2", "2a"}
    assert tree["1"]["content"] == "Mở đầu." and tree["1.1"]["content"] == "1. Một" and tree["1.1.b"]["content"] == "b) chữ b"
    assert tree["1.2"]["content"] == "2) Hai\n\ntiếp hai\n1. lặp lại" and [g["global_page"] for g in tree["1.2"]["page_segments"]] == [1, 2]
    assert tree["1.1.a"]["parent_provision_id"] == "d:provision:1.1" and tree["1.1.a"]["title"] == "Phạm vi, khoản 1, điểm a"
    assert parsing.provisions(parsing.articles(spark.createDataFrame([], PAGES))).count() == 0


def test_rules_of_effect(spark):
    said = (
        "Ngày 1 tháng 1 năm 2001 có nghị quyết. Luật này có hiệu lực khi được công bố; Luật này có hiệu lực thi hành kể từ ngày 2 tháng 3 năm 2004; Điểm a Khoản 2 Điều 5, Khoản 1 Điều 6 và Điều 7b có hiệu lực từ ngày 2004-05-06. "
        "Điều 9 có hiệu lực vào ngày Chính phủ định. Bản án có hiệu lực pháp luật. Nghị định này có hiệu lực từ ngày 31/2/2004"
    )
    rules = parsing.effect_rules(spark.createDataFrame([("d", said), ("e", None)], "k string, t string"), ["k"], "t")
    got = [(r["target_path"], r["mode"], r["effective_from"]) for r in rules.orderBy("place").collect()]
    assert got == [
        ("*", "explicit_date", D(2004, 3, 2)), ("5.2.a", "explicit_date", D(2004, 5, 6)), ("6.1", "explicit_date", D(2004, 5, 6)), ("7b", "explicit_date", D(2004, 5, 6)),
        ("9", "external_trigger", None), ("*", "external_trigger", None),
    ]
    kept = parsing.document_rules(rules, "k", ["place"])
    assert kept.filter("target_path = '*'").count() == 1 and kept.count() == 5
    assert rows(parsing.article_dates(rules, "k", ["place"])) == [("d", "7b", D(2004, 5, 6)), ("d", None, D(2004, 3, 2))]


def test_openings(spark):
    df = spark.createDataFrame([("## NGHỊ ĐỊNH số 5/2020/ND-CP **\nvề x", None), ("không số", "7/2020/TT-BXD"), ("a <!-- b\n --> c", None)], "t string, o string")
    number = text.head_id(F.col("t"), F.col("o"))
    got = df.select(number, text.document_type(F.col("t"), number), text.document_title(F.col("t"), number, text.document_type(F.col("t"), number)), text.content_id(F.col("t"))).collect()
    assert tuple(got[0])[:3] == ("5/2020/NĐ-CP", "Nghị định", "Nghị định 5/2020/NĐ-CP") and tuple(got[1])[:3] == ("7/2020/TT-BXD", "Thông tư", "Thông tư 7/2020/TT-BXD")
    assert got[2][3] == "DOC-" + hashlib.sha256("a c".encode()).hexdigest()[:24]


# --- ranking --------------------------------------------------------------------------------------------------------------


def brute_temporal(chunks, question, t, basis, ends, k):
    words = lambda s: re.findall(r"\w+", (s or "").lower())
    grams = lambda w: {tuple(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}
    fit = []
    for c in chunks:
        end = min([e for e in (c["effective_to"], ends.get(c["chunk_id"])) if e], default=None)
        if (c["issued_date"] and c["issued_date"] <= t) if basis != "effective" else (c["effective_from"] and c["effective_from"] <= t and (end is None or t < end)):
            fit.append(c)
    own = {c["chunk_id"]: words(c["text"]) for c in fit}
    mean = max(sum(map(len, own.values())) / max(len(own), 1), 1.0)
    idf = lambda df: math.log(1 + (len(fit) - df + 0.5) / (df + 0.5))
    q = words(question)
    scored = []
    for c in fit:
        w = own[c["chunk_id"]]
        s = sum(idf(sum(x in o for o in own.values())) * w.count(x) * 2.5 / (w.count(x) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for x in q if x in w)
        s += sum({2: 1.0, 3: 1.4}[len(g)] * idf(sum(g in grams(o) for o in own.values())) for g in grams(q) & grams(w))
        s += 8 * (c["logical_doc_id"].lower() in question.lower()) + 20 * ("hiệu lực" in question and t.strftime("%d/%m/%Y") in (c["text"] or ""))
        if round(s, 6) > 0:
            scored.append((-round(s, 6), c["chunk_id"], c["provision_id"] or c["chunk_id"]))
    out, seen = [], set()
    for s, i, p in sorted(scored):
        if p not in seen:
            seen.add(p)
            out.append((i, -s))
    return out[:k]


@pytest.mark.parametrize("block", [2, 100])
def test_temporal_ranking_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "TEXTS", 7)
    monkeypatch.setitem(ranking.rank.__kwdefaults__, "block", block)
    r = random.Random(4)
    day = lambda: D(2020, r.randint(1, 12), 1)
    vocabulary = "a b c d e ngày 01/06/2020".split()
    names = "chunk_id logical_doc_id provision_id provision_path text issued_date effective_from effective_to".split()
    chunks = [
        dict(zip(names, (f"c{i:02}", f"{i % 3}/2020/QH14", r.choice([None, f"p{i // 2}"]), str(i % 5), " ".join(r.choices(vocabulary, k=r.randint(0, 12))) if i else None, day(), r.choice([None, day()]), r.choice([None, day()]))))
        for i in range(40)
    ]
    questions = [(f"q{i}", " ".join(r.choices("a b c d e".split(), k=5)) + r.choice(["", " hiệu lực", " 1/2020/qh14"]), D(2020, 6, 1), r.choice(["issued", "effective", "status"])) for i in range(7)] + [("none", "a b", None, "effective")]
    rules = [("1/2020/QH14", None, None, "1", D(2020, 3, 1)), ("2/2020/QH14", None, "p4", "3", D(2020, 2, 1)), ("0/2020/QH14", "c06", None, None, D(2020, 1, 15))]
    ends = {}
    for doc, c_id, p_id, path, end in rules:
        for c in chunks:
            if c["logical_doc_id"] == doc and all(x is None or x == y for x, y in ((c_id, c["chunk_id"]), (p_id, c["provision_id"]), (path, c["provision_path"]))):
                ends[c["chunk_id"]] = min(end, ends.get(c["chunk_id"], end))
    df = spark.createDataFrame([tuple(c[n] for n in names) for c in chunks], "chunk_id string, logical_doc_id string, provision_id string, provision_path string, text string, issued_date date, effective_from date, effective_to date")
    asked = spark.createDataFrame(questions, "sample_id string, question string, t date, basis string")
    told = spark.createDataFrame(rules, "target_logical_doc_id string, target_chunk_id string, target_provision_id string, target_provision_path string, effective_to date")
    got: dict = {}
    for x in ranking.temporal(df, asked, 4, told).orderBy("sample_id", "rank_no").collect():
        got.setdefault(x["sample_id"], []).append((x["chunk_id"], x["score"]))
    want = {s: found for s, q, t, b in questions if t and (found := brute_temporal(chunks, q, t, b, ends, 4))}
    assert {s: [i for i, _ in f] for s, f in got.items()} == {s: [i for i, _ in f] for s, f in want.items()}
    assert all(abs(x - y) < 2e-6 for s in want for (_, x), (_, y) in zip(got[s], want[s]))
    assert ranking.temporal(df, asked, 0, told).count() == 0 and ranking.temporal(df.limit(0), asked, 3, told).count() == 0


def _phrase_texts(r, n, most):
    """Texts whose words are more and less common."""
    vocabulary = [f"w{i}" for i in range(60)]
    return [" ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=r.randint(0, most))) for _ in range(n)]


def test_few_texts_are_scored_and_none_is_missed(spark, monkeypatch):
    r = random.Random(5)
    day = lambda: r.randint(0, 400)
    texts = [(f"t{i:04}", w, day(), r.choice([None, day(), day()])) for i, w in enumerate(_phrase_texts(r, 3000, 40))]
    asked = [(f"q{i:02}", w + " w40 w50", day()) for i, w in enumerate(_phrase_texts(r, 40, 9))]
    # in one process, to see what is scored
    far = ranking.NEVER
    batch = pa.table({
        "id": [x[0] for x in texts], "group": [x[0] for x in texts], "doc": pa.nulls(3000, pa.string()), "text": [x[1] for x in texts], "issued": pa.array([far] * 3000, pa.int32()),
        "start": pa.array([x[2] for x in texts], pa.int32()), "end": pa.array([far if x[3] is None else x[3] for x in texts], pa.int32()), "stated": pa.nulls(3000),
    }).to_batches()
    block = ranking._block([{"sample_id": s, "question": q, "day": t, "by_issue": False, "docs": None, "effect": False} for s, q, t in asked], True, False)
    told = types.SimpleNamespace(value=block)
    coded = list(ranking._code(told, 1000, True)(iter(batch)))
    ranking._weigh(block, [x for b in ranking._count(told, 1000)(iter(coded)) for x in b.to_pylist()])
    low: dict = {}
    for b in ranking._floors(told, 3, 1.0, 1000, 1)(iter(coded)):
        for x in b.to_pylist():
            low.setdefault(x["q"], []).append(x["score"])
    for q, found in low.items():
        block.floor[q] = sorted(found)[-3] - ranking.SLACK if len(found) >= 3 else 0.0
    scored, exact = [], ranking._exact
    monkeypatch.setattr(ranking, "_exact", lambda texts, rows, *rest: (scored.append(len(rows)), exact(texts, rows, *rest))[1])
    found = [x for b in ranking._score(told, 3, 1.0, 1000)(iter(coded)) for x in b.to_pylist()]
    assert 0 < sum(scored) < 0.02 * len(texts) * len(asked)
    # by hand
    want = {}
    for s, q, t in asked:
        fit = {i: w.split() for i, w, a, z in texts if a <= t and (z is None or z > t)}
        mean = max(sum(map(len, fit.values())) / len(fit), 1.0)
        idf = {x: math.log(1 + (len(fit) - n + 0.5) / (n + 0.5)) for x in set(q.split()) for n in [sum(x in w for w in fit.values())]}
        score = {i: round(sum(idf[x] * w.count(x) * 2.5 / (w.count(x) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for x in q.split()), 6) for i, w in fit.items()}
        want[s] = sorted(((-v, i) for i, v in score.items() if v > 0))[:3]
    got: dict = {}
    for x in found:
        got.setdefault(x["sample_id"], []).append((-x["score"], x["id"]))
    assert all([i for _, i in sorted(got[s])[:3]] == [i for _, i in want[s]] and all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(sorted(got[s]), want[s])) for s in want)
    # and in Spark, over several tasks
    start = lambda n: D(2020, 1, 1) + datetime.timedelta(n)
    rows = spark.createDataFrame([(i, w, start(a), z if z is None else start(z)) for i, w, a, z in texts], "id string, text string, effective_from date, effective_to date").repartition(5)
    questions = spark.createDataFrame([(s, q, start(t)) for s, q, t in asked], "sample_id string, question string, t date")
    got = {}
    for x in retrieval.asof_bm25(rows, questions, 3, "id").orderBy("sample_id", "rank_no").collect():
        got.setdefault(x["sample_id"], []).append(x["id"])
    assert got == {s: [i for _, i in found] for s, found in want.items()}


def test_phrases_rank_without_pairs_of_questions_and_texts(spark, folder):
    r = random.Random(6)
    # every question and every third text has the same phrase
    texts = spark.createDataFrame([(f"t{i:03}", w + " common phrase here" * (i % 3 == 0)) for i, w in enumerate(_phrase_texts(r, 300, 30))] + [("null", None)], "id string, text string")
    asked = spark.createDataFrame([(f"q{i:02}", w + " common phrase here common phrase") for i, w in enumerate(_phrase_texts(r, 30, 12))] + [("short", "w1"), ("null", None)], "sample_id string, question string")
    pairs = retrieval.phrase_bonus(texts, asked, "id").select("sample_id", "id", F.round("bonus", 6).alias("score"))
    assert rows(retrieval.phrases(texts.repartition(3), asked.withColumn("t", F.lit(None).cast("date")), 4, "id")) == rows(retrieval.top(pairs, 4, "id"))
    plan = catalogue.QUERIES["phrase_topk"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_temporal_makes_its_chunks_twice_at_most(spark, folder):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # once to find the ends and once to get them; the rules read two tables
    assert plan(legal.chunk_ends(spark, folder)).count("Relation [") <= 4
    # and not again beside the scores: texts come from the checkpoint
    assert "content#" not in plan(legal.temporal_topk(spark, folder))


def test_a_rule_without_scope_is_refused(spark):
    told = spark.createDataFrame([("1/2020/QH14", None, None, "", D(2020, 3, 1))], "target_logical_doc_id string, target_chunk_id string, target_provision_id string, target_provision_path string, effective_to date")
    with pytest.raises(Exception, match="supersession rule"):
        ranking.superseding(told).collect()


# --- contracts, lake, settings --------------------------------------------------------------------------------------------


def test_named_checkpoints(spark):
    fields_ = "doc_id string, title string, issued_date date, effective_from date, effective_to date, doc_type string, storage_path string, doc_version_hash string"
    good = ("1/2020/QH14", "T", D(2020, 1, 1), D(2020, 1, 1), None, None, "p", "AB")
    rows_ = [good, ("2/2020/QH14", " ", *good[2:]), ("3/2020/QH14", *good[1:6], None, "ab"), ("4/2020/QH14", *good[1:6], "gone", "ab"), ("5/2020/QH14", *good[1:7], None), ("6/2020/QH14", *good[1:7], "cd"), ("7/2020/QH14", *good[1:6], "bad", "ab"), (None, *good[1:])]
    documents = contracts.with_file_hashes(spark.createDataFrame(rows_, fields_), spark.createDataFrame([("p", "ab"), ("bad", None)], "path string, file_hash string"))
    checked = contracts.named_checkpoint(documents, "bronze")
    assert {r["doc_id"]: r["codes"] for r in checked.collect()} == {
        "1/2020/QH14": [], "2/2020/QH14": ["SCHEMA_VIOLATION"], "3/2020/QH14": ["STORAGE_PATH_MISSING"], "4/2020/QH14": ["SOURCE_FILE_NOT_FOUND"], "5/2020/QH14": ["DOCUMENT_HASH_MISSING"],
        "6/2020/QH14": ["DOCUMENT_HASH_MISMATCH"], "7/2020/QH14": ["SOURCE_HASH_FAILED"], None: ["SCHEMA_VIOLATION"],
    }
    reports = contracts.quarantine_reports(checked)
    assert {r["report_name"] for r in reports.collect()} >= {"2_2020_QH14", "unknown"}
    sha = lambda i, v, t: hashlib.sha256(f"chunk_id={i}\ndoc_version_hash={v}\ntext={t}".encode()).hexdigest()
    chunks = [("1/2020/QH14", "a", "1/2020/QH14", "p", 1, "x", "ab", sha("a", "ab", "x")), ("1/2020/QH14", "b", "x", None, 1, "x", "old", "no"), ("1/2020/QH14", "c", "1/2020/QH14", "p", 0, "x", "ab", "no"), ("2/2020/QH14", "d", "2/2020/QH14", "p", 1, "x", "ab", sha("d", "ab", "x").upper())]
    made = spark.createDataFrame(chunks, "of_doc string, chunk_id string, chunk_doc_id string, provision_id string, page_number int, text string, chunk_version string, chunk_hash string")
    got = {r["doc_id"]: r["chunk_issues"] for r in contracts.chunk_provenance(documents, made).collect()}
    assert got["1/2020/QH14"] == ["CHUNK_DOCUMENT_HASH_MISMATCH", "CHUNK_DOC_ID_MISMATCH", "CHUNK_HASH_MISMATCH", "CHUNK_PROVENANCE_INVALID", "PROVISION_ID_MISSING"]
    assert got["2/2020/QH14"] == [] and got["3/2020/QH14"] == ["CHUNKS_MISSING"]


def test_spans_of_cells(spark):
    cells = '[{"rows": 2, "columns": 2, "cells": [{"value": "a"}, {"row": 1, "column": 1, "colspan": 2}, {"row": "x"}, {"row": -1}, {"rowspan": 0}, {"row": 1.5}]}, {"rows": 0, "columns": 2, "cells": [{"row": 9}]}, {"cells": [{"row": 9}]}]'
    df = spark.createDataFrame([(cells,), ("[]",), (None,)], "t string")
    assert [r[0] for r in df.select(quality.bad_spans(F.from_json("t", quality.RAW_TABLES))).collect()] == [5, 0, 0]
    df = spark.createDataFrame([([["a", "b"], ["c"]],), ([],), (None,)], "r array<array<string>>")
    got = [r[0] for r in df.select(tables.normalised(F.col("r"))).collect()]
    assert [(c["row"], c["column"], c["value"]) for c in got[0]["cells"]] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, None)] and got[1]["cells"] == got[2]["cells"] == []


def test_upserts_refuse(spark):
    page = "logical_doc_id string, part_no int, physical_page int, file_path string, created_at timestamp"
    parts = spark.createDataFrame([("d", 1, "new")], "logical_doc_id string, part_no int, file_path string")
    at = datetime.datetime(2020, 1, 1)
    new = spark.createDataFrame([("d", 1, 1, "old", at)], page)
    assert lake.upsert_pages(new.limit(0), new, parts).first()["file_path"] == "new"
    with pytest.raises(Exception, match="no part in Bronze"):
        lake.upsert_pages(new.limit(0), spark.createDataFrame([("e", 1, 1, "old", at)], page), parts).collect()
    gold = "chunk_id string, logical_doc_id string, doc_version_hash string, chunk_hash string, physical_file_id string, global_page int, text_content string, provision_id string, effectivity_mode string"
    fine = ("c", "d", "v", "h", "f", 1, "t", "p", "inherit")
    silver = spark.createDataFrame([("p",)], "provision_id string")
    ok = spark.createDataFrame([fine], gold)
    assert lake.upsert_gold(ok.limit(0), ok, silver).count() == 1
    for bad, says in (((*fine[:6], "", *fine[7:]), "missing"), ((*fine[:7], "q", "inherit"), "not in Silver"), ((*fine[:8], "maybe"), "unknown mode")):
        with pytest.raises(Exception, match=says):
            lake.upsert_gold(ok.limit(0), spark.createDataFrame([bad], gold), silver).collect()


def test_cache_and_listing(spark):
    cache = spark.createDataFrame([("a", "m", 9, "x"), ("b", "m", 8, "y")], "sample_id string, model string, version int, answer string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    assert rows(lake.not_cached(asked, cache, "m")) == [("b",), ("c",)]
    kept = lake.cached(cache, spark.createDataFrame([("b", "z")], "sample_id string, answer string"), "m")
    assert rows(kept) == [("a", "m", 9, "x"), ("b", "m", 9, "z")] and rows(lake.not_cached(asked, kept, "m")) == [("c",)]
    df = spark.range(0, 100, 1, 7).select(F.pmod(F.col("id") * 37, F.lit(100)).alias("x"))
    assert sorted(rows(lake.numbered(lake.listing(df, "x")))) == [(i, i) for i in range(100)]
    assert lake.numbered(lake.listing(df.limit(0), "x")).count() == 0


def test_export_happens_after_failure_too(spark, tmp_path):
    def fails():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        lake.export_all({"t": spark.range(3)}, str(tmp_path), fails)
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == 3


def test_settings_and_lazy_hooks(tmp_path):
    (tmp_path / "s.json").write_text('{"retrieval": {"top_k": 7}}')
    assert config.Settings.read(str(tmp_path / "s.json")).retrieval.top_k == 7 and config.Settings().chunking.size == 512
    (tmp_path / "t.json").write_text('{"retrieval": {"topk": 7}}')
    with pytest.raises(ValueError):
        config.Settings.read(str(tmp_path / "t.json"))
    (tmp_path / "l.json").write_text('{"null_ratio": 0.5, "required": ["title"]}')
    assert contracts.Limits.read(str(tmp_path / "l.json")).required == ("title",)
    assert hooks.hook("retriever", "temporal") is ranking.temporal


def test_segments_are_checked_and_ordered(spark):
    seg = lambda page, t: f'{{"physical_file_id": "f", "global_page": {page}, "text": "{t}"}}'
    df = spark.createDataFrame([("p", "d", f'[{seg("null", "z")}, {seg(2, "b")}, {seg(1, " ")}, {seg(1, "a")}]'), ("q", "d", "[]"), ("r", "d", None)], "provision_id string, logical_doc_id string, page_segments_json string")
    assert [r["text"] for r in chunking.segments(df).orderBy("page_order").collect()] == ["a", "b", "z"]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        chunking.segments(spark.createDataFrame([("p", "d", "{oops")], df.schema)).collect()
    with pytest.raises(Exception, match="another document"):
        chunking.checked_provisions(df, "other").collect()


def test_blocks_keep_keys_together(spark):
    df = spark.createDataFrame([(k,) for k in [1, 2, 2, 2, 3, None, 4]], "k int")
    assert [[r["k"] for r in part] for part in session.blocks(df, "k", 2)] == [[1, 2, 2, 2], [3, 4]]
