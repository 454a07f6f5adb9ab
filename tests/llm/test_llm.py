from __future__ import annotations

import base64
import random
import re
from itertools import combinations
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolake.llm import bpe, distinctive, near, packing, pages, personal, queries, split, unify

# --- 6 --------------------------------------------------------------------------------------------------------------------

ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary(), "rb"))}
public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aab  \n\t'sđệ 　́\x1c")), max_size=60))
def test_ids_equal_the_public_encoder(text):
    assert bpe.encoder(bpe.vocabulary()).encode(text) == public.encode_ordinary(text)


def test_ids_of_long_runs_and_special_strings():
    own = bpe.encoder(bpe.vocabulary())
    for text in ("a" * 20_000, "<|endoftext|>", "đ" * 3001, " " * 999 + "x"):
        assert own.encode(text) == public.encode_ordinary(text)


def test_pair_tree_is_leftmost():
    tree = bpe.PairTree([3, 1, 1, 2])
    assert tree.least() == 1
    tree.put(1, 9)
    assert tree.least() == 2


def test_ids_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "ab", None), (3, "ab", None)], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode(df, ["doc_id"]).collect())
    assert got == [(1, []), (2, []), (3, public.encode_ordinary("ab")), (3, public.encode_ordinary("ab"))]
    assert bpe.encode(df.filter("false"), ["doc_id"]).count() == 0


# --- 7 --------------------------------------------------------------------------------------------------------------------


def brute_nnls(a, b):
    best = np.inf
    for k in range(a.shape[1] + 1):
        for c in combinations(range(a.shape[1]), k):
            x = np.linalg.lstsq(a[:, list(c)], b, rcond=None)[0] if c else np.zeros(0)
            if (x >= -1e-9).all():
                best = min(best, np.linalg.norm(a[:, list(c)] @ x - b if c else b))
    return best


def test_nnls_is_optimal():
    r = np.random.default_rng(0)
    for _ in range(20):
        a, b = r.normal(size=(5, 6)), r.normal(size=5)
        x = packing.nnls(a, b)
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= brute_nnls(a, b) + 1e-6


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=40))
def test_plans_hold_every_item_once(histogram):
    plan = packing.make_plan(histogram, 64, 16, 3)
    held: dict[int, int] = {}
    for sizes, n, _ in plan.runs:
        assert sum(sizes) <= 64 and n > 0
        for s in sizes:
            held[s] = held.get(s, 0) + n
    assert held == histogram
    total = sum(s * n for s, n in histogram.items())
    assert plan.containers <= 11 / 9 * -(-total // 64) + 2 or max(histogram, default=0) > 32


@pytest.mark.parametrize("seed, times", [(1, 1), (2, 1), (3, 10), (4, 1000)])
def test_combinations_need_no_more_containers_than_greedy_packing_alone(seed, times):
    sizes = np.clip(np.random.default_rng(seed).lognormal(6.5, 1.0, 5000), 1, 4096).astype(int)
    values, counts = np.unique(sizes, return_counts=True)
    histogram = dict(zip(values.tolist(), (counts * times).tolist()))
    plan = packing.make_plan(histogram)
    assert plan.containers <= packing.make_plan(histogram, depth=0).containers
    held: dict[int, int] = {}
    for own, n, _ in plan.runs:
        for size in own:
            held[size] = held.get(size, 0) + n
    assert held == histogram
    assert sum(n for own, n, _ in plan.runs if sum(own) == 4096 and 1 < len(own) < 4) > 0.1 * plan.containers


def test_containers(spark):
    r = random.Random(3)
    sizes = [(i, r.choice([0, 1, 5, 30, 30, 30, 63, 64, 65, 200])) for i in range(500)] + [(900, None)]
    df = spark.createDataFrame(sizes, "id long, size long")
    got = packing.pack(df, 64, 16, 3, bucket_rows=20).collect()
    assert {x["id"] for x in got} == {i for i, _ in sizes}
    used: dict[int, list] = {}
    whole: dict[int, int] = {}
    for x in got:
        whole[x["id"]] = whole.get(x["id"], 0) + x["n_tokens"]
        if x["n_tokens"]:
            used.setdefault(x["container_id"], []).append((x["container_offset"], x["n_tokens"]))
        else:
            assert x["container_id"] is None
    assert whole == {i: n or 0 for i, n in sizes}
    for spans in used.values():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 64
    for i, n in sizes:
        pieces = sorted(x["n_tokens"] for x in got if x["id"] == i)
        assert len(pieces) == max(1, -(-(n or 0) // 64))
    assert packing.pack(df.filter("false"), 64, 16).count() == 0


# --- 3 --------------------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=80), st.data())
def test_strongest_cut_is_the_rightmost_maximum(values, data):
    table = split.StrongestCut(np.array(values))
    a = data.draw(st.integers(0, len(values) - 1))
    b = data.draw(st.integers(a, len(values) - 1))
    assert table.query(a, b) == max(range(a, b + 1), key=lambda i: (values[i], i))


def test_pieces_cover_and_overlap():
    r = random.Random(1)
    text = "".join("w%d%s" % (i, r.choice([" ", " ", ", ", ". ", "; ", "\n", "\n\n", " ", ".\n1. "])) for i in range(3000))
    words = split._RUN.findall(text)
    got = split.pieces(text)
    assert got[0][0] == 0 and got[-1][1] == len(words) and got[-1][2] == -1
    for (a, b, _, piece), (c, *_) in zip(got, got[1:]):
        assert b - c == split.OVERLAP
    for a, b, strength, piece in got:
        assert 0 < b - a <= split.LIMIT and split._RUN.findall(piece) == words[a:b]


@pytest.mark.parametrize("n, pieces", [(0, 0), (512, 0), (513, 2), (960, 2), (961, 3)])
def test_pieces_without_boundaries(n, pieces):
    assert len(split.pieces(" ".join(["w"] * n))) == pieces


def test_oversized_provisions(spark):
    long, short = " ".join(["từ"] * 513), "a b"
    j = '[{"text": "a"}, {"text": null}, {"text": "%s"}]' % long
    rows = [("p", long, j), ("p", long, j), ("q", short, "[]"), ("r", None, None), ("s", "x" * 5000, "not json"), (None, long, "[]")]
    df = spark.createDataFrame(rows, "provision_id string, content string, page_segments_json string").withColumn("text", F.lit(1)).withColumn("piece", F.lit(2))
    got = split.oversized(split.split_oversized(split.provision_texts(df)))
    assert sorted(map(tuple, got.collect()), key=str) == [("p", 0), ("p", 3), (None, 0)]
    assert split.split_oversized(split.provision_texts(df.filter("false"))).count() == 0


# --- 2 --------------------------------------------------------------------------------------------------------------------


def brute_scores(texts, mu=1000.0, min_df=2):
    import math
    from collections import Counter

    docs = {key: Counter(re.findall(r"\w+", t.lower())) for key, t in texts.items()}
    cf, df = Counter(), Counter()
    for d in docs.values():
        cf.update(d)
        df.update(d.keys())
    total = sum(cf.values())
    out = {}
    for key, d in docs.items():
        n = sum(d.values())
        for w, tf in d.items():
            q = cf[w] / total
            p = (tf + mu * q) / (n + mu)
            out[(*key, w)] = round(p * math.log(p / q), 6) if df[w] >= min_df else 0.0
    return out


@pytest.mark.parametrize("hot", [1000, 3, 1])
def test_distinctive_terms(spark, hot):
    texts = {("t", "a"): "x y y z", ("t", "b"): "x y q", ("u", "a"): "x z z z z"}
    rows = [(s, i, t) for (s, i), t in texts.items()] + [("t", "a", "x y y z"), ("t", "n", None), ("t", "e", ""), ("t", "w", " ,.")]
    df = spark.createDataFrame(rows, "source_table string, record_id string, text string").withColumn("term", F.lit(1))
    got = {(r["source_table"], r["record_id"], r["term"]): r["score"] for r in distinctive.distinctive_terms(df, hot_terms=hot).collect()}
    want = brute_scores(texts)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert distinctive.distinctive_terms(df.filter("false")).count() == 0


# --- 4 --------------------------------------------------------------------------------------------------------------------


def near_texts():
    r = random.Random(5)
    vocabulary = ["w%d" % i for i in range(40)]
    out = []
    for g in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([69, 70, 71, 90, 150, 400]))]
        for k in range(r.randint(1, 5)):
            t = list(base)
            for _ in range(r.randint(0, len(t) // 10)):
                at = r.randrange(len(t))
                t[at : at + r.randint(0, 2)] = [r.choice(vocabulary)] * r.randint(0, 2)
            out.append((r.randint(0, 1), f"{g}-{k}", " ".join(t).upper() if k == 3 else " ".join(t)))
    out += [(0, "copy", out[0][2]), (0, "copy", out[0][2]), (0, None, out[0][2]), (0, "null", None), (0, "empty", ""), (1, "few", "a b c")]
    return out


def brute_pairs(rows, t):
    sets: dict = {}
    for s, i, x in rows:
        w = (x or "").lower().split()
        if i is not None and len(w) >= 70:
            sets[s, i] = set(zip(w, w[1:], w[2:]))
    return {
        (near.SOURCES[a[0]], min(a[1], b[1]), max(a[1], b[1]))
        for a, b in combinations(sorted(sets), 2)
        if a[0] == b[0] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])
    }


@pytest.mark.parametrize("threshold, load, share", [(Fraction(3, 5), 0.8, 20_000), (Fraction(3, 5), 3.0, 2), (Fraction(4, 5), 1.5, 1)])
def test_pairs_equal_brute_force(spark, threshold, load, share):
    rows = near_texts()
    df = spark.createDataFrame(rows, "source int, id string, text string").withColumn("doc", F.lit(1))
    members, pairs = near.similar_texts(df, threshold, load=load, share=share, counters=1 << 10)
    got = {tuple(r) for r in near.id_pairs(members, pairs).collect()}
    assert got == brute_pairs(rows, threshold)


def test_groups_are_components(spark):
    rows = near_texts()
    df = spark.createDataFrame(rows, "source int, id string, text string")
    members, pairs = near.similar_texts(df)
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, a, b in brute_pairs(rows, Fraction(3, 5)):
        x, y = sorted((root((s, a)), root((s, b))))
        parent[y] = x
    got = {(r["source_table"], r["id"]): (r["source_table"], r["group_id"]) for r in near.id_groups(members, near.groups(pairs)).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_the_number_of_parts_changes_no_pair(spark):
    df = spark.createDataFrame(near_texts(), "source int, id string, text string")
    found = [{tuple(r) for r in near.id_pairs(*near.similar_texts(df, Fraction(1, 2), parts=parts)).collect()} for parts in (1, 300)]
    assert found[0] == found[1] and found[0]


def test_bytes_on_the_way_are_bounded_whatever_the_number_of_parts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 48, int(n), dtype=np.uint64)) for n in rng.integers(60, 150, 500)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(sets)), pa.array(range(len(sets))), pa.array([near.packed(s) for s in sets], pa.binary())], names=["source", "no", "shingles"])
    bands, whole = near.Bands(near.THRESHOLD, near.LOAD), sum(len(s) for s in sets) * near.BYTES
    index, _, band = near.Sets(batch).index(bands)
    groups = {int(g): int(n) for g, n in enumerate(np.bincount(band)) if n}

    def sent(parts: int) -> tuple[float, float]:
        class Told:
            value = np.zeros(1 << 20, np.uint32), near.Parts(groups, parts)

        (out,) = near._emit(near.THRESHOLD, near.LOAD, Told, near.SHARE)(iter([batch]))
        return tuple(sum(len(x) for i in of for x in out.column(i).to_pylist()) / whole for of in ((5,), range(2, 6)))

    few, many, most = (sent(parts) for parts in (6, 700, 100_000))
    assert few[0] == many[0] == most[0] < 1.1  # the entries themselves
    # Heads and parities: once for each entry at most.
    entry = near.SHORT + near._HEAD.itemsize + 8 * int(bands.words[bands.of(np.array([150]))][0])
    assert few[1] < 1.5 and many[1] <= most[1] <= few[0] / near.SHORT * entry


def matched(sets, monkeypatch, load=near.LOAD):
    """The pairs that the look-up of one part finds, and how many it had to look at."""
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(sets)), pa.array(range(len(sets))), pa.array([near.packed(s) for s in sets], pa.binary())], names=["source", "no", "shingles"])
    index, _, band = near.Sets(batch).index(near.Bands(near.THRESHOLD, load))

    class Told:
        value = np.bincount((index & np.uint64((1 << 16) - 1)).astype(np.int64), minlength=1 << 16).astype(np.uint32), near.Parts({0: 1}, 1)

    looked, apart = [0], near.apart

    def counting(flat, start, words, x, y):
        looked[0] += len(x)
        return apart(flat, start, words, x, y)

    monkeypatch.setattr(near, "apart", counting)
    sent = list(near._emit(near.THRESHOLD, load, Told, near.SHARE)(iter([batch])))
    pairs = [(x, y) for out in near._match(near.THRESHOLD, load)(iter(sent)) for x, y in zip(*(out.column(i).to_pylist() for i in range(2)))]
    return pairs, looked[0]


def phrase_sets(many: int, seed: int = 3):
    """Sets of 70 to 150 shingles, nearly all of a few phrases, and for every tenth a near copy of another size."""
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 1 << 48, (60, 15), dtype=np.uint64)
    sets: list[np.ndarray] = []
    for i in range(many):
        n = int(rng.integers(70, 151))
        own = np.unique(np.r_[common[rng.choice(60, 10, replace=False)].ravel()[: n - 8], rng.integers(0, 1 << 48, 8, dtype=np.uint64)])
        sets.append(own)
        if i % 10 == 0:
            sets.append(rng.choice(own, int(len(own) * rng.uniform(0.6, 1.0)), replace=False))
    return [np.unique(s) for s in sets]


def test_a_look_up_meets_only_sizes_that_still_need_it(monkeypatch):
    sets = phrase_sets(1_000)
    pairs, looked = matched(sets, monkeypatch)
    held = {frozenset(p) for p in pairs}
    owners: dict = {}
    for i, s in enumerate(sets):
        for x in s.tolist():
            owners.setdefault(x, []).append(i)
    shared: dict = {}
    for who in owners.values():
        for p in combinations(who, 2):
            shared[p] = shared.get(p, 0) + 1
    true = {frozenset((i, j)) for (i, j), k in shared.items() if 5 * k >= 3 * (len(sets[i]) + len(sets[j]) - k)}
    assert len(true) >= 50 and true <= held
    assert looked < 100_000


def test_no_texts_no_pairs(spark):
    df = spark.createDataFrame([], "source int, id string, text string")
    assert near.id_pairs(*near.similar_texts(df)).count() == 0


def test_parities_never_exceed_the_difference():
    r = np.random.default_rng(2)
    bands = near.Bands(Fraction(3, 5), 1.0)

    base = [np.unique(r.integers(0, 1 << 40, n).astype(np.uint64)) for n in (60, 90, 150, 300)]
    sets = base + [np.unique(np.r_[b[: len(b) * 3 // 4], r.integers(0, 1 << 40, 40).astype(np.uint64)]) for b in base]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(sets)), pa.array(range(len(sets))), pa.array([near.packed(s) for s in sets], pa.binary())], names=["source", "no", "shingles"])
    one = near.Sets(batch)
    flat, words = one.parities(bands)
    x, y = map(np.array, zip(*combinations(range(len(sets)), 2)))
    apart = near.apart(flat, np.cumsum(words) - words, words, x, y)
    for i, j, d in zip(x, y, apart):
        assert d <= len(np.setxor1d(sets[i], sets[j]))


def test_parities_of_different_lengths_are_folded():
    r = np.random.default_rng(4)
    words = r.choice([3, 6, 12], 40)
    start = np.cumsum(words) - words
    flat = r.integers(0, 1 << 63, int(words.sum()), dtype=np.uint64)
    x, y = map(np.array, zip(*combinations(range(40), 2)))
    expected = []
    for i, j in zip(x, y):
        low = min(words[i], words[j])
        both = [np.bitwise_xor.reduce(flat[start[k] : start[k] + words[k]].reshape(-1, low), axis=0) for k in (i, j)]
        expected.append(int(np.bitwise_count(both[0] ^ both[1]).sum()))
    assert near.apart(flat, start, words, x, y).tolist() == expected


# --- 5 --------------------------------------------------------------------------------------------------------------------


def test_unify_kinds_and_repairs(spark):
    clean = "Điều khoản của cơ quan chậm nhất m² ½ µm"
    rows = [
        ("t", "1", clean), ("t", "2", "cơ quan ｃủａ"), ("t", "3", "của c​ơ"), ("t", "4", "сủа cơ quаn"), ("t", "5", "«Товар» μέτρον 5 Ω α"),
        ("t", "6", "xуz"), ("t", "7", None), ("t", "8", ""), ("t", "4", "сủа cơ quаn"), ("t", "9", "Ðiều"),
    ]
    df = spark.createDataFrame(rows, "source_table string, row_key string, text string").withColumn("kind", F.lit(1))
    got = {tuple(r)[1:] for r in unify.found_kinds(df).collect()}
    assert got == {("2", "space"), ("2", "fullwidth"), ("3", "decomposed"), ("3", "invisible"), ("4", "lookalike"), ("9", "lookalike")}
    texts = {r["row_key"]: r["text"] for r in unify.unified(df).collect()}
    assert texts["1"] == clean and texts["2"] == "cơ quan của" and texts["3"] == "của cơ" and texts["4"] == "của cơ quan"
    assert texts["5"] == rows[4][2] and texts["6"] == "xуz" and texts["7"] is None and texts["8"] == "" and texts["9"] == "Điều"
    assert unify.found_kinds(df.filter("false")).count() == 0


def test_compose_in_any_order():
    assert unify.compose("mã̂u") == "mẫu" == unify.compose("mã̂u")


# --- 1 --------------------------------------------------------------------------------------------------------------------


def page_rows():
    body = "Trường hợp chủ kho đã nghiệm thu phương án khôi phục thì cơ quan\nquản lý bến phải đăng tải văn bản đề nghị trong vòng 9 giờ."
    letters = "bcdghklmnpqrstvx"
    own = lambda n, s=0: " ".join(letters[(n * k + s * s * k + s) % 16] + "anh" for k in range(1, 9)) + "."
    rows = [("1/2020/QH14", 1, n, n, f"CÔNG BÁO/Số 1 + 2/Ngày 3-4-2020   {n}\n{own(n)}\n{own(n, 1)}\n{body}\n{body}\n{body}\n{own(n, 2)}\n{own(n, 3)}\n- {n} -", None) for n in range(1, 30)]
    bad = "CÔNG BÁO/Số 1 + 2/Ngày 3-4-2020   30\n" + body.replace("nghiệm", "nghi•ệm").replace("phải", "phảl") + "\nTrường hợp chủ kho đã ngh-\niệm thu phương án – khôi phục\nphần 7\n30"
    return [*rows, ("1/2020/QH14", 1, 30, 30, bad, None), ("1/2020/QH14", 1, 30, 30, bad, None), ("1/2020/QH14", 1, 31, 31, None, ""), (None, None, None, None, "một dòng", None)]


def test_pages(spark):
    df = spark.createDataFrame(page_rows(), "logical_doc_id string, part_no int, physical_page int, global_page int, raw_text string, markdown_content string").withColumn("field", F.lit(1))
    read = pages.read_pages(df)
    found = pages.found_lines(read)
    got = sorted((r["line_no"], r["kind"]) for r in found.filter("physical_page = 30").collect())
    assert got == [(1, "running_head"), (2, "misread"), (3, "misread"), (4, "broken_word"), (7, "page_number")]
    assert {(r["line_no"], r["kind"]) for r in found.filter("physical_page = 2").collect()} == {(1, "running_head"), (12, "page_number")}
    text = read.filter("physical_page = 30").first()["repaired"]
    assert "đã nghiệm thu phương án – khôi phục" in text and "CÔNG BÁO" not in text and "phải đăng tải" in text
    assert pages.found_lines(pages.read_pages(df.filter("false"))).count() == 0


PAGES = "logical_doc_id string, part_no int, physical_page int, global_page int, raw_text string, markdown_content string"


def test_long_lines_of_the_body_are_no_heads(spark):
    long = "cơ quan quản lý bến phải đăng tải văn bản đề nghị trong vòng nhiều giờ"
    assert len(long) >= 40

    def page(n, at_edge):
        own = [f"{c * 3} riêng {chr(97 + n // 10)}{chr(97 + n % 10)}" for c in "bcdghklm"]
        own[-1 if at_edge else 4] = long
        return "\n".join([f"CÔNG BÁO/Số 1 + 2/Ngày 3-4-2020   {n}", *own])

    once = [("1/2020/QH14", 1, n, n, page(n, n % 3 == 0), None) for n in range(2, 32)]
    joined = [(*row[:5], "# " + row[4].replace("\n", "  ")) for row in once]
    for rows in (once, joined):
        df = spark.createDataFrame(rows, PAGES)
        assert pages.train(df).heads == {"cong bao so ngay"}
        found = pages.found_lines(pages.read_pages(df)).filter("field = 'raw_text' and kind = 'running_head'")
        assert {r["line_no"] for r in found.collect()} == {1}


def test_words_of_both_texts_of_a_page_count(spark):
    rows = [("d", 1, n, n, "hồ sơ kho hàng vàng vàng", "<!-- PageProvenance: physical_file=x -->\nhồ sơ hồ sơ kho bến vàng") for n in range(5)]
    model = pages.train(spark.createDataFrame(rows, PAGES))
    assert model.words == {"hồ": 10, "sơ": 10, "kho": 5, "hàng": 5, "vàng": 10, "bến": 5}
    assert model.pairs["kho", "hàng"] == model.pairs["kho", "bến"] == model.pairs["sơ", "hồ"] == 5 and model.pairs["hồ", "sơ"] == 10


def test_every_candidate_of_a_word_meets_its_neighbours():
    words = {c + "an": 1000 for c in "bcdghklmnprstv"} | {"xan": 300, "toi": 1000}
    model = pages.Model(words, {("toi", "xan"): 300}, 100_000, set()).prepare()
    assert {w for w, _ in model.candidates("qan")} == set(words) - {"toi"}
    assert pages.decode(["toi", "qan"], {1}, model) == ["toi", "xan"]


@pytest.mark.parametrize("line, is_number", [("[3]", True), ("- 3 -", True), ("Trang 3/88", True), ("iii", True), ("l3", False), ("4", False), ("3", True), ("3 điều", False), ("", False)])
def test_page_numbers(line, is_number):
    assert pages.is_page_number(line, {3}) is is_number


# --- 8 --------------------------------------------------------------------------------------------------------------------

SENTENCES = [
    "Tôi tên là Phạm Xuân Kha, căn cước N4805851, hiện trú tại K208/18 Đồng Vàng, phường An Tre, Lam Hạ.",
    "Liên hệ: kha.pham@thukhu.test; DĐ: 0502 202 547 để biết. Mã hồ sơ 651387137675 được tiếp nhận.",
    "Nguyên đơn là ông Đặng Gia Thụy, giấy chứng minh 092 298 648 724, địa chỉ số nhà 84, ngõ 298 Lụa Xanh, quận Hạ Lam, Đảo Yên.",
    "Công ty (mã số thuế 9827048418) đã nộp 760.654.000 đồng. Biên lai AB000123 ngày 12/03/1959.",
    "Giấy tờ tùy thân số 054364682889 do Đỗ Diệu Mộc xuất trình.",
    "Sau đó anh Bùi Thanh Vinh gọi từ số +84 478 136 710 để hẹn lại; thư vinh [at] hopthu.example.",
]


def test_mentions():
    model = personal.train(SENTENCES * 30)
    text = "Ký tên\nĐẶNG GIA THỤY. Bị đơn bà Đặng Gia Thụy, căn cước 035193321835, email a.b+c@x.example, ĐT O478136710, lô hàng 123456789, phố Trần Hạ Lam."
    got = {(text[s:e], k) for s, e, k in personal.mentions([text], model)[0]}
    assert got == {("ĐẶNG GIA THỤY", "name"), ("Đặng Gia Thụy", "name"), ("035193321835", "identity"), ("a.b+c@x.example", "email"), ("O478136710", "phone")}
    assert personal.redact(text, personal.mentions([text], model)[0]).startswith("Ký tên\n[NAME]. Bị đơn bà [NAME], căn cước [IDENTITY]")
    odd = "Gọi từ​ số 0502 202 547"
    assert [(odd[s:e], k) for s, e, k in personal.mentions([odd], model)[0]] == [("0502 202 547", "phone")]
    assert personal.mentions([None, "", " \n"], model) == [[], [], []]


def test_mentions_of_rows(spark):
    rows = [(i, s) for i, s in enumerate(SENTENCES * 20)] + [(500, None), (501, ""), (None, SENTENCES[1]), (0, SENTENCES[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(1))
    out = personal.protect(df)
    found = personal.found_mentions(out)
    assert {r["kind"] for r in found.collect()} == {"email", "phone", "identity", "address", "name"}
    assert found.filter("doc_id = 0").count() == 3
    assert out.filter("doc_id = 500").first()["redacted"] is None
    assert personal.found_mentions(personal.protect(df.filter("false"))).count() == 0


def test_names_outside_the_training_sample_are_proposed(spark):
    usual = [f"{SENTENCES[n % len(SENTENCES)]} Tờ {n}." for n in range(300)]
    rare = [*(f"Nguyên đơn là ông Đỗ Khuê Mẫn, căn cước 09229864872{n}." for n in range(3)), "Giấy tờ tùy thân số 054364682889 do Đỗ Khuê Mẫn xuất trình."]
    df = spark.createDataFrame(list(enumerate(usual + rare)), "doc_id long, text string")
    got = {r["doc_id"]: r["redacted"] for r in personal.protect(df, train_texts=60).collect()}
    assert len(got) == len(usual + rare) and got[303] == "Giấy tờ tùy thân số [IDENTITY] do [NAME] xuất trình."
    twice = personal.names_of_all(df.union(df))
    assert {"khuê", "mẫn"} <= twice.given and twice.given == personal.learn_names(usual + rare).given


def test_names_of_no_list_are_found():
    """Family or given names that neither the list nor the sample knows: behind a title, repeated, or behind a known family name."""
    model = personal.train(SENTENCES * 30)
    for text, name in (
        ("Hôm qua ông Ninh Khắc Tùng đã ký. Về sau Ninh Khắc Tùng rời đi.", "Ninh Khắc Tùng"),
        ("Nguyễn Khắc Tùng, sinh năm 1980, đã khai.", "Nguyễn Khắc Tùng"),
    ):
        found = [(s, text[s:e]) for s, e, k in personal.mentions([text], model)[0] if k == "name"]
        assert found == [(m.start(), name) for m in re.finditer(name, text)]


def _two_way_model(**weights):
    index = {f: i for i, f in enumerate(weights)}
    rows = np.zeros((len(index), 6))
    for f, w in weights.items():
        rows[index[f], [0, 5]] = w
    return {f"person|{f}" if f != "bias" else "person|": i for f, i in index.items()}, rows


def test_messages_make_repeats_agree():
    index, weights = _two_way_model(bias=(0, 0), a=(0, 3.0), b=(0.5, 0))
    model = personal.Model(personal.Names(set(personal.FAMILIES), {"gia"}), index, weights, np.zeros((6, 6)), 2.5, 0.0)
    a = personal.Candidate("person", 0, 5, ["a"], same="x", alike="x")
    b = personal.Candidate("person", 900, 905, ["b"], same="x", alike="x")
    assert model.label([[a, b], [], [b]]) == [[5, 5], [], [0]]
    assert model.label([[a, b]], skip=False) == [[5, 0]]
    b.same = b.alike = "y"
    assert model.label([[a, b]]) == [[5, 0]]


def test_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(5)
    nodes, potentials = rng.normal(size=(3, 6)), rng.normal(size=(3, 6, 6))
    kind = np.array([1, 0])
    belief, pairs = personal.pass_messages(nodes, np.array([0, 1]), np.array([1, 2]), kind, potentials, 60)
    whole = np.exp(nodes[0][:, None, None] + nodes[1][None, :, None] + nodes[2][None, None, :] + potentials[1][:, :, None] + potentials[0][None, :, :])
    whole /= whole.sum()
    share = np.exp(belief - belief.max(axis=1, keepdims=True))
    assert np.allclose(share[1] / share[1].sum(), whole.sum(axis=(0, 2)), atol=1e-3)
    assert np.allclose(pairs[1], whole.sum(axis=2), atol=1e-3) and np.allclose(pairs[0], whole.sum(axis=0), atol=1e-3)


def test_every_query_has_a_schema(spark, folder):
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert queries.QUERIES["p3_found"](spark, folder).columns == ["provision_id", "segment_no"]
    assert queries.QUERIES["p4_found"](spark, folder).columns == ["source_table", "id_a", "id_b"]
