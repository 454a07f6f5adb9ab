"""The registered queries of the core, each over its whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.functions import dates, quality, text
from chronolake.operators import asof, chunking, contracts, evaluation, lake, retrieval, structure
from chronolake.session import table
from chronolake.sources import hooks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AT = "2006-06-01"
W = r"'[\p{L}\p{N}_]+'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _provisions(spark: SparkSession, folder: str, *columns: str, where: Column | None = None) -> DataFrame:
    """Columns of the provisions, exact duplicates once. Filter and columns come before that, so that they reach the scan and only
    what is asked for crosses the network."""
    rows = table(spark, folder, "silver_provisions")
    rows = rows.filter(where) if where is not None else rows
    return rows.select(*columns).distinct() if columns else rows.dropDuplicates(["provision_id"])


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return _provisions(spark, folder, "provision_id", "effective_from", "effective_to", "content").withColumnRenamed("content", "text")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "naive_q100").select("sample_id", "question").distinct()
    return rows.withColumn("t", dates.event_date(F.col("question")))


#: Shared pieces of the SQL.
P = "provisions AS (SELECT DISTINCT ON (provision_id) * FROM silver_provisions ORDER BY provision_id)"
Q = """questions AS (SELECT sample_id, question, try_strptime(regexp_extract(question, '([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})', 1), '%d/%m/%Y')::DATE AS t
  FROM (SELECT DISTINCT sample_id, question FROM naive_q100))"""
TERMS = f"""asked AS (SELECT sample_id, t, term, count(*) AS times FROM (SELECT sample_id, t, unnest(regexp_extract_all(lower(question), {W})) AS term FROM questions) GROUP BY ALL),
words AS (SELECT provision_id, effective_from, effective_to, regexp_extract_all(lower(content), {W}) AS terms FROM provisions),
postings AS (SELECT provision_id, effective_from, effective_to, len(terms) AS n_words, term, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM words) GROUP BY ALL)"""


# --- point in time --------------------------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT provision_id, logical_doc_id, effective_from, effective_to FROM provisions WHERE effective_from <= DATE '{AT}' AND (effective_to IS NULL OR effective_to > DATE '{AT}')")
def asof_provisions(spark, folder):
    found = asof.as_of(table(spark, folder, "silver_provisions"), F.lit(AT).cast("date"))
    return found.select("provision_id", "logical_doc_id", "effective_from", "effective_to").distinct()


@query(f"""WITH {P} SELECT provision_id FROM provisions WHERE effective_from <= DATE '{AT}' AND (effective_to IS NULL OR effective_to > DATE '{AT}')
  AND logical_doc_id IN (SELECT logical_doc_id FROM silver_effectivity_rules WHERE target_path <> '*')""")
def asof_provisions_docs(spark, folder):
    docs = table(spark, folder, "silver_effectivity_rules").filter("target_path <> '*'").select("logical_doc_id")
    return asof.as_of(table(spark, folder, "silver_provisions"), F.lit(AT).cast("date"), docs).select("provision_id").distinct()


@query(f"WITH {P} SELECT provision_id, issued_date FROM provisions WHERE issued_date <= DATE '{AT}'")
def issued_provisions(spark, folder):
    return asof.issued_by(table(spark, folder, "silver_provisions"), F.lit(AT).cast("date")).select("provision_id", "issued_date").distinct()


@query(f"""WITH {P} SELECT provision_id, CASE WHEN effective_from IS NOT NULL THEN effective_from <= DATE '{AT}' AND (effective_to IS NULL OR DATE '{AT}' < effective_to) END AS in_force FROM provisions""")
def in_force_state(spark, folder):
    return _provisions(spark, folder, "provision_id", "effective_from", "effective_to").select("provision_id", dates.in_force(F.col("effective_from"), F.col("effective_to"), F.lit(AT).cast("date")).alias("in_force"))


@query(f"""WITH {P}, joined AS (SELECT p.provision_id, p.effective_from, least(p.effective_to,
    (SELECT min(r.effective_to) FROM silver_effectivity_rules r WHERE r.logical_doc_id = p.logical_doc_id AND r.target_path IN ('*', p.provision_path))) AS valid_to FROM provisions p)
  SELECT * FROM joined WHERE effective_from <= DATE '{AT}' AND (valid_to IS NULL OR DATE '{AT}' < valid_to)""")
def superseded_provisions(spark, folder):
    rows = _provisions(spark, folder, "provision_id", "logical_doc_id", "provision_path", "effective_from", "effective_to", where=F.col("effective_from") <= F.lit(AT).cast("date"))
    found = asof.superseded(rows, table(spark, folder, "silver_effectivity_rules"), F.lit(AT).cast("date"))
    return found.select("provision_id", "effective_from", "valid_to")


@query("SELECT o_orderkey, o_custkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders")
def order_versions(spark, folder):
    return asof.versions(table(spark, folder, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "valid_from", "valid_to")


@query("""WITH v AS (SELECT o_orderkey, o_custkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)
  SELECT e.event_id, v.o_orderkey FROM events e JOIN v ON e.user_id = v.o_custkey AND v.valid_from <= e.ts AND (v.valid_to IS NULL OR e.ts < v.valid_to)""")
def events_asof_order(spark, folder):
    v = asof.versions(table(spark, folder, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", F.col("o_custkey").alias("user_id"), "valid_from", "valid_to")
    return asof.asof_join(table(spark, folder, "events"), v, "user_id", "ts").select("event_id", "o_orderkey")


@query(f"""WITH {P}, {Q} SELECT t, count(p.provision_id) AS n_valid FROM (SELECT DISTINCT t FROM questions WHERE t IS NOT NULL) q
  LEFT JOIN provisions p ON p.effective_from <= q.t AND (p.effective_to IS NULL OR p.effective_to > q.t) GROUP BY t""")
def valid_at_each_question(spark, folder):
    days = _questions(spark, folder).filter("t is not null").select("t").distinct()
    return asof.counts_at(_provisions(spark, folder, "provision_id", "effective_from", "effective_to"), days).select("t", "n_valid")


# --- text -----------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {W})) AS term FROM documents) GROUP BY ALL")
def term_frequency(spark, folder):
    return retrieval.postings(table(spark, folder, "documents"), ["doc_id"]).select("doc_id", "term", "tf")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {W})) AS term FROM documents) GROUP BY term")
def document_frequency(spark, folder):
    rows = table(spark, folder, "documents").select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT count(*) AS n, round(avg(len(regexp_extract_all(lower(text), {W}))), 6) AS mean_words FROM documents")
def corpus_statistics(spark, folder):
    return table(spark, folder, "documents").agg(F.count("*").alias("n"), F.round(F.avg(F.size(text.tokens(F.col("text")))), 6).alias("mean_words"))


@query(f"""WITH {P}, w AS (SELECT regexp_extract_all(lower(content), {W}) AS t FROM provisions),
  g AS (SELECT unnest(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS phrase FROM w WHERE len(t) >= 2
    UNION ALL SELECT unnest(list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) FROM w WHERE len(t) >= 3)
  SELECT phrase, count(*) AS df FROM g GROUP BY phrase""")
def phrase_frequency(spark, folder):
    two, three = (retrieval.phrase_counts(_texts(spark, folder), "provision_id", n) for n in (2, 3))
    return two.unionByName(three)


@query("SELECT doc_id, strip_accents(replace(lower(text), 'đ', 'd')) AS folded FROM documents")
def folded_documents(spark, folder):
    """Every document, whatever its language and characters."""
    return table(spark, folder, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("""SELECT DISTINCT doc_id, id AS cited FROM (SELECT doc_id, unnest(regexp_extract_all(upper(text), '[0-9]{1,5}/[0-9]{4}/[\\p{Lu}0-9]+(?:-[\\p{Lu}0-9]+)*')) AS id FROM documents)""")
def document_ids_named(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.explode(text.doc_ids(F.col("text"))).alias("cited"))


# --- chunks ---------------------------------------------------------------------------------------------------------------

_CHUNKS = f"""{P}, seg AS (SELECT provision_id, logical_doc_id, unnest(range(len(s))) AS segment_no, s FROM (SELECT provision_id, logical_doc_id,
    from_json(page_segments_json, '[{{"physical_file_id":"VARCHAR","physical_page":"INTEGER","global_page":"INTEGER","text":"VARCHAR"}}]') AS s FROM provisions)),
  tx AS (SELECT provision_id, logical_doc_id, segment_no, s[segment_no + 1].physical_file_id AS physical_file_id, s[segment_no + 1].global_page AS global_page,
    list_filter(regexp_split_to_array(s[segment_no + 1].text, '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> '') AS w FROM seg),
  win AS (SELECT *, unnest(range(CASE WHEN len(w) <= 512 THEN 1 ELSE 1 + ceil((len(w) - 512) / 448.0)::BIGINT END)) AS chunk_index FROM tx WHERE len(w) > 0),
  chunks AS (SELECT logical_doc_id || ':' || provision_id || ':' || coalesce(global_page::VARCHAR, 'unknown') || ':' || segment_no || ':' || chunk_index AS chunk_id, provision_id, global_page,
    array_to_string(w[chunk_index * 448 + 1 : chunk_index * 448 + 512], ' ') AS text_content, coalesce(physical_file_id, '') AS version FROM win)"""


@query(f"WITH {_CHUNKS} SELECT chunk_id, provision_id, global_page, sha256('chunk_id=' || chunk_id || chr(10) || 'doc_version_hash=' || version || chr(10) || 'text=' || text_content) AS chunk_hash FROM chunks")
def chunk_hashes(spark, folder):
    return chunking.chunks(table(spark, folder, "silver_provisions")).select("chunk_id", "provision_id", "global_page", "chunk_hash")


@query(f"WITH {_CHUNKS} SELECT count(*) AS chunks, count(DISTINCT chunk_id) AS ids, count(*) - count(DISTINCT chunk_id) AS collisions FROM chunks")
def chunk_ids_unique(spark, folder):
    made = chunking.chunks(table(spark, folder, "silver_provisions"))
    return made.groupBy("chunk_id").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("chunks"), F.count("*").alias("ids"), (F.sum("n") - F.count("*")).alias("collisions")
    )


@query(f"""WITH {_CHUNKS} SELECT chunk_id, ['CHUNK_HASH_MISMATCH'] AS codes FROM chunks WHERE len(text_content) % 7 = 0""")
def chunk_provenance(spark, folder):
    """Every seventh length gets a false hash; the check must find just these."""
    made = chunking.chunks(table(spark, folder, "silver_provisions"))
    made = made.withColumn("chunk_hash", F.when(F.length("text_content") % 7 == 0, F.upper("chunk_hash")).otherwise(F.col("chunk_hash")))
    return chunking.provenance_issues(made)


# --- retrieval ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {P}, {Q}, {TERMS}, s AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM words), df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
  scored AS (SELECT a.sample_id, p.provision_id, round(sum(a.times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_words / mean)))), 6) AS score
    FROM asked a JOIN postings p USING (term) JOIN df USING (term), s GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, provision_id)::INTEGER AS rank_no FROM scored WHERE score > 0) WHERE rank_no <= 5""")
def bm25_topk(spark, folder):
    return retrieval.bm25(_texts(spark, folder), _questions(spark, folder), 5, "provision_id")


@query(f"""WITH {P}, {Q}, {TERMS},
  s AS (SELECT q.t, count(*) AS n, greatest(avg(len(terms)), 1) AS mean FROM (SELECT DISTINCT t FROM questions WHERE t IS NOT NULL) q JOIN words w ON w.effective_from <= q.t AND (w.effective_to IS NULL OR w.effective_to > q.t) GROUP BY q.t),
  met AS (SELECT q.t, p.* FROM (SELECT DISTINCT t, term FROM asked) q JOIN postings p USING (term) WHERE p.effective_from <= q.t AND (p.effective_to IS NULL OR p.effective_to > q.t)),
  df AS (SELECT t, term, count(*) AS df FROM met GROUP BY ALL),
  scored AS (SELECT a.sample_id, m.provision_id, round(sum(a.times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_words / mean)))), 6) AS score
    FROM asked a JOIN met m USING (t, term) JOIN df USING (t, term) JOIN s USING (t) GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, provision_id)::INTEGER AS rank_no FROM scored WHERE score > 0) WHERE rank_no <= 5""")
def asof_bm25_topk(spark, folder):
    return retrieval.asof_bm25(_texts(spark, folder), _questions(spark, folder), 5, "provision_id")


@query(f"""WITH {P}, {Q}, n AS (SELECT count(*) AS n FROM provisions),
  pg AS (SELECT provision_id, k, unnest(list_distinct(CASE WHEN k = 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END)) AS phrase
    FROM (SELECT provision_id, regexp_extract_all(lower(content), {W}) AS t FROM provisions), (VALUES (2), (3)) v(k) WHERE len(t) >= k),
  qg AS (SELECT sample_id, k, unnest(list_distinct(CASE WHEN k = 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END)) AS phrase
    FROM (SELECT sample_id, regexp_extract_all(lower(question), {W}) AS t FROM questions), (VALUES (2), (3)) v(k) WHERE len(t) >= k),
  df AS (SELECT k, phrase, count(*) AS df FROM pg GROUP BY ALL),
  s AS (SELECT sample_id, provision_id, round(sum(CASE WHEN k = 2 THEN 1.0::DOUBLE ELSE 1.4::DOUBLE END * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))), 6) AS score FROM qg JOIN pg USING (k, phrase) JOIN df USING (k, phrase), n GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, provision_id)::INTEGER AS rank_no FROM s WHERE score > 0) SELECT * FROM r WHERE rank_no <= 5""")
def phrase_topk(spark, folder):
    return retrieval.phrases(_texts(spark, folder), _questions(spark, folder), 5, "provision_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, coalesce(provision_id, chunk_id) ORDER BY score DESC, chunk_id) AS place
    FROM (SELECT DISTINCT sample_id, rank_no, chunk_id, provision_id, score FROM naive_q100)) SELECT sample_id, provision_id, chunk_id, score FROM r WHERE place = 1""")
def best_chunk_of_provision(spark, folder):
    rows = table(spark, folder, "naive_q100").select("sample_id", "rank_no", "chunk_id", "provision_id", "score").distinct()
    return retrieval.best_of_group(rows, F.coalesce("provision_id", "chunk_id"), "chunk_id").select("sample_id", "provision_id", "chunk_id", "score")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
  s AS (SELECT q.vec_id AS sample_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM q, v)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, vec_id)::INTEGER AS rank_no FROM s) WHERE rank_no <= 5""")
def dense_topk(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return retrieval.dense(vectors, vectors.filter("vec_id % 100 = 0"), 5)


# --- quality and contracts ------------------------------------------------------------------------------------------------

_PAGES = "pages AS (SELECT DISTINCT ON (logical_doc_id, part_no, physical_page) * FROM silver_pages ORDER BY logical_doc_id, part_no, physical_page, created_at)"
_DIA = quality.DIACRITIC
_NOISE = r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}À-ỹ.,;:!?%(){}\[\]\"''“”‘’\-+/=*#|<>]"
_METRICS = f"""{_PAGES}, m AS (SELECT logical_doc_id, part_no, physical_page, markdown_content AS t, tables_json,
    CASE WHEN coalesce(len(markdown_content), 0) = 0 THEN 1.0 ELSE len(regexp_extract_all(markdown_content, '[\\x{{0000}}\\x{{FFFD}}]'))::DOUBLE / len(markdown_content) END AS null_ratio,
    CASE WHEN coalesce(len(regexp_extract_all(markdown_content, '\\p{{L}}')), 0) = 0 THEN 0.0 ELSE len(regexp_extract_all(markdown_content, '{_DIA}'))::DOUBLE / len(regexp_extract_all(markdown_content, '\\p{{L}}')) END AS density,
    CASE WHEN coalesce(len(markdown_content), 0) = 0 THEN 1.0 ELSE len(regexp_extract_all(markdown_content, '{_NOISE}'))::DOUBLE / len(markdown_content) END AS noise,
    list_transform(list_filter(string_split(coalesce(markdown_content, ''), chr(10)), lambda x: contains(x, '|')), lambda x: len(string_split(regexp_replace(regexp_replace(x, '^\\s*\\|', ''), '\\|\\s*$', ''), '|'))) AS cells FROM pages),
  metrics AS (SELECT *, CASE WHEN len(cells) = 0 THEN 0.0 ELSE list_sum(list_transform(cells, lambda c: abs(c - list_max(cells))))::DOUBLE / list_sum(cells) END AS broken,
    from_json(tables_json, '[{{"rows":"INTEGER","columns":"INTEGER","cells":[{{"row":"INTEGER","column":"INTEGER","rowspan":"INTEGER","colspan":"INTEGER","value":"VARCHAR"}}]}}]') AS tables FROM m),
  tabled AS (SELECT *, coalesce(list_bool_or(list_transform(tables, lambda tb: len(tb.cells) > 0 AND len(list_filter(tb.cells, lambda c: coalesce(c."row", 1) = 0)) = 0)), false) AS headless,
    coalesce(list_sum(list_transform(tables, lambda tb: CASE WHEN tb."rows" > 0 AND tb."columns" > 0 THEN len(list_filter(tb.cells, lambda c: coalesce(c."row", 0) < 0 OR coalesce(c."column", 0) < 0 OR coalesce(c.rowspan, 1) < 1 OR coalesce(c.colspan, 1) < 1 OR coalesce(c."row", 0) + coalesce(c.rowspan, 1) > tb."rows" OR coalesce(c."column", 0) + coalesce(c.colspan, 1) > tb."columns")) ELSE 0 END)), 0) AS spans FROM metrics)"""


def _latest_pages(spark, folder):
    return lake.latest(table(spark, folder, "silver_pages"), ["logical_doc_id", "part_no", "physical_page"], F.asc("created_at"))


@query(f"WITH {_METRICS} SELECT logical_doc_id, part_no, physical_page, round(null_ratio, 6)::DOUBLE AS null_ratio, round(density, 6)::DOUBLE AS density, round(noise, 6)::DOUBLE AS noise, round(broken, 6)::DOUBLE AS broken FROM metrics")
def page_quality(spark, folder):
    t = F.col("markdown_content")
    return _latest_pages(spark, folder).select(
        "logical_doc_id", "part_no", "physical_page", F.round(quality.null_ratio(t), 6).alias("null_ratio"), F.round(quality.diacritic_density(t), 6).alias("density"),
        F.round(quality.noise_ratio(t), 6).alias("noise"), F.round(quality.broken_cells(t), 6).alias("broken"),
    )


@query(f"WITH {_METRICS} SELECT logical_doc_id, part_no, physical_page, headless, spans::INTEGER AS spans FROM tabled")
def table_quality(spark, folder):
    m = quality.metrics(F.col("markdown_content"), F.col("tables_json"))
    return _latest_pages(spark, folder).select(
        "logical_doc_id", "part_no", "physical_page", m["missing_table_headers"].alias("headless"), m["merged_cell_issues"].alias("spans")
    )


@query(f"""WITH {_METRICS} SELECT logical_doc_id, part_no, physical_page, list_sort(list_filter([CASE WHEN null_ratio > 0.05 THEN 'NULL_RATIO_EXCEEDED' END, CASE WHEN density < 0.1 THEN 'DIACRITIC_DENSITY_LOW' END,
  CASE WHEN noise > 0.02 THEN 'OCR_NOISE_EXCEEDED' END, CASE WHEN broken > 0.05 THEN 'TABLE_INTEGRITY_FAILED' END, CASE WHEN headless THEN 'TABLE_HEADER_MISSING' END, CASE WHEN spans > 0 THEN 'MERGED_CELL_ISSUE' END], lambda x: x IS NOT NULL)) AS codes FROM tabled""")
def quality_contract(spark, folder):
    checked = contracts.checkpoint(_latest_pages(spark, folder), quality=contracts.quality_codes("markdown_content", "tables_json"))
    return checked.select("logical_doc_id", "part_no", "physical_page", "codes")


_TEMPORAL = "list_filter([CASE WHEN effective_from < issued_date THEN 'INVALID_START_DATE' END, CASE WHEN effective_to <= effective_from THEN 'INVALID_END_DATE' END], lambda x: x IS NOT NULL)"
_SCHEMA = """list_filter([CASE WHEN title IS NULL OR trim(title) = '' THEN 'MISSING_TITLE' END, CASE WHEN content IS NULL OR trim(content) = '' THEN 'MISSING_CONTENT' END,
  CASE WHEN status IS NULL OR trim(status) = '' THEN 'MISSING_STATUS' END, CASE WHEN NOT regexp_full_match(coalesce(logical_doc_id, ''), '[0-9]+/[0-9]{4}/(NĐ-CP|TT-[A-Z]+|QH[0-9]+|QĐ-[A-Za-z]+|NQ-[A-Z]+)|DOC-[0-9a-f]{24}') THEN 'DOC_ID_INVALID' END], lambda x: x IS NOT NULL)"""


def _contract(spark, folder):
    return contracts.checkpoint(_provisions(spark, folder), schema=contracts.field_codes(["title", "content", "status"]), temporal=contracts.temporal_codes())


@query(f"WITH {P} SELECT provision_id, list_sort(list_concat({_SCHEMA}, {_TEMPORAL})) AS codes, CASE WHEN len(list_concat({_SCHEMA}, {_TEMPORAL})) = 0 THEN 'PASSED' ELSE 'QUARANTINE' END AS status_code FROM provisions")
def contract_report(spark, folder):
    return _contract(spark, folder).select("provision_id", "codes", "status_code")


@query(f"WITH {P}, c AS (SELECT unnest(list_concat({_SCHEMA}, {_TEMPORAL})) AS code FROM provisions) SELECT code, count(*) AS n FROM c GROUP BY code")
def quarantine_by_code(spark, folder):
    _, bad = contracts.split(_contract(spark, folder))
    return bad.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


_FAULTS = f"faults AS (SELECT level AS mutation_type, CASE WHEN status = 'expired' OR title IS NULL THEN 'QUARANTINE' ELSE 'PASSED' END AS expected, CASE WHEN len(list_concat({_SCHEMA}, {_TEMPORAL})) = 0 THEN 'PASSED' ELSE 'QUARANTINE' END AS actual FROM provisions)"


def _faults(spark, folder):
    expected = F.when((F.col("status") == "expired") | F.col("title").isNull(), "QUARANTINE").otherwise("PASSED")
    return _contract(spark, folder).select(F.col("level").alias("mutation_type"), expected.alias("expected"), F.col("status_code").alias("actual"))


@query(f"WITH {P}, {_FAULTS} SELECT mutation_type, count(*) FILTER (expected = 'QUARANTINE') AS expected_n, round(count(*) FILTER (expected = 'QUARANTINE' AND actual = 'QUARANTINE')::DOUBLE / nullif(count(*) FILTER (expected = 'QUARANTINE'), 0), 6) AS rate FROM faults GROUP BY mutation_type")
def detection_by_kind(spark, folder):
    return evaluation.detection(_faults(spark, folder))


@query(f"WITH {P}, {_FAULTS} SELECT count(*) FILTER (expected = 'QUARANTINE' AND actual = 'QUARANTINE') AS tp, count(*) FILTER (expected = 'PASSED' AND actual = 'PASSED') AS tn, count(*) FILTER (expected = 'PASSED' AND actual = 'QUARANTINE') AS fp, count(*) FILTER (expected = 'QUARANTINE' AND actual = 'PASSED') AS fn FROM faults")
def contract_confusion(spark, folder):
    return evaluation.confusion(_faults(spark, folder))


# --- structure ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {P} SELECT a.provision_id, coalesce(c.provision_id, b.provision_id, a.provision_id) AS root_id, 1 + (b.provision_id IS NOT NULL)::INT + (c.provision_id IS NOT NULL)::INT AS depth
  FROM provisions a LEFT JOIN provisions b ON a.parent_provision_id = b.provision_id LEFT JOIN provisions c ON b.parent_provision_id = c.provision_id""")
def tree_roots(spark, folder):
    return structure.ancestors(table(spark, folder, "silver_provisions"))


_RULE = "SELECT logical_doc_id, target_path, arg_max({mode: mode, s: effective_from, e: effective_to, t: trigger_reference}, rule_id) AS r FROM (SELECT DISTINCT ON (rule_id) * FROM silver_effectivity_rules ORDER BY rule_id) GROUP BY ALL"
_INHERIT = "CASE WHEN {p}.mode IN ('explicit_date', 'inherit') AND {p}.s IS NOT NULL THEN {{mode: 'inherit', s: {p}.s, e: {p}.e, t: NULL::VARCHAR}} WHEN {p}.mode = 'external_trigger' THEN {{mode: 'external_trigger', s: NULL::DATE, e: NULL::DATE, t: {p}.t}} ELSE {{mode: 'unknown', s: NULL::DATE, e: NULL::DATE, t: NULL::VARCHAR}} END"


@query(f"""WITH {P}, rules AS ({_RULE}), base AS (SELECT p.provision_id, p.logical_doc_id, p.parent_provision_id, p.level, r.r FROM provisions p LEFT JOIN rules r ON p.logical_doc_id = r.logical_doc_id AND p.provision_path = r.target_path AND r.target_path <> '*'),
  a AS (SELECT b.provision_id, level, coalesce(b.r, {_INHERIT.format(p='w.r')}) AS st FROM base b LEFT JOIN rules w ON b.logical_doc_id = w.logical_doc_id AND w.target_path = '*' WHERE level = 'article'),
  c AS (SELECT b.provision_id, b.level, coalesce(b.r, {_INHERIT.format(p='a.st')}) AS st FROM base b LEFT JOIN a ON b.parent_provision_id = a.provision_id WHERE b.level = 'clause'),
  d AS (SELECT b.provision_id, b.level, coalesce(b.r, {_INHERIT.format(p='c.st')}) AS st FROM base b LEFT JOIN c ON b.parent_provision_id = c.provision_id WHERE b.level = 'point')
  SELECT provision_id, level, st.mode AS mode, st.s AS effective_from, st.e AS effective_to, st.t AS trigger_reference FROM (FROM a UNION ALL FROM c UNION ALL FROM d)""")
def effectivity_resolved(spark, folder):
    return structure.resolve_effectivity(table(spark, folder, "silver_provisions"), table(spark, folder, "silver_effectivity_rules"))


@query(f"""WITH {_PAGES} SELECT logical_doc_id, part_no, physical_page, coalesce(len(raw_text), 0)::INTEGER AS n,
  coalesce(sum(coalesce(len(raw_text), 0) + 2) OVER (PARTITION BY logical_doc_id ORDER BY part_no, physical_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_start FROM pages""")
def page_offsets(spark, folder):
    return structure.page_offsets(_latest_pages(spark, folder))


@query(f"""WITH {_PAGES}, l AS (SELECT logical_doc_id, part_no, physical_page, unnest(range(len(string_split(raw_text, chr(10))))) AS line_no, string_split(raw_text, chr(10)) AS a FROM pages),
  h AS (SELECT logical_doc_id, part_no, physical_page, line_no, regexp_extract(a[line_no + 1], '^\\s*(?:#{{1,6}}\\s*)?(?:\\*\\*)?\\s*Điều\\s+([0-9]+[a-zđ]?)\\.', 1) AS number FROM l),
  k AS (SELECT *, row_number() OVER (PARTITION BY logical_doc_id, number ORDER BY part_no, physical_page, line_no) AS place FROM h WHERE number <> ''), f AS (SELECT * EXCLUDE place FROM k WHERE place = 1)
  SELECT logical_doc_id, part_no, physical_page, line_no::INTEGER AS line_no, number, lead(physical_page) OVER w AS next_page, lead(number) OVER w AS next_number FROM f WINDOW w AS (PARTITION BY logical_doc_id ORDER BY part_no, physical_page, line_no)""")
def article_headings(spark, folder):
    return structure.headings(_latest_pages(spark, folder))


@query(f"""WITH {P}, {_PAGES} SELECT p.provision_id, g.global_page, greatest(p.start_global_page, g.global_page) AS from_, least(p.end_global_page + 1, g.global_page + 1) AS to_ FROM provisions p
  JOIN (SELECT DISTINCT logical_doc_id, global_page FROM pages) g ON p.logical_doc_id = g.logical_doc_id AND g.global_page + 1 > p.start_global_page AND g.global_page < p.end_global_page + 1""")
def pages_of_provisions(spark, folder):
    spans = _provisions(spark, folder, "provision_id", "logical_doc_id", "start_global_page", "end_global_page").select("provision_id", "logical_doc_id", F.col("start_global_page").alias("span_start"), (F.col("end_global_page") + 1).alias("span_end"))
    pages = table(spark, folder, "silver_pages").select("logical_doc_id", "global_page").distinct()
    pages = pages.select("logical_doc_id", "global_page", F.col("global_page").alias("page_start"), (F.col("global_page") + 1).alias("page_end"))
    return structure.overlap(spans, pages, "logical_doc_id").select("provision_id", "global_page", "from_", "to_")


# --- lake -----------------------------------------------------------------------------------------------------------------


@query("SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY logical_doc_id, part_no ORDER BY ingested_at DESC) AS k FROM bronze_pdf_parts) WHERE k = 1")
def bronze_latest(spark, folder):
    return lake.latest(table(spark, folder, "bronze_pdf_parts"), ["logical_doc_id", "part_no"], F.desc("ingested_at"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def orders_upserted(spark, folder):
    """An upsert by customer of each half of the orders gives the last order of each."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    early = lake.latest(orders.filter("o_orderdate < timestamp '1998-06-01'"), ["o_custkey"], *order)
    late = lake.latest(orders.filter("o_orderdate >= timestamp '1998-06-01'"), ["o_custkey"], *order)
    return lake.upsert(early, late, ["o_custkey"]).drop("o_orderdate")


@query("""SELECT DISTINCT p.logical_doc_id, p.part_no, p.physical_page, b.file_path AS bronze_path FROM silver_pages p LEFT JOIN
  (SELECT logical_doc_id, part_no, arg_max(file_path, ingested_at) AS file_path FROM bronze_pdf_parts GROUP BY ALL) b USING (logical_doc_id, part_no)""")
def page_files(spark, folder):
    parts = lake.latest(table(spark, folder, "bronze_pdf_parts"), ["logical_doc_id", "part_no"], F.desc("ingested_at"))
    parts = parts.select("logical_doc_id", "part_no", F.col("file_path").alias("bronze_path"))
    pages = table(spark, folder, "silver_pages").select("logical_doc_id", "part_no", "physical_page").distinct()
    return pages.join(parts, ["logical_doc_id", "part_no"], "left")


@query("SELECT DISTINCT q.chunk_id FROM naive_q100 q WHERE NOT EXISTS (SELECT 1 FROM silver_provisions p WHERE p.provision_id = q.provision_id AND p.status = 'active')")
def chunks_without_active_provision(spark, folder):
    active = table(spark, folder, "silver_provisions").filter("status = 'active'")
    return lake.orphans(table(spark, folder, "naive_q100").select("chunk_id", "provision_id"), active, ["provision_id"]).select("chunk_id").distinct()


@query("SELECT DISTINCT rule_id, sha256(concat(coalesce(logical_doc_id, ''), chr(10), coalesce(target_path, ''), chr(10), coalesce(mode, ''), chr(10), coalesce(effective_from::VARCHAR, ''), chr(10), coalesce(effective_to::VARCHAR, ''), chr(10), coalesce(source_text, ''))) AS key FROM silver_effectivity_rules")
def rule_keys(spark, folder):
    key = lake.rule_key("logical_doc_id", "target_path", "mode", "effective_from", "effective_to", "source_text")
    return table(spark, folder, "silver_effectivity_rules").select("rule_id", key.alias("key")).distinct()


@query("""WITH a AS (SELECT DISTINCT logical_doc_id FROM silver_pages), b AS (SELECT DISTINCT logical_doc_id FROM naive_q100 WHERE logical_doc_id IS NOT NULL)
  SELECT logical_doc_id, 'left' AS only_in FROM a WHERE logical_doc_id NOT IN (FROM b) UNION ALL SELECT logical_doc_id, 'right' FROM b WHERE logical_doc_id NOT IN (SELECT logical_doc_id FROM a WHERE logical_doc_id IS NOT NULL)""")
def documents_only_once(spark, folder):
    return lake.same_keys(table(spark, folder, "silver_pages"), table(spark, folder, "naive_q100").filter("logical_doc_id is not null"), "logical_doc_id")


# --- evaluation -----------------------------------------------------------------------------------------------------------

@query("""WITH s AS (SELECT DISTINCT sample_id, latency_ms FROM naive_q100 WHERE latency_ms IS NOT NULL)
  SELECT round(avg(latency_ms), 1) AS mean_ms, min(latency_ms) AS least_ms, max(latency_ms) AS most_ms, count(*) AS n FROM s""")
def answer_latency(spark, folder):
    rows = table(spark, folder, "naive_q100").filter("latency_ms is not null").select("sample_id", "latency_ms").distinct()
    return rows.agg(F.round(F.avg("latency_ms"), 1).alias("mean_ms"), F.min("latency_ms").alias("least_ms"), F.max("latency_ms").alias("most_ms"), F.count("*").alias("n"))


@query("""SELECT DISTINCT sample_id, regexp_extract(text, '^([^.]*\\.?)', 1) || chr(10) || 'Nguồn: ' || logical_doc_id AS answer FROM naive_q100 WHERE rank_no = 1""")
def extractive_answers(spark, folder):
    return hooks.extractive_answers(table(spark, folder, "naive_q100"))


@query("""WITH a AS (SELECT DISTINCT sample_id, regexp_extract(text, '^([^.]*\\.?)', 1) || chr(10) || 'Nguồn: ' || logical_doc_id AS answer FROM naive_q100 WHERE rank_no = 1),
  l AS (SELECT sample_id, unnest(string_split(answer, chr(10))) AS line FROM a)
  SELECT DISTINCT sample_id, unnest(regexp_extract_all(upper(line), '[0-9]+/[0-9]{4}/[A-ZĐ0-9]+(?:-[A-ZĐ0-9]+)*')) AS cited FROM l WHERE regexp_matches(lower(line), '(nguồn|nguon|sources?|citation)\\s*:')""")
def answer_citations(spark, folder):
    answers = hooks.extractive_answers(table(spark, folder, "naive_q100"))
    return answers.select("sample_id", F.explode(text.cited_docs(F.col("answer"))).alias("cited"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def events_per_day(spark, folder):
    """The batch form of the stream's windows."""
    rows = table(spark, folder, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value, max(ts) AS last_ts FROM events GROUP BY event_type")
def events_by_type(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("ts").alias("last_ts")
    )
