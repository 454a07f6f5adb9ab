"""Registered queries on legal structure, rules of effect, the temporal retriever, contracts, evaluation and the lake's upserts, each
over its whole tables, and the SQL that must give the same rows. Faults that the data lack are planted alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.functions import dates, text
from chronolake.operators import chunking, contracts, evaluation, lake, parsing, ranking, structure
from chronolake.plans.catalogue import _CHUNKS, _PAGES, P, W, _latest_pages, _provisions, query
from chronolake.session import table
from chronolake.sources import hooks, tables

#: Unicode white space in RE2, for the SQL.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP = f"regexp_replace({{0}}, '^{WS}+|{WS}+$', '', 'g')".replace("{0}", "%s")
FOLD = "strip_accents(replace(lower(%s), 'đ', 'd'))"


def sql_date(y: str, m: str, d: str) -> str:
    return f"try_strptime({y} || '-' || {m} || '-' || {d}, '%Y-%m-%d')::DATE"


# --- dates and openings ---------------------------------------------------------------------------------------------------

_ISO = "(?:^|[^0-9])([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[^0-9]|$)"
_SHORT = "(?:^|[^0-9])([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})(?:[^0-9]|$)"
_LONG = r"(?i)ngày\s+([0-9]{1,2})\s+tháng\s+([0-9]{1,2})\s+năm\s+([0-9]{4})"


def _event(c: str) -> str:
    part = lambda p, g: f"regexp_extract({c}, '{p}', {g})"
    return (
        f"CASE WHEN regexp_matches({c}, '{_ISO}') THEN {sql_date(*(part(_ISO, g) for g in (1, 2, 3)))} WHEN regexp_matches({c}, '{_SHORT}') THEN {sql_date(*(part(_SHORT, g) for g in (3, 2, 1)))}"
        f" WHEN regexp_matches({c}, '{_LONG}') THEN {sql_date(*(part(_LONG, g) for g in (3, 2, 1)))} END"
    )


_BASIS = f"""CASE WHEN regexp_matches(lower(question), '{"|".join(dates.STATUS)}') THEN 'status' WHEN regexp_matches(lower(question), '{"|".join(dates.EFFECTIVE)}') THEN 'effective'
  WHEN regexp_matches(lower(question), '{"|".join(dates.CONTENT)}') THEN 'issued' ELSE 'effective' END"""
# Questions of all kinds: the cached ones, and what else could be asked of their first chunk's document.
_ASKED = f"""base AS (SELECT sample_id, question, min(logical_doc_id) AS doc FROM naive_q100 GROUP BY ALL),
  worded AS (SELECT sample_id, CASE len(question) % 4 WHEN 0 THEN question || ' Quy định này đã có hiệu lực chưa?' WHEN 1 THEN question || ' Văn bản ' || coalesce(lower(doc), '') || ' quy định những nội dung gì?'
    WHEN 2 THEN question || ' Quy định nào bắt đầu áp dụng?' ELSE question END AS question FROM base),
  asked AS (SELECT sample_id, question, {_event('question')} AS t, {_BASIS} AS basis FROM worded)"""


def _asked(spark, folder):
    base = table(spark, folder, "naive_q100").groupBy("sample_id", "question").agg(F.min("logical_doc_id").alias("doc"))
    way, q = F.length("question") % 4, F.col("question")
    worded = (
        F.when(way == 0, F.concat(q, F.lit(" Quy định này đã có hiệu lực chưa?")))
        .when(way == 1, F.concat(q, F.lit(" Văn bản "), F.coalesce(F.lower("doc"), F.lit("")), F.lit(" quy định những nội dung gì?")))
        .when(way == 2, F.concat(q, F.lit(" Quy định nào bắt đầu áp dụng?")))
        .otherwise(q)
    )
    return base.select("sample_id", worded.alias("question")).withColumn("t", dates.event_date(F.col("question"))).withColumn("basis", dates.date_basis(F.col("question")))


@query(f"WITH {_ASKED} SELECT sample_id, t, basis FROM asked")
def question_dates_and_bases(spark, folder):
    return _asked(spark, folder).select("sample_id", "t", "basis")


@query(f"SELECT doc_id, {_event('text')} AS named FROM documents WHERE text IS NOT NULL")
def first_dates(spark, folder):
    """The date rule of questions over all documents, whose texts write dates in every way."""
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", dates.event_date(F.col("text")).alias("named"))


@query(f"""WITH {_ASKED} SELECT sample_id, CASE WHEN len(sample_id || question) % 5 = 0 THEN 'issued' WHEN regexp_matches(lower(question), '{"|".join(dates.STATUS)}') THEN 'status'
  WHEN len(question) % 3 = 0 THEN 'issued' ELSE 'effective' END AS basis FROM asked""")
def sample_bases(spark, folder):
    """A told basis in a fifth of the samples, and categories of which one is about wording."""
    told = F.when(F.length(F.concat("sample_id", "question")) % 5 == 0, "issued")
    category = F.when(F.length("question") % 3 == 0, "amendment_retrieval").otherwise("temporal")
    return _asked(spark, folder).select("sample_id", dates.sample_basis(told, F.col("question"), category).alias("basis"))


@query(f"""WITH m AS (SELECT provision_id, logical_doc_id, content, unnest(['17/6/2006', '2006-06-17', 'x 17 tháng 6 năm 2006 y']) AS form FROM (SELECT DISTINCT provision_id, logical_doc_id, content FROM silver_provisions)),
  s AS (SELECT DISTINCT provision_id, form || ' ' || coalesce(content, '') AS t FROM m)
  SELECT provision_id, t AS said, regexp_matches(t, '(^|[^0-9])0?17[/.]0?6[/.]2006([^0-9]|$)') OR regexp_matches(t, '(^|[^0-9])2006-06-17([^0-9]|$)') OR regexp_matches(t, '(?i)(^|[^0-9])0?17\\s+tháng\\s+0?6\\s+năm\\s+2006([^0-9]|$)') AS mentions FROM s""")
def date_mentions(spark, folder):
    """Whether a provision's text, a form of a date before it, states a day."""
    rows = table(spark, folder, "silver_provisions").select("provision_id", F.explode(F.array(*map(F.lit, ("17/6/2006", "2006-06-17", "x 17 tháng 6 năm 2006 y")))).alias("form"), "content")
    said = rows.select("provision_id", F.concat_ws(" ", "form", F.coalesce("content", F.lit(""))).alias("said")).distinct()
    return said.withColumn("mentions", dates.mentions_date(F.col("said"), F.lit("2006-06-17").cast("date")))


_SIGNED = dates.SIGNED_AT
_HEADS = f"""{_PAGES}, opened AS (SELECT logical_doc_id, part_no, physical_page, raw_text, 'Hà Nội, ngày ' || (physical_page % 31) || ' tháng 2 năm 2005' || chr(10) || coalesce(raw_text, '') AS t FROM pages),
  h AS (SELECT *, {FOLD % 'left(raw_text, 20000)'} AS folded FROM opened WHERE raw_text IS NOT NULL),
  n AS (SELECT *, regexp_extract(folded, '(?:^|[^a-z0-9])([0-9]+/[0-9]{{4}}/[a-z0-9]+(?:-[a-z0-9]+)*)', 1) AS found FROM h),
  i AS (SELECT *, CASE WHEN found = '' THEN logical_doc_id ELSE regexp_extract(found, '^(.*)/', 1) || '/' || CASE WHEN found LIKE '%/nd-cp' THEN 'NĐ-CP' WHEN regexp_matches(found, '/qd-[^/]*$') THEN 'QĐ-' || upper(regexp_extract(found, '/qd-([^/]*)$', 1)) ELSE upper(regexp_extract(found, '([^/]*)$', 1)) END END AS doc_id FROM n),
  k AS (SELECT *, CASE WHEN contains(folded, 'nghi dinh') THEN 'Nghị định' WHEN contains(folded, 'thong tu') THEN 'Thông tư' WHEN contains(folded, 'luat') THEN 'Luật' WHEN contains(folded, 'quyet dinh') THEN 'Quyết định' WHEN contains(folded, 'nghi quyet') THEN 'Nghị quyết'
    WHEN contains(lower(doc_id), '/nđ-cp') THEN 'Nghị định' WHEN contains(lower(doc_id), '/tt-') THEN 'Thông tư' WHEN contains(lower(doc_id), '/qđ-') THEN 'Quyết định' WHEN contains(lower(doc_id), '/nq-') THEN 'Nghị quyết' END AS doc_type FROM i)"""


@query(f"""WITH {_HEADS}, l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(left(raw_text, 16000), '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '^[#*]*(?:{WS}|[#*])+|(?:{WS}|[#*])+$', '', 'g')), lambda x: contains(x, doc_id) AND len(x) <= 300) AS titles FROM k)
  SELECT logical_doc_id, part_no, physical_page, doc_id, doc_type, coalesce(titles[1], concat_ws(' ', doc_type, doc_id)) AS title,
    {sql_date(*(f"regexp_extract({FOLD % 't'}, '{_SIGNED}', {g})" for g in (3, 2, 1)))} AS issued_date FROM l""")
def page_openings(spark, folder):
    """Number, type, title and date of signing as each page's text would give them; the pages' own words tell the rest."""
    rows = _latest_pages(spark, folder).filter("raw_text is not null")
    signed = F.concat(F.lit("Hà Nội, ngày "), (F.col("physical_page") % 31).cast("string"), F.lit(" tháng 2 năm 2005\n"), F.col("raw_text"))
    named = rows.withColumn("doc_id", text.head_id(F.col("raw_text"), F.col("logical_doc_id"))).withColumn("doc_type", text.document_type(F.col("raw_text"), F.col("doc_id")))
    return named.select(
        "logical_doc_id", "part_no", "physical_page", "doc_id", "doc_type",
        text.document_title(F.col("raw_text"), F.col("doc_id"), F.col("doc_type")).alias("title"), dates.issued_date(signed).alias("issued_date"),
    )


@query(f"""WITH {_PAGES}, b AS (SELECT logical_doc_id, part_no, physical_page, regexp_replace(markdown_content, '(?s)<!--.*?-->', '', 'g') AS t FROM pages WHERE markdown_content IS NOT NULL)
  SELECT logical_doc_id, part_no, physical_page, 'DOC-' || left(sha256({STRIP % f"regexp_replace(t, '{WS}+', ' ', 'g')"}), 24) AS content_id FROM b""")
def content_ids(spark, folder):
    rows = _latest_pages(spark, folder).filter("markdown_content is not null")
    return rows.select("logical_doc_id", "part_no", "physical_page", text.content_id(F.col("markdown_content")).alias("content_id"))


# --- from pages to provisions ---------------------------------------------------------------------------------------------

_A, _C, _D = (p.replace("\\", "\\") for p in (parsing.ARTICLE, parsing.CLAUSE, parsing.POINT))
_PARSED = f"""{_PAGES}, tx AS (SELECT *, {STRIP % "coalesce(raw_text, '')"} AS raw, {STRIP % "regexp_replace(coalesce(markdown_content, ''), '(?s)<!--.*?-->', '', 'g')"} AS marked FROM pages),
  pg AS (SELECT * EXCLUDE (raw, marked), CASE WHEN raw <> '' THEN raw ELSE marked END AS txt FROM tx),
  placed AS (SELECT *, coalesce(sum(len(txt) + 2) OVER (PARTITION BY logical_doc_id ORDER BY part_no, physical_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page_start,
    string_split(regexp_replace(replace(txt, chr(0), ''), '(?im)^{_A}', chr(1) || '\\0', 'g'), chr(1)) AS ps FROM pg),
  cutp AS (SELECT * EXCLUDE (ps, txt), unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM placed),
  st AS (SELECT *, page_start + coalesce(sum(len(piece)) OVER (PARTITION BY logical_doc_id, part_no, physical_page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, lower(regexp_extract(piece, '(?i)^{_A}', 1)) AS number FROM cutp),
  firsts AS (SELECT logical_doc_id, number, min(start) AS start FROM st WHERE number <> '' GROUP BY ALL),
  heads AS (SELECT s.*, f.number AS head FROM st s LEFT JOIN firsts f ON s.logical_doc_id = f.logical_doc_id AND s.start = f.start AND s.number = f.number WHERE piece <> ''),
  owned AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY logical_doc_id ORDER BY part_no, start) AS article_number FROM heads),
  bodies AS (SELECT *, CASE WHEN head IS NOT NULL THEN substr(piece, len(regexp_extract(piece, '(?i)^{_A}', 0)) + 1) ELSE piece END AS rest FROM owned WHERE article_number IS NOT NULL),
  texts AS (SELECT *, CASE WHEN head IS NOT NULL THEN {STRIP % "regexp_extract(rest, '^([^' || chr(10) || ']*)', 1)"} END AS title, {STRIP % "CASE WHEN head IS NOT NULL THEN regexp_replace(rest, '^[^' || chr(10) || ']*' || chr(10) || '?', '') ELSE rest END"} AS body FROM bodies),
  articles AS (SELECT logical_doc_id, article_number, logical_doc_id || ':article:' || article_number AS article_id, max(title) AS title, coalesce(string_agg(body, chr(10) || chr(10) ORDER BY part_no, start) FILTER (body <> ''), '') AS content,
    arg_min(global_page, start) AS first_page, arg_max(global_page, start) AS last_page, count(*) FILTER (body <> '') AS segments FROM texts GROUP BY logical_doc_id, article_number)"""


@query(f"WITH {_PARSED} SELECT logical_doc_id, article_number, article_id, title, content, first_page, last_page, segments::INTEGER AS segments FROM articles")
def articles_parsed(spark, folder):
    found = parsing.articles(_latest_pages(spark, folder))
    return found.select(
        "logical_doc_id", "article_number", "article_id", "title", "content", F.col("first.global_page").alias("first_page"), F.col("last.global_page").alias("last_page"), F.size("segments").alias("segments")
    )


_TREE = f"""{_PARSED}, cp AS (SELECT *, string_split(regexp_replace(content, '(?im)^{_C}', chr(1) || '\\0', 'g'), chr(1)) AS ps FROM articles),
  cu AS (SELECT * EXCLUDE ps, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM cp),
  cs AS (SELECT *, coalesce(sum(len(piece)) OVER (PARTITION BY article_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, regexp_extract(piece, '(?i)^{_C}', 1) AS number FROM cu),
  ck AS (SELECT * FROM cs WHERE number <> '' QUALIFY row_number() OVER (PARTITION BY article_id, number ORDER BY i) = 1),
  clauses AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY article_id ORDER BY start), len(content)) AS stop FROM ck),
  pp AS (SELECT *, string_split(regexp_replace(substr(content, start::BIGINT + 1, (stop - start)::BIGINT), '(?im)^{_D}', chr(1) || '\\0', 'g'), chr(1)) AS ps FROM clauses),
  pu AS (SELECT * EXCLUDE (ps, piece, i), unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM pp),
  pt AS (SELECT *, start + coalesce(sum(len(piece)) OVER (PARTITION BY article_id, number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, lower(regexp_extract(piece, '(?i)^{_D}', 1)) AS letter FROM pu),
  pk AS (SELECT * FROM pt WHERE letter <> '' QUALIFY row_number() OVER (PARTITION BY article_id, number, letter ORDER BY i) = 1),
  points AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY article_id, number ORDER BY pos), stop) AS until FROM pk),
  tree AS (SELECT article_id AS provision_id, logical_doc_id, article_id, NULL AS parent_provision_id, 'article' AS level, article_number AS provision_number, lower(article_number) AS provision_path, coalesce(title, '') AS title, 0 AS s,
      coalesce((SELECT min(c.start) FROM clauses c WHERE c.article_id = a.article_id), len(content)) AS e, content FROM articles a
    UNION ALL SELECT logical_doc_id || ':provision:' || lower(article_number) || '.' || number, logical_doc_id, article_id, article_id, 'clause', number, lower(article_number) || '.' || number, coalesce(title, '') || ', khoản ' || number, start,
      coalesce((SELECT min(p.pos) FROM points p WHERE p.article_id = c.article_id AND p.number = c.number), stop), content FROM clauses c
    UNION ALL SELECT logical_doc_id || ':provision:' || lower(article_number) || '.' || number || '.' || letter, logical_doc_id, article_id, logical_doc_id || ':provision:' || lower(article_number) || '.' || number, 'point', letter, lower(article_number) || '.' || number || '.' || letter,
      coalesce(title, '') || ', khoản ' || number || ', điểm ' || letter, pos, until, content FROM points)"""


@query(f"WITH {_TREE} SELECT provision_id, parent_provision_id, level, provision_number, provision_path, title, {STRIP % 'substr(content, s::BIGINT + 1, (e - s)::BIGINT)'} AS content, s::INTEGER AS text_start, e::INTEGER AS text_end FROM tree")
def provisions_parsed(spark, folder):
    found = parsing.provisions(parsing.articles(_latest_pages(spark, folder)))
    return found.select("provision_id", "parent_provision_id", "level", "provision_number", "provision_path", "title", "content", "text_start", "text_end")


@query(f"""WITH {_TREE}, seg AS (SELECT logical_doc_id || ':article:' || article_number AS article_id, global_page, body, coalesce(sum(len(body) + 2) OVER (PARTITION BY logical_doc_id, article_number ORDER BY part_no, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM texts WHERE body <> ''),
  clip AS (SELECT t.provision_id, g.global_page, {STRIP % 'substr(content, greatest(a, s)::BIGINT + 1, (least(a + len(body), e) - greatest(a, s))::BIGINT)'} AS piece FROM tree t JOIN seg g USING (article_id) WHERE greatest(a, s) < least(a + len(body), e))
  SELECT * FROM clip WHERE piece <> ''""")
def provision_pages_parsed(spark, folder):
    """Which part of each provision stands on which page."""
    found = parsing.provisions(parsing.articles(_latest_pages(spark, folder)))
    return found.select("provision_id", F.explode("page_segments").alias("g")).select("provision_id", "g.global_page", F.col("g.text").alias("piece"))


# --- rules of effect ------------------------------------------------------------------------------------------------------

_FORCE = r"co\s+hieu\s+luc(?:\s+thi\s+hanh)?(\s+(?:ke\s+tu|tu|vao)\s+ngay.*)"


def _rule_date(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN {sql_date(*(f"regexp_extract({c}, '{p}', {g})" for g in order))}" for p, order in parsing.DATES) + " END"


_SAID = f"""texts AS (SELECT logical_doc_id, string_agg(DISTINCT source_text, ' ' ORDER BY source_text) AS t FROM silver_effectivity_rules GROUP BY logical_doc_id),
  sent AS (SELECT logical_doc_id, unnest(s) AS source_text, generate_subscripts(s, 1) - 1 AS sentence_no FROM (SELECT logical_doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(t, '{WS}+', ' ', 'g'), '\\. +', '.' || chr(1), 'g'), ';', chr(1), 'g'), chr(1)) AS s FROM texts)),
  said AS (SELECT *, {FOLD % 'source_text'} AS f FROM sent), eff AS (SELECT *, regexp_extract(f, '(?s){_FORCE}', 1) AS behind FROM said WHERE regexp_matches(f, '(?s){_FORCE}')),
  cutf AS (SELECT *, regexp_replace(f, '{parsing.POINT_REF}', '#', 'g') AS f1 FROM eff), cutg AS (SELECT *, regexp_replace(f1, '{parsing.CLAUSE_REF}', '#', 'g') AS f2 FROM cutf),
  refs AS (SELECT *, list_concat(list_concat(
      list_transform(regexp_extract_all(f, '{parsing.POINT_REF}'), lambda x: regexp_replace(x, '^{parsing.POINT_REF}$', '\\3.\\2.\\1')),
      list_transform(regexp_extract_all(f1, '{parsing.CLAUSE_REF}'), lambda x: regexp_replace(x, '^{parsing.CLAUSE_REF}$', '\\2.\\1'))),
      regexp_extract_all(regexp_replace(f2, '(khoan|diem)\\s+dieu', '#', 'g'), 'dieu\\s+([0-9]+[a-z]?)', 1)) AS r FROM cutg),
  rules AS (SELECT logical_doc_id, sentence_no, source_text, {_rule_date('behind')} AS effective_from, CASE WHEN len(r) > 0 THEN r WHEN regexp_matches(f, '{parsing.WHOLE}') THEN ['*'] ELSE [] END AS targets FROM refs),
  found AS (SELECT logical_doc_id, sentence_no, generate_subscripts(targets, 1) - 1 AS target_no, unnest(targets) AS target_path, effective_from, CASE WHEN effective_from IS NULL THEN 'external_trigger' ELSE 'explicit_date' END AS mode, source_text FROM rules),
  kept AS (SELECT * FROM found WHERE target_path <> '*' UNION ALL (SELECT * FROM found WHERE target_path = '*' QUALIFY row_number() OVER (PARTITION BY logical_doc_id ORDER BY mode <> 'explicit_date', sentence_no, target_no) = 1))"""


def _rule_texts(spark, folder):
    rows = table(spark, folder, "silver_effectivity_rules").groupBy("logical_doc_id").agg(F.sort_array(F.collect_set("source_text")).alias("s"))
    return parsing.effect_rules(rows.select("logical_doc_id", F.array_join("s", " ").alias("t")), ["logical_doc_id"], "t")


@query(f"WITH {_SAID} SELECT logical_doc_id, target_path, mode, effective_from, CASE WHEN effective_from IS NULL THEN source_text END AS trigger_reference, source_text FROM kept")
def rules_extracted(spark, folder):
    """What a document's sentences on effect say, taken as one text."""
    found = parsing.document_rules(_rule_texts(spark, folder), "logical_doc_id", ["place"])
    return found.select("logical_doc_id", "target_path", "mode", "effective_from", "trigger_reference", "source_text")


@query(f"""WITH {_SAID} SELECT logical_doc_id, target_path AS article_number, arg_max(effective_from, (sentence_no, target_no)) AS effective_from FROM found WHERE target_path <> '*' AND NOT contains(target_path, '.') AND mode = 'explicit_date' GROUP BY ALL
  UNION ALL SELECT logical_doc_id, NULL, effective_from FROM kept WHERE target_path = '*' AND mode = 'explicit_date'""")
def article_dates(spark, folder):
    return parsing.article_dates(_rule_texts(spark, folder), "logical_doc_id", ["place"])


@query(f"""WITH {_SAID}, a AS (SELECT DISTINCT logical_doc_id, target_path, effective_from FROM kept WHERE effective_from IS NOT NULL), b AS (SELECT DISTINCT logical_doc_id, target_path, effective_from FROM silver_effectivity_rules WHERE effective_from IS NOT NULL)
  SELECT count(*) AS known, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.logical_doc_id = b.logical_doc_id AND a.target_path = b.target_path AND a.effective_from = b.effective_from)) AS found FROM b""")
def rules_found_again(spark, folder):
    """How many of the table's dated rules the extraction finds in its sentences."""
    key = ["logical_doc_id", "target_path", "effective_from"]
    b = table(spark, folder, "silver_effectivity_rules").filter("effective_from is not null").select(*key).distinct()
    a = rules_extracted(spark, folder).filter("effective_from is not null").select(*key).distinct().withColumn("there", F.lit(1))
    return b.join(a, key, "left").agg(F.count("*").alias("known"), F.count("there").alias("found"))


# --- faults in trees and rules --------------------------------------------------------------------------------------------

_BAD_TREE = f"""{P}, planted AS (SELECT provision_id, logical_doc_id, CASE WHEN len(content) % 11 = 0 THEN NULL WHEN len(content) % 23 = 0 THEN 'none' ELSE parent_provision_id END AS parent_provision_id, CASE WHEN len(content) % 13 = 0 THEN 'section' ELSE level END AS level,
    CASE WHEN len(content) % 17 = 0 THEN provision_path || 'x' ELSE provision_path END AS provision_path, provision_number, CASE WHEN len(content) % 29 = 0 THEN 'maybe' ELSE effectivity_mode END AS effectivity_mode, content FROM provisions),
  rows_ AS (SELECT DISTINCT * EXCLUDE content FROM (FROM planted UNION ALL SELECT * REPLACE (provision_number || 'b' AS provision_number) FROM planted WHERE len(content) % 19 = 0)),
  up AS (SELECT provision_id AS parent_id, min(level) AS parent_level, min(provision_path) AS parent_path FROM rows_ GROUP BY 1),
  j AS (SELECT r.*, u.*, count(*) OVER (PARTITION BY r.provision_id) AS same_id, count(*) OVER (PARTITION BY r.logical_doc_id, r.provision_path) AS same_path FROM rows_ r LEFT JOIN up u ON r.parent_provision_id = u.parent_id)"""


def _bad_tree(spark, folder):
    n = F.length("content")
    rows = table(spark, folder, "silver_provisions").select(
        "provision_id", "logical_doc_id", F.when(n % 11 == 0, None).when(n % 23 == 0, "none").otherwise(F.col("parent_provision_id")).alias("parent_provision_id"), F.when(n % 13 == 0, "section").otherwise(F.col("level")).alias("level"),
        F.when(n % 17 == 0, F.concat("provision_path", F.lit("x"))).otherwise(F.col("provision_path")).alias("provision_path"), "provision_number", F.when(n % 29 == 0, "maybe").otherwise(F.col("effectivity_mode")).alias("effectivity_mode"), n.alias("n"),
    )
    return rows.unionByName(rows.filter("n % 19 = 0").withColumn("provision_number", F.concat("provision_number", F.lit("b"))))


@query(f"""WITH {_BAD_TREE}, c AS (SELECT DISTINCT provision_id, logical_doc_id, provision_path, list_sort(list_filter([CASE WHEN same_id > 1 THEN 'ID_NOT_UNIQUE' END, CASE WHEN same_path > 1 THEN 'PATH_NOT_UNIQUE' END,
    CASE WHEN level NOT IN ('article', 'clause', 'point') THEN 'LEVEL_UNKNOWN' END, CASE WHEN parent_provision_id IS NOT NULL AND parent_id IS NULL THEN 'PARENT_MISSING' END,
    CASE WHEN level = 'article' AND (parent_id IS NOT NULL OR provision_path <> provision_number) THEN 'ROOT_INVALID' END,
    CASE WHEN (parent_provision_id IS NULL OR parent_id IS NOT NULL) AND ((level = 'clause' AND (parent_level IS NULL OR parent_level <> 'article')) OR (level = 'point' AND (parent_level IS NULL OR parent_level <> 'clause'))) THEN 'PARENT_LEVEL_INVALID' END,
    CASE WHEN level IN ('clause', 'point') AND parent_id IS NOT NULL AND provision_path <> parent_path || '.' || provision_number THEN 'PATH_INVALID' END,
    CASE WHEN effectivity_mode NOT IN ('inherit', 'explicit_date', 'external_trigger', 'unknown') THEN 'MODE_UNKNOWN' END], lambda x: x IS NOT NULL)) AS codes FROM j)
  SELECT * FROM c WHERE len(codes) > 0""")
def tree_issues(spark, folder):
    return structure.tree_issues(_bad_tree(spark, folder))


_BAD_RULES = f"""r0 AS (SELECT DISTINCT rule_id, logical_doc_id, target_path, mode, effective_from, effective_to, trigger_reference, len(source_text) + len(rule_id || target_path) AS n FROM silver_effectivity_rules),
  r AS (SELECT rule_id, logical_doc_id, CASE WHEN n % 7 = 0 THEN '999' ELSE target_path END AS target_path, mode, CASE WHEN n % 5 = 0 THEN NULL ELSE effective_from END AS effective_from, effective_to, trigger_reference FROM r0
    UNION ALL SELECT rule_id || 'b', logical_doc_id, target_path, 'external_trigger', NULL, effective_to, CASE WHEN n % 2 = 0 THEN 'khi có hướng dẫn' END FROM r0 WHERE n % 3 = 0)"""


@query(f"""WITH {P}, {_BAD_RULES},
  k AS (SELECT logical_doc_id, target_path, count(DISTINCT (mode, coalesce(effective_from::VARCHAR, ''), coalesce(effective_to::VARCHAR, ''), coalesce(trigger_reference, ''))) AS said FROM r GROUP BY ALL),
  c AS (SELECT rule_id, list_filter([CASE WHEN target_path <> '*' AND NOT EXISTS (SELECT 1 FROM provisions p WHERE p.logical_doc_id = r.logical_doc_id AND p.provision_path = r.target_path) THEN 'TARGET_UNKNOWN' END,
    CASE WHEN (mode = 'explicit_date' AND effective_from IS NULL) OR (mode = 'external_trigger' AND trigger_reference IS NULL) THEN 'FIELD_MISSING' END,
    CASE WHEN (SELECT said FROM k WHERE k.logical_doc_id = r.logical_doc_id AND k.target_path = r.target_path) > 1 THEN 'RULES_CONFLICT' END], lambda x: x IS NOT NULL) AS codes FROM r)
  SELECT * FROM c WHERE len(codes) > 0""")
def rule_issues(spark, folder):
    rows = table(spark, folder, "silver_effectivity_rules").select(
        "rule_id", "logical_doc_id", "target_path", "mode", "effective_from", "effective_to", "trigger_reference", (F.length("source_text") + F.length(F.concat("rule_id", "target_path"))).alias("n")
    ).distinct()
    bad = rows.withColumn("target_path", F.when(F.col("n") % 7 == 0, "999").otherwise(F.col("target_path"))).withColumn("effective_from", F.when(F.col("n") % 5 == 0, None).otherwise(F.col("effective_from")))
    more = rows.filter("n % 3 = 0").withColumns({
        "rule_id": F.concat("rule_id", F.lit("b")), "mode": F.lit("external_trigger"), "effective_from": F.lit(None).cast("date"), "trigger_reference": F.when(F.col("n") % 2 == 0, "khi có hướng dẫn"),
    })
    return structure.rule_issues(bad.unionByName(more), table(spark, folder, "silver_provisions"))


# --- the temporal retriever -----------------------------------------------------------------------------------------------

_ENDED = f"""{_CHUNKS}, told AS (SELECT DISTINCT logical_doc_id AS d, target_path AS p, CASE WHEN len(rule_id) % 2 = 0 THEN NULL ELSE 'x' END AS x, effective_to AS e FROM silver_effectivity_rules WHERE effective_to IS NOT NULL AND target_path <> '*'
    UNION SELECT logical_doc_id, NULL, provision_id, effective_from + 400 FROM provisions WHERE len(content) % 9 = 0 AND effective_from IS NOT NULL),
  corpus AS (SELECT c.chunk_id, p.logical_doc_id, c.provision_id, p.provision_path, c.text_content AS text, p.issued_date, p.effective_from,
    least(p.effective_to, (SELECT min(e) FROM told WHERE d = p.logical_doc_id AND (told.p IS NULL OR told.p = p.provision_path) AND (told.x IS NULL OR told.x = p.provision_id))) AS effective_to FROM chunks c JOIN provisions p USING (provision_id))"""


def _corpus(spark, folder):
    dated = ("provision_path", "issued_date", "effective_from", "effective_to")
    return chunking.chunks(table(spark, folder, "silver_provisions"), inherit=dated).withColumnRenamed("text_content", "text").select("chunk_id", "logical_doc_id", "provision_id", *dated, "text")


def _supersession(spark, folder):
    """Ends by path, of which some name an id that nothing has, and ends by provision."""
    by_path = table(spark, folder, "silver_effectivity_rules").filter("effective_to is not null and target_path <> '*'").select(
        F.col("logical_doc_id").alias("target_logical_doc_id"), F.lit(None).cast("string").alias("target_chunk_id"), F.when(F.length("rule_id") % 2 == 0, None).otherwise(F.lit("x")).alias("target_provision_id"), F.col("target_path").alias("target_provision_path"), "effective_to",
    )
    by_id = table(spark, folder, "silver_provisions").filter("length(content) % 9 = 0 and effective_from is not null").select(
        F.col("logical_doc_id").alias("target_logical_doc_id"), F.lit(None).cast("string").alias("target_chunk_id"), F.col("provision_id").alias("target_provision_id"), F.lit(None).cast("string").alias("target_provision_path"), F.date_add("effective_from", 400).alias("effective_to"),
    )
    return by_path.unionByName(by_id).distinct()


@query(f"WITH {_ENDED} SELECT chunk_id, effective_from, effective_to FROM corpus")
def chunk_ends(spark, folder):
    """Ends of chunks as scoped supersession rules bring them forward."""
    return ranking.ends_brought_forward(_corpus(spark, folder), _supersession(spark, folder)).select("chunk_id", "effective_from", "effective_to")


_GRAMS = "list_distinct(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"
_RANKED = f"""{_ENDED}, {_ASKED}, words AS (SELECT *, regexp_extract_all(lower(text), {W}) AS w FROM corpus), q AS (SELECT *, regexp_extract_all(lower(question), {W}) AS w,
      list_transform(regexp_extract_all(upper(question), '[0-9]+/[0-9]{{4}}/[A-ZĐ0-9]+(?:-[A-ZĐ0-9]+)*'), lambda x: x) AS named, regexp_matches(lower(question), 'hiệu lực|thi hành|áp dụng|bắt đầu') AS effect FROM asked WHERE t IS NOT NULL),
  elig AS (SELECT sample_id, chunk_id, len(words.w) AS n_words FROM q JOIN words ON CASE WHEN basis = 'effective' THEN effective_from <= t AND (effective_to IS NULL OR effective_to > t) ELSE issued_date <= t END),
  stat AS (SELECT sample_id, count(*) AS n, greatest(avg(n_words), 1) AS mean FROM elig GROUP BY 1),
  qt AS (SELECT sample_id, term, count(*)::DOUBLE AS times, 0 AS gram FROM (SELECT sample_id, unnest(w) AS term FROM q) GROUP BY ALL UNION ALL SELECT sample_id, unnest({_GRAMS}), NULL, 1 FROM q),
  ct AS (SELECT chunk_id, term, count(*) AS tf, 0 AS gram FROM (SELECT chunk_id, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM qt WHERE gram = 0) GROUP BY ALL
    UNION ALL SELECT * FROM (SELECT chunk_id, unnest({_GRAMS}) AS term, 1, 1 FROM words) WHERE term IN (SELECT term FROM qt WHERE gram = 1)),
  met AS (SELECT e.sample_id, e.chunk_id, e.n_words, c.term, c.gram, c.tf, qt.times FROM qt JOIN ct c USING (term, gram) JOIN elig e ON e.sample_id = qt.sample_id AND e.chunk_id = c.chunk_id),
  df AS (SELECT sample_id, term, gram, count(*) AS df FROM met GROUP BY ALL),
  lex AS (SELECT m.sample_id, m.chunk_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * CASE WHEN gram = 0 THEN times * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_words / mean)) WHEN len(term) - len(replace(term, ' ', '')) = 1 THEN 1.0::DOUBLE ELSE 1.4::DOUBLE END) AS s
    FROM met m JOIN df USING (sample_id, term, gram) JOIN stat USING (sample_id) GROUP BY ALL),
  scored AS (SELECT e.sample_id, e.chunk_id, k.provision_id, round(coalesce(l.s, 0) + CASE WHEN list_contains(q.named, upper(k.logical_doc_id)) THEN 8 ELSE 0 END + CASE WHEN q.effect AND (regexp_matches(k.text, '(^|[^0-9])' || strftime(t, '%Y-%m-%d') || '([^0-9]|$)')
      OR regexp_matches(k.text, '(^|[^0-9])0?' || day(t) || '[/.]0?' || month(t) || '[/.]' || year(t) || '([^0-9]|$)') OR regexp_matches(k.text, '(?i)(^|[^0-9])0?' || day(t) || '\\s+tháng\\s+0?' || month(t) || '\\s+năm\\s+' || year(t) || '([^0-9]|$)')) THEN 20 ELSE 0 END, 6) AS score
    FROM elig e JOIN q USING (sample_id) JOIN corpus k USING (chunk_id) LEFT JOIN lex l USING (sample_id, chunk_id)),
  one AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY sample_id, provision_id ORDER BY score DESC, chunk_id) = 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, chunk_id)::INTEGER AS rank_no FROM one QUALIFY rank_no <= 5)"""


@query(f"""WITH {_RANKED} SELECT r.sample_id, r.rank_no, r.chunk_id, r.provision_id, r.score, q.basis AS date_basis, k.effective_to, CASE WHEN k.effective_from IS NOT NULL THEN k.effective_from <= t AND (k.effective_to IS NULL OR t < k.effective_to) END AS in_force
  FROM ranked r JOIN q USING (sample_id) JOIN corpus k USING (chunk_id)""")
def temporal_topk(spark, folder):
    """The whole temporal retriever: date basis, supersession, BM25 and phrases over the eligible chunks, boosts, one chunk a provision."""
    found = ranking.temporal(_corpus(spark, folder), _asked(spark, folder), 5, _supersession(spark, folder))
    return found.select("sample_id", "rank_no", "chunk_id", "provision_id", "score", "date_basis", "effective_to", "in_force")


# --- contracts ------------------------------------------------------------------------------------------------------------

_R = "(coalesce(try_cast(regexp_extract(logical_doc_id, '^([0-9]+)', 1) AS INTEGER), 8) % 10)"
_DOCS = f"""{P}, dp AS (SELECT logical_doc_id, min(issued_date) AS issued_date, min(effective_from) AS effective_from, max(effective_to) AS effective_to, min(title) AS title FROM provisions GROUP BY 1),
  bl AS (SELECT * FROM bronze_pdf_parts QUALIFY row_number() OVER (PARTITION BY logical_doc_id, part_no ORDER BY ingested_at DESC, physical_file_id) = 1), b1 AS (SELECT * FROM bl WHERE part_no = 1),
  dm AS (SELECT logical_doc_id AS doc_id, CASE WHEN {_R} = 4 THEN ' ' ELSE title END AS title, issued_date, effective_from, CASE WHEN {_R} = 6 THEN effective_from ELSE effective_to END AS effective_to, CASE WHEN {_R} = 5 THEN 'Công văn' ELSE 'Luật' END AS doc_type,
    CASE {_R} WHEN 0 THEN NULL WHEN 1 THEN file_path || '.gone' ELSE file_path END AS storage_path, CASE {_R} WHEN 2 THEN NULL WHEN 3 THEN 'ff' ELSE upper(physical_file_id) END AS doc_version_hash FROM dp JOIN b1 USING (logical_doc_id)),
  files AS (SELECT file_path AS path, max(CASE WHEN {_R} = 7 THEN NULL ELSE physical_file_id END) AS file_hash, true AS there FROM bl GROUP BY file_path),
  dh AS (SELECT d.*, coalesce(there, false) AS there, file_hash FROM dm d LEFT JOIN files f ON d.storage_path = f.path),
  sc AS (SELECT *, title IS NULL OR trim(title) = '' OR issued_date IS NULL OR effective_from IS NULL OR NOT regexp_full_match(doc_id, '[0-9]+/[0-9]{{4}}/(NĐ-CP|TT-[A-Z]+|QH[0-9]+|QĐ-[A-Za-z]+|NQ-[A-Z]+)|DOC-[0-9a-f]{{24}}') OR doc_type NOT IN ('Nghị định', 'Thông tư', 'Luật', 'Quyết định', 'Nghị quyết') AS bad FROM dh),
  pv AS (SELECT *, CASE WHEN coalesce(storage_path, '') = '' THEN 'STORAGE_PATH_MISSING' WHEN NOT there THEN 'SOURCE_FILE_NOT_FOUND' WHEN file_hash IS NULL THEN 'SOURCE_HASH_FAILED' WHEN coalesce(doc_version_hash, '') = '' THEN 'DOCUMENT_HASH_MISSING' WHEN lower(doc_version_hash) <> file_hash THEN 'DOCUMENT_HASH_MISMATCH' END AS prov FROM sc)"""


def _number(c: str):
    return F.coalesce(F.regexp_extract(c, "^([0-9]+)", 1).try_cast("int"), F.lit(8)) % 10


def _documents(spark, folder):
    """One row per document with its file's hash, and faults planted by the number's last digit."""
    r = _number("logical_doc_id")
    own = _provisions(spark, folder, "provision_id", "logical_doc_id", "issued_date", "effective_from", "effective_to", "title").groupBy("logical_doc_id").agg(
        F.min("issued_date").alias("issued_date"), F.min("effective_from").alias("effective_from"), F.max("effective_to").alias("effective_to"), F.min("title").alias("title")
    )
    parts = lake.latest(table(spark, folder, "bronze_pdf_parts"), ["logical_doc_id", "part_no"], F.desc("ingested_at"), F.asc("physical_file_id"))
    joined = own.join(parts.filter("part_no = 1").select("logical_doc_id", "file_path", "physical_file_id"), "logical_doc_id")
    rows = joined.select(
        F.col("logical_doc_id").alias("doc_id"), F.when(r == 4, " ").otherwise(F.col("title")).alias("title"), "issued_date", "effective_from", F.when(r == 6, F.col("effective_from")).otherwise(F.col("effective_to")).alias("effective_to"),
        F.when(r == 5, "Công văn").otherwise("Luật").alias("doc_type"), F.when(r == 0, None).when(r == 1, F.concat("file_path", F.lit(".gone"))).otherwise(F.col("file_path")).alias("storage_path"),
        F.when(r == 2, None).when(r == 3, "ff").otherwise(F.upper("physical_file_id")).alias("doc_version_hash"),
    )
    files = parts.select(F.col("file_path").alias("path"), F.when(_number("logical_doc_id") != 7, F.col("physical_file_id")).alias("file_hash"))
    return contracts.with_file_hashes(rows, files)


_REPORT = "list_sort(list_filter([%s], lambda x: x IS NOT NULL))"


@query(f"WITH {_DOCS} SELECT doc_id, CASE WHEN bad THEN ['SCHEMA_VIOLATION'] WHEN prov IS NOT NULL THEN [prov] ELSE [] END AS codes, CASE WHEN bad OR prov IS NOT NULL THEN 'QUARANTINE' ELSE 'PASSED' END AS status_code FROM pv")
def bronze_checkpoint(spark, folder):
    return contracts.named_checkpoint(_documents(spark, folder), "bronze").select("doc_id", "codes", "status_code")


@query(f"""WITH {_DOCS} SELECT 'bronze' AS checkpoint, regexp_replace(doc_id, '[^\\p{{L}}\\p{{N}}_.-]+', '_', 'g') AS report_name, '{{"doc_id":"' || doc_id || '","checkpoint":"bronze","status_code":"QUARANTINE","codes":["' || CASE WHEN bad THEN 'SCHEMA_VIOLATION' ELSE prov END || '"]}}' AS report
  FROM pv WHERE bad OR prov IS NOT NULL""")
def quarantine_reports(spark, folder):
    return contracts.quarantine_reports(contracts.named_checkpoint(_documents(spark, folder), "bronze"))


_SILVER = f"""{_DOCS}, tp AS (SELECT *, CASE WHEN effective_from < issued_date THEN 'INVALID_START_DATE' END AS a, CASE WHEN effective_to <= effective_from THEN 'INVALID_END_DATE' END AS b FROM pv)"""


@query(f"WITH {_SILVER} SELECT doc_id, CASE WHEN bad THEN ['SCHEMA_VIOLATION'] ELSE {_REPORT % 'a, b'} END AS codes FROM tp")
def silver_document_checkpoint(spark, folder):
    """Schema and dates of the silver checkpoint; its quality layer is checked by page in quality_contract."""
    good = _documents(spark, folder).withColumn("text", F.lit("Điều này có đủ dấu tiếng Việt")).withColumn("tables_json", F.lit("[]"))
    return contracts.named_checkpoint(good, "silver").select("doc_id", "codes")


# Chunks checked with their documents: another document's, an old version's, without a provision, with a false hash or no page.
_CHECKED = f"""{_DOCS}, {_CHUNKS.split(", seg AS", 1)[1].join(["seg AS", ""])},
  cc AS (SELECT c.*, p.logical_doc_id AS of_doc, len(text_content) % 50 AS m, len(text_content) AS l FROM chunks c JOIN provisions p USING (provision_id)),
  ch AS (SELECT of_doc, chunk_id, CASE WHEN m = 1 THEN 'other' ELSE of_doc END AS chunk_doc_id, CASE WHEN m = 2 THEN NULL ELSE provision_id END AS provision_id, CASE WHEN m = 3 THEN 0 ELSE global_page END AS page_number, text_content AS text,
    CASE WHEN m = 4 THEN 'old' ELSE version END AS chunk_version, m FROM cc WHERE coalesce(try_cast(regexp_extract(of_doc, '^([0-9]+)', 1) AS INTEGER), 8) % 10 <> 9 AND (l % 40 <> 0 OR m > 4)),
  hh AS (SELECT ch.*, pv.file_hash, CASE WHEN m = 5 THEN 'false' ELSE sha256('chunk_id=' || chunk_id || chr(10) || 'doc_version_hash=' || chunk_version || chr(10) || 'text=' || text) END AS chunk_hash FROM ch JOIN pv ON of_doc = doc_id),
  each AS (SELECT of_doc, unnest(CASE WHEN page_number IS NULL OR page_number < 1 THEN ['CHUNK_PROVENANCE_INVALID'] ELSE list_filter([CASE WHEN chunk_doc_id <> of_doc THEN 'CHUNK_DOC_ID_MISMATCH' END, CASE WHEN provision_id IS NULL THEN 'PROVISION_ID_MISSING' END,
    CASE WHEN file_hash IS NULL OR lower(chunk_version) <> file_hash THEN 'CHUNK_DOCUMENT_HASH_MISMATCH' END, CASE WHEN m = 5 THEN 'CHUNK_HASH_MISMATCH' END], lambda x: x IS NOT NULL) END) AS code FROM hh),
  issues AS (SELECT doc_id, CASE WHEN NOT EXISTS (SELECT 1 FROM hh WHERE of_doc = doc_id) THEN ['CHUNKS_MISSING'] ELSE coalesce((SELECT list_sort(list(DISTINCT code)) FROM each WHERE of_doc = doc_id), []) END AS chunk_issues FROM pv)"""


def _checked_chunks(spark, folder):
    made = chunking.chunks(table(spark, folder, "silver_provisions"))
    m, size = F.length("text_content") % 50, F.length("text_content")
    kept = made.filter((_number("logical_doc_id") != 9) & ((size % 40 != 0) | (m > 4)))
    version = F.when(m == 4, "old").otherwise(F.coalesce("physical_file_id", F.lit("")))
    return kept.select(
        F.col("logical_doc_id").alias("of_doc"), "chunk_id", F.when(m == 1, "other").otherwise(F.col("logical_doc_id")).alias("chunk_doc_id"), F.when(m == 2, None).otherwise(F.col("provision_id")).alias("provision_id"),
        F.when(m == 3, 0).otherwise(F.col("global_page")).alias("page_number"), F.col("text_content").alias("text"), version.alias("chunk_version"),
        F.when(m == 5, "false").otherwise(chunking.chunk_hash(F.col("chunk_id"), version, F.col("text_content"))).alias("chunk_hash"),
    )


@query(f"WITH {_CHECKED} SELECT doc_id, chunk_issues FROM issues")
def chunk_provenance_by_document(spark, folder):
    return contracts.chunk_provenance(_documents(spark, folder), _checked_chunks(spark, folder))


@query(f"WITH {_CHECKED} SELECT doc_id, CASE WHEN bad THEN ['SCHEMA_VIOLATION'] ELSE list_sort(list_concat(CASE WHEN prov IS NULL THEN [] ELSE [prov] END, chunk_issues)) END AS codes FROM pv JOIN issues USING (doc_id)")
def gold_checkpoint(spark, folder):
    documents = _documents(spark, folder)
    issues = contracts.chunk_provenance(documents, _checked_chunks(spark, folder))
    return contracts.named_checkpoint(documents.join(issues, "doc_id"), "gold").select("doc_id", "codes")


@query(f"""WITH {_SILVER}, f AS (SELECT CASE WHEN {_R.replace('logical_doc_id', 'doc_id')} IN (4, 5) THEN 'schema' WHEN {_R.replace('logical_doc_id', 'doc_id')} = 6 THEN 'dates' ELSE 'clean' END AS mutation_type, CASE WHEN bad OR a IS NOT NULL OR b IS NOT NULL THEN 'QUARANTINE' ELSE 'PASSED' END AS actual FROM tp)
  SELECT count(*) FILTER (mutation_type <> 'clean') AS expected_n, round(count(*) FILTER (mutation_type <> 'clean' AND actual = 'QUARANTINE')::DOUBLE / nullif(count(*) FILTER (mutation_type <> 'clean'), 0), 6) AS rate FROM f""")
def planted_detection_rate(spark, folder):
    """How many of the documents with a planted fault of schema or dates the silver checkpoint quarantines."""
    good = _documents(spark, folder).withColumn("text", F.lit("Điều này có đủ dấu tiếng Việt")).withColumn("tables_json", F.lit("[]"))
    r = _number("doc_id")
    kind = F.when(r.isin(4, 5), "schema").when(r == 6, "dates").otherwise("clean")
    checked = contracts.named_checkpoint(good, "silver").select(kind.alias("mutation_type"), F.when(kind == "clean", "PASSED").otherwise("QUARANTINE").alias("expected"), F.col("status_code").alias("actual"))
    return evaluation.detection_rate(checked)


# --- evaluation -----------------------------------------------------------------------------------------------------------

# Labels that the hits don't decide: the first chunk's provision by its id, the second's by its path, and the least provision of
# the first chunk's document; answers that cite the first, the first and the last, or no document.
_LABELLED = f"""{P}, n AS (SELECT DISTINCT sample_id, question, rank_no, chunk_id, logical_doc_id, provision_id, provision_path, text, effective_from, effective_to FROM naive_q100),
  lat AS (SELECT sample_id, max(latency_ms) AS latency_ms FROM naive_q100 GROUP BY 1), least_ AS (SELECT logical_doc_id, min(provision_id) AS least FROM provisions GROUP BY 1),
  top AS (SELECT sample_id, max(question) AS question, arg_min((chunk_id, logical_doc_id, provision_id, text), rank_no) AS a, arg_min((logical_doc_id, provision_path), rank_no) FILTER (rank_no > 1) AS b, arg_max(logical_doc_id, rank_no) AS z FROM n GROUP BY sample_id),
  lab AS (SELECT sample_id, question, len(question) % 3 AS way, a[1] AS a_chunk, a[2] AS a_doc, a[3] AS a_prov, a[4] AS a_text, b[1] AS b_doc, b[2] AS b_path, z, least, latency_ms, {_event('question')} AS t FROM top LEFT JOIN least_ ON least_.logical_doc_id = a[2] LEFT JOIN lat USING (sample_id)),
  ans AS (SELECT *, CASE way WHEN 0 THEN regexp_extract(a_text, '^([^.]*\\.?)', 1) || ' Zzz 1.' || chr(10) || 'Nguồn: ' || a_doc WHEN 1 THEN question || chr(10) || 'Nguồn: ' || a_doc || '; ' || z ELSE CASE WHEN len(question) % 2 = 0 THEN ' ' ELSE 'Không đủ thông tin trong tài liệu.' END END AS answer FROM lab),
  k5 AS (SELECT * FROM n WHERE rank_no <= 5)"""


def _labelled(spark, folder):
    rows = table(spark, folder, "naive_q100")
    n = rows.select("sample_id", "question", "rank_no", "chunk_id", "logical_doc_id", "provision_id", "provision_path", "text", "effective_from", "effective_to").distinct()
    chunk = F.struct("rank_no", "chunk_id", "logical_doc_id", "provision_id", "provision_path", "text", "effective_from", "effective_to")
    one = n.groupBy("sample_id").agg(F.max("question").alias("question"), F.array_sort(F.collect_list(chunk)).alias("chunks"))
    a, b, z = F.get("chunks", F.lit(0)), F.get("chunks", F.lit(1)), F.element_at("chunks", -1)
    least = _provisions(spark, folder, "provision_id", "logical_doc_id").groupBy(F.col("logical_doc_id").alias("first_doc")).agg(F.min("provision_id").alias("least"))
    latency = rows.groupBy("sample_id").agg(F.max("latency_ms").alias("latency_ms"))
    joined = one.withColumn("first_doc", a["logical_doc_id"]).join(least, "first_doc", "left").join(latency, "sample_id", "left")
    way, q = F.length("question") % 3, F.col("question")
    ref = lambda doc, pid, path: F.struct(doc.alias("logical_doc_id"), pid.alias("provision_id"), path.alias("provision_path"))
    none = F.lit(None).cast("string")
    refs = F.array(ref(a["logical_doc_id"], a["provision_id"], none), ref(b["logical_doc_id"], none, b["provision_path"]), ref(a["logical_doc_id"], F.col("least"), none))
    answer = (
        F.when(way == 0, F.concat(F.regexp_extract(a["text"], r"^([^.]*\.?)", 1), F.lit(" Zzz 1.\nNguồn: "), a["logical_doc_id"]))
        .when(way == 1, F.concat(q, F.lit("\nNguồn: "), a["logical_doc_id"], F.lit("; "), z["logical_doc_id"]))
        .otherwise(F.when(F.length(q) % 2 == 0, " ").otherwise("Không đủ thông tin trong tài liệu."))
    )
    empty = F.array().cast("array<string>")
    return joined.select(
        "sample_id", F.lit("naive").alias("model"), "chunks", answer.alias("answer"), F.when(way == 2, F.array().cast(refs_type)).otherwise(refs).alias("gold_provisions"),
        F.when((way == 2) & (F.length(q) % 5 != 0), F.array(a["chunk_id"], F.lit("no such chunk"))).otherwise(empty).alias("gold_chunks"),
        F.when(way == 1, F.array(F.lower(a["logical_doc_id"]))).otherwise(empty).alias("gold_citations"), F.array(a["logical_doc_id"]).alias("gold_docs"),
        dates.event_date(q).alias("t_event"), F.when(F.length(q) % 7 == 0, "issued").otherwise("effective").alias("basis"), "latency_ms",
    )


refs_type = "array<struct<logical_doc_id:string,provision_id:string,provision_path:string>>"

_TOK = f"list_distinct(list_filter(regexp_extract_all(lower(nfc_normalize(%s)), {W}), lambda x: len(x) > 1 OR regexp_matches(x, '^[\\p{{L}}\\p{{Nd}}²³¹⁰-⁹₀-₉]$')))"
_SCORED = f"""{_LABELLED},
  keys AS (SELECT sample_id, list_distinct(list_concat(list('id' || chr(10) || logical_doc_id || chr(10) || provision_id) FILTER (provision_id IS NOT NULL), list('path' || chr(10) || logical_doc_id || chr(10) || provision_path) FILTER (provision_path IS NOT NULL))) AS hit, list(DISTINCT chunk_id) AS ids,
      count(*) AS n, count(effective_from) AS known, string_agg(coalesce(text, ''), ' ' ORDER BY rank_no) AS ev FROM k5 GROUP BY 1),
  val AS (SELECT sample_id, count(*) FILTER (effective_from <= t AND (effective_to IS NULL OR t < effective_to)) AS good FROM k5 JOIN lab USING (sample_id) WHERE effective_from IS NOT NULL GROUP BY 1),
  gold AS (SELECT *, CASE WHEN way < 2 THEN list_distinct(list_filter(['id' || chr(10) || a_doc || chr(10) || a_prov, 'path' || chr(10) || b_doc || chr(10) || b_path, 'id' || chr(10) || a_doc || chr(10) || least], lambda x: x IS NOT NULL)) ELSE [] END AS g,
      CASE WHEN way = 2 AND len(question) % 5 <> 0 THEN list_distinct([a_chunk, 'no such chunk']) ELSE [] END AS gc, CASE WHEN way = 0 THEN list_distinct(list_filter([a_doc, b_doc], lambda x: x IS NOT NULL)) ELSE [a_doc] END AS gd,
      list_distinct(regexp_extract_all(upper(regexp_extract(answer, '(?i)(?:nguồn|nguon|sources?|citation)\\s*:\\s*([^\\r\\n]+)', 1)), '[0-9]+/[0-9]{{4}}/[A-ZĐ0-9]+(?:-[A-ZĐ0-9]+)*')) AS cited, {_TOK % "regexp_replace(answer, '(?im)^\\s*(?:nguồn|nguon|sources?|citation)\\s*:\\s*.*$', '', 'g')"} AS own FROM ans),
  scored AS (SELECT sample_id, 'naive' AS model, round(CASE WHEN len(g) > 0 THEN len(list_intersect(g, hit))::DOUBLE / len(g) WHEN len(gc) > 0 THEN len(list_intersect(gc, ids))::DOUBLE / len(gc) END, 6) AS recall,
      round(CASE WHEN len(question) % 7 <> 0 AND t IS NOT NULL AND known > 0 THEN coalesce(good, 0)::DOUBLE / known END, 6) AS validity, round(known::DOUBLE / n, 6) AS coverage,
      round(CASE WHEN trim(answer) <> '' AND len(cited) > 0 THEN len(list_filter(cited, lambda x: NOT list_contains(list_transform(gd, lambda y: upper(y)), x)))::DOUBLE / len(cited) END, 6) AS invalid_citations,
      CASE WHEN trim(answer) <> '' THEN (len(cited) > 0)::INTEGER::DOUBLE END AS citation_coverage, round(CASE WHEN trim(answer) <> '' THEN CASE WHEN len(own) = 0 THEN 0.0 ELSE len(list_intersect(own, {_TOK % 'ev'}))::DOUBLE / len(own) END END, 6) AS faithfulness, latency_ms
    FROM gold JOIN keys USING (sample_id) LEFT JOIN val USING (sample_id))"""


@query(f"WITH {_SCORED} SELECT * FROM scored")
def retrieval_scores(spark, folder):
    scored = evaluation.evaluate(_labelled(spark, folder))
    return scored.select("sample_id", "model", *(F.round(m, 6).alias(m) for m in evaluation.METRICS), "latency_ms")


@query(f"WITH {_SCORED} SELECT model, count(*) AS samples, " + ", ".join(f"round(avg({m}), 3) AS {m}, count({m}) AS {m}_judged" for m in evaluation.METRICS) + ", round(avg(latency_ms), 1) AS latency_ms FROM scored GROUP BY model")
def score_summary(spark, folder):
    return evaluation.summary(retrieval_scores(spark, folder))


@query(f"""WITH {_LABELLED}, u AS (SELECT sample_id, a_doc AS d, CASE WHEN len(question) % 4 = 0 THEN a_prov || '?' ELSE a_prov END AS i, CASE WHEN len(question) % 5 = 0 THEN 'x' END AS p FROM lab UNION ALL SELECT sample_id, b_doc, NULL, CASE WHEN len(question) % 3 = 0 THEN b_path || '.z' ELSE b_path END FROM lab)
  SELECT DISTINCT sample_id, i AS label, 'PROVISION_UNKNOWN' AS why FROM u WHERE i IS NOT NULL AND NOT EXISTS (SELECT 1 FROM provisions v WHERE v.logical_doc_id = d AND v.provision_id = i AND (p IS NULL OR p = v.provision_path))
  UNION ALL SELECT DISTINCT sample_id, p, 'PATH_UNKNOWN' FROM u WHERE i IS NULL AND NOT EXISTS (SELECT 1 FROM provisions v WHERE v.logical_doc_id = d AND v.provision_path = p)
  UNION ALL SELECT DISTINCT sample_id, 'no such chunk', 'CHUNK_UNKNOWN' FROM lab WHERE way = 2 AND len(question) % 5 <> 0""")
def labels_unknown(spark, folder):
    """Labels, some of them spoilt, that the tables don't bear out."""
    n = table(spark, folder, "naive_q100")
    whole = n.select("sample_id", "question", "rank_no", "logical_doc_id", "provision_id", "provision_path").distinct().groupBy("sample_id").agg(
        F.max("question").alias("q"), F.array_sort(F.collect_list(F.struct("rank_no", "logical_doc_id", "provision_id", "provision_path"))).alias("c")
    )
    a, b, size = F.get("c", F.lit(0)), F.get("c", F.lit(1)), F.length("q")
    first = F.struct(a["logical_doc_id"].alias("logical_doc_id"), F.when(size % 4 == 0, F.concat(a["provision_id"], F.lit("?"))).otherwise(a["provision_id"]).alias("provision_id"), F.when(size % 5 == 0, "x").alias("provision_path"))
    second = F.struct(b["logical_doc_id"].alias("logical_doc_id"), F.lit(None).cast("string").alias("provision_id"), F.when(size % 3 == 0, F.concat(b["provision_path"], F.lit(".z"))).otherwise(b["provision_path"]).alias("provision_path"))
    labels = whole.select("sample_id", F.array(first, second).alias("gold_provisions")).join(_labelled(spark, folder).select("sample_id", "gold_chunks"), "sample_id")
    return evaluation.missing_labels(labels, _provisions(spark, folder, "logical_doc_id", "provision_id", "provision_path"), n)


@query(f"""WITH n AS (SELECT DISTINCT sample_id, question, rank_no, chunk_id, logical_doc_id, article_id, provision_path, global_page, text, effective_from, effective_to FROM naive_q100 WHERE rank_no <= 5),
  b AS (SELECT *, row_number() OVER (PARTITION BY sample_id, question ORDER BY rank_no, chunk_id) AS i, {_event('question')} AS t FROM n),
  c AS (SELECT sample_id, question, i, '[Context ' || i || ']' || chr(10) || 'Document: ' || coalesce(logical_doc_id, 'unknown') || chr(10) || 'Article: ' || coalesce(article_id, 'unknown') || chr(10) || 'Provision: ' || coalesce(provision_path, 'unknown') || chr(10) || 'Page: ' || coalesce(global_page::VARCHAR, 'unknown') || chr(10)
    || 'Issued: unknown; effective: ' || coalesce(effective_from::VARCHAR, 'unknown') || ' to ' || coalesce(effective_to::VARCHAR, 'open-ended') || '; status: ' || CASE WHEN effective_from <= t AND (effective_to IS NULL OR t < effective_to) THEN 'in force at t_event' WHEN effective_from > t OR effective_to <= t THEN 'not in force at t_event' ELSE 'effectivity at t_event unknown' END
    || '; retrieval basis: effective.' || chr(10) || chr(10) || coalesce(text, '') AS block FROM b)
  SELECT sample_id, $rules || chr(10) || chr(10) || 'CONTEXT' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY i) || chr(10) || chr(10) || 'QUESTION' || chr(10) || question || chr(10) || chr(10) || 'ANSWER' || chr(10) AS prompt FROM c GROUP BY sample_id, question""".replace("$rules", "'" + hooks.RULES.replace("'", "''") + "'"))
def answer_prompts(spark, folder):
    rows = table(spark, folder, "naive_q100").select("sample_id", "question", "rank_no", "chunk_id", "logical_doc_id", "article_id", "provision_path", "global_page", "text", "effective_from", "effective_to").distinct()
    at = dates.event_date(F.col("question"))
    rows = rows.withColumn("issued_date", F.lit(None).cast("date")).withColumn("in_force", F.when(at.isNotNull(), dates.in_force(F.col("effective_from"), F.col("effective_to"), at)))
    return hooks.prompts(rows.withColumn("date_basis", F.lit("effective")))


# --- lake -----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {P}, a AS (SELECT article_id, min(title) AS article_title FROM provisions WHERE level = 'article' GROUP BY article_id), b AS (SELECT * FROM bronze_pdf_parts QUALIFY row_number() OVER (PARTITION BY logical_doc_id, part_no ORDER BY ingested_at DESC) = 1),
  c AS (SELECT DISTINCT chunk_id, article_id, provision_id, logical_doc_id, 1 AS part_no FROM naive_q100)
  SELECT c.chunk_id, a.article_title, p.title AS provision_title, p.start_global_page, b.physical_file_id AS part_file, b.file_path FROM c LEFT JOIN a USING (article_id) LEFT JOIN provisions p ON p.provision_id = c.provision_id LEFT JOIN b ON b.logical_doc_id = c.logical_doc_id AND b.part_no = c.part_no""")
def chunk_lineage(spark, folder):
    chunks = table(spark, folder, "naive_q100").select("chunk_id", "article_id", "provision_id", "logical_doc_id", F.lit(1).alias("part_no")).distinct()
    joined = lake.lineage(chunks, table(spark, folder, "silver_provisions"), table(spark, folder, "bronze_pdf_parts"))
    return joined.select("chunk_id", "article_title", "provision_title", "start_global_page", "part_file", "file_path")


_HALVES = "SELECT * FROM bronze_pdf_parts"


@query("""SELECT logical_doc_id, part_no, physical_file_id, ingested_at, 'lake/' || regexp_replace(logical_doc_id, '[^\\p{L}\\p{N}_.-]+', '_', 'g') || '/part_' || lpad(part_no::VARCHAR, 3, '0') || '_' || left(physical_file_id, 12) || '_' || regexp_extract(file_path, '([^/]*)$', 1) AS copied_to
  FROM bronze_pdf_parts QUALIFY row_number() OVER (PARTITION BY logical_doc_id, part_no ORDER BY ingested_at DESC, physical_file_id) = 1""")
def bronze_upserted(spark, folder):
    """Loads of before and after a moment, one upserted into the other."""
    parts = table(spark, folder, "bronze_pdf_parts")
    none = parts.limit(0)
    first = lake.upsert_parts(none, parts.filter("ingested_at < timestamp_ntz '2024-01-15'"))
    both = lake.upsert_parts(first, parts.filter("ingested_at >= timestamp_ntz '2024-01-15'"))
    return both.withColumn("copied_to", lake.bronze_path("lake")).select("logical_doc_id", "part_no", "physical_file_id", "ingested_at", "copied_to")


@query("""WITH b AS (SELECT logical_doc_id, part_no, arg_max(file_path, ingested_at) AS bronze FROM bronze_pdf_parts GROUP BY ALL)
  SELECT p.logical_doc_id, p.part_no, p.physical_page, p.created_at, b.bronze AS file_path FROM silver_pages p JOIN b USING (logical_doc_id, part_no) QUALIFY row_number() OVER (PARTITION BY p.logical_doc_id, p.part_no, p.physical_page ORDER BY p.created_at DESC) = 1""")
def pages_upserted(spark, folder):
    parts = lake.latest(table(spark, folder, "bronze_pdf_parts"), ["logical_doc_id", "part_no"], F.desc("ingested_at"))
    pages = table(spark, folder, "silver_pages")
    return lake.upsert_pages(pages.limit(0), pages, parts).select("logical_doc_id", "part_no", "physical_page", "created_at", "file_path")


@query(f"WITH {_CHUNKS} SELECT c.chunk_id, p.effectivity_mode FROM chunks c JOIN provisions p USING (provision_id) WHERE c.global_page IS NOT NULL AND c.version <> ''")
def gold_upserted(spark, folder):
    """Chunks with all that Gold needs, checked against Silver and upserted."""
    made = chunking.chunks(table(spark, folder, "silver_provisions"), inherit=("effectivity_mode",)).filter("global_page is not null and physical_file_id is not null")
    gold = made.withColumn("doc_version_hash", F.col("physical_file_id")).drop("page_order", "metadata_json")
    half = F.pmod(F.xxhash64("chunk_id"), F.lit(2))
    silver = table(spark, folder, "silver_provisions")
    first = lake.upsert_gold(gold.limit(0), gold.filter(half == 0), silver)
    return lake.upsert_gold(first, gold, silver).select("chunk_id", "effectivity_mode")


@query("""WITH a AS (SELECT logical_doc_id AS id, count(*) AS n, max(effective_from) AS last_date FROM silver_effectivity_rules GROUP BY 1), b AS (SELECT logical_doc_id AS id, count(*) AS n, max(ingested_at)::DATE AS last_date FROM bronze_pdf_parts GROUP BY 1)
  SELECT coalesce(a.id, b.id) AS id, coalesce(b.n, a.n) AS n, coalesce(a.last_date, b.last_date) AS last_date FROM a FULL JOIN b USING (id)""")
def split_merged(spark, folder):
    """Two annotated sets merged: the old one's counts win, the new one's dates do, and what only the old one has stays."""
    a = table(spark, folder, "silver_effectivity_rules").groupBy(F.col("logical_doc_id").alias("id")).agg(F.count("*").alias("n"), F.max("effective_from").alias("last_date"))
    b = table(spark, folder, "bronze_pdf_parts").groupBy(F.col("logical_doc_id").alias("id")).agg(F.count("*").alias("n"), F.to_date(F.max("ingested_at")).alias("last_date"))
    return lake.merge_sets(a, b, "id", ["n"], ["last_date"])


@query("SELECT DISTINCT sample_id FROM naive_q100 WHERE sample_id NOT IN (SELECT sample_id FROM naive_q100 WHERE latency_ms IS NOT NULL AND len(question) % 4 <> 0)")
def answers_to_write(spark, folder):
    """Samples without an answer in the cache's present version; a fourth of the cache is of an older one."""
    rows = table(spark, folder, "naive_q100")
    version = F.when(F.length("question") % 4 == 0, lake.CACHE_VERSION - 1).otherwise(lake.CACHE_VERSION)
    cache = rows.filter("latency_ms is not null").select("sample_id", F.lit("naive").alias("model"), version.alias("version"))
    return lake.not_cached(rows.select("sample_id").distinct(), cache, "naive")


@query("SELECT logical_doc_id, list_sort(list(DISTINCT start_global_page)) AS pages FROM silver_provisions WHERE start_global_page IS NOT NULL GROUP BY 1")
def source_pages(spark, folder):
    return lake.sorted_values(table(spark, folder, "silver_provisions"), ["logical_doc_id"], "start_global_page", "pages")


@query(f"WITH {P} SELECT logical_doc_id, start_global_page, provision_path, provision_id, row_number() OVER (ORDER BY logical_doc_id NULLS LAST, start_global_page NULLS LAST, provision_path NULLS LAST, provision_id) - 1 AS place FROM provisions")
def provisions_listed(spark, folder):
    """In the order of document, page and path; each row's place comes from the sorted rows, which no single task holds."""
    columns = ["logical_doc_id", "start_global_page", "provision_path", "provision_id"]
    listed = lake.listing(_provisions(spark, folder, *columns), *columns)
    return lake.numbered(listed)


@query(f"""WITH {_PAGES}, l AS (SELECT logical_doc_id, part_no, physical_page, list_filter(string_split(coalesce(markdown_content, ''), chr(10)), lambda x: contains(x, '|') AND NOT regexp_matches(x, '^[\\s|:-]*$')) AS a FROM pages),
  r AS (SELECT *, list_transform(a, lambda x: list_transform(string_split(regexp_replace(regexp_replace(x, '^\\s*\\|', ''), '\\|\\s*$', ''), '|'), lambda y: trim(y))) AS m FROM l),
  u AS (SELECT logical_doc_id, part_no, physical_page, list_max(list_transform(m, lambda x: len(x))) AS w, unnest(m) AS v, generate_subscripts(m, 1) - 1 AS "row" FROM r)
  SELECT logical_doc_id, part_no, physical_page, "row"::INTEGER AS "row", i::INTEGER AS "column", v[i + 1] AS value FROM (SELECT *, unnest(range(w)) AS i FROM u)""")
def tables_normalised(spark, folder):
    """The tables in the pages' markdown as cells, short rows padded."""
    rows = _latest_pages(spark, folder).select("logical_doc_id", "part_no", "physical_page", tables.normalised(tables.markdown_rows(F.col("markdown_content"))).alias("t"))
    each = rows.select("logical_doc_id", "part_no", "physical_page", F.explode("t.cells").alias("c"))
    return each.select("logical_doc_id", "part_no", "physical_page", "c.row", "c.column", "c.value")


@query("""SELECT DISTINCT chunk_id, article_id, logical_doc_id AS doc_id, text, global_page AS page_number, provision_id, 'active' AS status, 1 AS part_no FROM naive_q100 WHERE global_page IS NOT NULL""")
def contract_chunks(spark, folder):
    """Chunks in the contracts' form, from a table that has other names for some columns and none for others."""
    rows = table(spark, folder, "naive_q100").filter("global_page is not null")
    gold = lake.aliased(
        rows, {"chunk_id": [], "article_id": [], "logical_doc_id": ["doc_id"], "text_content": ["text"], "global_page": ["page_number"], "provision_id": [], "chunk_hash": [], "status": [], "part_no": []} , {"status": "active", "part_no": 1}
    )
    shaped = lake.contract_chunks(gold).drop("chunk_hash")
    return shaped.withColumn("status", F.lit("active")).withColumn("part_no", F.lit(1)).distinct()


@query("SELECT column_index AS position, column_name AS name FROM duckdb_columns() WHERE table_name = 'silver_provisions'")
def provision_columns(spark, folder):
    return lake.columns_of(table(spark, folder, "silver_provisions")).select((F.col("position") + 1).alias("position"), "name")
