"""From pages to articles, from articles to provisions, and from their wording to the rules of when they take effect.

A document may hold a tenth of all pages, so nothing gathers one in a task: windows run within a document's part, and what they
need of the parts before or behind comes from one row a part. An article's text is bounded by what laws write into one article.

Headings are found where a marker put before each of them splits the text, which keeps every character's place.

Cases: pages without raw text fall back to their markdown without comments; text before a document's first heading belongs to no
article; of headings with one number the first counts and the others stay in the text around them; NULL and empty contents give
the article's own row alone; an invalid date is no date.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.dates import made
from chronolake.functions.text import fold, strip_space
from chronolake.session import cut

MARK = "\x00"
# How articles, clauses and points are headed, misread "Điều" among them.
ARTICLE = r"[ \t]*(?:#{1,6}[ \t]*)?(?:\*\*[ \t]*)?(?:Điều|Điu|Diu|Dieu)[ \t\r\n]+([0-9]+[A-Za-z]?)[ \t]*\.?(?:\*\*)?"
CLAUSE = r"[ \t]*(?:(?:Khoản|Khoan)\s+)?([0-9]+)[.)][ \t]+"
POINT = r"[ \t]*([a-zđ])[.)][ \t]+"
IN_FORCE = r"co\s+hieu\s+luc(?:\s+thi\s+hanh)?(?=\s+(?:ke\s+tu|tu|vao)\s+ngay)"
POINT_REF = r"diem\s+([a-z])\s+khoan\s+([0-9]+)\s+dieu\s+([0-9]+[a-z]?)"
CLAUSE_REF = r"khoan\s+([0-9]+)\s+dieu\s+([0-9]+[a-z]?)"
ARTICLE_REF = r"(?<!khoan\s)(?<!diem\s)dieu\s+([0-9]+[a-z]?)"
WHOLE = r"(?:nghi\s+dinh|thong\s+tu|luat|quyet\s+dinh|nghi\s+quyet|van\s+ban)\s+nay"
DATES = (
    (r"ngay\s+([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", (1, 2, 3)),
    (r"ngay\s+([0-9]{1,2})\s+thang\s+([0-9]{1,2})\s+nam\s+([0-9]{4})", (3, 2, 1)),
    (r"ngay\s+([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})", (3, 2, 1)),
)

_SEGMENT = ["physical_file_id", "file_path", "part_no", "physical_page", "global_page"]


def split_at(text: Column, heading: str) -> Column:
    """The text cut before each heading at a line's start; the first piece is what stands before them."""
    return F.split(F.regexp_replace(F.regexp_replace(text, MARK, ""), f"(?imud)^(?={heading})", MARK), MARK)


def number_at(piece: Column, heading: str) -> Column:
    return F.lower(F.regexp_extract(piece, f"(?iu)^{heading}", 1))


def page_text(pages: DataFrame) -> Column:
    raw = strip_space(F.coalesce("raw_text", F.lit("")))
    return F.when(raw != "", raw).otherwise(strip_space(F.regexp_replace(F.coalesce("markdown_content", F.lit("")), r"(?s)<!--.*?-->", "")))


def part_offsets(rows: DataFrame, length: Column) -> DataFrame:
    """logical_doc_id, part_no, part_start: where each part's text starts in its document. One row a part takes part."""
    sums = rows.groupBy("logical_doc_id", "part_no").agg(F.sum(length).alias("_n"))
    before = Window.partitionBy("logical_doc_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("logical_doc_id", "part_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("part_start"))


def _placed(pages: DataFrame) -> DataFrame:
    """Pages with their text and where it starts in the document, pages two characters apart."""
    rows = pages.withColumn("text", page_text(pages))
    within = Window.partitionBy("logical_doc_id", "part_no").orderBy("physical_page").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("text") + 2
    rows = rows.withColumn("in_part", F.coalesce(F.sum(length).over(within), F.lit(0)))
    joined = rows.join(part_offsets(rows, length), ["logical_doc_id", "part_no"])
    return joined.withColumn("page_start", F.col("part_start") + F.col("in_part")).drop("part_start", "in_part")


def article_pieces(pages: DataFrame) -> DataFrame:
    """One row per page and stretch of it between headings: whose article it belongs to, and where it stands in the document."""
    each = _placed(pages).withColumn("pieces", split_at(F.col("text"), ARTICLE))
    # Where each piece starts: the lengths before it, kept as the last entry of what the fold has so far.
    zero = F.array(F.lit(0))
    starts = F.aggregate(F.transform("pieces", lambda p: F.length(p)), zero, lambda got, n: F.concat(got, F.array(F.element_at(got, -1) + n)))
    rows = each.withColumn("starts", starts).select("logical_doc_id", *_SEGMENT, "page_start", "starts", F.posexplode("pieces").alias("piece_no", "piece"))
    rows = rows.select("logical_doc_id", *_SEGMENT, "piece_no", "piece", (F.col("page_start") + F.get("starts", F.col("piece_no"))).alias("start"))
    # The first piece of a page is a heading's too where the page begins with one; blank first pieces are none at all.
    number = number_at(F.col("piece"), ARTICLE)
    # The pieces are read four times from here on, so they are made once.
    rows = cut(rows.withColumn("number", F.when(number != "", number)).filter("piece <> ''"))
    first = rows.filter("number is not null").groupBy("logical_doc_id", "number").agg(F.min("start").alias("start"))
    heads = first.select("logical_doc_id", "start", F.struct("start", "number").alias("head"))
    marked = rows.join(heads, ["logical_doc_id", "start"], "left")
    # The article of a piece is that of the last heading up to it, in its part or in one before.
    up_to = Window.partitionBy("logical_doc_id", "part_no").orderBy("start")
    own = marked.withColumn("own", F.last("head", ignorenulls=True).over(up_to))
    last = own.groupBy("logical_doc_id", "part_no").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("start"))).alias("last"))
    earlier = Window.partitionBy("logical_doc_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("logical_doc_id", "part_no", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    joined = own.join(last, ["logical_doc_id", "part_no"]).withColumn("article", F.coalesce("own", "before")).filter("article is not null")
    heading = f"(?iu)^{ARTICLE}"
    body = F.when(F.col("head").isNotNull(), F.regexp_replace("piece", heading, "")).otherwise(F.col("piece"))
    return joined.select(
        "logical_doc_id", F.col("article.number").alias("article_number"), *_SEGMENT, "start", F.col("head").isNotNull().alias("headed"), body.alias("body")
    )


def articles(pages: DataFrame) -> DataFrame:
    """One row per article: its title (the rest of the heading's line), content, span of pages and page segments, whose places
    (text_start, text_end) are those in content."""
    rows = article_pieces(pages)
    title = F.when(F.col("headed"), strip_space(F.regexp_extract("body", r"^([^\n]*)", 1)))
    text = F.when(F.col("headed"), F.regexp_replace("body", r"^[^\n]*\n?", "")).otherwise(F.col("body"))
    rows = rows.withColumn("title", title).withColumn("body", strip_space(text))
    part = F.struct("start", *_SEGMENT, F.col("body").alias("text"))
    one = rows.groupBy("logical_doc_id", "article_number").agg(
        F.max("title").alias("title"), F.array_sort(F.collect_list(part)).alias("parts"),
    )
    page = lambda which: F.struct(*(F.col(f"parts")[which][c].alias(c) for c in _SEGMENT))  # noqa: E731,F541
    filled = one.select("*", page(F.lit(0)).alias("first"), page(F.size("parts") - 1).alias("last")).withColumn("parts", F.filter("parts", lambda p: p["text"] != ""))
    begins = F.aggregate(F.transform("parts", lambda p: F.length(p["text"]) + 2), F.array(F.lit(0)), lambda got, n: F.concat(got, F.array(F.element_at(got, -1) + n)))
    filled = filled.withColumn("begins", begins)
    start = lambda i: F.get("begins", i)
    segments = F.transform(
        "parts",
        lambda p, i: F.struct(*(p[c].alias(c) for c in _SEGMENT), p["text"].alias("text"), start(i).alias("text_start"), (start(i) + F.length(p["text"])).alias("text_end")),
    )
    return filled.select(
        "logical_doc_id", "article_number", F.concat_ws(":", "logical_doc_id", F.lit("article"), "article_number").alias("article_id"),
        "title", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("content"), "first", "last", segments.alias("segments"),
    )


_CLAUSE, _POINT = (re.compile(f"^{p}", re.I | re.M) for p in (CLAUSE, POINT))
_PROVISION = (
    "provision_id string, logical_doc_id string, article_id string, parent_provision_id string, level string, provision_number string, provision_path string, title string, "
    "content string, text_start int, text_end int, page_segments array<struct<physical_file_id:string,file_path:string,part_no:int,physical_page:int,global_page:int,text:string>>"
)


def _stretches(text: str, heading: re.Pattern, start: int, end: int) -> list[tuple[str, int, int]]:
    """number, start and end of the headed stretches of text[start:end]; the first of each number cuts, others don't."""
    first: dict[str, int] = {}
    for m in heading.finditer(text, start, end):
        first.setdefault(m[1].lower(), m.start())
    places = [*first.values(), end]
    return [(number, a, b) for number, a, b in zip(first, places, places[1:])]


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            text, title, doc, path = r["content"] or "", r["title"] or "", r["logical_doc_id"], (r["article_number"] or "").lower()

            def add(level, number, own, provision_id, parent, said, start, end):
                segments = []
                for g in r["segments"] or ():
                    piece = text[max(start, g["text_start"]) : max(0, min(end, g["text_end"]))].strip()
                    if piece:
                        segments.append({c: g[c] for c in _SEGMENT} | {"text": piece})
                rows.append(
                    {
                        "provision_id": provision_id, "logical_doc_id": doc, "article_id": r["article_id"], "parent_provision_id": parent, "level": level, "provision_number": number,
                        "provision_path": own, "title": said, "content": text[start:end].strip(), "text_start": start, "text_end": end, "page_segments": segments,
                    }
                )

            clauses = _stretches(text, _CLAUSE, 0, len(text))
            add("article", r["article_number"], path, r["article_id"], None, title, 0, clauses[0][1] if clauses else len(text))
            for number, start, end in clauses:
                points = _stretches(text, _POINT, start, end)
                own = f"{path}.{number}"
                clause = f"{doc}:provision:{own}"
                add("clause", number, own, clause, r["article_id"], f"{title}, khoản {number}", start, points[0][1] if points else end)
                for letter, a, b in points:
                    add("point", letter, f"{own}.{letter}", f"{clause}.{letter}", clause, f"{title}, khoản {number}, điểm {letter}", a, b)
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_ARROW = pa.schema(
    [
        *((c, pa.string()) for c in ("provision_id", "logical_doc_id", "article_id", "parent_provision_id", "level", "provision_number", "provision_path", "title", "content")),
        ("text_start", pa.int32()), ("text_end", pa.int32()),
        ("page_segments", pa.list_(pa.struct([("physical_file_id", pa.string()), ("file_path", pa.string()), ("part_no", pa.int32()), ("physical_page", pa.int32()), ("global_page", pa.int32()), ("text", pa.string())]))),
    ]
)


def provisions(found: DataFrame) -> DataFrame:
    """article, clause and point rows of parsed articles: ids, paths, titles, contents, places and page segments.

    One pass over each article's text in Arrow batches, without an exchange: Spark has no function that gives the places of
    matches. A clause ends where the next begins, its own text where its first point does."""
    return found.select("logical_doc_id", "article_number", "article_id", "title", "content", "segments").mapInArrow(_tree, _PROVISION)


# --- rules of effect ------------------------------------------------------------------------------------------------------


def effect_rules(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, place, target_path, mode, effective_from, effective_to, trigger_reference, source_text: what each sentence says of
    when something takes effect. Points, clauses and articles it names are the targets; a sentence on the document itself targets
    "*"; without a date behind the phrase the sentence is an external trigger."""
    sentences = F.split(F.regexp_replace(text, r"(?U)\s+", " "), r";|(?<=\.)\s+")
    rows = texts.select(*keys, F.posexplode(sentences).alias("sentence_no", "source_text")).withColumn("said", fold(F.col("source_text")))
    rows = rows.filter(F.col("said").rlike(IN_FORCE))
    behind = F.regexp_extract("said", rf"(?s)^.*?{IN_FORCE}(.*)$", 1)
    date = F.lit(None).cast("date")
    for pattern, order in reversed(DATES):
        date = F.when(behind.rlike(pattern), made(*(F.regexp_extract(behind, pattern, g) for g in order))).otherwise(date)
    without_points = F.regexp_replace("said", POINT_REF, "#")
    without_clauses = F.regexp_replace(without_points, CLAUSE_REF, "#")
    every = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    path = lambda pattern, *groups: lambda x: F.concat_ws(".", *(F.regexp_extract(x, pattern, g) for g in groups))
    refs = F.concat(
        F.transform(every(F.col("said"), POINT_REF), path(POINT_REF, 3, 2, 1)),
        F.transform(every(without_points, CLAUSE_REF), path(CLAUSE_REF, 2, 1)),
        F.transform(every(without_clauses, ARTICLE_REF), path(ARTICLE_REF, 1)),
    )
    targets = F.when(F.size(refs) > 0, refs).when(F.col("said").rlike(WHOLE), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))
    each = rows.select(*keys, "sentence_no", "source_text", date.alias("effective_from"), F.posexplode(targets).alias("target_no", "target_path"))
    dated = F.col("effective_from").isNotNull()
    return each.select(
        *keys, F.struct("sentence_no", "target_no").alias("place"), "target_path", F.when(dated, "explicit_date").otherwise("external_trigger").alias("mode"),
        "effective_from", F.lit(None).cast("date").alias("effective_to"), F.when(~dated, F.col("source_text")).alias("trigger_reference"), "source_text",
    )


def document_rules(rules: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rules of a document with one "*" at most: the first with a date, else the first of all."""
    scoped = rules.filter("target_path <> '*'")
    rest = [c for c in rules.columns if c != key]
    best = rules.filter("target_path = '*'").groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(F.col("mode") != "explicit_date", *order)).alias("one"))
    return scoped.unionByName(best.select(key, "one.*"))


def article_dates(rules: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, article_number (NULL: the document's default), effective_from: dates of whole articles, the last said of each."""
    whole = rules.filter("mode = 'explicit_date' and not contains(target_path, '.')")
    dated = whole.filter("target_path <> '*'").groupBy(key, F.col("target_path").alias("article_number")).agg(F.max_by("effective_from", F.struct(*order)).alias("effective_from"))
    default = document_rules(rules, key, order).filter("target_path = '*' and mode = 'explicit_date'").select(key, F.lit(None).cast("string").alias("article_number"), "effective_from")
    return dated.unionByName(default)
