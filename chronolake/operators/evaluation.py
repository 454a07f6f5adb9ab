"""Scores of retrieved chunks and answers; what cannot be judged is NULL and leaves averages alone.

A row has a sample's labels, its ranked chunks as an array of structs (chunk_id, logical_doc_id, provision_id, provision_path, text,
effective_from, effective_to; best first) and its answer. All scores are one projection; texts are composed (NFC) before they are
compared, once where they come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions.dates import in_force
from chronolake.functions.text import cited_docs, evaluation_tokens, nfc, strip_space, without_citations

K = 5
METRICS = ("recall", "validity", "coverage", "invalid_citations", "citation_coverage", "faithfulness")


def _keys(refs: Column, ids_only: bool) -> Column:
    """id and path keys of provisions within their document; a label is known by its id if it has one, else by its path."""
    has_id = F.coalesce
    by_id = lambda r: F.when(has_id(r["provision_id"], F.lit("")) != "", F.concat_ws("\n", F.lit("id"), r["logical_doc_id"], r["provision_id"]))
    by_path = lambda r: F.when(has_id(r["provision_path"], F.lit("")) != "", F.concat_ws("\n", F.lit("path"), r["logical_doc_id"], r["provision_path"]))
    if ids_only:
        return F.array_distinct(F.array_compact(F.transform(refs, lambda r: F.coalesce(by_id(r), by_path(r)))))
    return F.array_distinct(F.array_compact(F.concat(F.transform(refs, by_id), F.transform(refs, by_path))))


def _share(part: Column, whole: Column) -> Column:
    return F.when(F.size(whole) > 0, F.size(part) / F.size(whole))


def recall(gold_provisions: Column, gold_chunks: Column, chunks: Column, k: int = K) -> Column:
    """Share of the labelled provisions, or without any of the labelled chunks, among the first k; NULL without labels."""
    top = F.slice(chunks, 1, k)
    gold = _keys(gold_provisions, True)
    ids = F.array_distinct(F.coalesce(gold_chunks, F.array().cast("array<string>")))
    by_provision = _share(F.array_intersect(gold, _keys(top, False)), gold)
    return F.coalesce(by_provision, _share(F.array_intersect(ids, F.transform(top, lambda c: c["chunk_id"])), ids))


def temporal_validity(chunks: Column, at: Column, basis: Column, k: int = K) -> Column:
    """Share of the first k chunks with a known start that are in force at the date; only questions of effect are judged."""
    known = F.filter(F.slice(chunks, 1, k), lambda c: c["effective_from"].isNotNull())
    good = F.filter(known, lambda c: in_force(c["effective_from"], c["effective_to"], at))
    return F.when((basis == "effective") & at.isNotNull(), _share(good, known))


def temporal_coverage(chunks: Column, k: int = K) -> Column:
    top = F.slice(chunks, 1, k)
    return F.coalesce(_share(F.filter(top, lambda c: c["effective_from"].isNotNull()), top), F.lit(0.0))


def gold_documents(citations: Column, gold_provisions: Column, gold_docs: Column) -> Column:
    """The documents an answer should cite: its labels' citations, else the documents of its provisions, else its documents."""
    some = lambda c: F.when(F.size(c) > 0, c)
    of = F.filter(F.transform(gold_provisions, lambda r: r["logical_doc_id"]), lambda d: F.coalesce(d, F.lit("")) != "")
    return F.array_distinct(F.transform(F.coalesce(some(citations), some(of), gold_docs), F.upper))


def answered(answer: Column) -> Column:
    return strip_space(F.coalesce(answer, F.lit(""))) != ""


def invalid_citations(answer: Column, gold: Column) -> Column:
    """Share of the cited documents that are no labels; NULL without labels, answer or citation."""
    cited = cited_docs(answer)
    return F.when(answered(answer) & (F.size(gold) > 0), _share(F.array_except(cited, gold), cited))


def citation_coverage(answer: Column) -> Column:
    return F.when(answered(answer), (F.size(cited_docs(answer)) > 0).cast("double"))


def faithfulness(answer: Column, evidence: Column) -> Column:
    """Share of the answer's words, without the lines that name sources, that the evidence has; 0.0 if it has no word."""
    own = evaluation_tokens(without_citations(answer))
    return F.when(answered(answer), F.coalesce(_share(F.array_intersect(own, evaluation_tokens(evidence)), own), F.lit(0.0)))


def evaluate(rows: DataFrame, k: int = K) -> DataFrame:
    """sample_id, model and all scores with the latency: one row a sample and model."""
    evidence = F.array_join(F.transform(F.slice("chunks", 1, k), lambda c: F.coalesce(c["text"], F.lit(""))), " ")
    ready = rows.withColumn("answer", nfc(F.col("answer"))).withColumn("evidence", nfc(evidence))
    gold = gold_documents(F.col("gold_citations"), F.col("gold_provisions"), F.col("gold_docs"))
    chunks, answer = F.col("chunks"), F.col("answer")
    return ready.select(
        "sample_id", "model", recall(F.col("gold_provisions"), F.col("gold_chunks"), chunks, k).alias("recall"),
        temporal_validity(chunks, F.col("t_event"), F.col("basis"), k).alias("validity"), temporal_coverage(chunks, k).alias("coverage"),
        invalid_citations(answer, gold).alias("invalid_citations"), citation_coverage(answer).alias("citation_coverage"),
        faithfulness(answer, F.col("evidence")).alias("faithfulness"), "latency_ms",
    )


def summary(scored: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Per model the mean of every metric (three places) over the rows that could be judged, how many these are, and the mean
    latency (one place); a metric that no row has is NULL."""
    parts = [x for m in metrics for x in (F.round(F.avg(m), 3).alias(m), F.count(m).alias(f"{m}_judged"))]
    return scored.groupBy("model").agg(F.count("*").alias("samples"), *parts, F.round(F.avg("latency_ms"), 1).alias("latency_ms"))


def missing_labels(samples: DataFrame, provisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """sample_id, label, why: labels that nothing in the tables bears out: a provision by id (whose path, if told, must be its own)
    or by path within its document, or a chunk by id."""
    refs = samples.select("sample_id", F.explode("gold_provisions").alias("r")).select("sample_id", "r.*").distinct()
    known = provisions.select("logical_doc_id", "provision_id", F.col("provision_path").alias("own_path")).distinct()
    by_id = refs.filter("coalesce(provision_id, '') <> ''").join(known, ["logical_doc_id", "provision_id"], "left")
    wrong = by_id.groupBy("sample_id", "logical_doc_id", "provision_id", "provision_path").agg(
        F.coalesce(F.bool_or(F.col("own_path").isNotNull() & (F.coalesce("provision_path", F.lit("")).isin("") | (F.col("provision_path") == F.col("own_path")))), F.lit(False)).alias("fits")
    )
    wrong = wrong.filter(~F.col("fits")).select("sample_id", F.col("provision_id").alias("label"), F.lit("PROVISION_UNKNOWN").alias("why"))
    paths = known.select("logical_doc_id", F.col("own_path").alias("provision_path")).distinct()
    by_path = refs.filter("coalesce(provision_id, '') = ''").join(paths, ["logical_doc_id", "provision_path"], "left_anti")
    by_path = by_path.select("sample_id", F.col("provision_path").alias("label"), F.lit("PATH_UNKNOWN").alias("why"))
    asked = samples.select("sample_id", F.explode("gold_chunks").alias("chunk_id"))
    absent = asked.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").select("sample_id", F.col("chunk_id").alias("label"), F.lit("CHUNK_UNKNOWN").alias("why"))
    return wrong.unionByName(by_path).unionByName(absent).distinct()


# --- contracts against planted faults -------------------------------------------------------------------------------------


def detection_rate(results: DataFrame) -> DataFrame:
    """The share of faulty rows (not "clean") to be quarantined that were; NULL if there are none."""
    faulty = (F.col("mutation_type") != "clean") & (F.col("expected") == "QUARANTINE")
    return results.agg(
        F.count_if(faulty).alias("expected_n"),
        F.round(F.try_divide(F.count_if(faulty & (F.col("actual") == "QUARANTINE")), F.count_if(faulty)), 6).alias("rate"),
    )


def detection(results: DataFrame) -> DataFrame:
    """Per kind of fault, the share of rows to be quarantined that were; NULL where none was to be."""
    expected = F.col("expected") == "QUARANTINE"
    return results.groupBy("mutation_type").agg(
        F.count_if(expected).alias("expected_n"),
        F.round(F.try_divide(F.count_if(expected & (F.col("actual") == "QUARANTINE")), F.count_if(expected)), 6).alias("rate"),
    )


def confusion(results: DataFrame) -> DataFrame:
    """PASSED is what the contracts give; it counts as PASS."""
    e, a = F.col("expected") == "QUARANTINE", F.col("actual") == "QUARANTINE"
    return results.agg(F.count_if(e & a).alias("tp"), F.count_if(~e & ~a).alias("tn"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"))
