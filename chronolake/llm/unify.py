"""Problem 5: one form for texts that look alike.

Wide forms become ASCII, odd spaces the plain blank, zero-width characters go, accents that are characters of their own are put
into their letters (in the usual order, shape before tone). Look-alike letters are repaired by script: a token that mixes scripts
(or holds a rare letter for a usual one) is rewritten in its dominant script, or failing that in another, but only where the
result is a word of the corpus; symbols, units, fractions and words wholly in one foreign script stay as they are.

One Arrow pass over the texts gives, far smaller than they, the kinds seen, the mixed tokens and each task's distinct words; the
words are checked by a join, so no vocabulary is held in one place.

Cases: NULL and empty texts have no kinds and stay as they are; NULL parts of a page's key count as empty; rows with the same key
and the same text count once; any length of text; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.session import cut, spread

WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
SPACES = "               　"
INVISIBLE = "᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
# Letters of other alphabets, and rare Latin letters, by the usual Latin letter they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһѵԁԛԝ", "ABESIJKMHOPCTYXaesijopcyxhvdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιυρχηκ", "ABEZHIKMNOPTYXoaviupxnk"))
RARE = dict(zip("ÐðƉɖɑɡıȷąęįųĄĘĮŲǫ", "ĐđĐđagijạẹịụẠẸỊỤọ"))
LATIN = CYRILLIC | GREEK | RARE
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items()}
TO_GREEK = {v: k for k, v in GREEK.items()}

# Letters that stay are in the table too: a character that a table lacks costs several times as much.
_PLAIN = {c: c for c in (*range(0x250), *range(0x1E00, 0x1F00))} | WIDE | dict.fromkeys(map(ord, SPACES), " ") | dict.fromkeys(map(ord, INVISIBLE))
_FLAGS = {
    "fullwidth": re.compile("[！-～]"),
    "decomposed": re.compile("[̀-ͯ᷀-᷿⃐-⃿]"),
    "invisible": re.compile(f"[{INVISIBLE}]"),
    "space": re.compile(f"[{SPACES}]"),
}
_ASCII_OR_USUAL = re.compile(r"[̀-ͯ]")
_CLUSTER = re.compile(r"([^\W\d_])([̀-ͯ]+)")
_SHAPE = {"̂": 0, "̆": 0, "̛": 0, "̨": 1}
_TOKEN = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")
# Letters with accents of the other alphabets count too: the letter under the accent may be a look-alike.
_SUSPECT = re.compile("[" + "".join(RARE) + "̨Ͱ-ԯἀ-῿]")
_TO_LATIN = str.maketrans(LATIN | {"̨": "̣"})
_INTO = {"latin": _TO_LATIN, "cyrillic": str.maketrans(TO_CYRILLIC), "greek": str.maketrans(TO_GREEK)}
KEPT_WORDS = 200_000


def compose(text: str) -> str:
    """Accents into their letters, whatever the order in which they came."""
    if not _ASCII_OR_USUAL.search(text):
        return unicodedata.normalize("NFC", text)

    def cluster(m: re.Match) -> str:
        base, *marks = unicodedata.normalize("NFD", m[0])
        return unicodedata.normalize("NFC", base + "".join(sorted(marks, key=lambda c: _SHAPE.get(c, 2))))

    return unicodedata.normalize("NFC", _CLUSTER.sub(cluster, text))


def plain(text: str) -> str:
    """Everything but the look-alike letters."""
    return compose(text.translate(_PLAIN))


def script(letter: str) -> str:
    if letter in RARE:
        return "rare"
    at = ord(letter)
    if 0x370 <= at < 0x400 or 0x1F00 <= at < 0x2000:
        return "greek"
    if 0x400 <= at < 0x530:
        return "cyrillic"
    return "latin" if at < 0x250 or 0x1E00 <= at < 0x1F00 else "other"


def proposals(token: str) -> list[str]:
    """The forms of a mixed token to look up, its dominant script's first; none for a token of one script."""
    counts: dict[str, int] = {}
    for letter in token:
        if not unicodedata.combining(letter):
            counts[script(letter)] = counts.get(script(letter), 0) + 1
    if "̨" in token:
        counts["rare"] = counts.get("rare", 0) + 1
    if len(counts) < 2 and "rare" not in counts:
        return []
    order = sorted((s for s in counts if s in _INTO), key=lambda s: (-counts[s], s != "latin"))
    if "latin" not in order:
        order.append("latin")
    parts = unicodedata.normalize("NFD", token)
    forms = [compose(parts.translate(_INTO[s])) for s in order]
    return [f for f in dict.fromkeys(forms) if f != token]


def kinds(text: str) -> list[str]:
    return [kind for kind, pattern in _FLAGS.items() if pattern.search(text)]


def mixed(text: str) -> set[str]:
    """Tokens of a text in plain form that may hold look-alikes."""
    if not _SUSPECT.search(text):
        return set()
    chunks = {chunk for chunk in text.split() if _SUSPECT.search(chunk)}
    return {m[0] for chunk in chunks for m in _TOKEN.finditer(chunk) if _SUSPECT.search(m[0])}


def exchanged(text: str, usual: dict[str, str]) -> str:
    """The text with these whole tokens exchanged; only lines that may hold one are gone through."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if _SUSPECT.search(line):
            lines[i] = _TOKEN.sub(lambda m: usual.get(m[0], m[0]), line)
    return "\n".join(lines)


_SURVEY = "tag string, source_table string, row_key string, a string, b string, rank int"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    words: set[str] = set()
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = [*rows, *(("word", None, None, w, None, None) for w in words)]
        rows.clear()
        words.clear()
        fields = list(zip(*out)) if out else [[]] * 6
        names = ["tag", "source_table", "row_key", "a", "b", "rank"]
        types = [pa.string()] * 5 + [pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(list(f), t) for f, t in zip(fields, types)], names=names)

    for batch in batches:
        for source, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not text:
                continue
            if text.isascii():
                clean = text
            else:
                rows += (("kind", source, key, kind, None, None) for kind in kinds(text))
                clean = plain(text)
                for token in mixed(clean):
                    rows += (("mixed", source, key, token, form, k) for k, form in enumerate(proposals(token)))
            new = set(clean.split()) - seen
            if new:
                if len(seen) > KEPT_WORDS:
                    seen.clear()
                seen |= new
                for chunk in new:
                    if not _SUSPECT.search(chunk):
                        words.update(m[0].lower() for m in _TOKEN.finditer(chunk))
            if len(rows) + len(words) > KEPT_WORDS:
                yield flush()
        yield flush()


def page_and_provision_texts(pages: DataFrame, provisions: DataFrame) -> DataFrame:
    part = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("logical_doc_id", "part_no", "physical_page")]
    return pages.select(
        F.lit("silver_pages").alias("source_table"), F.concat_ws("|", *part).alias("row_key"), F.col("raw_text").alias("text")
    ).unionByName(
        provisions.select(
            F.lit("silver_provisions").alias("source_table"),
            F.coalesce(F.col("provision_id"), F.lit("")).alias("row_key"),
            F.col("content").alias("text"),
        )
    )


def survey(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kinds but for look-alikes: source_table, row_key, kind), (repairs: source_table, row_key, token, repaired)."""
    seen = cut(spread(texts.select("source_table", "row_key", "text").filter("text is not null")).mapInArrow(_survey, _SURVEY))
    found = seen.filter("tag = 'kind'").select("source_table", "row_key", F.col("a").alias("kind"))
    tokens = seen.filter("tag = 'mixed'").select(
        "source_table", "row_key", F.col("a").alias("token"), F.col("b").alias("repaired"), "rank", F.lower("b").alias("word")
    )
    forms = tokens.select("word").distinct()
    words = seen.filter("tag = 'word'").select(F.col("a").alias("word")).join(forms, "word", "left_semi").distinct()
    known = tokens.join(words, "word")
    best = known.groupBy("source_table", "row_key", "token").agg(F.min_by("repaired", "rank").alias("repaired"))
    return found, best


def found_kinds(texts: DataFrame) -> DataFrame:
    found, repairs = survey(texts)
    lookalike = repairs.select("source_table", "row_key", F.lit("lookalike").alias("kind"))
    return found.unionByName(lookalike).distinct()


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for i, repairs in enumerate(batch.column(3).to_pylist()):
            if texts[i] and not texts[i].isascii():
                own = {r["token"]: r["repaired"] for r in repairs or ()}
                texts[i] = plain(texts[i])
                if own:
                    texts[i] = exchanged(texts[i], own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["source_table", "row_key", "text"]
        )


def unified(texts: DataFrame) -> DataFrame:
    """source_table, row_key and the text in its one form; exact duplicates once."""
    _, repairs = survey(texts)
    own = repairs.groupBy("source_table", "row_key").agg(F.collect_list(F.struct("token", "repaired")).alias("repairs"))
    rows = texts.select("source_table", "row_key", "text").distinct().join(own, ["source_table", "row_key"], "left")
    return rows.mapInArrow(_apply, "source_table string, row_key string, text string").distinct()
