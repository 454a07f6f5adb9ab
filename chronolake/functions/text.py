"""Text functions, each from Column to Column and inside code generation."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters, digits and underscore of any script; the same class in Spark and in the SQL the queries are checked with.
WORD = r"[\p{L}\p{N}_]+"
DOC_ID = r"[0-9]{1,5}/[0-9]{4}/[\p{Lu}0-9]+(?:-[\p{Lu}0-9]+)*"
#: A document number as questions and citations write it, in any case; upper-cased by what finds it.
CITED_ID = r"(?<![\p{L}\p{N}_])[0-9]+/[0-9]{4}/[A-ZĐ0-9]+(?:-[A-ZĐ0-9]+)*(?![\p{L}\p{N}_])"
_CITES = r"(?:nguồn|nguon|sources?|citation)\s*:"
# The precomposed Vietnamese letters and the letters under their accents.
ACCENTED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd"


def _letters_under_accents() -> dict[str, str]:
    """Every letter that Unicode composes of one letter and accents, of any script, and that letter."""
    found = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        parts = unicodedata.normalize("NFD", c)
        bare = [x for x in parts if unicodedata.category(x) != "Mn"]
        if len(parts) > len(bare) == 1:
            found[c] = bare[0]
    return found


_UNDER = _letters_under_accents() | {"đ": "d"}



def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def strip_space(text: Column) -> Column:
    """Trim all Unicode white space, not blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def fold(text: Column) -> Column:
    """Lower case without accents, whether composed with their letters or written after them; other characters stay."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), "".join(_UNDER), "".join(_UNDER.values()))


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams; none where there are fewer than n words."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def windows(words: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of words; the last one reaches the end."""
    step, n = size - overlap, F.size(words)
    count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step))
    made = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))
    return F.when(n > 0, made).otherwise(F.array().cast("array<string>"))


def doc_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(DOC_ID), F.lit(0)))


def named_docs(text: Column) -> Column:
    """Document numbers that a text names, in upper case, each once."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(CITED_ID), F.lit(0)))


def cited_docs(text: Column) -> Column:
    """Document numbers behind a word for source and a colon, up to the line's end."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?iu){_CITES}\s*([^\r\n]+)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(blocks, named_docs)))


def without_citations(text: Column) -> Column:
    """The text without the lines that name its sources."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(rf"(?iu)^\s*{_CITES}")), "\n")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed form; Spark has no function for it."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def evaluation_tokens(text: Column) -> Column:
    """The distinct words two texts (in composed form) are compared by: lone signs are none."""
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 1) | w.rlike(r"^[\p{L}\p{Nd}²³¹⁰-⁹₀-₉]$")))


# --- what a document's opening says of it ---------------------------------------------------------------------------------

HEAD_ID, HEAD_TYPE, HEAD_TITLE = 20_000, 20_000, 16_000
# Kinds of documents, how they are written without accents, and what their numbers hold.
KINDS = (
    ("Nghị định", "nghi dinh", "/nd-cp"),
    ("Thông tư", "thong tu", "/tt-"),
    ("Luật", "luat", None),
    ("Quyết định", "quyet dinh", "/qd-"),
    ("Nghị quyết", "nghi quyet", "/nq-"),
)


def head_id(text: Column, otherwise: Column) -> Column:
    """The first document number of the opening, its type's accents put back."""
    found = F.regexp_extract(fold(F.substring(text, 1, HEAD_ID)), r"(?<![a-z0-9])([0-9]+/[0-9]{4}/[a-z0-9]+(?:-[a-z0-9]+)*)", 1)
    number, sign = F.regexp_extract(found, "^(.*)/", 1), F.upper(F.regexp_extract(found, "([^/]*)$", 1))
    sign = F.when(sign == "ND-CP", "NĐ-CP").when(sign.startswith("QD-"), F.concat(F.lit("QĐ"), F.substring(sign, 3, 1000))).otherwise(sign)
    return F.when(found == "", otherwise).otherwise(F.concat_ws("/", number, sign))


def document_type(text: Column, doc_id: Column) -> Column:
    """The first kind, in the order above, that the opening names, else the one that the number tells."""
    head, number = fold(F.substring(text, 1, HEAD_TYPE)), fold(doc_id)
    by_name = F.coalesce(*(F.when(head.contains(alias), kind) for kind, alias, _ in KINDS))
    return F.coalesce(by_name, *(F.when(number.contains(sign), kind) for kind, _, sign in KINDS if sign))


def document_title(text: Column, doc_id: Column, doc_type: Column) -> Column:
    """The first line of the opening that holds the number and has 300 characters at most, without heading marks; else type and
    number."""
    lines = F.transform(F.split(F.substring(text, 1, HEAD_TITLE), "\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"(?U)^[#*\s]+|[#*\s]+$", ""))
    found = F.get(F.filter(lines, lambda x: x.contains(doc_id) & (F.length(x) <= 300)), F.lit(0))
    return F.coalesce(found, F.concat_ws(" ", F.when(doc_id.isNotNull(), doc_type), doc_id))


def content_id(text: Column) -> Column:
    """A document's id by its contents: comments don't count, nor does white space."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return F.concat(F.lit("DOC-"), F.substring(F.sha2(strip_space(F.regexp_replace(bare, r"(?U)\s+", " ")), 256), 1, 24))
