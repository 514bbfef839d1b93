"""Text normalisation, splitting and predicates, as Column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The character tables of Arabic normalisation, in the order of their steps.
ARABIC_LETTERS = ("أإآٱىئ", "اااايي")
ARABIC_PUNCTUATION = ("،؛؟«»٫．", ',;?"".' + ".")
ARABIC_DIGITS = ("٠١٢٣٤٥٦٧٨٩", "0123456789")
ARABIC_MARKS = "ًٌٍَُِّْـ"
DASHES = "–—−_‑"
LATIN_DASHES = "–—−‒_‑"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}]"
REPEATED = r"([?.!,;:])\1+"
#: Rows of an Arrow batch of texts; values of it that are Python objects at once.
BATCH_ROWS, SLICE_ROWS = 256, 64


def small_batches() -> None:
    """Arrow batches of BATCH_ROWS rows at most for texts that go through Python, so that what a
    worker holds doesn't grow with the table. Plans run later, so it holds for the session."""
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def by_slices(column: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    """f of each value, null for null. Some values at a time become Python objects, so that a batch
    costs little more than its bytes, whatever its texts hold."""
    out = []
    for x in range(0, len(column), SLICE_ROWS):
        values = column.slice(x, SLICE_ROWS).to_pylist()
        out.append(pa.array([None if v is None else f(v) for v in values], kind))
    return pa.concat_arrays(out) if out else pa.array([], kind)


def strip(c: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends; runs of one punctuation mark to one."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), REPEATED, "$1")


def normalize_arabic(c: Column) -> Column:
    """Letters, punctuation and digits unified, marks and tatweel dropped, in one translate;
    then emoji, dash runs and ``collapse``."""
    one_to_one = ARABIC_LETTERS[0] + ARABIC_PUNCTUATION[0] + ARABIC_DIGITS[0] + DASHES + "“”„"
    to = ARABIC_LETTERS[1] + ARABIC_PUNCTUATION[1] + ARABIC_DIGITS[1] + "-" * len(DASHES) + '"""'
    out = F.translate(c, one_to_one + ARABIC_MARKS, to)
    return collapse(F.regexp_replace(F.regexp_replace(out, EMOJI, ""), "-+", "-"))


@F.arrow_udf(StringType())
def _nfc(s: pa.Array) -> pa.Array:
    return by_slices(s, lambda x: unicodedata.normalize("NFC", x), pa.string())


def nfc(c: Column) -> Column:
    """Unicode composition, which has no built-in."""
    small_batches()
    return _nfc(c)


def latin_steps(c: Column) -> Column:
    """Everything of ``normalize_latin`` after composition."""
    out = F.translate(c, "`´ʼ", "'''")
    out = F.replace(F.translate(out, "«»", '""'), F.lit("'\", "), F.lit('"'))
    out = F.translate(out, "„", '"')
    out = F.regexp_replace(F.translate(out, LATIN_DASHES, "-" * len(LATIN_DASHES)), "-+", "-")
    return strip_control(strip_tags(out))


def unescape_quotes(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def normalize_latin(c: Column) -> Column:
    return collapse(latin_steps(nfc(unescape_quotes(c))))


def normalize_text(c: Column, is_arabic: bool = False) -> Column:
    return normalize_arabic(c) if is_arabic else normalize_latin(c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def strip_control(c: Column) -> Column:
    """Without characters of Unicode's category C, line ends and tabs among them."""
    return F.regexp_replace(c, r"\p{C}", "")


def segment_whitespace(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), r"[ \t]+", " "), r"(?U)\s+([,.;:!?])", "$1")


def sentences(c: Column) -> Column:
    """Parts between runs of sentence marks, trimmed, without empty ones. Decimals split too."""
    return F.filter(F.transform(F.split(c, "[.!?؟]+"), strip), lambda x: x != "")


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, r"\s+"), "")


def ends_sentence(c: Column) -> Column:
    bare = F.regexp_replace(c, "[\\s\"')\\]}»”’]+$", "")
    return F.coalesce(bare.rlike(r"(\.\.\.|…|[.!?؟])$"), F.lit(False))


def looks_like_list_item(c: Column) -> Column:
    """A bullet, or a short number or letter with its mark, before the text."""
    return F.coalesce(c.rlike(r"^\s*([-•*]|\d+[.)]|[a-zA-Z][.)])\s+\S+"), F.lit(False))


def is_heading(text: Column, size: Column, median_size: Column) -> Column:
    """A short line that is not only a section number, and stands out: by its size if sizes are
    known, else by a leading section number."""
    t = strip(text)
    number_only = t.rlike(r"^\d+(\.\d+)*$")
    by_size = (size >= median_size + 1.2) & t.rlike("[A-Za-z]")
    by_number = t.rlike(r"^\d+(\.\d+)*\s+\S+") & (F.length(t) <= 60)
    return (t != "") & (F.length(t) <= 80) & ~number_only & F.when(size.isNotNull() & median_size.isNotNull(), by_size).otherwise(by_number)


def join_lines(lines: Column) -> Column:
    """An array of lines as one text: a hyphen before a lower-case start is closed, other line
    ends become a space."""
    joined = F.array_join(lines, "\n")
    return segment_whitespace(F.replace(F.regexp_replace(joined, r"-\n(?=\p{Ll})", ""), F.lit("\n"), F.lit(" ")))


def language_by_script(c: Column) -> Column:
    """The default language detector: Arabic script, Latin script, or unknown."""
    arabic = F.length(F.regexp_replace(c, r"[^\p{IsArabic}]", ""))
    latin = F.length(F.regexp_replace(c, r"[^\p{IsLatin}]", ""))
    return F.when(F.coalesce(arabic + latin, F.lit(0)) == 0, "unknown").when(arabic >= latin, "ar").otherwise("latin")
