"""Quality rules, line first: drop bad lines, then reject documents that lose too much text.

Native: DataFrame functions only. Each line that holds a word is judged on its own:

* punctuation: it must end in terminal punctuation (closing quotes and brackets may follow),
  and marks such as ``#*$%&|<>`` or runs of ``!`` and ``?`` may not pepper its words;
* navigation: a row of short entries parted by ``|``, ``»`` and the like is dropped;
* boilerplate: a line of at most ``PHRASE_WORDS`` words with a phrase about cookies, logins, rights
  or licences in one of four languages (``PHRASES``; a parameter) is dropped.

A document is rejected if the lines that pass hold less than ``min_left`` of its word
characters, or if a base count fails (fewer than ``min_words`` words, or too many words
in repeated 3-word windows). All work is row by row: no shuffle, no group to be skewed.

Defined results: a null or empty text has no words and is rejected. An input column with
the name of an output column is replaced. Rows repeat as they come, also with equal ids; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import SPACE_CLASS

MIN_WORDS, MAX_REPEAT, MIN_LEFT, MAX_MARKS = 50, 50, 0.5, 0.3
# The marks that count as symbols, line ends, closers, entry separators, phrases.
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[#*$%&|<>]+|[!?]{2,}"
LINE_ENDS = [".", "!", "?", "…", "。", "！", "？", "؟", ":", ";"]
CLOSERS = "\"')]}»”’"
SPACES = " \t\n\x0b\x0c\r"
ENTRIES = r" [|»›>•·/] "
PHRASES = {
    "en": ["all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies", "uses cookies", "accept cookies", "enable javascript", "click here", "sign up now", "sign up for", "please log in", "log in to continue", "subscribe to our", "subscribe now", "lorem ipsum", "licensed under", "copyright [0-9]{4}", "powered by", "skip to content"],
    "de": ["alle rechte vorbehalten", "datenschutzerkl[äÄ]rung", "nutzungsbedingungen", "verwendet cookies", "cookies akzeptieren", "hier klicken", "jetzt anmelden", "jetzt registrieren", "newsletter abonnieren", "lizenziert unter", "zum inhalt springen"],
    "es": ["todos los derechos reservados", "pol[íÍ]tica de privacidad", "condiciones de uso", "utiliza cookies", "aceptar cookies", "haga clic aqu[íÍ]", "iniciar sesi[óÓ]n", "reg[íÍ]strate ahora", "suscr[íÍ]bete", "bajo licencia", "ir al contenido"],
    "fr": ["tous droits r[éÉ]serv[éÉ]s", "politique de confidentialit[éÉ]", "conditions d['’]utilisation", "utilise des cookies", "accepter les cookies", "cliquez ici", "se connecter", "abonnez-vous", "sous licence", "aller au contenu"],
}


def phrase_pattern(phrases: dict[str, list[str]]) -> str:
    """Any phrase of any language, between what isn't a letter; the same for Java and RE2."""
    return r"(?i)(?:^|[^\p{L}])(?:" + "|".join(p for own in phrases.values() for p in own) + r")(?:$|[^\p{L}])"


BOILERPLATE = phrase_pattern(PHRASES)
#: Words of a line that a phrase can make boilerplate at most; longer ones are prose that names it.
PHRASE_WORDS = 40


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words that lie in a window found twice or more: windows sorted with their places, so
    that equal ones are neighbours; n log n, however repetitive the text."""
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(s: Column) -> Column:
        hit = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.get(F.transform(F.array(ranked), count), 0)


def clean_lines(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, min_left: float = MIN_LEFT, max_marks: float = MAX_MARKS, phrases: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    cleaned_text (the lines that pass; lines without a word stay where they were)."""
    t = F.coalesce(F.col(text), F.lit(""))
    boilerplate = phrase_pattern(PHRASES if phrases is None else phrases)
    own = [f"__gm_{x}" for x in ("words", "all", "windows", "verdicts", "lines")]
    words, every, windows, verdicts, lines = map(F.col, own)
    out = docs.withColumns({own[0]: F.array_remove(F.split(t, SPACE_CLASS), ""), own[1]: F.split(t, "\n", -1)})

    def verdict(line: Column) -> Column:
        """0: fails, 1: passes, 2: has no word."""
        trimmed = F.trim(line, F.lit(SPACES))
        n = F.size(F.split(trimmed, SPACE_CLASS))
        entries = F.size(F.split(trimmed, ENTRIES))
        good = (
            F.right(F.rtrim(trimmed, F.lit(CLOSERS)), F.lit(1)).isin(LINE_ENDS)
            & ~((entries >= 3) & (n <= 5 * entries))
            & ((F.size(F.split(trimmed, MARKS, -1)) - 1) <= max_marks * n)
            & ~((n <= PHRASE_WORDS) & trimmed.rlike(boilerplate))
        )
        return F.when(trimmed == "", 2).when(good, 1).otherwise(0)

    n = F.size(words)
    out = out.withColumns({
        own[2]: F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>")),
        # a line goes with its verdict: a lambda over lines that looked it up in an array would have
        # the array made again for each line where the optimizer merges the two projections
        own[3]: F.transform(every, lambda x: F.struct(x.alias("line"), verdict(x).alias("v"))),
    })
    solid = lambda x: F.char_length(F.regexp_replace(x, SPACE_CLASS, ""))
    out = out.withColumns({
        own[4]: F.transform(F.filter(verdicts, lambda x: x["v"] < 2), lambda x: x["line"]),
        "cleaned_text": F.array_join(F.transform(F.filter(verdicts, lambda x: x["v"] > 0), lambda x: x["line"]), "\n"),
    })
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": solid(t).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_repeat_words(words, windows)).cast("long"),
        "__gm_left": solid(F.col("cleaned_text")),
    })
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & (F.col("__gm_left") >= min_left * F.col("word_chars"))}).drop(*own, "__gm_left")


def kept_documents(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of clean_lines that are kept. The row number in the predicate holds it where it is:
    pushed below the projections that make ``kept`` it would have to repeat them over and over."""
    rows = clean_lines(docs, text, **limits).withColumn("__gm_row", F.monotonically_increasing_id())
    return rows.where("kept AND __gm_row >= 0").drop("__gm_row")
