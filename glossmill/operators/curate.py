"""Curation of corrections: preparation, scores, the decision tree, and simpler rule sets."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.scores import final_score, improvement, l2_normalize, length_ratio, text_scores
from glossmill.functions.text import normalize_arabic, sentences, strip
from glossmill.operators.dedup import greedy_items
from glossmill.sources.sinks import Staging


# Reasons, notes, formats and sample outputs that users of the rules rely on.
SAME, MEANING = "human edit too similar to model output (similarity=%.3f)", "translation may not preserve source meaning"
CLOSE, NO_BETTER = "high similarity (%.3f) with insufficient improvement", "not better than model outputs"
LOW, COPY = "confidence score below threshold (%.3f < {})", "duplicate human correction"
EMPTY, SHORT, STUB_YES, STUB_NO = "empty human_edit", "too short", "stub_accept_nonempty", "stub_reject_empty"
DATASET, NONE_ACCEPTED = "finetune_dataset.jsonl", "no correction was accepted"
MISSING = "Missing %s in item %d"
BAD_REQUEST, BAD_PAIR, NO_ITEMS = "bad_request", "language_pair must be a list of two names", "frontend_payload must hold an item"
NOTHING_LEFT = "nothing left after normalisation"
SOURCE_LINE, MODEL_LINE, HUMAN_LINE = "Source: ", "LLM Translation: ", "Corrected:"
SAMPLE_OUTPUTS = {"model1": "صباح الخير جميعا.", "model2": "أهلا صباح الخير للجميع.", "model3": "صباح الخير يا الجميع."}
SAMPLE_DEFAULT = "نص تجريبي ثابت."


@dataclass(frozen=True)
class Thresholds:
    accept: float = 0.70
    exact: float = 0.995
    near: float = 0.92
    strict: float = 0.85
    weights: tuple[float, float, float] = (0.4, 0.1, 0.5)


def preprocess(items: DataFrame) -> DataFrame:
    """human_edit and all outputs normalised; status says whether anything is left of the edit."""
    out = items.withColumns({"human_edit": normalize_arabic(F.col("human_edit")), "llm_outputs": F.transform_values("llm_outputs", lambda _, v: normalize_arabic(v))})
    return out.withColumn("status", F.when(F.coalesce(F.col("human_edit"), F.lit("")) == "", "preprocess_failed").otherwise("ok"))


def validate_payload(items: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """A message for each item that lacks a field, the first one missing; null where it is sound."""
    said = F.coalesce(*[F.when(F.col(c).isNull(), F.format_string(MISSING, F.lit(c), F.col(ordinal))) for c in ("source", "llm_outputs", "human_edit")])
    return items.withColumn("error", said)


def validate_requests(requests: DataFrame, items: DataFrame) -> DataFrame:
    """(request_id, code, message) of requests(request_id, language_pair array, frontend_payload) with
    items(request_id, ordinal, source, llm_outputs, human_edit): the pair must hold two names, the
    payload an item at least, and each item all fields. The first fault stands; sound: nulls."""
    pair, n = F.col("language_pair"), F.coalesce("n", F.lit(0))
    two = F.coalesce((F.size(pair) == 2) & F.forall(pair, lambda x: x.isNotNull() & (F.trim(x) != "")), F.lit(False))
    faults = validate_payload(items).groupBy("request_id").agg(F.count("*").alias("n"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ordinal"))).alias("error"))
    rows = requests.select("request_id", "language_pair").join(faults, "request_id", "left")
    message = F.when(~two, BAD_PAIR).when(n == 0, NO_ITEMS).otherwise(F.col("error"))
    return rows.select("request_id", F.when(message.isNotNull(), BAD_REQUEST).alias("code"), message.alias("message"))


def with_judges(items: DataFrame, meaning: Column | None = None, quality: Column | None = None) -> DataFrame:
    """Items with the columns ``meaning`` and ``quality`` from the judges given: any Column, such as
    a pandas UDF over source and human_edit around a model. Without one an item passes."""
    one = F.lit(1.0)
    return items.withColumns({"meaning": F.coalesce(meaning if meaning is not None else one, one), "quality": F.coalesce(quality if quality is not None else one, one)})


def judge_prompts(items: DataFrame, key: str = "item_id", t: Thresholds = Thresholds()) -> DataFrame:
    """items with what a judge is asked, for judges that are models: ``meaning_prompt`` about source
    and edit, and ``quality_prompt`` about the outputs and the edit, which asks for more where the
    edit is closer to an output than ``strict``. ``judge_reply`` reads the answers."""
    near = F.coalesce("max_similarity", F.lit(0.0)) > t.strict
    outputs = F.array_join(F.transform(F.array_sort(F.map_entries("llm_outputs")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    ask = F.concat(F.lit("Source: "), said("source"), F.lit("\nTranslation: "), said("human_edit"))
    better = F.concat(F.lit("Source: "), said("source"), F.lit("\n"), outputs, F.lit("\nHuman: "), said("human_edit"))
    strict = F.when(near, F.lit("\nThe human text is close to an output: it has to mend a plain fault or read far better.")).otherwise("")
    scored = items if "max_similarity" in items.columns else items.join(model_scores(items, key).select(key, "max_similarity"), key, "left")
    return scored.withColumns({"meaning_prompt": F.concat(ask, F.lit("\nIs the whole meaning kept? 1 or 0.")), "quality_prompt": F.concat(better, strict, F.lit("\nIs the human text better than each output? 1 or 0."))})


def warm_memory(existing: DataFrame, accepted: DataFrame, embed: Column | None = None) -> DataFrame:
    """The memory of vectors (id, item_id, text, v) with the sentences of accepted rows (item_id,
    human_translation) that it doesn't hold yet; blank translations have none."""
    spoken = accepted.where(strip(F.col("human_translation")) != "").select("item_id", F.posexplode(sentences(F.col("human_translation"))).alias("pos", "text"))
    new = spoken.select(F.xxhash64("item_id", "pos").alias("id"), "item_id", "text").join(existing.select("id"), "id", "left_anti")
    return existing.select("id", "item_id", "text", "v").union(embedded(new, "text", embed).select("id", "item_id", "text", "v"))


def embedded(rows: DataFrame, text: str, embed: Column | None = None, out: str = "v", dims: int = 64) -> DataFrame:
    """rows with unit vectors of a text in ``out``: from ``embed``, any Column of arrays, such as a
    pandas UDF around a model; by default hashed character trigrams, which need none."""
    made = rows.withColumn(out, embed if embed is not None else hashed_trigrams(F.col(text), dims))
    return made.withColumn(out, l2_normalize(F.col(out)))


def hashed_trigrams(text: Column, dims: int) -> Column:
    """Counts of a text's character trigrams by hash, in batches."""

    @F.pandas_udf("array<double>")
    def count(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            grams = [t[i : i + 3].encode() for i in range(max(len(t) - 2, 1))] if t else []
            out.append(np.bincount([zlib.crc32(g) % dims for g in grams], minlength=dims).astype(float))
        return pd.Series(out)

    return count(text)


@dataclass(frozen=True)
class Batch:
    """What a batch gives: an outcome for each item, the rows to store, and the memory's new vectors."""

    outcomes: DataFrame
    accepted: DataFrame
    vectors: DataFrame


def process_batch(items: DataFrame, memory: DataFrame, staging: Staging, language_pair: str = "en-ar", now: Column | None = None, t: Thresholds = Thresholds(), similar: float = 0.85, embed: Column | None = None) -> Batch:
    """A batch through all steps: items(item_id, source, llm_outputs, human_edit, meaning, quality)
    are checked, normalised, decided, freed of copies of the ``memory`` (id, v) and of earlier
    accepted items, and given their outcome (item_id, decision, score, reason, message).

    A faulty item is an outcome of its own, ``error`` with a message, and stops no other: fields
    that are missing, nothing left after normalisation, or no model output to compare with. Rows
    repeat by item_id as the caller has them unique."""
    sound = staging.save(validate_payload(items, "item_id"))
    ready = preprocess(sound.where("error IS NULL")).drop("error")
    empty = ready.where("status <> 'ok'")
    decided = staging.save(validate(ready.where("status = 'ok'"), "item_id", t))
    new = decided.where("decision = 'accept'")
    spoken = new.select("item_id", F.posexplode(sentences(F.col("human_edit"))).alias("pos", "text")).withColumn("id", F.xxhash64("item_id", "pos"))
    vectors = staging.save(embedded(spoken, "text", embed))
    kept = staging.save(greedy_items(vectors, memory, similar, staging))
    out = decided.join(kept, "item_id", "left")
    copy = F.coalesce(~F.col("kept"), F.lit(False))
    message = F.when(F.col("decision") == "error", F.col("reason"))
    outcomes = out.select("item_id", F.when(copy, "reject").otherwise(F.col("decision")).alias("decision"), F.when(~copy, F.col("score")).alias("score"), F.when(copy, COPY).when(message.isNull(), F.col("reason")).alias("reason"), message.alias("message"))
    nothing = [F.lit("error").alias("decision"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("reason")]
    outcomes = outcomes.union(sound.where("error IS NOT NULL").select("item_id", *nothing, F.col("error").alias("message"))).union(empty.select("item_id", *nothing, F.lit(NOTHING_LEFT).alias("message")))
    outcomes = staging.save(outcomes)
    stamp = F.current_timestamp().cast("string") if now is None else now
    rows = decided.drop("decision", "score", "reason").join(outcomes, "item_id").select("item_id", F.col("source").alias("source_text"), F.lit(language_pair).alias("language_pair"), "llm_outputs", F.col("human_edit").alias("human_translation"), "score", stamp.alias("timestamp"), "decision", "reason")
    stored = accepted_rows(rows)
    return Batch(outcomes, stored, vectors.join(stored.select("item_id"), "item_id", "left_semi").select("id", "item_id", "text", "v"))


def model_pairs(items: DataFrame, key: str) -> DataFrame:
    """(key, model, hyp, ref): each human text beside each model output."""
    return items.select(key, F.col("human_edit").alias("hyp"), F.explode("llm_outputs").alias("model", "ref"))


def model_scores(items: DataFrame, key: str) -> DataFrame:
    """(key, max_similarity, max_chrf, mean_chrf, max_ratio, longest, n_models) over the outputs."""
    pairs = model_pairs(items, key).select(key, "model", text_scores("hyp", "ref").alias("s"), length_ratio(F.col("ref"), F.col("hyp")).alias("ratio"), F.length("ref").alias("n"))
    both = pairs.select(key, "model", "s.*", "ratio", "n")
    held = F.array_sort(F.collect_list(F.struct("model", "chrf")))
    mean = F.aggregate(held, F.lit(0.0), lambda s, x: s + x["chrf"]) / F.size(held)
    return both.groupBy(key).agg(F.max("similarity").alias("max_similarity"), F.max("chrf").alias("max_chrf"), mean.alias("mean_chrf"), F.max("ratio").alias("max_ratio"), F.max("n").alias("longest"), F.count("*").alias("n_models"))


def decide(scored: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """decision, score and reason from max_similarity, max_chrf, mean_chrf, max_ratio, longest,
    meaning and quality: the first rule that holds. Items without outputs are errors, unless
    their meaning is rejected before."""
    ms, meaning, quality = F.col("max_similarity"), F.col("meaning"), F.col("quality")
    imp = improvement(F.length("human_edit"), F.col("longest"), F.col("mean_chrf"))
    judge = F.when(quality >= 0.5, quality).otherwise(F.lit(1.0))
    judge = F.when((ms > t.strict) & (judge > 0.5), imp).otherwise(judge)
    fin = final_score(F.col("max_chrf"), F.col("max_ratio"), judge, t.weights)
    three = lambda s, x: F.format_string(s, x)
    weak = quality < 0.5
    rules: list[tuple[Column, str, Column, Column]] = [
        (ms >= t.exact, "reject", F.lit(0.0), three(SAME, ms)),
        (meaning < 0.5, "reject", F.lit(0.0), F.lit(MEANING)),
        (F.col("longest").isNull(), "error", F.lit(None).cast("double"), F.lit("no model outputs")),
        ((ms >= t.near) & weak & (imp < 0.6), "reject", imp, three(CLOSE, ms)),
        ((ms < t.near) & weak & (imp < 0.5), "reject", imp, F.lit(NO_BETTER)),
        (((ms > 0.9) & (fin > 0.8)) | (fin >= t.accept), "accept", fin, F.lit(None).cast("string")),
    ]
    last = (F.lit("reject"), fin, three(LOW.format(t.accept), fin))

    def first(i: int) -> Column:
        out = last[i]
        for rule in rules[::-1]:
            value = F.lit(rule[1]) if i == 0 else rule[i + 1]
            out = F.when(rule[0], value).otherwise(out)
        return out

    return scored.withColumns({"decision": first(0), "score": first(1), "reason": first(2)})


def validate(items: DataFrame, key: str, t: Thresholds = Thresholds()) -> DataFrame:
    """items(key, human_edit, llm_outputs, meaning, quality) with decision, score and reason."""
    scored = items.join(model_scores(items, key), key, "left")
    return decide(scored.withColumn("max_similarity", F.coalesce("max_similarity", F.lit(0.0))), t)


def fallback_rules(items: DataFrame) -> DataFrame:
    edit = F.coalesce(strip(F.col("human_edit")), F.lit(""))
    reason = F.when(edit == "", EMPTY).when(F.length(edit) < 8, SHORT).otherwise("")
    return items.withColumns({"decision": F.when(reason == "", "accept").otherwise("reject"), "reason": reason})


def stub_rules(items: DataFrame) -> DataFrame:
    some = F.coalesce(strip(F.col("human_edit")), F.lit("")) != ""
    return items.withColumns({"decision": F.when(some, "accept").otherwise("reject"), "reason": F.when(some, STUB_YES).otherwise(STUB_NO)})


def fallback_summary(decided: DataFrame, by: list[str], check_monitor: bool = True) -> DataFrame:
    """(by, n_accepted, dataset_path): a path from four accepts on, a note for none, else null."""
    path = F.when(F.col("n_accepted") >= 4, DATASET).when(F.col("n_accepted") == 0, NONE_ACCEPTED)
    return decided.groupBy(*by).agg(F.count_if(F.col("decision") == "accept").alias("n_accepted")).withColumn("dataset_path", path if check_monitor else F.lit(None).cast("string"))


#: Rule sets by name; ``full`` needs judge columns.
STRATEGIES = {"fallback": fallback_rules, "stub": stub_rules, "full": lambda items, key="item_id": validate(items, key)}


def strategy(name: str):
    """A rule set by name, or the fallback if there is none of that name."""
    return STRATEGIES.get(name, fallback_rules)


#: What an accepted row holds, as it is kept in JSON lines.
ACCEPTED = "source_text string, language_pair string, llm_outputs map<string,string>, human_translation string, score double, timestamp string"


def typed_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """Accepted rows of JSON lines: those that parse, have all required fields, and have them of
    their types; others are left out. A number where a text belongs isn't one."""
    kinds = {"source_text": '"', "language_pair": '["\\[]', "llm_outputs": "[{]", "human_translation": '"', "score": "[-0-9]", "timestamp": '"'}
    parsed = lines.select(F.col(value), F.from_json(value, ACCEPTED, {"mode": "PERMISSIVE"}).alias("r"))
    sound = F.lit(True)
    for name, begin in kinds.items():
        sound = sound & F.col(value).rlike(f'"{name}"\\s*:\\s*{begin}')
    return schema_valid(parsed.where("r IS NOT NULL").where(sound).select("r.*"))


def error(code: str, message: Column | str) -> Column:
    """The uniform error of a request: {code, message}."""
    return F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def by_mode(mode: str | None, real=None):
    """The rule set that a mode names: ``real`` takes the one given, or the full rules; any other mode,
    or none, the fallback, which needs no models."""
    if (mode or "").strip().lower() == "real":
        return real if real is not None else STRATEGIES["full"]
    return fallback_rules


def schema_valid(rows: DataFrame) -> DataFrame:
    """Rows with all required fields of the accepted table."""
    need = ["source_text", "language_pair", "llm_outputs", "human_translation", "score", "timestamp"]
    ok = F.lit(True)
    for c in need:
        ok = ok & F.col(c).isNotNull()
    return rows.where(ok)


def accepted_rows(corrections: DataFrame) -> DataFrame:
    return schema_valid(corrections).where("decision = 'accept'").drop("decision", "reason")


def status_update(results: DataFrame, payload: DataFrame) -> DataFrame:
    """(segment_id, status, reason): results(ordinal, position, decision, reason, message) beside
    payload(position, segment_id); of several results for a position the last stays, and only
    decisions count. The first reason that isn't blank is taken."""
    last = results.groupBy("position").agg(F.max_by(F.struct("decision", "reason", "message"), "ordinal").alias("r"))
    got = payload.where("segment_id IS NOT NULL").join(last, "position").where(F.col("r.decision").isin("accept", "reject"))
    reason = F.coalesce(F.nullif(F.col("r.reason"), F.lit("")), F.nullif(F.col("r.message"), F.lit("")), F.lit(""))
    return got.select("segment_id", F.col("r.decision").alias("status"), reason.alias("reason"))


def first_output(outputs: Column) -> Column:
    """The output of the model whose name is smallest."""
    return F.element_at(outputs, F.array_min(F.map_keys(outputs)))


def generate_outputs(sources: DataFrame, models: list[str], answers: dict[str, str] | None = None, default: str = SAMPLE_DEFAULT) -> DataFrame:
    """Fixed answers of named models; a model without one gives the default."""
    known = SAMPLE_OUTPUTS if answers is None else answers
    names = F.array(*[F.lit(m) for m in models])
    said = F.array(*[F.lit(known.get(m, default)) for m in models])
    return sources.withColumn("llm_outputs", F.map_from_arrays(names, said))


def last_rows(log: DataFrame, n: int | None = None, position: str = "pos", default: int = 50) -> DataFrame:
    """The last n rows by position (0 or none: the default), of which blank ones then go."""
    return log.orderBy(F.col(position).desc()).limit(n or default).where(strip(F.col("source_text")) != "").orderBy(position)


def few_shot_prompt(rows: DataFrame, source: str, output: str, position: str = "pos") -> DataFrame:
    """One text: an example for each row in order, then the open item."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    example = F.concat(F.lit(SOURCE_LINE), blank(F.col("source_text")), F.lit(f"\n{MODEL_LINE}"), blank(first_output(F.col("llm_outputs"))), F.lit(f"\n{HUMAN_LINE} "), blank(F.col("human_translation")), F.lit("\n"))
    held = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), example.alias("e")))), lambda x: x["e"])
    return rows.agg(F.concat(F.array_join(held, "\n"), F.lit(f"\n{SOURCE_LINE}{source}\n{MODEL_LINE}{output}\n{HUMAN_LINE}")).alias("prompt"))


def cycle_trigger(n_rows: Column, last_reset: Column, now: Column, rows: int = 10_000, days: int = 7) -> Column:
    return (n_rows >= rows) | (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_reset.cast("timestamp")) >= days * 86_400_000_000)
