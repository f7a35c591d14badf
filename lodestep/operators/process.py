"""Raw candidates to processed ones: every block of the schema as columns, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.operators.corpus import candidate_type


def thinking_source(given: Column, thinking: Column, tagged: Column, extended: Column) -> Column:
    inferred = F.when(T.text_or_empty(thinking) == "", "none").when(tagged, "inline_think_tags").when(extended, "claude_api_block").otherwise("parsed_reasoning")
    return F.coalesce(F.nullif(given, F.lit("")), inferred)


def quality_flags(response: Column, thinking: Column, num_steps: Column, answer: Column, approach: Column, blackhole: Column | None = None) -> Column:
    """The names of a candidate's quality problems, in a fixed order."""
    return F.array_compact(F.array(
        F.when(T.fewer_words(response, 80), "very_short"), F.when(num_steps == 0, "no_steps_found"), F.when(answer.isNull(), "answer_not_extracted"),
        F.when(approach == "unknown", "approach_unknown"), F.when(T.has_repeated_ngram(response), "repeated_content"),
        F.when(T.is_incomplete(response), "incomplete_response"), F.when(T.has_han(thinking), "language_mixing"),
        F.when(F.lit(False) if blackhole is None else blackhole, "reasoning_blackhole"),
    ))


def needs_review(df: DataFrame, response: str, gold: str) -> DataFrame:
    """``df`` with correct (the response reaches the gold answer) and needs_review: it does by an approach that no keyword tells. Without an answer both are false."""
    answered = df.withColumn("_answer", T.extract_answer(F.col(response))["answer"]).withColumn("_match", T.answers_match(F.col("_answer"), F.col(gold)))
    right = F.coalesce(F.col("_match")["matches"], F.lit(False))
    return answered.withColumn("correct", right).withColumn("needs_review", F.col("correct") & (T.classify_approach(F.col(response))["label"] == "unknown")).drop("_answer", "_match")


def process_candidates(df: DataFrame) -> DataFrame:
    """Flat candidates with answers, steps, approaches, type, readiness, quality flags and inclusion added.

    Upstream verdicts (answer_correct, answer_match_method, approaches, mechanism) win over computed ones where given.
    """
    c = F.col
    out = df.withColumn("_split", T.split_think(c("full_text")))
    use_full = (T.text_or_empty(c("response_text")) == "") & (T.text_or_empty(c("full_text")) != "")
    out = out.withColumns({"thinking_text": F.when(use_full, c("_split.think")).otherwise(T.text_or_empty(c("thinking_text"))), "response_text": F.when(use_full, c("_split.response")).otherwise(T.text_or_empty(c("response_text")))}).drop("_split")
    out = out.withColumns({"has_think_tags": c("full_text").contains("<think>"), "full_text": F.coalesce(F.nullif(c("full_text"), F.lit("")), T.assemble(c("thinking_text"), c("response_text")))})
    out = out.withColumns({
        "thinking_source": thinking_source(c("thinking_source"), c("thinking_text"), c("has_think_tags"), c("has_extended_thinking")),
        "_answer": T.extract_answer(c("response_text")), "reasoning_steps": T.segment_steps(c("response_text")),
        "_approach": T.classify_approach(c("response_text")), "_gold": T.classify_approach(c("gold_solution"))["label"],
        "_settled": F.when(c("thinking_text") != "", T.classify_approach(T.settled_region(c("thinking_text")))["label"]),
    })
    out = out.withColumns({"_match": T.answers_match(c("_answer.answer"), c("gold_answer")), "answer_extracted": c("_answer.answer")})
    out = out.withColumns({
        "answer_correct": F.coalesce("answer_correct", c("_match.matches")), "answer_match_method": F.coalesce("answer_match_method", c("_match.method")),
        "normalised_extracted": T.normalise_answer(c("answer_extracted")), "normalised_gold": T.normalise_answer(c("gold_answer")),
        "answer_in_thinking": F.when(c("thinking_text") != "", T.extract_answer(c("thinking_text"))["answer"]), "num_steps": F.size("reasoning_steps"),
        "step_types": F.transform("reasoning_steps", lambda s, i: T.step_type(s, i, F.size("reasoning_steps"))),
        "think_step_count": F.when(c("thinking_text") != "", F.size(T.segment_steps(c("thinking_text")))).when(c("thinking_source") == "none", 0),
        "approach_in_response": F.coalesce(F.nullif("approach_in_response", F.lit("")), c("_approach.label")), "approach_keywords": c("_approach.keywords"),
        "stated_approach_sentence": T.stated_approach(c("reasoning_steps")), "approach_in_thinking": F.when(c("thinking_text") != "", F.coalesce(F.nullif("approach_in_thinking", F.lit("")), c("_settled"))),
    })
    out = out.withColumns({
        "approach_matches_gold": F.coalesce("approach_matches_gold", T.approaches_match(c("approach_in_response"), c("_gold"))),
        "thinking_response_gap": F.when(c("thinking_text") != "", T.approaches_match(c("approach_in_thinking"), c("approach_in_response")).eqNullSafe(False)),
    })
    kind = candidate_type(c("answer_correct"), c("approach_matches_gold"), c("type_b_mechanism"), c("thinking_response_gap"), c("thinking_source"))
    out = out.withColumn("_type", kind).withColumns({"candidate_type": c("_type.type"), "type_confidence": c("_type.confidence"), "type_source": c("_type.decided_by")})
    flawed = c("type_b_mechanism").isin("flawed_lucky", "unfaithful", "spurious")
    is_b = c("candidate_type") == "B"
    flags = quality_flags(c("response_text"), c("thinking_text"), c("num_steps"), c("answer_extracted"), c("approach_in_response"), c("blackhole_detected"))
    out = out.withColumns({
        "error_type": F.when(is_b & flawed, c("type_b_mechanism")).when(is_b & c("thinking_response_gap"), "wrong_framing").when(is_b, "wrong_concept"),
        "error_location": F.when(is_b & flawed, "reasoning_validity").when(is_b, "step_2_approach"),
        "can_approach_corrupt": (c("approach_in_response") != "unknown") & (c("stated_approach_sentence") != "") & (c("num_steps") >= 2), "can_step_corrupt": c("num_steps") >= 3,
        "can_conclusion_corrupt": c("answer_extracted").isNotNull() & T.is_numeric_answer(c("answer_extracted")),
        "corruption_priority": F.when(is_b, "high").when((c("candidate_type") == "A") & (c("approach_in_response") != "unknown"), "medium").otherwise("low"),
        "training_label": F.when(c("candidate_type") == "A", 0).when(is_b, 1).otherwise(2), "contrastive_group": c("record_id"), "quality_flags": flags,
        "extraction_warning": F.when((c("_answer.method") != "boxed") & c("answer_extracted").isNotNull(), F.concat(F.lit("answer extracted via fallback method: "), c("_answer.method"))),
    })
    bad = F.arrays_overlap("quality_flags", F.array(*map(F.lit, ("incomplete_response", "repeated_content", "reasoning_blackhole"))))
    included = c("answer_extracted").isNotNull() & (c("num_steps") > 0) & (T.text_or_empty(c("full_text")) != "") & c("generation_error").isNull() & ~bad
    return out.withColumn("include_in_training", included).drop("_answer", "_approach", "_gold", "_settled", "_match", "_type")
