"""Column builders for the text of solutions: inside Catalyst but for the n-grams, which are counted in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestep.functions import patterns as P

#: Separators of the assembled text.
THINK_OPEN, THINK_CLOSE, RESPONSE = "[THINKING]", "[/THINKING]", "[RESPONSE]"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value worked out once: a lambda works an expression that it captures out again for every element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def words(x: Column) -> Column:
    """White-space separated words; null and blank give an empty array."""
    return F.filter(F.split(text_or_empty(x), r"\s+"), lambda w: w != "")


def n_words(x: Column) -> Column:
    return F.size(words(x)).cast("long")


def fewer_words(x: Column, n: int) -> Column:
    """Whether there are fewer than ``n`` words; no more are cut off than that takes."""
    return F.size(F.filter(F.split(text_or_empty(x), r"\s+", n + 2), lambda w: w != "")) < n


def count_of(x: Column, piece: str) -> Column:
    return ((F.length(x) - F.length(F.replace(x, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def latex_density(x: Column) -> Column:
    """Backslashes and dollar signs per word, words counted as one at least."""
    return (count_of(text_or_empty(x), "\\") + count_of(text_or_empty(x), "$")).cast("double") / F.greatest(n_words(x), F.lit(1))


def latex_token_share(x: Column) -> Column:
    """Share of words that hold a backslash, a dollar sign, a caret or an underscore before a brace."""
    tokens = words(x)
    return F.coalesce(F.try_divide(F.size(F.filter(tokens, lambda w: w.rlike(r"\\|\$|\^|_\{"))).cast("double"), F.size(tokens)), F.lit(0.0))


def split_think(full: Column) -> Column:
    """Struct (think, response) by the first close tag, else the bracket form, else an unclosed tag, else all response."""
    full = text_or_empty(full)
    without = lambda x: F.regexp_replace(x, r"^\[RESPONSE\]", "")
    clean = lambda x: strip(F.replace(F.replace(x, F.lit(THINK_OPEN), F.lit("")), F.lit("<think>"), F.lit("")))
    bracket = r"(?s)\[THINKING\](.*?)\[/THINKING\](.*)"
    closed, framed, opened = full.contains("</think>"), full.rlike(bracket), full.contains("<think>")
    tail = F.substring(full, F.instr(full, "</think>") + 8, F.length(full))
    think = (
        F.when(closed, clean(F.substring_index(full, "</think>", 1)))
        .when(framed, clean(F.regexp_extract(full, bracket, 1)))
        .when(opened, strip(F.substring(full, F.instr(full, "<think>") + 7, F.length(full))))
        .otherwise("")
    )
    response = (
        F.when(closed, strip(without(tail)))
        .when(framed, strip(without(F.regexp_extract(full, bracket, 2))))
        .when(opened, "")
        .otherwise(strip(without(full)))
    )
    return F.struct(think.alias("think"), response.alias("response"))


def assemble(think: Column, response: Column) -> Column:
    framed = F.concat(F.lit(THINK_OPEN), think, F.lit(THINK_CLOSE + RESPONSE), text_or_empty(response))
    return F.when(text_or_empty(think) != "", framed).otherwise(text_or_empty(response))


def last_boxed(x: Column) -> Column:
    """Content of the last boxed group, braces balanced at any depth; an unclosed last group gives the rest of the text; null without one."""
    x = text_or_empty(x)

    def step(acc: Column, piece: Column) -> Column:
        brace = F.left(piece, F.lit(1))
        depth = acc["depth"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(
            depth.alias("depth"), (acc["at"] + F.length(piece)).alias("at"),
            F.when((acc["end"] == 0) & (depth == 0), acc["at"] + 1).otherwise(acc["end"]).alias("end"),
        )

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    content = lambda rest, end: F.when(end > 0, F.left(rest, end - 1)).otherwise(rest)
    # Every piece but the first begins with a brace.
    closed = lambda rest: let(F.aggregate(F.split(rest, "(?=[{}])"), start, step)["end"], lambda end: content(rest, end))
    return F.when(x.contains("\\boxed{"), strip(let(F.substring_index(x, "\\boxed{", -1), closed)))


def extract_answer(x: Column) -> Column:
    """Struct (answer, method): boxed, else the first "answer is", else the last number of the last three lines."""
    x = text_or_empty(x)
    boxed = last_boxed(x)
    said = F.regexp_extract(x, P.ANSWER_IS, 1)
    lines = F.split(F.regexp_replace(strip(x), r"\r\n?", "\n"), "\n")
    tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), 3), "\n")
    number = F.try_element_at(F.regexp_extract_all(tail, F.lit(P.NUMBER), F.lit(0)), F.lit(-1))
    has_said = x.rlike(P.ANSWER_IS)
    answer = F.when(boxed.isNotNull(), boxed).when(has_said, strip(said)).otherwise(number)
    method = F.when(boxed.isNotNull(), "boxed").when(has_said, "answer_is").when(number.isNotNull(), "last_number").otherwise("none")
    return F.struct(answer.alias("answer"), method.alias("method"))


def as_number(x: Column) -> Column:
    """The number that a text writes out, else null; suffixes such as 1d are not numbers."""
    return F.when(x.rlike(P.FLOAT), x.try_cast("double"))


def plain_number(x: Column) -> Column:
    """A double as text: whole numbers below 2**95 in full, others with the fewest digits that tell them apart, with an exponent below 0.0001 and from 10**16 on."""
    def whole(v: Column) -> Column:
        high = F.floor(F.abs(v) / 4294967296.0).cast("long")  # exact: a power of two
        low = (F.abs(v) - high * 4294967296.0).cast("long")
        text = (high.cast("decimal(20, 0)") * F.lit(4294967296).cast("decimal(10, 0)") + low.cast("decimal(10, 0)")).cast("string")
        return F.concat(F.when(v < 0, "-").otherwise(""), text)

    def spread(s: Column) -> Column:
        e = F.substring_index(s, "E", -1).cast("int")
        digits = F.replace(F.regexp_replace(F.substring_index(F.ltrim(s, F.lit("-")), "E", 1), r"\.0$", ""), F.lit("."), F.lit(""))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        large = F.concat(F.left(digits, e + 1), F.lit("."), F.substr(digits, e + 2))
        point = F.when(F.length(digits) > 1, F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))).otherwise(digits)
        power = F.concat(point, F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
        sign = F.when(F.startswith(s, F.lit("-")), "-").otherwise("")
        return F.concat(sign, F.when((e >= -4) & (e < 0), small).when((e >= 0) & (e < 16), large).otherwise(power))

    text = x.cast("string")
    return F.when((x % 1 == 0) & (F.abs(x) < 2.0**95), whole(x)).when(F.contains(text, F.lit("E")), let(text, spread)).otherwise(text)


def normalise_answer(x: Column) -> Column:
    """Without currency, percent, thousands marks and outer dots; whole numbers as integers, others as ``plain_number``; null is empty."""
    s = strip(text_or_empty(x))
    for piece in ("$", ",", "\\%", "%", "\\!", "\\,"):
        s = F.replace(s, F.lit(piece), F.lit(""))
    s = F.btrim(s, F.lit("$ ."))
    return let(s, lambda t: let(as_number(t), lambda number: F.when(number.isNotNull(), plain_number(number)).otherwise(t)))


def right_side(x: Column) -> Column:
    """After the last equals sign, if there is one."""
    x = text_or_empty(x)
    return F.when(x.contains("="), strip(F.substring_index(x, "=", -1))).otherwise(x)


def answers_match(extracted: Column, gold: Column) -> Column:
    """Struct (matches, method): exact, normalised (also by right sides), within 0.001, else none; two empty ones do not match."""
    e, g = strip(text_or_empty(extracted)), strip(text_or_empty(gold))
    ours = F.array_distinct(F.array(normalise_answer(extracted), normalise_answer(right_side(e))))
    theirs = F.array_distinct(F.array(normalise_answer(gold), normalise_answer(right_side(g))))
    same = F.size(F.array_remove(F.array_intersect(ours, theirs), "")) > 0
    near = F.exists(ours, lambda a: F.exists(theirs, lambda b: F.coalesce(F.abs(as_number(a) - as_number(b)) < 1e-3, F.lit(False))))
    method = F.when((e == g) & (e != ""), "exact").when((e == "") & (g == ""), "none").when(same, "normalised").when(near, "float").otherwise("none")
    return F.struct((method != "none").alias("matches"), method.alias("method"))


def is_numeric_answer(x: Column) -> Column:
    return as_number(normalise_answer(x)).isNotNull()


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def segment_steps(x: Column) -> Column:
    """Numbered steps, else paragraphs, else lines, else sentences: the first cut that gives two or more."""
    mark = "\u0001"
    several = lambda cut: let(_pieces(cut), lambda parts: F.when(F.size(parts) >= 2, parts))

    def of(t: Column) -> Column:
        """Each cut is worked out where those before it give fewer than two."""
        numbered = F.when(F.regexp_count(t, F.lit(P.NUMBERED)) >= 2, several(F.split(F.regexp_replace(t, f"({P.NUMBERED})", f"{mark}$1"), mark)))
        sentences = _pieces(F.split(t, r"(?<=[.!?])\s+(?=[A-Z\\])"))
        cuts = F.coalesce(numbered, several(F.split(t, r"\n\s*\n")), several(F.split(t, r"\n")), sentences)
        return F.when(t == "", F.array().cast("array<string>")).otherwise(cuts)

    return let(strip(text_or_empty(x)), of)


def step_type(step: Column, index: Column, n: Column) -> Column:
    return (
        F.when((index == n - 1) | step.rlike(P.CONCLUDE), "conclusion")
        .when(step.rlike(P.VERIFY), "verification")
        .when(step.rlike(P.APPROACH), "approach_statement")
        .when(step.rlike(P.SETUP) | (index == 0), "setup")
        .otherwise("computation")
    )


def keyword_hits(low: Column, groups: dict[str, list[str]]) -> dict[str, Column]:
    """The keywords of each group that a lower-cased text holds, in list order."""
    return {k: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in kws])) for k, kws in groups.items()}


def classify_approach(x: Column) -> Column:
    """Struct (label, keywords): unknown, a single category, or mixed; at most five keywords in list order."""
    names = F.array(*map(F.lit, P.APPROACH_KEYWORDS))

    def of(hits: Column) -> Column:
        some = F.filter(names, lambda k, i: F.size(F.get(hits, i)) > 0)
        label = F.when(F.size(some) == 0, "unknown").when(F.size(some) > 1, "mixed").otherwise(F.try_element_at(some, F.lit(1)))
        return F.struct(label.alias("label"), F.slice(F.flatten(hits), 1, 5).alias("keywords"))

    return let(F.lower(text_or_empty(x)), lambda low: let(F.array(*keyword_hits(low, P.APPROACH_KEYWORDS).values()), of))


def infer_subject(x: Column) -> Column:
    """The first subject with the most keys; other without any."""
    names = F.array(*map(F.lit, P.SUBJECT_KEYS))

    def of(sizes: Column) -> Column:
        top = F.array_max(sizes)
        return F.when(top > 0, F.get(names, (F.array_position(sizes, top) - 1).cast("int"))).otherwise("other")

    return let(F.lower(text_or_empty(x)), lambda low: let(F.array(*[F.size(h) for h in keyword_hits(low, P.SUBJECT_KEYS).values()]), of))


def normalise_subject(x: Column) -> Column:
    """The subject whose key a label holds first, in one vocabulary; other without one."""
    low = F.lower(text_or_empty(x))
    return F.coalesce(*[F.when(F.contains(low, F.lit(key)), F.lit(name)) for key, name in P.SUBJECT_NAMES.items()], F.lit("other"))


def settled_region(x: Column) -> Column:
    """What follows the last change of mind if five words or more, else the last quarter of the words, twenty at least."""
    def of(t: Column) -> Column:
        tails = [F.when(t.rlike(p), F.element_at(F.split(t, p), -1)) for p in P.ABANDON]
        shortest = F.array_min(F.array_compact(F.array(*[F.when(y.isNotNull(), F.struct(F.length(y).alias("l"), y.alias("s"))) for y in tails])))
        return let(strip(shortest["s"]), lambda tail: F.when(F.coalesce(n_words(tail) >= 5, F.lit(False)), tail).otherwise(let(words(t), last)))

    def last(w: Column) -> Column:
        k = F.least(F.size(w), F.greatest(F.lit(20), F.floor(F.size(w) / 4).cast("int")))
        return F.when(F.size(w) > 0, F.array_join(F.slice(w, F.size(w) - k + 1, k), " ")).otherwise("")

    return let(strip(text_or_empty(x)), of)


def thinking_switch(x: Column) -> Column:
    """The first switch marker's text, by marker order; null without one."""
    return F.coalesce(*[F.nullif(strip(F.regexp_extract(text_or_empty(x), p, 0)), F.lit("")) for p in P.SWITCH])


def stated_approach(steps: Column) -> Column:
    """First sentence of the first step, without its number."""
    first = F.regexp_replace(F.coalesce(F.get(steps, F.lit(0)), F.lit("")), r"(?i)^\s*(?:step\s*)?[0-9]+[\.\):]\s*", "")
    return strip(F.element_at(F.split(first, r"(?<=[.!?])\s", 2), 1))


def approaches_match(a: Column, b: Column) -> Column:
    known = lambda x: F.coalesce((x != "") & (x != "unknown"), F.lit(False))
    return F.when(known(a) & known(b), a == b)


def _sorted_ngrams(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of every ``n`` words in a row, put together from hashes of half as many: the work does not grow with ``n``. Few words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # at ASCII white space, as the pattern in ``words``
    if len(words) < n:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)

    def of(n: int) -> np.ndarray:
        if n == 1:
            return one
        a = of(n // 2)
        g = a[: len(a) - n // 2] * np.uint64(0x9E3779B97F4A7C15) + a[n // 2 :]
        g ^= g >> np.uint64(29)
        return g if n % 2 == 0 else g[:-1] * np.uint64(0xBF58476D1CE4E5B9) + one[n - 1 :]

    return np.sort(of(n))


def has_repeated_ngram(x: Column, n: int = 20, most: int = 3) -> Column:
    """Whether some n words in a row occur more than ``most`` times; texts of fewer than 2n words do not.

    n-grams are sorted, so that repeats lie side by side; no rows are multiplied. In Arrow batches: over arrays of words Catalyst works element by element, and a slice
    for each run of words copies all of them.
    """
    def repeats(texts: pa.Array) -> pa.Array:
        grams = (_sorted_ngrams(t.as_py(), n) for t in texts)
        return pa.array([len(g) > n and bool((g[most:] == g[:-most]).any()) for g in grams], pa.bool_())

    return F.arrow_udf(repeats, "boolean")(x)


def ngram_counts(x: Column, n: int) -> Column:
    """Struct (most, distinct): how often the most frequent ``n`` words in a row of a text occur, and how many different ones there are.

    Counted in the row, over sorted 64-bit hashes: nothing is shuffled and no row is multiplied. 0 where there are fewer words.
    """
    def counted(g: np.ndarray) -> tuple[int, int]:
        ends = np.flatnonzero(np.append(g[1:] != g[:-1], True)) if len(g) else np.zeros(0, int)
        return int(np.diff(ends, prepend=-1).max(initial=0)), len(ends)

    def counts(texts: pa.Array) -> pa.Array:
        found = np.array([counted(_sorted_ngrams(t.as_py(), n)) for t in texts], np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["most", "distinct"])

    return F.arrow_udf(counts, "most long, distinct long")(x)


def is_incomplete(x: Column) -> Column:
    cut = lambda last: ~last.rlike(r"[.!?}$]$") | (n_words(last) < 4)
    of = lambda t: F.when(t == "", True).when(t.contains("\\boxed{"), False).otherwise(let(strip(F.element_at(F.split(t, r"\r\n?|\n"), -1)), cut))
    return let(strip(text_or_empty(x)), of)


def has_han(x: Column) -> Column:
    return text_or_empty(x).rlike(P.HAN)


def mechanism_label(reply: Column) -> Column:
    """The first known label after the last "label:", else the known label that occurs last."""
    t = F.lower(text_or_empty(reply))
    known = P.MECHANISMS_SOUND + P.MECHANISMS_FLAWED
    tail = F.substring_index(t, "label:", -1)
    first = F.array_min(F.array_compact(F.array(*[F.when(tail.contains(k), F.struct(F.instr(tail, k).alias("at"), F.lit(k).alias("k"))) for k in known])))
    back = F.reverse(t)
    last = F.array_max(F.array_compact(F.array(*[
        F.when(t.contains(k), F.struct((-F.instr(back, k[::-1]) - len(k)).alias("at"), F.lit(k).alias("k"))) for k in known
    ])))
    return F.when(t.contains("label:"), F.coalesce(first["k"], last["k"])).otherwise(last["k"])


def clip(x: Column, cap: int) -> Column:
    """Head (60 %) and tail of a text longer than ``cap``."""
    head = int(cap * 0.6)
    return F.when(F.length(x) <= cap, x).otherwise(F.concat(F.left(x, F.lit(head)), F.lit("\n[...]\n"), F.right(x, F.lit(cap - head))))


def channels(x: Column) -> Column:
    """Struct (analysis, final) of a channel-marked reply; without marks all is final."""
    def part(name: str) -> Column:
        return F.nullif(strip(F.regexp_extract(text_or_empty(x), rf"(?s)<\|channel\|>{name}<\|message\|>(.*?)(?:<\|end\|>|<\|return\|>|<\|start\|>|<\|channel\|>|$)", 1)), F.lit(""))

    bare = strip(F.regexp_replace(text_or_empty(x), r"<\|[a-z_]+\|>", ""))
    return F.struct(F.coalesce(part("analysis"), F.lit("")).alias("analysis"), F.coalesce(part("final"), bare).alias("final"))


def long_steps(x: Column) -> Column:
    """Lines of more than three characters after the last close tag, else that text whole."""
    tail = strip(F.substring_index(text_or_empty(x), "</think>", -1))
    lines = F.filter(F.transform(F.split(tail, "\n"), strip), lambda s: F.length(s) > 3)
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(tail))


def problem_id(record_id: Column) -> Column:
    return F.regexp_replace(record_id, r"_c[0-9]+$", "")


def retypeset(x: Column) -> Column:
    """Bare integers wrapped in dollar signs."""
    return F.regexp_replace(x, r"(?<![\$\w.])(\d+)(?![\$\w.])", r"\$$1\$")


def inflate(steps: Column, dose: int) -> Column:
    """Re-typeset body, ``dose`` inert steps in turn, then the last step as it was."""
    body = F.transform(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0))), retypeset)
    inert = F.array(*[F.lit(P.INERT_STEPS[i % len(P.INERT_STEPS)]) for i in range(dose)]).cast("array<string>")
    return F.when(F.size(steps) > 0, F.concat(body, inert, F.slice(steps, F.size(steps), F.lit(1)))).otherwise(steps)
