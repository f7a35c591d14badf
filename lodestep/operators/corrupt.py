"""Corruptions and damages of solutions as Column builders; every random choice is a hash of the seed and the row's key.

A builder that finds nothing to damage returns null; nothing is replaced by another kind of damage.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.functions import patterns as P
from lodestep.functions import text as T
from lodestep.functions.rand import h, hashes, u


def _dose(n: Column, severity: float) -> Column:
    """How many of n to hit: floor(n * severity), one at least, n at most."""
    return F.least(n, F.greatest(F.lit(1), F.floor(n * severity).cast("int")))


def _hit(hashed: Column, k: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a flag for each hash: whether it is among the k least, equal ones by their order. No index is looked up in a list of those hit."""
    flags = lambda at: T.let(F.get(F.sort_array(at), k - 1), lambda last: fn(F.transform(at, lambda p: p <= last)))
    return T.let(F.transform(hashed, lambda x, i: F.shiftleft(x, 31) + i), flags)


def diffuse_mask(response: Column, key: Column, severity: float, seed: int = 1) -> Column:
    """A share of the words replaced by a mask."""
    def masked(w: Column, hashed: Column) -> Column:
        put = lambda hit: F.array_join(F.zip_with(w, hit, lambda x, is_hit: F.when(is_hit, "[MASK]").otherwise(x)), " ")
        return F.when(F.size(w) > 0, _hit(hashed, _dose(F.size(w), severity), put)).otherwise(response)

    w = T.words(response)
    return T.let(F.struct(w.alias("w"), hashes(F.size(w), seed, key).alias("hashed")), lambda a: T.let(a["w"], lambda w: masked(w, a["hashed"])))


def step_delete(steps: Column, key: Column, severity: float, seed: int = 2) -> Column:
    """A share of the interior steps dropped; fewer than three steps stay as they are."""
    inner = F.size(steps) - 2
    stay = lambda hit: F.filter(steps, lambda s, i: ~F.coalesce(F.get(hit, i - 1), F.lit(False)))
    return F.when(F.size(steps) >= 3, _hit(hashes(inner, seed, key, 1), _dose(inner, severity), stay)).otherwise(steps)


def region_excise(steps: Column, key: Column, severity: float, seed: int = 3) -> Column:
    """One run of interior steps dropped; fewer than four steps stay as they are."""
    inner = F.size(steps) - 2
    k = _dose(inner, severity)
    start = (h(seed, key) % F.greatest(inner - k + 1, F.lit(1))).cast("int") + 1
    return F.when(F.size(steps) >= 4, F.filter(steps, lambda s, i: (i < start) | (i >= start + k))).otherwise(steps)


def connective_strip(response: Column) -> Column:
    """Every logical connective removed."""
    return F.regexp_replace(response, P.CONNECTIVES, "")


def result_mask(steps: Column, key: Column, severity: float, seed: int = 4) -> Column:
    """Numbers masked in a share of the interior steps; the last step keeps its own."""
    number = r"(?<![\\\w])-?[0-9]+(?:\.[0-9]+)?"
    inside = lambda i: (i > 0) & (i < F.size(steps) - 1)
    masked = F.transform(steps, lambda s, i: F.when(inside(i) & (u(seed, key, i) < severity), F.regexp_replace(s, number, "[NUM]")).otherwise(s))
    return F.when(F.size(steps) >= 3, masked).otherwise(steps)


def excess_inject(steps: Column, key: Column, severity: float, seed: int = 5) -> Column:
    """Distractor steps put in at hashed places, one at least."""
    k = F.greatest(F.lit(1), F.floor(F.size(steps) * severity).cast("int"))
    inert = F.array(*map(F.lit, P.INERT_STEPS))

    def put(acc: Column, j: Column) -> Column:
        place = (h(seed, key, j) % (F.size(acc) + 1)).cast("int")
        piece = F.get(inert, (h(seed + 100, key, j) % len(P.INERT_STEPS)).cast("int"))
        return F.concat(F.slice(acc, F.lit(1), place), F.array(piece), F.slice(acc, place + 1, F.greatest(F.size(acc), F.lit(1))))

    return F.when(F.size(steps) > 0, F.aggregate(F.sequence(F.lit(1), k), steps, put)).otherwise(steps)


def connective_dose(response: Column, key: Column, severity: float, seed: int = 6) -> Column:
    """Each connective removed with a chance of ``severity``, drawn by its place among the text's connectives."""
    parts = F.split(F.regexp_replace(response, P.CONNECTIVES, "\u0001"), "\u0001", -1)
    put = lambda found, part, i: F.when(i == 0, part).otherwise(F.concat(F.when(u(seed, key, i - 1) < severity, F.lit("")).otherwise(F.get(found, i - 1)), part))
    drawn = T.let(F.regexp_extract_all(response, F.lit(P.CONNECTIVES), F.lit(0)), lambda found: F.array_join(F.transform(parts, lambda part, i: put(found, part, i)), ""))
    # A text that holds the mark itself would be cut there, too: it keeps its connectives' count, so such texts stay as they are.
    return F.when(F.contains(response, F.lit("\u0001")), response).otherwise(drawn)


def _lines(steps: Column) -> Column:
    return F.array_join(steps, "\n")


#: Graded corruptions by name: each takes steps, text, key and a dose in [0, 1], and gives a text.
DOSE_OPERATORS: dict[str, Callable[[Column, Column, Column, float], Column]] = {
    "diffuse_mask": lambda steps, text, key, dose: diffuse_mask(text, key, dose),
    "step_delete": lambda steps, text, key, dose: _lines(step_delete(steps, key, dose)),
    "region_excise": lambda steps, text, key, dose: _lines(region_excise(steps, key, dose)),
    "connective_strip": lambda steps, text, key, dose: connective_dose(text, key, dose) if dose < 1 else connective_strip(text),
    "result_mask": lambda steps, text, key, dose: _lines(result_mask(steps, key, dose)),
    "excess_inject": lambda steps, text, key, dose: _lines(excess_inject(steps, key, dose)),
}


def rejoined(steps: Column, text: Column) -> Column:
    """Steps joined as ``text`` separates its own."""
    sep = separator(text)
    return F.when(sep == "\n\n", F.array_join(steps, "\n\n")).when(sep == "\n", _lines(steps)).otherwise(F.array_join(steps, " "))


def corruption_dataset(df: DataFrame, key: str, text: str, steps: str, gold: str) -> DataFrame:
    """One row for each corruption that a candidate is flagged ready for and that changes it: original_text, corrupted_text, corruption_type, and what it carries.

    ``df`` has can_approach_corrupt, can_step_corrupt, can_conclusion_corrupt and include_in_training (null counts as false), and candidate_type,
    contrastive_group, dataset, corruption_priority and hardness_score, which every sample of the candidate carries with its key. A corruption that leaves the text as it
    was, or empty, gives no row. Null texts give none.
    """
    k, t, s = F.col(key), F.col(text), F.col(steps)
    made = {"approach": _lines(approach_corruption(s, k)), "step": rejoined(step_corruption(s, k), t), "conclusion": conclusion_corruption(t, F.col(gold), k)}
    one = lambda kind: F.struct(F.lit(kind).alias("corruption_type"), F.when(F.col(f"can_{kind}_corrupt"), made[kind]).alias("corrupted_text"))
    carried = ["candidate_type", "contrastive_group", "dataset", "corruption_priority", "hardness_score"]
    rows = df.where("include_in_training").select(key, *carried, t.alias("original_text"), F.inline(F.array(*map(one, made))))
    return rows.where("corrupted_text <> original_text and corrupted_text <> ''")


def noisy_vector(v: Column, key: Column, scale: float, seed: int) -> Column:
    """Gaussian noise added to each component, ``scale`` times the vector's own deviation, by Box and Muller from two hashes."""
    doubles = v.cast("array<double>")
    n = F.size(v)
    mean = F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x * x) / n - mean * mean)
    normal = lambda i: F.sqrt(-2 * F.ln((h(seed, key, i) + 1) / F.lit(4294967296.0))) * F.cos(2 * math.pi * u(seed + 1, key, i))
    return T.let(spread, lambda sd: F.transform(doubles, lambda x, i: x + scale * sd * normal(i)))


def detect_approach(step: Column) -> Column:
    """The first family whose signal the step shows; null without one."""
    return F.coalesce(*[F.when(step.rlike(p), F.lit(k)) for k, p in P.APPROACH_SIGNALS.items()])


def approach_corruption(steps: Column, key: Column, seed: int = 6) -> Column:
    """The first step replaced by a canned sentence of another family."""
    families = F.array(*map(F.lit, P.APPROACH_REPLACEMENTS))
    found = detect_approach(F.get(steps, F.lit(0)))
    others = F.filter(families, lambda k: ~F.coalesce(k == found, F.lit(False)))
    family = F.get(others, (h(seed, key) % F.size(others)).cast("int"))
    texts = F.create_map(*[x for k, v in P.APPROACH_REPLACEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    sentence = F.get(F.try_element_at(texts, family), (h(seed + 1, key) % 3).cast("int"))
    return F.when(F.size(steps) > 0, F.concat(F.array(sentence), F.slice(steps, 2, F.greatest(F.size(steps), F.lit(1))))).otherwise(steps)


def separator(response: Column) -> Column:
    """What stands between the steps of a solution: a blank line, else a line break, else a space."""
    return F.when(F.contains(response, F.lit("\n\n")), "\n\n").when(F.contains(response, F.lit("\n")), "\n").otherwise(" ")


def step_corruption(steps: Column, key: Column, seed: int = 7, mode: str = "auto", inserted: tuple[str, ...] = tuple(P.INERT_STEPS)) -> Column:
    """An interior step deleted (``delete``), swapped with its neighbour (``shuffle``) or one of ``inserted`` put before it (``insert``).

    ``auto`` deletes for seven keys in ten and swaps for the others. Fewer than three steps stay.
    """
    n = F.size(steps)
    at = (h(seed + 1, key) % F.greatest(n - 2, F.lit(1))).cast("int") + 1
    swap = F.when(n - 2 >= 2, (h(seed + 1, key) % F.greatest(n - 3, F.lit(1))).cast("int") + 1).otherwise(0)
    deleted = F.filter(steps, lambda s, i: i != at)
    swapped = F.transform(steps, lambda s, i: F.when(i == swap, F.get(steps, swap + 1)).when(i == swap + 1, F.get(steps, swap)).otherwise(s))
    if mode == "insert":
        new = F.get(F.array(*map(F.lit, inserted)), (h(seed + 2, key) % len(inserted)).cast("int"))
        put = F.concat(F.slice(steps, F.lit(1), at), F.array(new), F.slice(steps, at + 1, F.greatest(n, F.lit(1))))
        return F.when(n < 3, steps).otherwise(put)
    out = {"delete": deleted, "shuffle": swapped, "auto": F.when(u(seed, key) < 0.7, deleted).otherwise(swapped)}[mode]
    return F.when(n < 3, steps).otherwise(out)


def perturb_number(value: Column, key: Column, seed: int = 8) -> Column:
    """One of six changes of a number, as text: whole numbers without a point, others to four places."""
    small = (h(seed + 1, key) % 10 + 1).cast("double")
    changes = F.array(value + small, value - small, value * 2, value / 2, value + 10, value - 10)
    out = F.get(changes, (h(seed, key) % 6).cast("int"))
    return F.when(out % 1 == 0, out.cast("long").cast("string")).otherwise(F.round(out, 4).cast("string"))


def conclusion_corruption(response: Column, gold: Column, key: Column, seed: int = 8) -> Column:
    """The number in the last boxed group changed, else the gold answer's, else a zero appended; without a box one is added."""
    plain = lambda x: T.as_number(F.replace(T.strip(x), F.lit(","), F.lit("")))
    inner = T.last_boxed(response)
    number = F.coalesce(plain(inner), plain(gold))
    wrong = F.coalesce(perturb_number(number, key, seed), F.when(inner.isNotNull(), F.concat(inner, F.lit("0"))), F.lit("0"))
    opener = F.length(response) - F.instr(F.reverse(response), F.lit("{dexob\\")) + 1
    tail = F.substring(response, opener + 1, F.length(response))
    rest = F.when(F.startswith(tail, inner), F.substring(tail, F.length(inner) + 1, F.length(tail))).otherwise("")
    boxed = F.concat(F.substring(response, F.lit(1), opener), wrong, rest)
    added = F.concat(F.regexp_replace(response, r"\s+$", ""), F.lit("\n\nTherefore the final answer is \\boxed{"), wrong, F.lit("}."))
    return F.when(inner.isNotNull(), boxed).otherwise(added)


def corrupt_words(x: Column, key: Column, share: float = 0.25, seed: int = 9) -> Column:
    """Each word dropped with a chance of ``share``; fewer than four words stay, and one word is always kept."""
    least = math.ceil(share * 2**32)
    kept = lambda w, hashed: F.filter(w, lambda s, i: F.get(hashed, i) >= least)
    joined = lambda w, left: F.when(F.size(left) == 0, F.get(w, F.lit(0))).otherwise(F.array_join(left, " "))
    of = lambda w, hashed: F.when(F.size(w) < 4, x).otherwise(T.let(kept(w, hashed), lambda left: joined(w, left)))
    w = T.words(x)
    return T.let(F.struct(w.alias("w"), hashes(F.size(w), seed, key).alias("hashed")), lambda a: T.let(a["w"], lambda w: of(w, a["hashed"])))


def _damage(kind: str, operation: str, steps: Column, at: Column, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("damage_type"), F.lit(operation).alias("operation"), at.cast("array<int>").alias("step_indices"), detail.alias("detail"), steps.alias("steps"))


def drop_step(steps: Column, key: Column, seed: int = 20) -> Column:
    n = F.size(steps)
    i = (h(seed, key) % F.greatest(n - 2, F.lit(1))).cast("int") + 1
    return F.when(n >= 3, _damage("structural", "drop_step", F.filter(steps, lambda s, j: j != i), F.array(i), F.left(F.get(steps, i), F.lit(80))))


def swap_steps(steps: Column, key: Column, seed: int = 21) -> Column:
    n = F.size(steps)
    i = (h(seed, key) % F.greatest(n - 1, F.lit(1))).cast("int")
    out = F.transform(steps, lambda s, j: F.when(j == i, F.get(steps, i + 1)).when(j == i + 1, F.get(steps, i)).otherwise(s))
    return F.when(n >= 3, _damage("structural", "swap_steps", out, F.array(i, i + 1), F.lit("adjacent order inverted")))


def duplicate_step(steps: Column, key: Column, seed: int = 22) -> Column:
    n = F.size(steps)
    i = (h(seed, key) % F.greatest(n, F.lit(1))).cast("int")
    out = F.concat(F.slice(steps, F.lit(1), i + 1), F.slice(steps, i + 1, F.greatest(n, F.lit(1))))
    return F.when(n >= 2, _damage("structural", "duplicate_step", out, F.array(i), F.left(F.get(steps, i), F.lit(80))))


def _sites(steps: Column, patterns: list[str]) -> Column:
    """(step, text) of every match, by step and pattern."""
    def of(pattern: str) -> Column:
        return F.transform(steps, lambda s, i: F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), lambda m: F.struct(i.alias("i"), m.alias("m"))))

    each = [of(p) for p in patterns]
    return F.sort_array(F.flatten(F.concat(*each)))


def _pick(sites: Column, key: Column, seed: int) -> Column:
    return F.get(sites, (h(seed, key) % F.greatest(F.size(sites), F.lit(1))).cast("int"))


def _replace_in(steps: Column, i: Column, old: Column, new: Column) -> Column:
    """The first ``old`` in step i replaced."""
    def one(s: Column) -> Column:
        at = F.instr(s, old)
        return F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + F.length(old), F.length(s)))

    return F.transform(steps, lambda s, j: F.when(j == i, one(s)).otherwise(s))


def break_reference(steps: Column, key: Column, seed: int = 23) -> Column:
    """A reference to another step pointed elsewhere or taken out."""
    return T.let(references(steps), lambda sites: _break_one(steps, key, seed, sites))


def references(steps: Column) -> Column:
    return _sites(steps, P.REFERENCES)


def _break_one(steps: Column, key: Column, seed: int, sites: Column) -> Column:
    return T.let(_pick(sites, key, seed), lambda site: _broken(steps, site, key, seed))


def _broken(steps: Column, site: Column, key: Column, seed: int) -> Column:
    number = F.nullif(F.regexp_extract(site["m"], "[0-9]+", 0), F.lit("")).try_cast("long")
    shift = F.get(F.array(*map(F.lit, (-2, -1, 1, 2))), (h(seed + 1, key) % 4).cast("int"))
    wrong = F.regexp_replace(site["m"], F.lit("[0-9]+"), F.greatest(F.lit(1), number + shift).cast("string"))
    misdirect = number.isNotNull() & (h(seed + 2, key) % 2 == 0)
    gone = F.transform(_replace_in(steps, site["i"], site["m"], F.lit("")), lambda s: T.strip(F.regexp_replace(s, r"\s{2,}", " ")))
    out = F.when(misdirect, _damage("dependency", "misdirect_reference", _replace_in(steps, site["i"], site["m"], wrong), F.array(site["i"]), site["m"]))
    return F.when(site.isNotNull(), out.otherwise(_damage("dependency", "drop_reference", gone, F.array(site["i"]), site["m"])))


def remove_constraint(steps: Column, key: Column, seed: int = 26) -> Column:
    """A condition taken out of a step; not where fewer than two words would be left."""
    return T.let(constraints(steps), lambda sites: _remove_one(steps, key, seed, sites))


def constraints(steps: Column) -> Column:
    return _sites(steps, P.CONSTRAINTS)


def _remove_one(steps: Column, key: Column, seed: int, sites: Column) -> Column:
    return T.let(_pick(sites, key, seed), lambda site: _unconstrained(steps, site))


def _unconstrained(steps: Column, site: Column) -> Column:
    out = F.transform(_replace_in(steps, site["i"], site["m"], F.lit("")), lambda s: F.btrim(F.regexp_replace(s, r"\s{2,}", " "), F.lit(" ,;")))
    made = lambda o: F.when(T.n_words(F.get(o, site["i"])) >= 2, _damage("constraint", "remove_condition", o, F.array(site["i"]), F.left(site["m"], F.lit(70))))
    return F.when(site.isNotNull(), T.let(out, made))


def notation_drift(steps: Column, key: Column, seed: int = 27) -> Column:
    """A single-letter variable of two or more steps renamed in one of them, to an unused letter."""
    return T.let(variables(steps), lambda found: _drift_one(steps, key, seed, found))


def variables(steps: Column) -> Column:
    """(v, i) of every single letter that stands alone, once for each step."""
    letter = r"(?<![A-Za-z\\])([a-zA-Z])(?![A-Za-z])"
    return F.flatten(F.transform(steps, lambda s, i: F.transform(F.array_distinct(F.regexp_extract_all(s, F.lit(letter), F.lit(1))), lambda v: F.struct(v.alias("v"), i.alias("i")))))


def _drift_one(steps: Column, key: Column, seed: int, found: Column) -> Column:
    return T.let(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["v"]))), lambda names: _drifted(steps, found, names, key, seed))


def _drifted(steps: Column, found: Column, names: Column, key: Column, seed: int) -> Column:
    several = F.filter(names, lambda v: (F.size(F.filter(found, lambda x: x["v"] == v)) >= 2) & ~v.isin("a", "A", "I"))

    def renamed(v: Column) -> Column:
        places = F.filter(found, lambda x: x["v"] == v)
        free = F.filter(F.array(*map(F.lit, "qwzkm")), lambda c: ~F.array_contains(names, c))
        new = F.coalesce(F.get(free, F.lit(0)), F.lit("q"))
        pattern = F.concat(F.lit(r"(?<![A-Za-z\\])"), v, F.lit("(?![A-Za-z])"))
        place = F.get(places, (h(seed + 1, key) % F.greatest(F.size(places), F.lit(1))).cast("int"))["i"]
        out = T.let(place, lambda i: F.struct(i.alias("i"), F.transform(steps, lambda s, j: F.when(j == i, F.regexp_replace(s, pattern, new)).otherwise(s)).alias("s")))
        return T.let(out, lambda o: F.when(v.isNotNull(), _damage("other", "notation_drift", o["s"], F.array(o["i"]), F.concat(v, F.lit(" -> "), new))))

    return T.let(F.get(several, (h(seed, key) % F.greatest(F.size(several), F.lit(1))).cast("int")), renamed)


def numeric_perturb(steps: Column, key: Column, seed: int = 29) -> Column:
    """One whole number changed by one or two, up only where it is at most two."""
    return T.let(numbers(steps), lambda sites: _perturb_one(steps, key, seed, sites))


def numbers(steps: Column) -> Column:
    return _sites(steps, [r"(?<![\w.])[0-9]+(?![\w.])"])


def _perturb_one(steps: Column, key: Column, seed: int, sites: Column) -> Column:
    return T.let(_pick(sites, key, seed), lambda site: _perturbed(steps, site, key, seed))


def _perturbed(steps: Column, site: Column, key: Column, seed: int) -> Column:
    old = site["m"].try_cast("decimal(38,0)")
    shift = F.when(old > 2, F.get(F.array(*map(F.lit, (-2, -1, 1, 2))), (h(seed + 1, key) % 4).cast("int"))).otherwise((h(seed + 1, key) % 2 + 1).cast("int"))
    new = (old + shift).cast("string")

    def one(s: Column) -> Column:
        at = F.regexp_instr(s, F.concat(F.lit(r"(?<![\w.])"), site["m"], F.lit(r"(?![\w.])")))
        return F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + F.length(site["m"]), F.length(s)))

    out = F.transform(steps, lambda s, j: F.when(j == site["i"], one(s)).otherwise(s))
    return F.when(new.isNotNull(), _damage("other", "numeric_perturb", out, F.array(site["i"]), F.concat(site["m"], F.lit(" -> "), new)))


DAMAGES: dict[str, list[Callable[[Column, Column], Column]]] = {
    "structural": [drop_step, swap_steps, duplicate_step],
    "dependency": [break_reference],
    "constraint": [remove_constraint],
    "other": [notation_drift, numeric_perturb],
}


#: What a damage looks for in the steps, and the damage at one of the places found: every try of a row picks from the same places.
SEARCHES: dict[Callable, tuple[Callable[[Column], Column], Callable[[Column, Column, int, Column], Column]]] = {
    break_reference: (references, _break_one), remove_constraint: (constraints, _remove_one), notation_drift: (variables, _drift_one), numeric_perturb: (numbers, _perturb_one),
}


#: The first seed of each damage; every further try adds a thousand to it.
SEEDS = {op: 20 + i * 3 for i, op in enumerate(op for ops in DAMAGES.values() for op in ops)}


def apply_damage(steps: Column, kind: str, key: Column, tries: int = 6) -> Column:
    """One damage of ``kind`` as a struct, or null where ``tries`` draws find none; every try draws its operation and its place afresh.

    Kinds that need a language model are refused.
    """
    if kind not in DAMAGES:
        raise NotImplementedError(f"{kind} needs a language model")
    ops = DAMAGES[kind]

    def draws(places: dict[Callable, Column]) -> Column:
        def one(op: Callable, t: int) -> Column:
            seed = SEEDS[op] + 1000 * t
            return F.when(F.size(places[op]) > 0, SEARCHES[op][1](steps, key, seed, places[op])) if op in places else op(steps, key, seed)

        def draw(t: int) -> Column:
            turn, out = h(40 + t, key) % len(ops), F.lit(None)
            for i, op in enumerate(ops):  # only the operation that is drawn is worked out
                out = F.when(turn == i, one(op, t)).otherwise(out) if len(ops) > 1 else one(op, t)
            return out

        return F.coalesce(*[draw(t) for t in range(tries)])

    def searched(left: list[Callable], places: dict[Callable, Column]) -> Column:
        """The steps are searched once for each damage, not at every try."""
        return T.let(SEARCHES[left[0]][0](steps), lambda found: searched(left[1:], places | {left[0]: found})) if left else draws(places)

    return searched([op for op in ops if op in SEARCHES], {})
