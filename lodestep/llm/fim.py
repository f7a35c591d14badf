"""Fill-in-middle transformation by escaped marker injection, in Column expressions only.

A delimiter that the text itself holds is escaped; ``regexp_replace`` appends the delimiter after every unit, counting it counts
the units, ``substring_index`` takes the parts by rank, and what was escaped comes back. One scan, no shuffle and no Python: a
row's memory is some multiple of its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.llm._shared import fresh

MARKS = ("<P>", "<S>", "<M>")
#: A run of A-Z and a-z, or one other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
_END, _ESC = "\u0001", "\u0002"


def _escaped(text: Column) -> Column:
    """``text`` without the delimiter: the escape and the delimiter become the escape with 0 and with 1."""
    return F.replace(F.replace(text, F.lit(_ESC), F.lit(f"{_ESC}0")), F.lit(_END), F.lit(f"{_ESC}1"))


def _bare(marked: Column) -> Column:
    return F.replace(marked, F.lit(_END), F.lit(""))


def _restored(marked: Column) -> Column:
    """A stretch of text as it was before ``_escaped`` and the delimiters."""
    return F.replace(F.replace(_bare(marked), F.lit(f"{_ESC}1"), F.lit(_END)), F.lit(f"{_ESC}0"), F.lit(_ESC))


def marked_units(text: Column, unit: str = UNIT) -> Column:
    """The escaped text with the delimiter after each unit; an escaped character is a unit. ``unit`` must match at every character."""
    return F.regexp_replace(_escaped(text), f"{_ESC}[01]|{unit}", f"$0{_END}")


def _index(marked: Column, rank: Column) -> Column:
    return F.call_function("substring_index", marked, F.lit(_END), rank.cast("int"))


def _first(marked: Column, k: Column) -> Column:
    """The first ``k`` units."""
    return _index(marked, k)


def _rest(marked: Column, k: Column, units: Column) -> Column:
    """What stands after the first ``k`` of ``units`` units: all behind the delimiter that is the (units - k + 1)th from the end."""
    return F.when(k == 0, marked).otherwise(_index(marked, k - units - 1))


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four whole numbers below 2**32: the first 8-digit groups of the sha256 of ``seed:doc_id``. A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, percent_spm: int = 20, marks: tuple[str, str, str] = MARKS, unit: str = UNIT) -> DataFrame:
    """``docs`` with n, form, prefix, middle, suffix and output, in place of columns of these names.

    The text is cut into n units (``unit``, matched from left to right over code points) and split after two ranks drawn by
    the id's hash. ``percent`` of the documents change, ``percent_spm`` of those into suffix, prefix, middle (spm), the others into
    prefix, suffix, middle (psm). A null text is empty. A text that is empty or holds one of ``marks`` stays as it is (plain); the
    parts of a plain text are null. Rows that repeat an id and a text give the same output; a null id is drawn as an empty
    one. An empty table gives no rows. Marks may not be part of each other, nor may one begin as another ends.
    """
    made, c = ("n", "form", "prefix", "middle", "suffix", "output"), F.col
    kept = [c(f"`{x}`") for x in docs.columns if x.lower() not in made]
    t, m, n, lo, hi, tail, *h = fresh(docs, "fim_text", "fim_marked", "fim_n", "fim_lo", "fim_hi", "fim_tail", "fim_1", "fim_2", "fim_3", "fim_4")
    h1, h2, h3, h4 = map(c, h)
    cut = docs.select(*kept, F.coalesce(c("text").cast("string"), F.lit("")).alias(t), *[d.alias(x) for d, x in zip(draws(seed, c("doc_id")), h, strict=True)])
    cut = cut.withColumn(m, marked_units(c(t), unit)).withColumn(n, (F.length(m) - F.length(_bare(c(m)))).cast("long"))
    plain = c(t) == ""
    for mark in marks:
        plain = plain | F.contains(c(t), F.lit(mark))
    form = F.when(plain | (h3 % 100 >= percent), "plain").when(h4 % 100 < percent_spm, "spm").otherwise("psm")
    a, b = h1 % (c(n) + 1), h2 % (c(n) + 1)
    cut = cut.withColumns({"form": form, lo: F.least(a, b), hi: F.greatest(a, b)})
    if_cut = lambda part: F.when(c("form") != "plain", part)
    between, left = c(hi) - c(lo), c(n) - c(lo)
    cut = cut.withColumn("prefix", if_cut(_restored(_first(c(m), c(lo))))).withColumn(tail, if_cut(_rest(c(m), c(lo), c(n))))
    cut = cut.withColumns({"middle": _restored(_first(c(tail), between)), "suffix": _restored(_rest(c(tail), between, left))})
    p, s, e = map(F.lit, marks)
    output = F.when(c("form") == "psm", F.concat(p, "prefix", s, "suffix", e, "middle")).when(c("form") == "spm", F.concat(s, "suffix", p, "prefix", e, "middle"))
    return cut.select(*kept, c(n).alias("n"), "form", "prefix", "middle", "suffix", output.otherwise(c(t)).alias("output"))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text from ``transform``'s output and form; null where either is null."""
    p, s, e = marks
    front = lambda of, mark: F.substring_index(of, mark, 1)
    back = lambda of, mark: F.substring_index(of, mark, -1)
    two = front(back(output, s), e)  # psm: <P>prefix<S>suffix<M>middle
    psm = F.concat(F.substring(front(output, s), len(p) + 1, 2**31 - 1), back(output, e), two)
    spm = F.concat(front(back(output, p), e), back(output, e), F.substring(front(output, p), len(s) + 1, 2**31 - 1))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
