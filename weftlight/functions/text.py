"""Column expressions over text: tokens, terms, sentences, citations, numbers, overlap. Each rule exists once, here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a term list leaves out. Each list belongs to its own rule and they differ on purpose.
QUESTION_STOP = "what which when where who how why the a an and or of to in on for with is are was were does do did not this that these those from by at it its about between".split()
RELEVANCE_STOP = "what which when where does that have been from about how many was were this with their supports claim evidence information data system using based provide".split()
ANSWER_STOP = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into through during "
    "before after above below between under again further then once here there when where why how all both each few more most other some such no nor not only own same so than "
    "too very just because but and or if while about against it its this that these those what which who whom whose"
).split()
#: Negating words and phrases (fixed values).
NEGATIONS = (
    "not|no|never|neither|nor|does not|do not|did not|was not|were not|has not|have not|had not|cannot|can't|won't|wouldn't|shouldn't|couldn't|isn't|aren't|wasn't|weren't|"
    "doesn't|don't|didn't|hasn't|haven't|hadn't|lack|lacks|lacking|without|fewer|less|lower|decreased|declined|reduced"
)
#: Metric names next to which values are read (fixed values).
METRICS = "revenue employees utilization growth output production units profit income capacity rate percent sales cost price margin".split()


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; punctuation stays."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def terms(text: Column, least: int, stop: list[str]) -> Column:
    """Distinct words of at least `least` letters, digits or underscores, without the stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{" + str(least) + r",})"), 1)), literal_array(stop))


def ascii_terms(text: Column, least: int, stop: list[str]) -> Column:
    """As terms(), of ASCII letters, digits and underscores only."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]{" + str(least) + r",})"), 1)), literal_array(stop))


def key_terms(text: Column) -> Column:
    """Distinct runs of a-z without the answer stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)), literal_array(ANSWER_STOP))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's terms that the text has; 0 if either is empty."""
    return F.when((F.size(query) == 0) | (F.size(text) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(query, text)) / F.size(query))


def relevance(query: Column, text: Column) -> Column:
    """0.4 Jaccard and 0.6 coverage of two term arrays."""
    return 0.4 * jaccard(query, text) + 0.6 * coverage(query, text)


def sentences(text: Column) -> Column:
    """Split after . ! ? and white space; empty pieces go."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def citation_ids(text: Column) -> Column:
    """Numbers of [n] markers; full-width brackets and digits count."""
    plain = F.translate(text, "【】０１２３４５６７８９", "[]0123456789")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"\[(\d{1,6})\]"), 1), lambda x: x.cast("int"))


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\d+\]|【\d+】", "")


def numbers(text: Column) -> Column:
    """Numeric expressions with optional $ and unit, commas removed, citation markers ignored."""
    found = F.regexp_extract_all(without_citations(text), F.lit(r"(?i)([$]?\s*[\d,]+\.?\d*\s*(?:%|percent|million|billion|trillion|M|B|K|thousand)?)"), 1)
    return F.filter(F.transform(found, lambda x: F.regexp_replace(F.trim(x), ",", "")), lambda x: x.rlike(r"^[0-9$]"))


def number_value(raw: Column) -> Column:
    """A numeric expression as a double; k, m, b and t multiply; spelled units and other rests give null."""
    base = F.regexp_replace(F.trim(raw), r"^\$+", "")
    last = F.lower(F.substring(base, -1, 1))
    factor = F.when(last == "k", 1e3).when(last == "m", 1e6).when(last == "b", 1e9).when(last == "t", 1e12).otherwise(1.0)
    digits = F.when(last.isin("k", "m", "b", "t"), F.expr("1")).otherwise(F.lit(0))
    body = F.when(digits == 1, F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)
    return F.when(F.trim(body).rlike(r"^[0-9]+\.?[0-9]*$|^\.[0-9]+$"), F.trim(body).try_cast("double") * factor)


def numbers_match(a: Column, b: Column) -> Column:
    """Integers must be equal, other numbers within one percent; zero matches what is closer than 1."""
    whole = (a == F.floor(a)) & (b == F.floor(b))
    return (
        F.when(a.isNull() | b.isNull(), False)
        .when((a == 0) | (b == 0), F.abs(a - b) < 1.0)
        .when(whole, a == b)
        .otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)) < 0.01)
    )


def scaled(value: Column, unit: Column) -> Column:
    """A value in billions by its unit (B, M, K); percent and bare values stay."""
    u = F.lower(unit)
    return value * F.when(u.isin("million", "mn", "m"), 1e-3).when(u.isin("thousand", "k"), 1e-6).otherwise(1.0)


def years(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z_])(20[0-9]{2})(?![0-9A-Za-z_])"), 1), lambda x: x.cast("int"))))


def masked_ascii(text: Column) -> Column:
    """Other than ASCII characters become a digit, so word boundaries mean the same to every engine."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "0")


def proper_nouns(text: Column) -> Column:
    """Runs of capitalised ASCII words, in order, repeats kept."""
    return F.regexp_extract_all(masked_ascii(text), F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), 1)


def any_in(low: Column, words: list[str]) -> Column:
    """Whether any of the words occurs in the text, anywhere and literally."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def has_negation(text: Column) -> Column:
    return masked_ascii(F.lower(text)).rlike(rf"\b(?:{NEGATIONS})\b")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")
