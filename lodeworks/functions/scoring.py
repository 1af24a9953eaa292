"""Scoring expressions over columns: credits, severities, grades, name measures and graph ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut-points of grades, of badge colours, and weights of severities.
GRADES = ((90, "A+"), (80, "A"), (70, "B"), (60, "C"), (50, "D"))
COLOURS = ((90, "brightgreen"), (80, "green"), (70, "yellowgreen"), (60, "yellow"), (50, "orange"))
SEVERITY_WEIGHT = {"error": 3.0, "warning": 1.0, "info": 0.2}
PENALTY_SCALE = 120.0
# Suffixes of file names that name a platform.
PLATFORMS = (
    "darwin linux windows amd64 arm64 386 unix freebsd netbsd openbsd dragonfly solaris plan9 wasm js wasip1 ios android "
    "mips mips64 ppc64 riscv64 s390x loong64"
).split()


def decay_credit(value: Column, threshold: float | Column, width: float = 4.0) -> Column:
    """1 up to threshold, then falling in a straight line to 0 at threshold * (1 + width)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    over = F.lit(1.0) - (value - t) / (F.lit(float(width)) * t)
    return F.when(value <= t, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), over))


def issue_severity(value: Column, threshold: Column) -> Column:
    """error from 3 times the threshold, warning from 1.5 times or without a threshold, else info."""
    ratio = value / threshold
    return F.when(threshold <= 0, "warning").when(ratio >= 3, "error").when(ratio >= 1.5, "warning").otherwise("info")


def severity_weight(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, w in SEVERITY_WEIGHT.items():
        out = F.when(severity == name, F.lit(w)).otherwise(out)
    return out


def debt_penalty(weight: Column, n: Column, errors: Column) -> Column:
    """Rate of weighted issues on a scale of 120, rounded; 0 without rows or issues, 1 at least with an error."""
    raw = F.round(weight / n * F.lit(PENALTY_SCALE)).cast("long")
    return F.when((n == 0) | (weight == 0), F.lit(0).cast("long")).when(errors > 0, F.greatest(raw, F.lit(1).cast("long"))).otherwise(raw)


def banded(score: Column, bands, other: str) -> Column:
    out = F.lit(other)
    for least, name in reversed(bands):
        out = F.when(score >= least, name).otherwise(out)
    return out


def grade(score: Column) -> Column:
    return banded(score, GRADES, "F")


def badge_colour(score: Column) -> Column:
    return banded(score, COLOURS, "red")


def badge_url(score: Column) -> Column:
    """Badge address with a percent-encoded label."""
    return F.format_string("https://img.shields.io/badge/score-%d%%2F100-%s", score, badge_colour(score))


def camel_words(name: Column) -> Column:
    """Words of a CamelCase name: runs of upper, lower, digits and others, the last upper going with the lower run after it."""
    return F.regexp_extract_all(name, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))


def word_count_score(words: Column) -> Column:
    n = F.size(words)
    return F.when((n >= 2) & (n <= 4), F.lit(1.0)).when(n == 1, F.lit(0.5)).when(n == 5, F.lit(0.7)).otherwise(F.lit(0.5))


def specificity(words: Column, generic: list[str], action: list[str], domain: Column) -> Column:
    """Mean over words: generic 0, action 0.5, in the domain's vocabulary 1, else 0.75; 0 without words."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    g, a = lits(generic), lits(action)
    one = lambda w: F.when(F.array_contains(g, w), 0.0).when(F.array_contains(a, w), 0.5).when(F.array_contains(domain, w), 1.0).otherwise(0.75)
    low = F.transform(words, F.lower)
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.aggregate(low, F.lit(0.0), lambda s, w: s + one(w)) / F.size(words))


def verb_noun(name: Column) -> Column:
    return name.rlike("^[A-Z]") & (F.size(camel_words(name)) >= 2)


def title_case(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(F.lower(word), 2, 1 << 20))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)([A-Z])", "_$1"))


def pascal_case(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20))


def generalise(path: Column, entity: Column, module: Column) -> Column:
    """path with the entity's and then the module's snake name replaced by placeholders."""
    return F.replace(F.replace(path, snake_case(entity), F.lit("{entity}")), snake_case(module), F.lit("{module}"))


def resolved(path: Column, entity: Column, module: Column) -> Column:
    """The paths that a generalised one may stand for: at most two, the entity's first."""
    e, m = snake_case(entity), snake_case(module)
    one = lambda x: F.replace(F.replace(path, F.lit("{entity}"), x), F.lit("{module}"), m)
    return F.array_distinct(F.array(one(e), one(m)))


def suffix_of(base: Column) -> Column:
    """Last ``_part`` of a file name without its platform tag."""
    return F.regexp_extract(F.regexp_replace(base, f"_({'|'.join(PLATFORMS)})$", ""), r"_[^_]*$", 0)


def instability(ca: Column, ce: Column) -> Column:
    return F.coalesce(F.try_divide(ce.cast("double"), (ca + ce).cast("double")), F.lit(0.0))


def abstractness(interfaces: Column, structs: Column) -> Column:
    return F.coalesce(F.try_divide(interfaces.cast("double"), (interfaces + structs).cast("double")), F.lit(0.0))


def main_sequence_distance(a: Column, i: Column) -> Column:
    return F.abs(a + i - F.lit(1.0))


def similarity(a: Column, b: Column) -> Column:
    """Less over more; 1 if both are 0."""
    return F.when((a == 0) & (b == 0), F.lit(1.0)).otherwise(F.least(a, b).cast("double") / F.greatest(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def entropy_ratio(counts: Column) -> Column:
    """Shannon entropy of an array of counts over the log of their sum; 0 for one name or none, 1 at most."""
    n = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    h = F.aggregate(counts, F.lit(0.0), lambda s, c: s - c / n * F.log2(c / n))
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), h / F.log2(n)))


def lower_rank(values: Column, q: float = 0.9) -> Column:
    """The element at trunc((n - 1) * q) of the sorted array."""
    return F.element_at(F.array_sort(values), (F.size(values) - 1).cast("double").__mul__(F.lit(q)).cast("int") + 1)
