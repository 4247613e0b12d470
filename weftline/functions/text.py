"""Scalar text functions, all of them Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content.
STOP_WORDS = (
    "about also and any are because been being but can could did does doing for from get got had has have here how into its just know like made make many may might more most "
    "much not one our really said say says should some than that the their them then there they think this two very was well were what when where which who why will with would yeah yes you your"
).split()
# Labels in their order on ties, and the relation node that gives each.
POSITIVE_LABELS = ("SUPPORT", "ATTACK", "REPHRASE")
NODE_LABELS = {"RA": "SUPPORT", "CA": "ATTACK", "MA": "REPHRASE"}


def content_tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric runs of three characters or more that are no stop words, sorted."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: F.length(w) >= 3)
    return F.array_sort(F.array_distinct(F.array_except(kept, F.array(*map(F.lit, STOP_WORDS)))))


def overlap_features(a: Column, b: Column) -> dict[str, Column]:
    """Shared tokens, overlap coefficient and Jaccard similarity of two token sets; empty sets count as one."""
    shared = F.size(F.array_intersect(a, b))
    return {
        "shared": shared,
        "overlap": shared / F.greatest(F.lit(1), F.least(F.size(a), F.size(b))),
        "jaccard": shared / F.greatest(F.lit(1), F.size(a) + F.size(b) - shared),
    }


def seeded_hash(seed: str, *key: Column) -> Column:
    """SHA-256 of ``seed|key|...`` in hex: an order that any engine can repeat."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]), 256)


def hash_bucket(seed: str, *key: Column) -> Column:
    """0..99 from the first 16 bits of the seeded hash."""
    return (F.conv(F.substring(seeded_hash(seed, *key), 1, 4), 16, 10).cast("long") % 100).cast("int")


def short_id(prefix: str, seed: str, n: int, *key: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(seeded_hash(seed, *key), 1, n))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)[\\s\\x1c-\\x1f]+", " "))


def speaker_of(text: Column) -> Column:
    """What stands before `` : `` or, failing that, before the first colon; null when empty or absent."""
    at = F.when(F.instr(text, " : ") > 0, F.instr(text, " : ")).when(F.instr(text, ":") > 0, F.instr(text, ":"))
    name = F.trim(F.substring(text, F.lit(1), at - F.lit(1)))
    return F.when(at.isNotNull() & (name != ""), name)


def unfence(response: Column) -> Column:
    """The body of a response that is one code fence as a whole, else the response."""
    fence = r"(?is)\A\s*```(?:json)?\s*\n?(.*?)\n?```\s*\z"
    return F.when(response.rlike(fence), F.regexp_extract(response, fence, 1)).otherwise(response)


def category(labels: Column) -> Column:
    """NONE, the one label, or MIXED, from the set of labels of a block."""
    return F.when(F.size(labels) == 0, "NONE").when(F.size(labels) == 1, F.element_at(labels, 1)).otherwise("MIXED")


def calibrated_label(scores: dict[str, Column], none: Column, margin: Column) -> Column:
    """The best label (ties in the order given) when it beats ``none`` by more than the margin."""
    ranked = F.greatest(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("label")) for i, (k, s) in enumerate(scores.items())])
    return F.when(ranked["s"] - none > margin, ranked["label"]).otherwise("NONE")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)
