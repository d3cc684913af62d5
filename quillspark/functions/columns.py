"""Scalar functions of the engine as Column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L


def words_in(c: Column, words: list[str]) -> Column:
    return c.isin(*words)


def overlaps(tokens: Column, words: list[str]) -> Column:
    """Whether an array has one of the words; false for null."""
    return F.coalesce(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words])), F.lit(False))


def head_key(phrase: Column) -> Column:
    """Last part of a phrase joined by underscores."""
    return F.substring_index(phrase, "_", -1)


def spoken(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def underscored(tokens: Column) -> Column:
    return F.array_join(tokens, "_")


def coarse_pos(pos: Column) -> Column:
    return F.when(F.startswith(pos, F.lit("N")), "N").otherwise("X")


def pos_head(tokens: Column, tags: Column) -> Column:
    """Last token of the first run of noun tags; the last token where there is none."""
    n = F.size(tokens)
    is_noun = F.transform(tags, lambda t: F.startswith(t, F.lit("N")))
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(is_noun, i) & ((i == n) | ~F.coalesce(F.try_element_at(is_noun, i + 1), F.lit(False))))
    return F.when(n > 0, F.try_element_at(tokens, F.coalesce(F.try_element_at(ends, F.lit(1)), n)))


def length_bin(n: Column) -> Column:
    """1 and 2 as they are, 3 to 7 as 4, 8 to 14 as 5, more as 6."""
    return F.when(n <= 2, n).when(n <= 7, 4).when(n <= 14, 5).otherwise(6).cast("int")


def similarity_bin(x: Column) -> Column:
    """Seven levels of a similarity, up to 0.5, 1, 1.5, 2, 2.5 and 3 and above; none counts as 0."""
    x = F.coalesce(x, F.lit(0.0))
    return F.when(x < 0.5, "low").when(x < 1, "lowish").when(x < 1.5, "mid").when(x < 2, "highish").when(x < 2.5, "high").when(x < 3, "higher").otherwise("really_high")


def count_bin(n: Column) -> Column:
    return F.when(n <= 2, n.cast("string")).otherwise("many")


def leacock_chodorow(distance: Column, depth: int) -> Column:
    """-ln((d + 1) / (2 depth)) of a shortest hypernym path of d edges."""
    return -F.log((distance + 1) / F.lit(2.0 * depth))


def determiner_first(tokens: Column) -> Column:
    """Class of the first token, as written: def, indef or no_det."""
    first = F.try_element_at(tokens, F.lit(1))
    return F.when(words_in(first, L.DEFINITE), "def").when(words_in(first, L.INDEFINITE_FIRST), "indef").otherwise("no_det")


def determiner_class(premodifiers: Column) -> Column:
    """poss, pos_pro, def, indef, demon or no_det, whichever comes first in this order."""
    return (
        F.when(overlaps(premodifiers, L.POSSESSIVES), "poss")
        .when(overlaps(premodifiers, L.POSSESSIVE_PRONOUNS), "pos_pro")
        .when(overlaps(premodifiers, L.DEFINITE_ARTICLE), "def")
        .when(overlaps(premodifiers, L.INDEFINITE), "indef")
        .when(overlaps(premodifiers, L.DEMONSTRATIVES), "demon")
        .otherwise("no_det")
    )


def has_preposition(tags: Column) -> Column:
    return F.coalesce(F.array_contains(tags, "IN"), F.lit(False))


def has_definite(tokens: Column) -> Column:
    return F.coalesce(F.exists(tokens, lambda t: F.lower(t).isin(*L.DEFINITE)), F.lit(False))


def premodifiers(tokens: Column, head: Column) -> Column:
    """Tokens before the first occurrence of the head."""
    return F.slice(tokens, F.lit(1), F.greatest(F.array_position(tokens, head).cast("int") - 1, F.lit(0)))


def np_type(head_tag: Column, head: Column) -> Column:
    return (
        F.when(F.startswith(head_tag, F.lit("NNP")), "proper").when(F.startswith(head_tag, F.lit("NN")), "common")
        .when(F.startswith(head_tag, F.lit("PRP")) | head.isin(*L.PRONOUN_HEADS, *L.INDEFINITE_PRONOUNS), "pronoun").otherwise("other")
    )


def np_number(head_tag: Column) -> Column:
    return F.when(head_tag.isin("NNS", "NNPS"), "plural").when(head_tag.isin("NN", "NNP"), "sing").otherwise("other")



def is_year(head: Column) -> Column:
    return F.coalesce(F.rlike(head, F.lit("^[0-9]{4}$")), F.lit(False))


def is_set_element(head: Column, premods: Column) -> Column:
    """By the head as written, or ``each`` or ``one`` before it."""
    return head.isin(*L.SET_ELEMENTS, *L.INDEFINITE, *L.NUMBERS) | overlaps(premods, ["each", "one"])


def acronym(tokens: Column) -> Column:
    """First letters of the capitalised tokens."""
    return F.array_join(F.transform(F.filter(tokens, lambda t: F.rlike(t, F.lit(r"^\p{Lu}"))), lambda t: F.substring(t, 1, 1)), "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where a vector is missing."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def anaphor_slot_first(pattern: Column, anaphor_slot: str = "<Y>") -> Column:
    """Whether the pattern begins with the slot of the anaphor."""
    return F.startswith(pattern, F.lit(anaphor_slot))


def swap_slots(pattern: Column) -> Column:
    """The same pattern with X and Y exchanged, for lists of the other convention."""
    return F.translate(pattern, "XY", "YX")


def slot_words(text: Column, pattern: str) -> tuple[Column, Column]:
    """The words that fill <X> and <Y> where a text matches a pattern; empty where it doesn't."""
    import re

    rx = re.escape(pattern).replace("<X>", r"(\S+)").replace("<Y>", r"(\S+)")
    x, y = (1, 2) if pattern.find("<X>") < pattern.find("<Y>") else (2, 1)
    return F.regexp_extract(text, rx, x), F.regexp_extract(text, rx, y)


def grammatical_role(dep: Column) -> Column:
    """The role by its dependency label: nsubj, dobj, pobj, nsubjpass, pred, other, or na without label."""
    return F.when(dep.isNull(), "na").when(dep.isin("nsubj", "dobj", "pobj", "nsubjpass"), dep).when(dep.isin("oprd", "prd"), "pred").otherwise("other")


def content_words(tokens: Column, tags: Column) -> Column:
    """Tokens whose tag is of a common or proper noun or an adjective."""
    keep = F.zip_with(tokens, tags, lambda w, t: F.when(t.isin(*L.CONTENT_TAGS), w))
    return F.array_compact(keep)
