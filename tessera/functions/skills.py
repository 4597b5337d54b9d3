"""Skills in tags and free text. Dictionaries, patterns and groups are the caller's, as plain dicts."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..operators.relational import first_seen
from .text import strip

_NONE = "array<string>"
#: Codegen limits make long alternations better in parts.
CHUNK = 40


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]) if pairs else F.create_map().cast("map<string,string>")


def split_tags(c: Column) -> Column:
    """Tags of 2 to 60 characters from text separated by commas, semicolons, bars, bullets or lines."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;|•\n]"), lambda t: strip(t))
    return F.filter(parts, lambda t: F.length(t).between(2, 60))


def classify_tags(tags: Column, dictionary: dict[str, str], junk: str) -> Column:
    """struct(skills, others): dictionary hits as their canonical names; other tags unless they match the junk pattern."""
    known = _map(dictionary)
    skills = F.filter(F.transform(tags, lambda t: known[F.lower(t)]), lambda s: s.isNotNull())
    others = F.filter(tags, lambda t: known[F.lower(t)].isNull() & ~t.rlike(f"(?iU){junk}"))
    return F.struct(first_seen(skills).alias("skills"), first_seen(others).alias("others"))


def skill_pattern(key: str) -> str:
    """A skill's name as a word of its own, whatever signs it ends with."""
    return rf"(?<![\w+#.]){re.escape(key)}(?![\w+#])"


def scan_text(c: Column, dictionary: dict[str, str], ambiguous: frozenset[str] = frozenset()) -> Column:
    """Canonical names of the dictionary's skills that the text holds, in the dictionary's order. Ambiguous keys are not looked for."""
    text = F.lower(F.coalesce(c, F.lit("")))
    keys = [k for k in dictionary if k not in ambiguous]
    parts = []
    for i in range(0, len(keys), CHUNK):
        own = keys[i : i + CHUNK]
        any_of = "|".join(skill_pattern(k) for k in own)
        hits = F.array(*[F.when(text.rlike(f"(?U){skill_pattern(k)}"), dictionary[k]) for k in own])
        parts.append(F.when(text.rlike(f"(?U){any_of}"), F.filter(hits, lambda h: h.isNotNull())).otherwise(F.array().cast(_NONE)))
    return first_seen(F.concat(*parts)) if parts else F.array().cast(_NONE)


def skills_and_tags(tags: Column, text: Column, dictionary: dict[str, str], junk: str, ambiguous: frozenset[str] = frozenset()) -> Column:
    found = classify_tags(split_tags(tags), dictionary, junk)
    return F.struct(first_seen(F.concat(found["skills"], scan_text(text, dictionary, ambiguous))).alias("skills"), found["others"].alias("tags"))


def normalize_names(names: Column, dictionary: dict[str, str]) -> Column:
    known = _map(dictionary)
    return F.transform(F.filter(F.coalesce(names, F.array().cast(_NONE)), lambda n: strip(n) != ""), lambda n: F.coalesce(known[F.lower(strip(n))], strip(n)))


def normalize_skill_name(c: Column, dictionary: dict[str, str], excluded: str) -> Column:
    """The canonical name; null for excluded text; other short ASCII names, capitalised up to 15 characters."""
    s = strip(c)
    other = F.when((F.length(s) <= 30) & s.rlike(r"^[\x20-\x7e]+$"), F.when(F.length(s) <= 15, F.initcap(s)).otherwise(s))
    return F.when((s == "") | s.rlike(f"(?iU){excluded}"), None).otherwise(F.coalesce(_map(dictionary)[F.lower(s)], other))


def preferred_skills(raw: Column, text: Column, required: Column, dictionary: dict[str, str]) -> Column:
    """From the raw list if there is one, else from the sentence after words of preference; required ones are left out."""
    listed = normalize_names(F.split(raw, ","), dictionary)
    sentence = F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), r"(?:ưu tiên|điểm cộng|nice to have|plus|yêu cầu khác)[\s:]*([^.\n]+)", 1)
    wanted = F.transform(F.coalesce(required, F.array().cast(_NONE)), F.lower)
    found = F.filter(scan_text(sentence, dictionary), lambda s: ~F.array_contains(wanted, F.lower(s)))
    return F.when(F.coalesce(strip(raw), F.lit("")) != "", listed).otherwise(found)


#: Words of preference, within 30 characters before and 60 after a skill.
PREFERENCE = ("ưu tiên", "điểm cộng", "lợi thế", "là một lợi thế", "nice to have", "preferred", "plus", "advantage", "bonus", "good to have")


def is_preferred(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(PREFERENCE))


def layered_evidence(skill: Column, pattern: Column, required: Column, preferred: Column, title: Column, requirements: Column, duties: Column) -> Column:
    """struct(type, method, confidence, evidence) by the first layer that holds the skill, or null.

    Layers: required tag 1.000, preferred tag 1.000, title .950, requirements
    .900 (preferred if a word of preference is near), duties .800. ``pattern``
    is the skill's regular expression, without case.
    """

    def layer(kind, method, confidence, evidence):
        return F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), F.lit(method).alias("method"), F.lit(confidence).cast("decimal(4,3)").alias("confidence"), F.substring(evidence, 1, 255).alias("evidence"))

    def tagged(tags):
        return F.exists(F.coalesce(tags, F.array().cast(_NONE)), lambda t: F.lower(t) == F.lower(skill))

    def window(c):
        at = F.regexp_instr(c, pattern)
        return F.substring(c, F.greatest(at - 30, F.lit(1)), F.least(at - 1, F.lit(30)) + 60)

    title, requirements, duties = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, requirements, duties))
    near = window(requirements)
    return (
        F.when(tagged(required), layer("required", "tag", "1.000", skill))
        .when(tagged(preferred), layer("preferred", "tag", "1.000", skill))
        .when(F.rlike(title, pattern), layer("required", "title", "0.950", title))
        .when(F.rlike(requirements, pattern), layer(F.when(is_preferred(near), "preferred").otherwise("required"), "requirements", "0.900", near))
        .when(F.rlike(duties, pattern), layer("required", "responsibilities", "0.800", window(duties)))
    )


def related_map(groups: list[list[str]]) -> dict[str, list[str]]:
    """For each lower-case skill the others of its groups."""
    out: dict[str, set[str]] = {}
    for group in groups:
        names = {g.lower() for g in group}
        for n in names:
            out.setdefault(n, set()).update(names - {n})
    return {k: sorted(v) for k, v in sorted(out.items())}


def split_match(user: Column, job: Column, groups: list[list[str]] = ()) -> Column:
    """struct(exact, related, missing) of the job's skills, in its order, as lower case."""
    own = F.transform(F.coalesce(user, F.array().cast(_NONE)), F.lower)
    wanted = F.array_distinct(F.transform(F.coalesce(job, F.array().cast(_NONE)), F.lower))
    related = related_map(groups)
    table = F.create_map(*[x for k, v in related.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if related else F.create_map().cast("map<string,array<string>>")
    exact = F.filter(wanted, lambda s: F.array_contains(own, s))
    left = F.filter(wanted, lambda s: ~F.array_contains(own, s))
    near = F.filter(left, lambda s: F.coalesce(F.arrays_overlap(table[s], own), F.lit(False)))
    return F.struct(exact.alias("exact"), near.alias("related"), F.array_except(left, near).alias("missing"))
