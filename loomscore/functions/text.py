"""Column functions over dialogue text: white space, surface forms, mentions, templates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def quoted(c: Column) -> Column:
    """A string as a regular expression that matches just it."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def surface_forms(people: Column | str, name: str = "name") -> Column:
    """array<struct<form, eid>> of all people's names and aliases, the longest first, then by the form itself.

    ``people``: array of structs with entity_id, ``name`` and aliases (nulls and empty forms are left out).
    """

    def of(p: Column) -> Column:
        own = F.array_distinct(F.concat(F.array(p[name]), F.coalesce(p["aliases"], F.array().cast("array<string>"))))
        real = F.filter(own, lambda f: f.isNotNull() & (f != ""))
        return F.transform(real, lambda f: F.struct((-F.length(f)).alias("n"), f.alias("form"), p["entity_id"].alias("eid")))

    sorted_ = F.array_sort(F.flatten(F.transform(col(people), of)))
    return F.transform(sorted_, lambda x: F.struct(x["form"].alias("form"), x["eid"].alias("eid")))


def positions(text: Column, form: Column) -> Column:
    """0-based places where ``form`` begins, each search going on after the last hit."""
    pieces = F.split(text, quoted(form), -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(s: Column, piece: Column) -> Column:
        at = s["at"] + F.length(piece)
        return F.struct((at + F.length(form)).alias("at"), F.array_append(s["found"], at).alias("found"))

    return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), zero, step, lambda s: s["found"])


def find_mentions(text: Column | str, forms: Column | str) -> Column:
    """array<struct<pos, eid>>, by place, of the forms found; a form is looked for after all longer ones, and a hit that
    overlaps a taken stretch is passed over."""
    none = F.array().cast("array<struct<pos:int,stop:int,eid:string>>")

    def step(taken: Column, f: Column) -> Column:
        size = F.length(f["form"])
        free = F.filter(positions(col(text), f["form"]), lambda p: ~F.exists(taken, lambda t: (t["pos"] < p + size) & (p < t["stop"])))
        return F.concat(taken, F.transform(free, lambda p: F.struct(p.alias("pos"), (p + size).alias("stop"), f["eid"].alias("eid"))))

    found = F.aggregate(col(forms), none, step)
    return F.array_sort(F.transform(found, lambda t: F.struct(t["pos"].alias("pos"), t["eid"].alias("eid"))))


def last_mention(mentions: Column | str) -> Column:
    return F.try_element_at(col(mentions), F.lit(-1))["eid"]


def mention_count(text: Column, part: Column) -> Column:
    """How often ``part`` occurs without overlap; 0 for an empty part."""
    return F.when(part == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))


def strip_speaker_labels(text: Column, labels: Column) -> Column:
    """Lines of ``text`` without a leading "label: "; of several that fit, the longest goes."""
    by_length = F.transform(F.array_sort(F.transform(F.filter(labels, lambda x: x.isNotNull() & (x != "")), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])

    def line(x: Column) -> Column:
        fits = F.try_element_at(F.filter(by_length, lambda n: x.startswith(F.concat(n, F.lit(": ")))), F.lit(1))
        return F.when(fits.isNotNull(), F.substring(x, F.length(fits) + 3, F.length(x))).otherwise(x)

    return F.transform(F.split(text, "\n"), line)


def render_template(template: str, slots: Sequence[str], values: Mapping[str, Column]) -> Column:
    """``{slot}`` replaced one slot after another, so a value may bring in a later slot."""
    if not template.strip():
        raise ValueError("the template is empty")
    missing = [s for s in slots if s not in values]
    if missing:
        raise KeyError(f"no value for slots {missing}")
    out: Column = F.lit(template)
    for slot in slots:
        out = F.replace(out, F.lit("{" + slot + "}"), F.coalesce(values[slot].cast("string"), F.lit("")))
    return out


def format_candidates(candidates: Column | str) -> Column:
    """"id: label" lines; an id alone where there is no label."""
    return F.array_join(F.transform(col(candidates), lambda c: F.when(F.coalesce(c["label"], F.lit("")) != "", F.concat(c["entity_id"], F.lit(": "), c["label"])).otherwise(c["entity_id"])), "\n")


def label_of(value: Column) -> Column:
    """A group's name: "None", "True", "False" for null and booleans, else the value as a string."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def label_of_boolean(value: Column) -> Column:
    return F.when(value, "True").when(~value, "False").otherwise("None")


def keyed_order(seed: int | str, *keys: Column | str) -> Column:
    """A hash that puts rows into a seeded order that is the same everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(col(k).cast("string") for k in keys)))
