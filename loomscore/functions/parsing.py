"""Column functions that read model answers: structured and free choices, aliases, judgements.

Each returns a struct with predicted_entity_id, parse_status (ok, invalid,
abstain, missing, unmapped) and note.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, col, quoted, strip

# Words and patterns that results depend on.
ABSTAIN_VALUES = ("abstain", "unknown", "none", "null", "")
ABSTAIN_PATTERNS = ("알 수 없", "판단할 수 없", "확인할 수 없", "모르겠", "특정할 수 없", "cannot determine", "not enough")
SPEAKER_PRONOUNS = ("화자", "말하는 사람", "발화자", "나", "내가", "저", "제가", "본인")
ADDRESSEE_PRONOUNS = ("청자", "듣는 사람", "상대방", "상대", "너", "네가", "당신", "그쪽")
AMBIGUITY = ("unambiguous", "ambiguous", "uncertain")


def outcome(predicted: Column | None, status: str, note: str) -> Column:
    who = F.lit(None).cast("string") if predicted is None else predicted
    return F.struct(who.alias("predicted_entity_id"), F.lit(status).alias("parse_status"), F.lit(note).alias("note"))


def longest_first(strings: Column) -> Column:
    """Stable by falling length."""
    keyed = F.transform(strings, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def ids_in(text: Column, ids: Column) -> Column:
    """The ids that stand in ``text`` between ASCII word boundaries; what one id took no shorter one finds.

    Ids of word characters only, as neutral ones are, are looked up among the
    text's words; others need a pattern of their own.
    """
    words = F.array_intersect(ids, F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    return F.when(F.forall(ids, lambda i: F.regexp_like(i, F.lit("^[A-Za-z0-9_]+$"))), words).otherwise(ids_by_pattern(text, ids))


def ids_by_pattern(text: Column, ids: Column) -> Column:
    zero = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, i: Column) -> Column:
        pattern = F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted(i), F.lit("(?![A-Za-z0-9_])"))
        hit = F.regexp_like(s["rest"], pattern)
        return F.struct(F.when(hit, F.regexp_replace(s["rest"], pattern, F.lit(" "))).otherwise(s["rest"]).alias("rest"), F.when(hit, F.array_append(s["found"], i)).otherwise(s["found"]).alias("found"))

    return F.aggregate(longest_first(ids), zero, step, lambda s: s["found"])


def json_object(text: Column) -> Column:
    """The text from the first "{" to the last "}", of the fenced block if there is one; null if there is none."""

    def within(body: Column) -> Column:
        start, stop = F.instr(body, "{"), F.length(body) - F.instr(F.reverse(body), "}") + 1
        return F.when((start > 0) & (F.instr(body, "}") > 0) & (stop > start), F.substring(body, start, stop - start + 1))

    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return bound(fenced, lambda f: bound(F.when(f != "", f).otherwise(text), within))


def abstains(text: Column) -> Column:
    return F.exists(F.array(*map(F.lit, ABSTAIN_PATTERNS)), lambda p: text.contains(p))


def parse_free(raw: Column | str, ids: Column | str) -> Column:
    raw, ids = col(raw), col(ids)

    def read(text: Column, found: Column) -> Column:
        return (
            F.when(raw.isNull(), outcome(None, "missing", "no response"))
            .when(text == "", outcome(None, "invalid", "empty"))
            .when(F.size(found) == 1, outcome(F.try_element_at(found, F.lit(1)), "ok", ""))
            .when(F.size(found) > 1, outcome(None, "invalid", "multiple ids"))
            .when(abstains(text), outcome(None, "abstain", "abstain pattern"))
            .otherwise(outcome(None, "invalid", "no candidate id"))
        )

    return bound(strip(raw), lambda text: bound(ids_in(text, ids), lambda found: read(text, found)))


def parse_structured(raw: Column | str, ids: Column | str, field: str = "entity_id") -> Column:
    """Reads ``field`` of the JSON object in an answer; a repeated key counts by its last value."""
    raw, ids = col(raw), col(ids)

    def kind(body: Column, value: Column) -> Column:
        # only a value that looks like an array is parsed a second time, to tell it from a string that does
        return F.when(value.startswith("["), F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant")))

    def of_value(text: Column, body: Column, bad: Column, value: Column) -> Column:
        return (
            F.when(raw.isNull(), outcome(None, "missing", "no response"))
            .when(text == "", outcome(None, "invalid", "empty"))
            .when(body.isNull() | bad.isNotNull(), outcome(None, "invalid", "json error"))
            .when(value.isNull() | F.lower(value).isin(*ABSTAIN_VALUES), outcome(None, "abstain", "abstain value"))
            .when(kind(body, value).startswith("ARRAY"), outcome(None, "invalid", "multiple ids"))
            .when(F.array_contains(ids, value), outcome(value, "ok", ""))
            .otherwise(outcome(None, "invalid", "id not in candidates"))
        )

    def of_body(text: Column, body: Column) -> Column:
        read = F.from_json(body, f"`{field}` string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        return bound(read, lambda r: bound(strip(r[field]), lambda value: of_value(text, body, r["_bad"], value)))

    return bound(strip(raw), lambda text: bound(json_object(text), lambda body: of_body(text, body)))


def alias_entries(roster: Column, speaker_label: Column, addressee_label: Column | None = None) -> Column:
    """array<struct<alias, eid>>: ids, labels and aliases, of which later ones win; then pronouns, which win over none.

    Without ``addressee_label``, or where it is null, the other of the labels A
    and B is the addressee's.
    """
    plain = F.flatten(
        F.transform(roster, lambda p: F.transform(F.concat(F.array(p["entity_id"], p["label"]), F.coalesce(p["aliases"], F.array().cast("array<string>"))), lambda a: F.struct(a.alias("alias"), p["entity_id"].alias("eid"))))
    )

    def owner(label: Column) -> Column:
        return F.try_element_at(F.filter(roster, lambda p: p["label"] == label), F.lit(-1))["entity_id"]

    other = F.when(speaker_label == "A", "B").otherwise("A")
    if addressee_label is not None:
        other = F.coalesce(addressee_label, other)

    def pronouns(words: tuple[str, ...], eid: Column) -> Column:
        none = F.array().cast("array<struct<alias:string,eid:string>>")
        return bound(eid, lambda who: F.when(who.isNull(), none).otherwise(F.transform(F.array(*map(F.lit, words)), lambda w: F.struct(w.alias("alias"), who.alias("eid")))))

    def last_of_each(ranked: Column) -> Column:
        backwards = F.reverse(F.transform(ranked, lambda e: e["alias"]))
        return bound(backwards, lambda names: F.filter(ranked, lambda e, i: F.array_position(names, e["alias"]) == F.size(names) - i))

    said = F.concat(pronouns(ADDRESSEE_PRONOUNS, owner(other)), pronouns(SPEAKER_PRONOUNS, owner(speaker_label)))
    return bound(F.concat(said, F.filter(plain, lambda e: F.coalesce(e["alias"], F.lit("")) != "")), last_of_each)


def entities_in(text: Column, entries: Column) -> Column:
    """The entities whose aliases ``text`` has, longer aliases first, each taken out of it."""
    # where an alias is taken out a space is left, so one that the text itself lacks comes about only if it has a space
    some = F.filter(entries, lambda e: text.contains(e["alias"]) | e["alias"].contains(" "))
    by_length = F.transform(F.array_sort(F.transform(some, lambda e, i: F.struct((-F.length(e["alias"])).alias("n"), i.alias("i"), e.alias("e")))), lambda s: s["e"])
    zero = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("eids"))

    def step(s: Column, e: Column) -> Column:
        hit = s["rest"].contains(e["alias"])
        return F.struct(F.when(hit, F.replace(s["rest"], e["alias"], F.lit(" "))).otherwise(s["rest"]).alias("rest"), F.when(hit, F.array_append(s["eids"], e["eid"])).otherwise(s["eids"]).alias("eids"))

    return F.array_distinct(F.aggregate(by_length, zero, step, lambda s: s["eids"]))


def parse_by_alias(raw: Column | str, entries: Column) -> Column:
    """The one entity whose aliases an answer has; longer aliases first, each taken out of the text."""
    raw = col(raw)

    def of_entities(eids: Column) -> Column:
        return (
            F.when(F.size(eids) == 1, outcome(F.try_element_at(eids, F.lit(1)), "ok", ""))
            .when(F.size(eids) == 0, outcome(None, "unmapped", "no alias matched"))
            .otherwise(outcome(None, "unmapped", "multiple entities"))
        )

    def read(text: Column) -> Column:
        return (
            F.when(raw.isNull(), outcome(None, "missing", "no response"))
            .when(text == "", outcome(None, "invalid", "empty"))
            .when(abstains(text), outcome(None, "abstain", "abstain pattern"))
            .otherwise(bound(entities_in(text, entries), of_entities))
        )

    return bound(strip(raw), read)


def parse_judgement(raw: Column | str, ids: Column | str, condition: Column | str = "condition") -> Column:
    """A reviewer's JSON as a struct of judgements.

    Values outside their domains become empty; a referent counts only with
    "unambiguous", naturalness and addressee only under condition "full".
    Notes are cut at 300 characters; without an object they hold
    "(unparsable)" and the answer's first 120.
    """
    raw, ids, full = col(raw), col(ids), col(condition) == "full"
    body = json_object(strip(raw))
    names = ("referent_id", "addressee_id", "context_sufficient", "ambiguity", "naturalness_1to5", "notes")
    read = F.from_json(body, ", ".join(f"{n} string" for n in names) + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    empty = body.isNull() | read["_bad"].isNotNull() | F.regexp_like(body, F.lit(r"^\{\s*\}$"))

    def one_of(field: str, domain: Column, when: Column, low: bool = False) -> Column:
        value = F.coalesce(strip(read[field]), F.lit(""))
        value = F.lower(value) if low else value
        return F.when(~empty & when & F.array_contains(domain, value), value).otherwise("").alias(field)

    def words(*w: str) -> Column:
        return F.array(*map(F.lit, w))

    sure = F.lower(F.coalesce(strip(read["ambiguity"]), F.lit(""))) == "unambiguous"
    notes = F.when(F.coalesce(raw, F.lit("")) == "", "(no response)").when(empty, F.concat(F.lit("(unparsable) "), F.replace(F.left(raw, F.lit(120)), F.lit("\n"), F.lit(" ")))).otherwise(F.left(F.coalesce(read["notes"], F.lit("")), F.lit(300)))
    always = F.lit(True)
    return F.struct(
        one_of("referent_id", ids, sure), one_of("addressee_id", ids, full), one_of("context_sufficient", words("yes", "no"), always, True), one_of("ambiguity", words(*AMBIGUITY), always, True),
        one_of("naturalness_1to5", words("1", "2", "3", "4", "5"), full), notes.alias("notes"),
    )


def pair_sides(pair_id: Column | str, lenient: bool = False) -> tuple[Column, Column]:
    """Base and variant of "scenario:a~b"; malformed ids give nulls, or with ``lenient`` what there is."""
    p = col(pair_id)
    names = F.when(p.contains(":"), F.substring(p, F.instr(p, ":") + 1, F.length(p))).otherwise(p)
    a = F.when(names.contains("~"), F.substring(names, F.lit(1), F.instr(names, "~") - 1)).otherwise(names)
    b = F.when(names.contains("~"), F.substring(names, F.instr(names, "~") + 1, F.length(names))).otherwise("")
    if lenient:
        return a, b
    whole = p.contains(":") & p.contains("~")
    return F.when(whole, a), F.when(whole, b)
