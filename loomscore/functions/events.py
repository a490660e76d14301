"""Answers of command line services as columns: one result object, or lines of events.

Both give a struct like an attempt's (``plans.runner.ATTEMPT``): outcome
(answered, transient, permanent), error, raw_text, tokens and names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, col, strip

# What an error's text must hold to be worth another attempt, for result objects and for events.
PASSING = ("rate", "overloaded", "timeout", "network", "529", "503")
PASSING_EVENTS = ("rate", "timeout", "network", "overloaded", "429", "503", "502")

FIELDS = {
    "raw_text": "string", "input_tokens": "long", "output_tokens": "long", "cache_read_input_tokens": "long", "reasoning_output_tokens": "long",
    "finish_reason": "string", "response_model": "string", "request_id": "string", "cost_usd": "double", "num_turns": "long",
}
RESULT = (
    "is_error boolean, result string, terminal_reason string, stop_reason string, session_id string, total_cost_usd double, num_turns long, usage struct<input_tokens:long,output_tokens:long>, "
    "modelUsage map<string,struct<canonicalModel:string,inputTokens:long,outputTokens:long,cacheReadInputTokens:long,cacheCreationInputTokens:long>>"
)
EVENT = "type string, thread_id string, message string, item struct<type:string,text:string>, usage struct<input_tokens:long,output_tokens:long,cached_input_tokens:long,reasoning_output_tokens:long>"


def holds(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))


def folded(outcome: Column, error: Column, **found: Column) -> Column:
    """The struct; what was found counts with an answer only."""
    parts = [(F.when(outcome == "answered", found[n]) if n in found else F.lit(None)).cast(k).alias(n) for n, k in FIELDS.items()]
    return F.struct(outcome.alias("outcome"), F.when(outcome != "answered", error).alias("error"), *parts)


def last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def is_json(body: Column) -> Column:
    """Whether a text is one JSON value; the parser by itself takes a value with anything after it."""
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    return F.coalesce(F.size(alone) == 1, F.lit(False))


def result_object(text: Column | str) -> Column:
    """The JSON object that begins at a text's first brace; the last model of its usage counts."""
    text = col(text)
    at = F.instr(text, "{")
    body = F.when(at > 0, F.substring(text, at, F.length(text)))
    read = F.when(is_json(body), F.from_json(body, RESULT))

    def fold(r: Column) -> Column:
        model = last(F.map_entries(r["modelUsage"]))
        own = model["value"]
        said = F.coalesce(F.nullif(r["result"], F.lit("")), F.nullif(r["terminal_reason"], F.lit("")), F.lit("unknown error"))
        wrong = F.coalesce(r["is_error"], F.lit(False))
        passing = ~holds(said, ("not logged in", "login")) & holds(said, PASSING)
        outcome = F.when(r.isNull(), "transient").when(wrong & passing, "transient").when(wrong, "permanent").otherwise("answered")
        error = F.when(r.isNull(), F.concat(F.lit("no json: "), F.right(text, F.lit(200)))).otherwise(said)
        tokens = sum((F.coalesce(own[f], F.lit(0)) for f in ("inputTokens", "cacheReadInputTokens", "cacheCreationInputTokens")), F.lit(0))
        return folded(
            outcome, error, raw_text=F.coalesce(r["result"], F.lit("null")), input_tokens=F.when(model.isNotNull(), tokens).otherwise(r["usage"]["input_tokens"]),
            output_tokens=F.when(model.isNotNull(), own["outputTokens"]).otherwise(r["usage"]["output_tokens"]), finish_reason=r["stop_reason"],
            response_model=F.coalesce(own["canonicalModel"], model["key"]), request_id=r["session_id"], cost_usd=r["total_cost_usd"], num_turns=r["num_turns"],
        )

    return bound(read, fold)


def event_lines(text: Column | str) -> Column:
    """A line an event, others skipped: the last message is the answer, the last usage and thread count, an error only without a message."""
    text = col(text)
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), strip), lambda x: x.startswith("{") & is_json(x))
    events = F.transform(lines, lambda x: F.struct(F.from_json(x, EVENT).alias("e"), x.alias("line")))

    def fold(all_: Column) -> Column:
        def those(*kinds: str) -> Column:
            return F.filter(all_, lambda x: x["e"]["type"].isin(*kinds))

        message = last(F.filter(those("item.completed"), lambda x: x["e"]["item"]["type"] == "agent_message"))["e"]["item"]["text"]
        failed = last(those("error", "turn.failed"))
        said = F.coalesce(F.nullif(failed["e"]["message"], F.lit("")), F.left(failed["line"], F.lit(300)))
        usage = last(those("turn.completed"))["e"]["usage"]
        outcome = F.when(message.isNotNull(), "answered").when(said.isNull() | holds(said, PASSING_EVENTS), "transient").otherwise("permanent")
        error = F.coalesce(said, F.concat(F.lit("no message: "), F.right(text, F.lit(200))))
        return folded(
            outcome, error, raw_text=message, input_tokens=usage["input_tokens"], output_tokens=usage["output_tokens"], cache_read_input_tokens=usage["cached_input_tokens"],
            reasoning_output_tokens=usage["reasoning_output_tokens"], finish_reason=F.when(usage.isNotNull(), "turn.completed"), request_id=last(those("thread.started"))["e"]["thread_id"],
        )

    return bound(events, fold)
