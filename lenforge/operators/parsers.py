"""Zone parsers: raw records of each format to (dataset, instruction, context, response)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lenforge.session import strip

#: Names of chat roles; other roles are kept as they are.
ROLES = {"user": "user", "human": "user", "prompter": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant", "system": "system"}


def filled(*cols: Column) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.when(F.length(c) > 0, c) for c in cols), F.lit(""))


def role(col: Column) -> Column:
    low = F.lower(col)
    out = low
    for name, norm in ROLES.items():
        if name != norm:
            out = F.when(low == name, norm).otherwise(out)
    return out


def alpaca(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(*keep, strip(filled(F.col("instruction"))).alias("instruction"), strip(filled(F.col("input"))).alias("context"), strip(filled(F.col("output"), F.col("response"))).alias("response"))


def pair(rows: DataFrame, prompt: str, response: str, context: str | None, keep: tuple[str, ...] = ()) -> DataFrame:
    get = lambda c: strip(filled(F.col(c))) if c and c in rows.columns else F.lit("")
    return rows.select(*keep, get(prompt).alias("instruction"), get(context).alias("context"), get(response).alias("response"))


def turns(rows: DataFrame) -> Column:
    """The first non-empty list of turns, as structs of role and content."""
    lists = [F.when(F.size(c) > 0, F.col(c)) for c in ("conversations", "messages") if c in rows.columns]
    return F.transform(F.coalesce(*lists), lambda t: F.struct(role(filled(t["role"], t["from"])).alias("role"), strip(filled(t["content"], t["value"])).alias("content")))


def chat(rows: DataFrame, turn_list: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The last answer, the nearest user turn before it, and the turns before that one as context."""
    text, none = F.lit(""), F.lit(None).cast("string")
    start = F.struct(text.alias("before"), none.alias("asked"), text.alias("asked_after"), none.alias("instruction"), text.alias("context"), none.alias("response"))

    def step(s: Column, t: Column) -> Column:
        user, answer = t["role"] == "user", (t["role"] == "assistant") & s["asked"].isNotNull()
        line = F.concat(t["role"], F.lit(": "), t["content"])
        longer = F.when(F.length(t["content"]) == 0, s["before"]).when(s["before"] == "", line).otherwise(F.concat(s["before"], F.lit("\n"), line))
        pick = lambda cond, new, old: F.when(cond, new).otherwise(s[old]).alias(old)
        return F.struct(
            longer.alias("before"), pick(user, t["content"], "asked"), pick(user, s["before"], "asked_after"), pick(answer, s["asked"], "instruction"), pick(answer, s["asked_after"], "context"), pick(answer, t["content"], "response")
        )

    # One pass over the turns; the generator keeps the optimizer from copying it into every filter and column above.
    folded = F.aggregate(turns(rows) if turn_list is None else turn_list, start, step)
    at = rows.select(*keep, F.explode(F.array(folded)).alias("_s")).where("_s.response IS NOT NULL")
    return at.select(*keep, "_s.instruction", "_s.context", "_s.response")


VALID = "length(instruction) > 0 AND length(response) > 0"


def parse(rows: DataFrame, fmt: str, dataset: str, prompt: str = "inputs", response: str = "targets", context: str | None = None) -> DataFrame:
    if fmt == "alpaca":
        out = alpaca(rows)
    elif fmt == "chat":
        out = chat(rows)
    elif fmt == "pair":
        out = pair(rows, prompt, response, context)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return out.where(VALID).select(F.lit(dataset).alias("dataset"), "instruction", "context", "response")


def source_stats(rows: DataFrame, parsed_valid: Column, by: str = "dataset") -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_read"), F.count_if(parsed_valid).alias("n_kept"))
