"""Column functions on zones, lengths, bands, padding and cost."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each zone begins with.
PREFIXES = {"instruction": "### Instruction: ", "context": "\n### Input: ", "response": "\n### Response: "}
WORD = r"([^ \t\n\r\f]+)"
CASES = {0: "FIT", 1: "LONG_CTX", 2: "LONG_RESP", 3: "MIXED"}
BANDS = {0: "SHORT", 1: "MEDIUM", 2: "LONG", 3: "CHUNKED"}
MAX_BANDS = 8


def n_words(text: Column) -> Column:
    """The default tokenizer's count: runs without white space. Any other Column function of a text may take its place."""
    return F.regexp_count(text, F.lit(WORD))


def zone_lengths(add_bos: bool = True, add_eos: bool = True, tokenizer: Callable[[Column], Column] = n_words) -> dict[str, Column]:
    """prompt_len, context_len and response_len; zones are tokenized one by one."""
    ctx = F.coalesce("context", F.lit(""))
    return {
        "prompt_len": tokenizer(F.concat(F.lit(PREFIXES["instruction"]), "instruction")) + int(add_bos),
        "context_len": F.when(F.length(F.regexp_replace(ctx, r"(?U)\s+", "")) > 0, tokenizer(F.concat(F.lit(PREFIXES["context"]), ctx))).otherwise(0),
        "response_len": tokenizer(F.concat(F.lit(PREFIXES["response"]), "response")) + int(add_eos),
    }


def case_code(prompt: Column, context: Column, response: Column, limit: int) -> Column:
    half = limit // 2
    long_ctx, long_resp = prompt + context > half, response > half
    return F.when(prompt + context + response <= limit, 0).when(long_ctx & long_resp, 3).when(long_resp, 2).otherwise(1)


def chunk_bounds(total: Column, limit: int) -> Column:
    """limit, 2·limit, … below the total."""
    return F.when(total > limit, F.sequence(F.lit(limit), (total - 1).cast("int"), F.lit(limit))).otherwise(F.array().cast("array<int>"))


def band_offline(total: Column, chunked: Column, short_max: int, medium_max: int) -> Column:
    return F.when(chunked, 3).when(total < short_max, 0).when(total < medium_max, 1).otherwise(2)


def n_bands(cutoffs: Sequence[int]) -> int:
    n = len(cutoffs) + 2
    if n > MAX_BANDS:
        raise ValueError(f"{n} bands; at most {MAX_BANDS}")
    if list(cutoffs) != sorted(cutoffs):
        raise ValueError("cutoffs must rise")
    return n


def band_at_load(total: Column, chunked: Column, cutoffs: Sequence[int], limit: int) -> Column:
    """Cutoffs are exclusive upper bounds; chunked or over-long rows go to the last band."""
    nb = n_bands(cutoffs)
    out = F.when(chunked | (total > limit), nb - 1)
    for i, c in enumerate(cutoffs):
        out = out.when(total < c, i)
    return out.otherwise(nb - 2)


def round_up(x: Column, m: int) -> Column:
    return F.ceil(x / F.lit(m)).cast("long") * m if m > 1 else x.cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def padding_pct(pad: Column, padded: Column) -> Column:
    return 100.0 * ratio(pad, padded)


def proxy_cost(padded: Column, alpha: float = 1.0, beta: float = 0.0, gamma: float = 0.0) -> Column:
    cost = alpha * padded + F.lit(beta)
    return cost + gamma * padded * padded if gamma else cost


def step_seconds(rows: Column, width: Column, a: Column | float, c: Column | float, d: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return lit(d) + lit(a) * rows * width + lit(c) * rows * width * width


def window_real(prompt: Column, total: Column, budget: int, width: int) -> Column:
    """Ids a chunked row keeps: the whole prompt, then context and response up to the budget, cut at the width."""
    return F.when(prompt >= budget, F.least(prompt, F.lit(width))).otherwise(F.least(total, F.lit(budget)))


def window_loss(prompt: Column, context: Column, total: Column, budget: int) -> Column:
    return F.when(prompt >= budget, 0).otherwise(F.greatest(F.lit(0), F.least(total, F.lit(budget)) - prompt - context))


def padded_ids(ids: Column, width: Column, pad_id: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), (width - F.size(ids)).cast("int")))


def attention_mask(n: Column, width: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), n.cast("int")), F.array_repeat(F.lit(0), (width - n).cast("int")))


def labels(prompt_ctx: Column, response: Column, width: Column, ignore: int = -100) -> Column:
    rest = width - prompt_ctx - F.size(response)
    return F.concat(F.array_repeat(F.lit(ignore), prompt_ctx.cast("int")), response, F.array_repeat(F.lit(ignore), rest.cast("int")))
