"""Zones to ids: pluggable tokenizers as Column functions, begin and end ids, the pad id, and what follows from the lengths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lenforge.functions import lengths as L


@dataclass(frozen=True)
class Tokenizer:
    """``encode`` maps a text column to ARRAY<INT>, without special ids. A tokenizer without a pad id pads with its end id."""

    name: str
    encode: Callable[[Column], Column]
    vocab_size: int
    bos_id: int
    eos_id: int
    pad_id: int | None = None

    @property
    def padding(self) -> int:
        return self.eos_id if self.pad_id is None else self.pad_id


def word_ids(text: Column, vocab: int = 50_000) -> Column:
    """The default: runs without white space, each with an id from 3 on that follows from its md5, the same in any engine."""
    code = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long")
    return F.transform(F.regexp_extract_all(text, F.lit(L.WORD), 1), lambda w: (code(w) % (vocab - 3) + 3).cast("int"))


WORDS = Tokenizer("words", word_ids, 50_000, 1, 2, 0)


def from_file(path: str, bos_id: int | None = None, eos_id: int | None = None, pad_id: int | None = None) -> Tokenizer:
    """A tokenizer.json of a public tokenizer, through the ``tokenizers`` library, in Arrow batches; the file's text travels with the plan."""
    import pandas as pd
    from tokenizers import Tokenizer as Library

    with open(path, encoding="utf-8") as f:
        text = f.read()
    kept: list[Library] = []

    @F.pandas_udf("array<int>")
    def encode(col: pd.Series) -> pd.Series:
        if not kept:
            kept.append(Library.from_str(text))
            kept[0].encode_special_tokens = True
        return pd.Series([e.ids for e in kept[0].encode_batch(col.fillna("").tolist(), add_special_tokens=False)])

    size = Library.from_str(text).get_vocab_size()
    end = size - 1 if eos_id is None else eos_id
    return Tokenizer(path, encode, size, end if bos_id is None else bos_id, end, pad_id)


def by_name(name: str) -> Tokenizer:
    return WORDS if name == "words" else from_file(name)


def rendered() -> dict[str, Column]:
    """The text of each zone with its prefix; a blank context has none."""
    ctx = F.coalesce("context", F.lit(""))
    blank = F.length(F.regexp_replace(ctx, r"(?U)\s+", "")) == 0
    return {
        "prompt": F.concat(F.lit(L.PREFIXES["instruction"]), F.coalesce("instruction", F.lit(""))),
        "context": F.when(blank, F.lit("")).otherwise(F.concat(F.lit(L.PREFIXES["context"]), ctx)),
        "response": F.concat(F.lit(L.PREFIXES["response"]), F.coalesce("response", F.lit(""))),
    }


def encode_zones(rows: DataFrame, tok: Tokenizer = WORDS, add_bos: bool = True, add_eos: bool = True) -> DataFrame:
    """Adds prompt_ids, context_ids and response_ids with their lengths; zones are encoded one by one."""
    z = rendered()
    ids = {k: tok.encode(v) for k, v in z.items()}
    one = lambda i: F.array(F.lit(i))
    prompt = F.concat(one(tok.bos_id), ids["prompt"]) if add_bos else ids["prompt"]
    response = F.concat(ids["response"], one(tok.eos_id)) if add_eos else ids["response"]
    context = F.when(F.length(z["context"]) == 0, F.array().cast("array<int>")).otherwise(ids["context"])
    out = rows.withColumns({"prompt_ids": prompt, "context_ids": context, "response_ids": response})
    out = out.withColumns({f"{k}_len": F.size(f"{k}_ids") for k in ("prompt", "context", "response")})
    return out.withColumn("total_len", F.col("prompt_len") + F.col("context_len") + F.col("response_len"))


def classified(rows: DataFrame, limit: int, short_max: int, medium_max: int) -> DataFrame:
    """Adds case_code, is_chunked, chunk_bounds, num_chunk_bounds and the build's band to rows with lengths."""
    case = L.case_code(F.col("prompt_len"), F.col("context_len"), F.col("response_len"), limit)
    out = rows.withColumns({"case_code": case, "chunk_bounds": L.chunk_bounds(F.col("total_len"), limit)})
    out = out.withColumns({"is_chunked": (F.col("case_code") > 0).cast("int"), "num_chunk_bounds": F.size("chunk_bounds")})
    return out.withColumn("band", L.band_offline(F.col("total_len"), F.col("is_chunked") == 1, short_max, medium_max))
