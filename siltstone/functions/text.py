"""Text functions as column expressions; arrays and strings only, so they stay inside generated code."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: One ideograph, or a run of digits and Latin letters.
TOKEN = "[一-鿿]|[0-9A-Za-zÀ-ÖØ-öø-ÿ]+"
IDEOGRAPH = "[一-鿿]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def token_estimate(text: Column) -> Column:
    """Non-ideograph tokens plus one and a half per ideograph, rounded half to even."""
    every, wide = F.size(tokens(text)), F.regexp_count(text, F.lit(IDEOGRAPH))
    return (every - wide + F.bround(wide * F.lit(1.5), 0)).cast("bigint")


@F.pandas_udf(StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def dedup_form(text: Column) -> Column:
    """Compatibility form, lower case, no punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(compatibility_form(text)), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def snapshot_form(text: Column) -> Column:
    """Unix line ends, no trailing blanks, no blank lines."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"[ \t]+$", "")), lambda x: x != ""), "\n")


def alias_form(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def sentences(text: Column, stops: str = "。！？\n") -> Column:
    """Pieces that end after a stop; blank ones are dropped."""
    return F.filter(F.transform(F.split(text, f"(?<=[{stops}])"), lambda s: F.trim(F.regexp_replace(s, "\n", " "))), lambda s: s != "")


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def char_bigrams(text: Column) -> Column:
    steps = F.when(F.length(text) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))))
    return F.array_distinct(F.transform(steps, lambda i: F.substring(text, i, F.lit(2))))


def bigram_overlap(text: Column, query: Column) -> Column:
    """Share of the query's bigrams that the text has."""
    q = char_bigrams(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.filter(q, lambda g: F.contains(text, g))) / F.size(q))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the padded words."""
    words = F.filter(F.split(F.lower(text), "[^0-9a-zà-öø-ÿ]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def context_window(text: Column, name: Column, reach: int = 40) -> Column:
    """The name with `reach` characters on either side, dots where the text goes on; empty if it isn't there."""
    at = F.position(name, text)
    start = F.greatest(at - reach, F.lit(1))
    end = F.least(at + F.length(name) + reach - 1, F.length(text))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at == 0, "").otherwise(cut)


def title_of(text: Column, fallback: Column) -> Column:
    """The first level-one Markdown heading, else the fallback."""
    found = F.regexp_extract(text, r"(?m)^# (.+)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(fallback)


def state_token(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def simhash(words: Column) -> Column:
    """64-bit fingerprint: each word votes with the low 64 bits of its MD5, a bit is set where the votes are positive.

    The votes of a document are summed in one vectorized call; the result is a bigint with the fingerprint's bits.
    """
    return _simhash(words)


#: Words whose votes are added at once; it bounds a batch's memory.
VOTES = 200_000


@F.pandas_udf(LongType())
def _simhash(words: pd.Series) -> pd.Series:
    import hashlib

    import numpy as np

    lists = [[] if w is None else w for w in words]
    sizes = np.array([len(w) for w in lists], np.int64)
    out = np.zeros(len(lists), np.int64)
    i = 0
    while i < len(lists):
        j = i + max(1, int(np.searchsorted(np.cumsum(sizes[i:]), VOTES, side="right")))
        some = np.flatnonzero(sizes[i:j]) + i
        if len(some):
            codes, distinct = pd.factorize(np.concatenate([np.asarray(lists[k], dtype=object) for k in some]))
            raw = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[8:] for w in distinct), np.uint8).reshape(-1, 8)
            starts = np.cumsum(sizes[some]) - sizes[some]
            votes = np.add.reduceat(np.unpackbits(raw, axis=1)[codes], starts, axis=0, dtype=np.int64) * 2 - sizes[some][:, None]
            out[some] = np.packbits(votes > 0, axis=1).view(">i8").ravel()
        i = j
    return pd.Series(out)


def _near_masks(bits: int, blocks: int) -> list[int]:
    """Of 64 bits cut into blocks, those of each choice of blocks - bits blocks, as signed numbers."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << ends[k + 1]) - 1) ^ ((1 << ends[k]) - 1) for k in range(blocks)]
    every = [sum(masks[k] for k in some) for some in combinations(range(blocks), blocks - bits)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in every]


def near_keys(fingerprint: Column, bits: int = 3, blocks: int = 6) -> Column:
    """Array of (choice, value): fingerprints that differ in at most `bits` bits share one. The bits are cut into blocks; so
    many differing bits leave blocks - bits of them whole, and each choice of these is a key, here of about 32 bits."""
    return F.array(*[F.struct(F.lit(i).alias("choice"), fingerprint.bitwiseAND(F.lit(mask)).alias("value")) for i, mask in enumerate(_near_masks(bits, blocks))])


def near_choice(a: Column, b: Column, bits: int = 3, blocks: int = 6) -> Column:
    """The first choice of near_keys that two fingerprints share, null if there is none."""
    differing = a.bitwiseXOR(b)
    return F.coalesce(*[F.when(differing.bitwiseAND(F.lit(mask)) == 0, i) for i, mask in enumerate(_near_masks(bits, blocks))])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("bigint")
