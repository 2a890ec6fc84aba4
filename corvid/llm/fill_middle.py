"""Fill-in-the-middle transformation of texts.

A text of n code points is cut at two of the n + 1 places between them, drawn from a
hash of its id, into prefix, middle and suffix, and put together again so that the middle
comes last: ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm).

The UTF-8 bytes of an Arrow batch are read as they lie.  One bit a byte says whether a
code point begins there; the bits are packed, and a directory holds the number of bits
set before each block of ``BLOCK`` bytes of them.  Rank of a text's end less rank of its
start is n, and select of two ranks gives the byte offsets of the cuts: no text is decoded
and no code point is walked.  The directory costs 8 bytes for each 512 bytes of text.

Edge cases: a null text counts as empty, a null id as the empty string; an empty text,
and one that holds a mark itself, stays plain; cuts at the ends and equal cuts leave empty
parts; equal ids are cut alike; an empty table gives an empty result; extra columns are
carried, and those named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
P, S, M = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and of those that put the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of packed bits in a block of the directory.
BLOCK = 64
#: Bytes of text under one directory, unless a single text is longer.
SPAN = 1 << 23

_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)


class Boundaries:
    """Rank and select over the starts of code points in UTF-8 bytes."""

    def __init__(self, raw: np.ndarray) -> None:
        bits = np.packbits((raw & 0xC0) != 0x80)
        self.bits = np.pad(bits, (0, -len(bits) % BLOCK + BLOCK))
        ones = _ONES[self.bits].reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))
        self.size = len(raw)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that begin before each byte offset."""
        at = np.asarray(at, np.int64)
        byte, bit = at >> 3, at & 7
        block = byte // BLOCK
        within = np.arange(BLOCK) < (byte % BLOCK)[:, None]
        rest = (_ONES[self.bits.reshape(-1, BLOCK)[block]] * within).sum(axis=1, dtype=np.int64)
        return self.before[block] + rest + _ONES[self.bits[byte] & (0xFF00 >> bit).astype(np.uint8)]

    def select(self, rank: np.ndarray) -> np.ndarray:
        """Byte offset at which the code point of each rank (from 0) begins; the end of the bytes for the rank after the last."""
        rank = np.asarray(rank, np.int64)
        past = rank >= self.before[-1]
        rank = np.where(past, 0, rank)
        block = np.searchsorted(self.before, rank, "right") - 1
        if not self.before[-1]:
            return np.full(len(rank), self.size)
        left = rank - self.before[block]
        upto = np.cumsum(_ONES[self.bits.reshape(-1, BLOCK)[block]], axis=1, dtype=np.int64)
        byte = (upto <= left[:, None]).sum(axis=1)
        left = left - np.where(byte > 0, np.take_along_axis(upto, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
        set_bits = np.cumsum(np.unpackbits(self.bits[block * BLOCK + byte][:, None], axis=1), axis=1)
        return np.where(past, self.size, (block * BLOCK + byte) * 8 + (set_bits <= left[:, None]).sum(axis=1))


def _spans(offsets: np.ndarray):
    """(first, end) rows whose texts together have about SPAN bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SPAN, "right")) - 1)
        yield first, min(end, n)
        first = min(end, n)


def cut(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[bytes, bytes, bytes]]]:
    """n, code points of prefix and middle, and the three parts as bytes of each text (binary or UTF-8, without nulls)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    ns, sizes, parts = [], [], []
    for first, end in _spans(offsets):
        at = offsets[first : end + 1] - offsets[first]
        part = raw[offsets[first] : offsets[end]]
        marks = Boundaries(part)
        ranks = marks.rank(at)
        n = np.diff(ranks)
        one, two = h1[first:end] % (n + 1), h2[first:end] % (n + 1)
        lo, hi = np.minimum(one, two), np.maximum(one, two)
        a, b = (np.minimum(marks.select(ranks[:-1] + k), at[1:]) for k in (lo, hi))
        whole = part.tobytes()
        ns.append(n)
        sizes += zip(lo.tolist(), (hi - lo).tolist(), strict=True)
        parts += [(whole[s:x], whole[x:y], whole[y:e]) for s, x, y, e in zip(at[:-1].tolist(), a.tolist(), b.tolist(), at[1:].tolist(), strict=True)]
    return np.concatenate(ns) if ns else np.zeros(0, np.int64), sizes, parts


def _cut_batch(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    n, sizes, parts = cut(text, h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False))
    columns = [pa.array(n, pa.int64()), *[pa.array([x[i] for x in sizes], pa.int64()) for i in range(2)]]
    columns += [pa.array([x[i] for x in parts], pa.binary()).cast(pa.string()) for i in range(3)]
    return pa.StructArray.from_arrays(columns, ["n", "prefix_chars", "middle_chars", "prefix", "middle", "suffix"])


def draws(record_id: Column) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the SHA-256 of ``1:`` and the id, as numbers."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(record_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut_percent: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Every column of ``docs``, with n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    split = F.arrow_udf(_cut_batch, "n long, prefix_chars long, middle_chars long, prefix string, middle string, suffix string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    h1, h2, h3, h4 = draws(F.col(id_col))
    marked = text.contains(P) | text.contains(S) | text.contains(M)
    plain = (text == "") | marked | (h3 % 100 >= cut_percent)
    form = F.when(plain, F.lit("plain")).when(h4 % 100 < suffix_first, F.lit("spm")).otherwise(F.lit("psm"))
    cuts = docs.select(*others, text.alias("__t"), form.alias("form"), split(text, h1, h2).alias("__c"))
    c = lambda name: F.col("__c")[name]
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(P), c("prefix"), F.lit(S), c("suffix"), F.lit(M), c("middle")))
        .when(F.col("form") == "spm", F.concat(F.lit(S), c("suffix"), F.lit(P), c("prefix"), F.lit(M), c("middle")))
        .otherwise(F.col("__t"))
    )
    chars = lambda name: F.when(F.col("form") != "plain", c(name)).alias(name)
    return cuts.select(*others, c("n").alias("n"), "form", chars("prefix_chars"), chars("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: its parts stand between marks that no cut text holds."""
    parts = F.split(output, f"{P}|{S}|{M}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digest(transformed: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of output and restored text."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (
  SELECT doc_id, text, n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS one, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT doc_id, text, n, form, least(one, two) AS a, greatest(one, two) AS b,
         substr(text, 1, least(one, two)) AS prefix, substr(text, least(one, two) + 1, abs(one - two)) AS middle,
         substr(text, greatest(one, two) + 1) AS suffix FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
