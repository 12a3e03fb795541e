"""Fill-in-the-middle by bit-parallelism on big integers (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import BLANK_SPLIT, blocks
from .store import ship, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Byte to digit: 1 for bytes of words, 1 for the first byte of a code point.
WORD = bytes(np.where(BLANK_SPLIT, ord("1"), ord("0")).astype(np.uint8))
LEAD = bytes(ord("0") if 0x80 <= b < 0xC0 else ord("1") for b in range(256))


def mask(raw: bytes, digits: bytes) -> int:
    """An integer whose bit i is the class of byte i."""
    return int(raw.translate(digits)[::-1], 2)


def unit_ends(raw: bytes) -> int:
    """Bits at the last byte of every unit: a word with the blanks before it, or blanks that end the text."""
    words = mask(raw, WORD)
    ends = words ^ (words & (words >> 1))
    last = 1 << (len(raw) - 1)
    return ends if words & last else ends | last


def select(bits: int, rank: int) -> int:
    """The place of the set bit of this rank (from 1): the half that has it is halved again."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank <= n:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - n, at + half
    return at


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from the seed and the id; a null id is an empty string."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[8 * k : 8 * k + 8], 16) for k in range(4)]


def rearranged(raw: bytes, doc_id: int | None, seed: int, rate: int, spm: int, marks: tuple[bytes, bytes, bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    if not raw:
        return 0, "plain", None, None, raw
    ends = unit_ends(raw)
    n = ends.bit_count()
    h1, h2, h3, h4 = draws(seed, doc_id)
    if h3 % 100 >= rate or any(m in raw for m in marks):
        return n, "plain", None, None, raw
    a, b = (select(ends, k) + 1 if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    leads = mask(raw, LEAD)
    before, inside = ((leads & ((1 << x) - 1)).bit_count() for x in (a, b))
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", before, inside - before, b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
    return n, "psm", before, inside - before, b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, marks: Sequence[str] = (PREFIX, SUFFIX, MIDDLE), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    `rate` percent of the documents are cut at two units and rearranged, `spm`
    percent of these with the suffix first.  A null text counts as empty; empty
    texts and texts with one of the marks stay plain; blanks alone are one unit; a
    null doc_id draws by an empty string; repeated rows get equal rows; long texts
    are cut whole; no rows give none; other columns are not read.  Work is linear
    in a text's bytes.
    """
    ship(docs.sparkSession)
    told = tuple(m.encode() for m in marks)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def cut(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, data, offsets in blocks(batch.column(1)):
                raw = data.tobytes()
                rows = [rearranged(raw[x:y], i, seed, rate, spm, told) for i, x, y in zip(ids[first:end], offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                n, form, before, inside, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def restored(output: Column, form: Column, marks: Sequence[str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that fill_in_middle() was given, from its output and form; null where either is.

    A rearranged text has each mark once, since texts with a mark stay plain and a
    mark can't begin in one part and end in another.
    """
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    last, begin, between = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(begin, between, last))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM g
"""
