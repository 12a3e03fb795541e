"""Source divergence audit by dense tiles of groups and terms (operator 11)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernel import LOWER, blocks, word_spans
from .store import materialize, ship, table

#: Bytes of terms: letters and everything outside ASCII.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[0x41:0x5B] = TERM_BYTES[0x61:0x7B] = TERM_BYTES[0x80:] = True

#: Bytes of text whose words are counted at once.
COUNT_BYTES = 4 << 20
#: Numbers in a tile of groups and terms (16 MB), terms of a tile at most, groups whose pairs one task sums, numbers in a step of all pairs.
TILE, TERMS, BAND, STEP = 1 << 21, 2048, 256, 1 << 20
#: Cells over which the rows of a language are dealt where they meet its totals.
SALTS = 64
#: One part in so many: the unit of p.
UNIT_STEPS, STEP_UNITS, PRIOR = 3, 1000, 5


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of rows (lang, source, text), which are not null: partial counts of blocks of text.

    A block's words are coded by a dictionary of the bytes themselves, so no hash
    stands for a term.
    """
    ship(docs.sparkSession)

    def count(batches):
        for batch in batches:
            names: dict[tuple[str, str], int] = {}
            group = np.array([names.setdefault(k, len(names)) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            langs, sources = (pa.array([k[i] for k in names], pa.string()) for i in (0, 1))
            for first, end, data, offsets in blocks(batch.column(2), COUNT_BYTES):
                starts, ends, words = word_spans(data, offsets, TERM_BYTES)
                if not len(starts):
                    continue
                where = np.zeros(len(starts) + 1, np.int64)
                np.cumsum(ends - starts, out=where[1:])
                letters = LOWER[data[TERM_BYTES[data]]]
                coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(letters)]).dictionary_encode()
                kinds = len(coded.dictionary)
                doc = np.repeat(np.arange(end - first), np.diff(words))
                pairs, n = np.unique(doc * kinds + coded.indices.to_numpy(), return_counts=True)
                cells, at = np.unique(group[first:end][pairs // kinds] * kinds + pairs % kinds, return_inverse=True)
                own, term = cells // kinds, coded.dictionary.take(pa.array(cells % kinds)).cast(pa.string())
                counts = [np.bincount(at, weights=w, minlength=len(cells)).astype(np.int64) for w in (n, None)]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(own)), sources.take(pa.array(own)), term, *map(pa.array, counts)], names=["lang", "source", "term", "n", "docs"])

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")


def parts(counts: np.ndarray, totals: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (N + 5 V)), exactly, by long division in three steps.

    Nothing overflows while a group has fewer than 9 * 10^15 words.
    """
    whole = np.asarray(totals, np.int64) + PRIOR * kept
    rest = counts.astype(np.int64) + PRIOR
    out = np.zeros(np.broadcast_shapes(rest.shape, whole.shape), np.int64)
    for _ in range(UNIT_STEPS):
        rest = rest * STEP_UNITS
        out = out * STEP_UNITS + rest // whole
        rest = rest % whole
    return out + 1


def pair_sums(p: np.ndarray, first: int, end: int) -> np.ndarray:
    """Sums over terms of abs(p[i] - p[j]) for i from `first` to `end` and every j: all pairs of a few rows at a time."""
    out = np.zeros((end - first, len(p)), np.int64)
    rows = max(1, STEP // max(1, p.size))
    for i in range(first, end, rows):
        out[i - first : min(i + rows, end) - first] = np.abs(p[i : min(i + rows, end), None, :] - p[None, :, :]).sum(axis=2)
    return out


def tile(rows: pa.Table, best: int) -> pa.Table:
    """Partial results (lang, source, part, item, value) of one term block and one band of a language's groups.

    `rows` has a row without term for each group of the language, with its total,
    and a row for each count.  Pairs are given once, the lesser source first; of
    each group's terms the `best` greatest, in their order, as a heap of this block.
    """
    lang, band, kept = rows["lang"][0].as_py(), rows["band"][0].as_py(), rows["kept"][0].as_py()
    told, cells = rows.filter(pc.is_null(rows["term"])), rows.filter(pc.is_valid(rows["term"]))
    named = sorted(zip(told["source"].to_pylist(), told["own"].to_pylist(), told["n"].to_pylist(), strict=True), key=lambda r: (r[1] != band, r[0].encode()))
    terms = sorted(set(cells["term"].to_pylist()), key=str.encode)
    sources = [s for s, _, _ in named]
    mine = sum(own == band for _, own, _ in named)
    totals = np.array([n for _, _, n in named], np.int64)
    counts = np.zeros((len(sources), len(terms)), np.int64)
    at = [pc.index_in(cells[c], pa.array(v, pa.string())).to_numpy() for c, v in (("source", sources), ("term", terms))]
    counts[at[0], at[1]] = cells["n"].to_numpy()
    p = parts(counts, totals[:, None], kept) if kept else np.zeros(counts.shape, np.int64)
    sums = pair_sums(p, 0, mine)
    source, part, item, value = [], [], [], []
    for i in range(mine):
        others = [j for j in range(len(sources)) if sources[i].encode() < sources[j].encode()]
        source += [sources[i]] * len(others)
        part += ["pair"] * len(others)
        item += [sources[j] for j in others]
        value += sums[i, others].tolist()
    if terms:
        q = parts(counts.sum(axis=0), int(totals.sum()), kept)
        for i in range(mine):
            above = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            gain = p[i, above] - q[above]
            top = np.argsort(-gain, kind="stable")[:best]
            source += [sources[i]] * len(top)
            part += ["term"] * len(top)
            item += [terms[j] for j in above[top]]
            value += gain[top].tolist()
    return pa.table([pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, min_docs: int = 30, best: int = 50, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's words differ from each other source's, and its most typical terms.

    Terms of at least `min_docs` documents of a language are dealt by a hash to its
    term blocks.  A task holds a block as a dense matrix of all the language's
    groups, sums the differences of a band of groups to all others, and keeps each
    of its groups' `best` terms; partial sums are added and partial lists merged by
    rank, both before and after the shuffle.  Nulls are empty strings; empty texts
    and texts without terms make a group occur; a language without kept terms gives
    pairs of value 0; repeated rows count each; long texts are counted whole; equal
    values are ranked by the item's bytes; no rows give none; other columns are not
    read.
    """
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = term_counts(base).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    known = counted.withColumns({"_docs": F.sum("docs").over(of_term), "_first": F.min("source").over(of_term) == F.col("source")}).where(F.col("_docs") >= min_docs)
    kept = materialize(known.select("lang", "source", "term", "n", "_first"), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("_first").cast("long")).alias("terms"))
    groups = materialize(base.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n", "terms"]), "groups")
    size = F.count(F.lit(1))
    langs = groups.groupBy("lang").agg(size.alias("groups"), F.sum("terms").alias("kept"))
    wide = F.least(F.lit(TERMS), F.greatest(F.lit(1), F.floor(F.lit(TILE) / F.col("groups"))))
    plan = langs.select("lang", "kept", F.greatest(F.lit(1), F.ceil(F.col("kept") / wide)).cast("int").alias("blocks"), F.ceil(F.col("groups") / BAND).cast("int").alias("bands"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    own = F.pmod(F.xxhash64("source"), F.col("bands")).cast("int")
    salt = F.pmod(F.xxhash64("term", "source"), F.lit(SALTS)).cast("int")
    placed = kept.withColumn("salt", salt).join(plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"])
    cells = placed.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), every("bands").alias("band"), "source", "term", "n", "kept", F.lit(0).alias("own"))
    told = groups.join(plan, "lang").select("lang", every("blocks").alias("block"), "bands", "source", "n", "kept", own.alias("own")).select("lang", "block", every("bands").alias("band"), "source", F.lit(None).cast("string").alias("term"), "n", "kept", "own")
    tiles = cells.unionByName(told).groupBy("lang", "block", "band").applyInArrow(lambda rows: tile(rows, best), "lang string, source string, part string, item string, value long")
    added = materialize(tiles.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "added")
    pairs = added.where("part = 'pair'")
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    typical = added.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= best)
    return both.withColumn("rank", rank).unionByName(typical)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x{7F}]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
cells AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 5)) // (n.n + 5 * v.v) AS p
          FROM n JOIN k ON n.lang = k.lang JOIN v ON v.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
q AS (SELECT c.lang, term, 1 + (1000000000 * (sum(c) + 5)) // (any_value(t.n) + 5 * any_value(v.v)) AS q
      FROM c JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) t ON t.lang = c.lang JOIN v ON v.lang = c.lang GROUP BY c.lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM cells JOIN q USING (lang, term) WHERE c > 0 AND p > q),
every AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM every WHERE part = 'pair' OR rank <= 50
"""
