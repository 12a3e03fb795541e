"""Benchmark decontamination by a prefix-filtered set join (operator 8)."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import LOWER, WORD_BYTES
from .store import materialize, ship, table

#: Bytes of benchmark text whose windows are broadcast at once; a larger benchmark takes several passes.
BROADCAST_BYTES = 32 << 20
#: ASCII letters in lower case; every byte that is no word byte becomes a blank.
TO_WORDS = bytes(np.where(WORD_BYTES, LOWER, 32).astype(np.uint8))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


def windows_of(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    """Runs of n words; all words as one run if there are fewer, but not none."""
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def _items(bench: DataFrame, block: int, of: int) -> list[tuple[str | None, str | None]]:
    own = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(of)) == block)
    return [(r.item_id, r.text) for r in own.collect()]


def _rarity(docs: DataFrame, vocabulary: frozenset) -> dict[bytes, int]:
    """How often every document has each benchmark word: counted at each partition, then summed."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known, held = shared.value, Counter()
        for batch in batches:
            for t in batch.column(0):
                held.update(filter(known.__contains__, words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


def _index(items: list[tuple[str | None, str | None]], n: int, seen: dict[bytes, int]) -> tuple[dict, dict]:
    """Prefix word -> {(offset, length)}, and window -> item ids.

    A window occurs only where all its words do (containment 1), so of its words
    in order of rarity the first alone is a sufficient prefix.
    """
    places: dict[bytes, set] = defaultdict(set)
    owners: dict[tuple, set] = defaultdict(set)
    for item, text in items:
        for w in windows_of(words_of(text), n):
            owners[w].add(item)
    for w in owners:
        rarest = min(range(len(w)), key=lambda i: (seen.get(w[i], 0), w[i], i))
        places[w[rarest]].add((rarest, len(w)))
    return {k: tuple(sorted(v)) for k, v in places.items()}, dict(owners)


def occurrences(words: list[bytes], places: dict, owners: dict) -> tuple[list[list[int]], set]:
    """Joined stretches of words inside windows, and the windows' items."""
    spans, items = [], set()
    if places.keys().isdisjoint(words):
        return spans, items
    for i, w in enumerate(words):
        if w in places:
            for offset, length in places[w]:
                a = i - offset
                if a >= 0 and a + length <= len(words) and (held := owners.get(tuple(words[a : a + length]))):
                    spans.append((a, a + length))
                    items |= held
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    return joined, items


def _passes(bench: DataFrame) -> int:
    size = bench.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    return max(1, -(-size // BROADCAST_BYTES))


def _shared_index(docs: DataFrame, bench: DataFrame, block: int, passes: int, n: int):
    """The broadcast index of one block of the benchmark, of bounded size."""
    items = _items(bench, block, passes)
    vocabulary = frozenset(w for _, t in items for w in words_of(t))
    return docs.sparkSession.sparkContext.broadcast(_index(items, n, _rarity(docs, vocabulary) if vocabulary else {}))


def uncontaminated(docs: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """The rows of `docs`, all columns, with no benchmark window in `text`.

    Null and empty texts stay; long texts are searched whole; repeated rows stay
    or go together; of equally rare words a window is joined on one, whichever it
    is; an empty benchmark or table changes nothing.
    """
    ship(docs.sparkSession)
    bench = bench.select(F.col("item_id").cast("string").alias("item_id"), "text")
    names, kinds = docs.columns, {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    at, passes, whole = names.index("text"), _passes(bench), docs
    for block in range(passes):
        # rarity is counted over the documents as they came, so blocks don't run through one another
        index = _shared_index(whole, bench, block, passes, n)

        def clean(batches, index=index):
            for batch in batches:
                kept = [not occurrences(words_of(t.as_py()), *index.value)[0] for t in batch.column(at)]
                yield batch.filter(pa.array(kept, pa.bool_()))

        docs = docs.mapInArrow(clean, ", ".join(f"`{c}` {kinds[c]}" for c in names))
    return docs


def contaminated(docs: DataFrame, bench: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words of every document inside benchmark windows: (doc_id, n_words, n_hit, items).

    Windows are joined to documents on their rarest word alone (rarity counted
    over all documents), kept where the offset of that word leaves room for the
    window inside the document, and verified word by word.  `items` lists the
    item ids with an occurring window, as strings in order.  The benchmark is
    broadcast in blocks of BROADCAST_BYTES; with more than one, a document's hits
    are united by row.  Null and empty texts have no words; a null item_id marks
    hits but is no item; repeated rows each give a row; an empty benchmark hits
    nothing; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    bench = bench.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    passes = _passes(bench)

    def one(block: int, whole: bool) -> DataFrame:
        index = _shared_index(docs, bench, block, passes, n)

        def mark(batches):
            places, owners = index.value
            for batch in batches:
                rows = []
                for t in batch.column(1):
                    words = words_of(t.as_py())
                    spans, items = occurrences(words, places, owners)
                    rows.append((len(words), sum(b - a for a, b in spans), sorted(x for x in items if x is not None), spans))
                c = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.string())), pa.array(c[3], pa.list_(pa.list_(pa.int64())))], names=["doc_id", "h", "n_words", "n_hit", "items", "spans"])

        out = docs.mapInArrow(mark, "doc_id long, h long, n_words long, n_hit long, items array<string>, spans array<array<long>>")
        return out.drop("h", "spans") if whole else out

    if passes == 1:
        return one(0, True)
    # Rows of equal id and text have equal hits and unite; `copies` brings them back.
    found = None
    for block in range(passes):
        part = materialize(one(block, False).groupBy("doc_id", "h", "n_words", "items", "spans").agg(F.count(F.lit(1)).alias("copies")), "leaks")
        found = part if found is None else found.unionByName(part)
    united = found.groupBy("doc_id", "h", "n_words").agg(F.max("copies").alias("copies"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    words = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s[0], s[1] - 1)))))
    return united.withColumn("n_hit", words.cast("long")).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_words", "n_hit", "items")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x{7F}]+')"
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT DISTINCT r, i, dw.k, item FROM dw JOIN win ON dw.s = win.s AND dw.k = win.k),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.r = pos.r LEFT JOIN its ON d.r = its.r
"""
