"""N-gram Jaccard join by prefix filters under several global orders (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import connected_components
from .kernel import BLANK_SPLIT, U64, Summary, blocks, mix, shingles, trim, word_hashes, word_spans
from .store import discard, materialize, most_counted, ranked, ship, sieve, sifted, table

#: Words and shingles whose corpus counts shape the first order, at most; the rest count as rare.
LISTED = {"word": 65_536, "gram": 262_144}
#: Bits of a set's parity bitmap.
MARK_BITS = 1024
#: Documents of a token that its others are tried against in the first round, growth from round to round, and parts of a join.
PIVOTS, GROWTH, SALTS = 16, 4, 8
#: A class of more than this share of all rows is joined by broadcast; at most so many are.
HOT_SHARE = 1024


def document_sets(column: pa.Array, n: int):
    """For each block of texts: first row, then for each text its sorted shingle hashes and their words' hashes."""
    for first, end, data, offsets in blocks(column):
        starts, ends, at = word_spans(data, offsets, BLANK_SPLIT)
        words = word_hashes(data, starts, ends)
        h, own = shingles(words, at, n)
        yield first, end, words, at, h, np.searchsorted(own, np.arange(end - first + 1))


def listed(docs: DataFrame, n: int) -> dict[str, np.ndarray]:
    """The corpus's most frequent words and shingles with their counts, over every text."""

    def count(batches):
        words, grams = Summary(), Summary()
        for batch in batches:
            for _, _, w, _, h, _ in document_sets(batch.column(0), n):
                words.add(w)
                grams.add(h)
        for kind, s in enumerate((words, grams)):
            s.fold()
            kept = s.counts >= (max(4, s.counts.sum() >> 18) if not kind else 3)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(kept.sum(), kind, np.int32)), pa.array(s.keys[kept].view(np.int64)), pa.array(s.counts[kept])], names=["kind", "key", "n"])
        trim()

    counted = materialize(docs.select("text").mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "listed")
    out = {}
    for kind, name in enumerate(("word", "gram")):
        top = most_counted(counted.where(F.col("kind") == kind).select("key", "n"), LISTED[name]).toPandas()
        keys, counts = top["key"].to_numpy(np.int64).view(U64), top["n"].to_numpy(np.int64)
        by = np.argsort(keys)
        out[name], out[f"{name}_n"] = keys[by], counts[by]
    discard(counted)
    return out


class Orders:
    """Three global orders of shingles, as 64-bit keys: the least key is the first shingle.

    The first is by rarity: shingles of listed counts last, by count, the others
    by their words' frequency (in powers of two), ties by hash.  The second is by
    hash with listed shingles last, the third by another hash alone.
    """

    def __init__(self, stats: dict[str, np.ndarray], n: int):
        self.stats, self.n = stats, n
        counts = stats["word_n"]
        least = max(1, int(counts.min())) if len(counts) else 1
        self.word_class = 1 + np.minimum(14, np.floor(np.log2(np.maximum(1, counts / least)))).astype(np.int64)
        rank = np.empty(len(stats["gram"]), np.int64)
        rank[np.argsort(stats["gram_n"], kind="stable")] = np.arange(len(rank))
        self.gram_rank = rank

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def rarity(self, words: np.ndarray, first: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        at, known = self._find(self.stats["word"], words)
        level = np.where(known, self.word_class[at] if len(self.word_class) else 0, 0)
        total = np.concatenate([[0], np.cumsum(level)])
        counts = np.diff(bounds)
        # shingle j of a text starts at its word j; a short text has one shingle of all its words
        start = np.repeat(first[:-1] - bounds[:-1], counts) + np.arange(len(h))
        stop = np.minimum(start + self.n, np.repeat(first[1:], counts))
        sums = np.minimum(62, total[stop] - total[start])
        key = (sums.astype(U64) << U64(56)) | (mix(h ^ U64(0x51ED27)) >> U64(8))
        return self._last(h, key)

    def _last(self, h: np.ndarray, key: np.ndarray) -> np.ndarray:
        at, known = self._find(self.stats["gram"], h)
        if not known.any():
            return key
        late = (U64(1) << U64(63)) | (self.gram_rank[at].astype(U64) << U64(40)) | (h >> U64(24))
        return np.where(known, late, key)

    def second(self, h: np.ndarray) -> np.ndarray:
        return self._last(h, mix(h ^ U64(0xA5A5_0002)) >> U64(1))

    def third(self, h: np.ndarray) -> np.ndarray:
        return mix(h ^ U64(0x5A5A_0003))


def _prefix(size: int, num: int, den: int) -> int:
    """How many first tokens of a set two sets of that similarity must share one of."""
    return size - -(-num * size // den) + 1 if size else 0


def parity(h: np.ndarray) -> np.ndarray:
    """Bitmap of a set: the bit of each token's hash is flipped once, so bitmaps differ in no more bits than sets in tokens."""
    flips = np.bincount((h >> U64(54)).astype(np.int64), minlength=MARK_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _strings(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*values, np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)), pa.array(flat))


def components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents linked by num/den Jaccard similarity of n-word shingle sets: (doc_id, n_shingles, component_id).

    Words are runs without ASCII white space, A-Z in lower case.  A document of
    fewer than n words has its whole sequence as one shingle; one without words
    has none and links with nothing.  Equal sets are one class, and classes are
    linked by `_joined`.  Null texts are empty.  Rows that share a doc_id are one
    node: the classes and links of any of them are those of the document, so it
    has one component.  A null doc_id takes part through its equal sets only and
    alone has a null component.  Repeated rows each give a row, an empty table none; long
    texts are read whole; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    orders = spark.sparkContext.broadcast(Orders(listed(docs, n), n))

    def describe(batches):
        for batch in batches:
            for first, end, words, at, h, bounds in document_sets(batch.column(1), n):
                key = orders.value.rarity(words, at, h, bounds)
                sizes, one, two, prefixes, marks, second, third = [], [], [], [], [], [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.unique(h[a:b])
                    sizes.append(len(own))
                    with np.errstate(over="ignore"):
                        one.append(np.add.reduce(own) if len(own) else U64(0))
                        two.append(np.add.reduce(mix(own ^ U64(0x77))) if len(own) else U64(0))
                    k = _prefix(len(own), num, den)
                    lead = np.unique(key[a:b])[:k]
                    prefixes.append(lead.view(np.int64))
                    marks.append(parity(own))
                    for held, order in ((second, orders.value.second(own)), (third, orders.value.third(own))):
                        held.append(own[np.argpartition(order, k - 1)[:k]].view(np.int64) if 0 < k < len(own) else own[:k].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(sizes, pa.int64()), pa.array(np.array(one, U64).view(np.int64)), pa.array(np.array(two, U64).view(np.int64)), _strings(prefixes), _strings(marks), _strings(second), _strings(third)], names=["doc_id", "size", "h1", "h2", "prefix", "marks", "second", "third"])
        trim()

    described = docs.mapInArrow(describe, "doc_id long, size long, h1 long, h2 long, prefix array<long>, marks array<long>, second array<long>, third array<long>")
    sets = materialize(described.withColumn("row", F.monotonically_increasing_id()), "sets")
    same = ["size", "h1", "h2"]
    # one row of each class, of its least id; rows are numbered in the written table, so the numbers stay
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row")))
    members = F.count(F.lit(1)).alias("members")
    classes = materialize(sets.where("size > 0").groupBy(*same).agg(first.alias("rep"), members).select(*same, "rep.doc_id", "rep.row", "members").withColumnRenamed("doc_id", "rep"), "classes")
    chosen = materialize(sets.where("size > 0").join(classes.select("row"), "row", "left_semi").select("doc_id", "size", "prefix", "marks", "second", "third"), "chosen")
    small = materialize(sets.select("doc_id", "size", "h1", "h2"), "sizes")
    discard(sets)
    joined = _joined(docs, chosen, n, num, den)
    shared = materialize(_shared_ids(small, same), "shared_ids")
    some = not shared.isEmpty()
    if some:
        joined = _united(small.join(shared, "doc_id", "left_semi"), classes, joined, same)
    of_class = classes.join(joined, classes.rep == joined.node, "left").select(*same, "members", F.coalesce("component", "rep").alias("component_id"))
    # documents without a set have no class; classes of over a 1024th of the rows, so 1024 of them at most, are broadcast
    full, none, total = small.where("size > 0"), small.where("size = 0"), small.count()
    hot = F.broadcast(of_class.where(F.col("members") > max(1000, total // HOT_SHARE)).drop("members"))
    placed = full.join(hot, same).unionByName(full.join(hot.drop("component_id"), same, "left_anti").join(of_class.drop("members"), same))
    if some:
        elsewhere = placed.join(shared, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        none = none.join(elsewhere, "doc_id", "left")
    else:
        none = none.withColumn("component_id", F.lit(None).cast("long"))
    return placed.unionByName(none).select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _shared_ids(small: DataFrame, same: list[str]) -> DataFrame:
    """Ids whose rows have different sets."""
    return small.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*same)).alias("low"), F.max(F.struct(*same)).alias("high")).where("low <> high").select("doc_id")


def _united(shared: DataFrame, classes: DataFrame, joined: DataFrame, same: list[str]) -> DataFrame:
    """`joined` with the classes united that have rows of one doc_id."""
    edges = shared.where("size > 0").join(classes.select(*same, "rep"), same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    stars = joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return materialize(connected_components(stars.unionByName(edges)), "parts")


def _passing(num: int, den: int, x: str, y: str):
    """Length and positional bounds: what is left of both sets after a shared token must hold the needed overlap."""
    c = F.col
    sizes = c(f"{x}.size") + c(f"{y}.size")
    room = F.least(c(f"{x}.size") - c(f"{x}.pos"), c(f"{y}.size") - c(f"{y}.pos"))
    shape = F.least(f"{x}.size", f"{y}.size") * den >= F.greatest(f"{x}.size", f"{y}.size") * num
    return shape & (room * (num + den) >= sizes * num)


def _joined(docs: DataFrame, chosen: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, component) of documents, of different sets, that verified links connect.

    A token's documents are first tried against the one that has it earliest;
    after components of what that links, those still in different components are
    tried in rounds, against ever more of the token's first documents, with new
    components after each.  So every link not found joins documents that other
    links join, and what one round joins the next doesn't pair.
    """
    postings = chosen.select("doc_id", "size", F.posexplode("prefix").alias("pos", "token")).select("token", "doc_id", "size", "pos")
    shared = chosen.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token")
    lists = materialize(postings.join(shared, "token", "left_semi"), "lists")
    pivots = lists.groupBy("token").agg(F.min(F.struct("pos", "doc_id", "size")).alias("y"))
    starred = lists.join(pivots, "token").select(F.struct("doc_id", "size", "pos").alias("x"), "y")
    tried = _pairs(starred.where((F.col("x.doc_id") != F.col("y.doc_id")) & _passing(num, den, "x", "y")))
    joined = materialize(connected_components(_verified(tried, chosen, docs, n, num, den)), "parts")
    left = materialize(_open(lists, joined), "open")
    discard(lists)
    left = materialize(ranked(left, ["token"], ["pos", "doc_id", "size"], ["doc_id"], "rank"), "open")
    low, high = 0, PIVOTS
    while not left.isEmpty():
        # a token's first documents come in SALTS copies, so that no task has all of a frequent token
        sides = left.select("token", "rank", F.struct("doc_id", "size", "pos", "part").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
        first = left.where(F.col("rank") < high).select("token", F.col("rank").alias("own"), F.struct("doc_id", "size", "pos", "part").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        more = first.join(sides, ["token", "salt"]).where((F.col("own") < F.col("rank")) & (F.col("x.part") != F.col("y.part")) & _passing(num, den, "x", "y"))
        late = _verified(_pairs(more), chosen, docs, n, num, den)
        if not late.isEmpty():
            stars = joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            joined = materialize(connected_components(stars.unionByName(late)), "parts")
        low, high = high, high * GROWTH
        now = materialize(_open(left.where(F.col("rank") >= low).drop("part"), joined), "open")
        discard(left)
        left = now
    discard(chosen)
    return joined


def _open(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows of tokens whose documents are in more than one part, with their `part`."""
    labelled = lists.join(joined, lists.doc_id == joined.node, "left").select(*lists.columns, F.coalesce("component", "doc_id").alias("part"))
    mixed = labelled.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("token")
    return labelled.join(mixed, "token", "left_semi")


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _candidates(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Shingle sets of the documents `wanted`, and of a few more."""

    def expand(batches):
        for batch in batches:
            for first, end, _, _, h, bounds in document_sets(batch.column(1), n):
                whole = [np.unique(h[a:b]).view(np.int64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), _strings(whole)], names=["id", "whole"])
        trim()

    maybe = sifted(docs, "doc_id", sieve(wanted, "doc_id")).select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    return materialize(maybe.mapInArrow(expand, "id long, whole array<long>"), "candidates")


def close_marks(num: int, den: int):
    """Whether parity bitmaps are no further apart than those of similar sets of these sizes can be."""
    c = F.col
    apart = F.aggregate(F.zip_with("marks_a", "marks_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = c("size_a") + c("size_b")
    return apart <= sizes - 2 * F.ceil(sizes * num / (num + den))


def with_sides(pairs: DataFrame, table: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Pairs (a, b) with both sides' columns."""
    a, b = (table.select(F.col(key).alias(s), *[F.col(x).alias(f"{x}_{s}") for x in columns]) for s in "ab")
    return pairs.join(a, "a").join(b, "b")


def _verified(pairs: DataFrame, chosen: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Similar pairs, written to the shared folder.

    A pair, any of its rows' sets where rows share a doc_id, must have close
    parity bitmaps, then share prefix tokens under the second and under the third
    order, before its sets are read and compared.
    """
    c = F.col
    close = materialize(with_sides(pairs, chosen, "doc_id", ("size", "marks")).where(close_marks(num, den)).select("a", "b").distinct(), "close")
    meet = F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")
    near = materialize(with_sides(close, chosen, "doc_id", ("second", "third")).where(meet).select("a", "b").distinct(), "near")
    wanted = materialize(near.select(c("a").alias("doc_id")).unionByName(near.select(c("b").alias("doc_id"))).distinct(), "wanted")
    sets = _candidates(docs, wanted, n)
    shared = F.size(F.array_intersect("whole_a", "whole_b"))
    out = materialize(with_sides(near, sets, "id", ("whole",)).where(shared * (num + den) >= (F.size("whole_a") + F.size("whole_b")) * num).select("a", "b").distinct(), "links")
    for done in (sets, close, near, wanted):
        discard(done)
    return out


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs`, all columns, of one document of each group of linked ones: that of the least id.

    Rows of one id are one document, as in components(): all of its different rows
    stay or go.  Repeated rows count once.  Rows with a null doc_id stay; documents
    without words are linked with nothing and stay; long texts are compared whole;
    no rows give none; columns with the names of this operator's own stay as they
    are.
    """
    groups = materialize(components(docs, n, num, den), "groups")
    drop = groups.where("component_id != doc_id").select("doc_id").distinct()
    again = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    bitmap = sieve(drop.unionByName(again), "doc_id")
    known = docs.where(F.col("doc_id").isNotNull())
    maybe = sifted(known, "doc_id", bitmap).join(drop, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return docs.where(F.col("doc_id").isNull()).unionByName(sifted(known, "doc_id", bitmap, False)).unionByName(maybe.select(*[f"`{c}`" for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r,
  [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS g FROM d),
e AS (SELECT r, doc_id, len(g) AS n, unnest(g) AS t FROM s),
i AS (SELECT x.r AS a, y.r AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM e x JOIN e y ON x.t = y.t AND x.r < y.r
      AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY x.r, y.r),
l AS (SELECT a, b FROM i WHERE 100 * c >= 90 * (na + nb - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT reach.a, min(d.doc_id) AS c FROM reach JOIN d ON reach.b = d.r GROUP BY reach.a) m ON m.a = s.r
"""
