"""Token counts by a two-tier map-side lookup (operator 2), and ids of whole texts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import RELEASED, Summary, trim
from .pretokens import Cutter, Lengths, classes
from .store import discard, materialize, most_counted, ship, table

#: Pre-tokens in the broadcast table, and entries of each of the two generations that a worker keeps beside it.
FREQUENT = 65_536
CACHE = 600_000
#: Pre-tokens that one partition has the text of at once, and characters of one at most.
COUNTED, LONGEST = 300_000, 64
_BEYOND = re.compile("[\ud800-\udfff\U00010000-\U0010ffff]")


def within_plane(text: str) -> bool:
    return text.isascii() or _BEYOND.search(text) is None


class Encoder:
    """A tokenizer file: its library's model, and whether texts can be encoded pre-token by pre-token.

    That is so (`split`) for byte-level BPE files without normaliser or template.
    """

    def __init__(self, path: str):
        self.special: dict[str, int] = {}
        self.cut, self.split, self.counter, self.ider = None, False, None, None
        self.sentencepiece = path.endswith(".model")
        if self.sentencepiece:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, added = told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
        plain = not any(told.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")) and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        self.split = plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, as the library gives them."""
        if self.sentencepiece:
            return [np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]
        encode = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        return [np.array(x.ids, np.uint32) for x in encode(texts, add_special_tokens=False)]

    def by_pretoken(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after another, and how many each has, from one call."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        told = self.model.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(told.ids, np.uint32), np.bincount(np.array(told.word_ids, np.int64), minlength=len(pieces))

    def apart(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Places of texts that can be split into pre-tokens, and of those that are encoded whole."""
        plain = [i for i, t in enumerate(texts) if within_plane(t) and not (self.cut and self.cut.search(t))] if self.split else []
        return plain, sorted(set(range(len(texts))).difference(plain))


_held: dict[tuple[str, str], Encoder] = {}
RELEASED.append(_held.clear)


def worker_encoder(path: str, use: str) -> Encoder:
    """This worker process's encoder for a file and a use; its cache serves later tasks too."""
    if (path, use) not in _held:
        _held[path, use] = Encoder(path)
    return _held[path, use]


def text_runs(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) with about `limit` characters a run; null is empty."""
    at, size, run = 0, 0, []
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= limit:
            yield at, run
            at, size, run = i + 1, 0, []
    if run:
        yield at, run


def frequent_pieces(docs: DataFrame, kinds: np.ndarray, text: str = "text", most: int = FREQUENT) -> list[str]:
    """The corpus's most frequent pre-tokens, about `most`, counted over every text.

    Each partition keeps a bounded summary of hashed pre-tokens (it forgets the
    rarest when too many are held) and sends those of at least a 2**-17 share
    that it has seen twice in a run of texts, of at most LONGEST characters.
    """

    def summary(batches):
        cut, held, names = Cutter(kinds), Summary(), {}
        for batch in batches:
            for _, run in text_runs(batch.column(0).to_pylist()):
                joined, starts, ends, _, h = cut([t for t in run if within_plane(t)])
                held.add(h)
                own, at, n = np.unique(h, return_index=True, return_counts=True)
                at = at[(n > 1) & (ends[at] - starts[at] <= LONGEST)]
                for x, a, b in zip(h[at].tolist(), starts[at].tolist(), ends[at].tolist(), strict=True):
                    if x not in names:
                        names[x] = joined[a:b]
                if len(names) > COUNTED:
                    held.fold()
                    alive = set(held.keys.tolist())
                    names = {x: p for x, p in names.items() if x in alive}
        held.fold()
        least = max(2, int(held.counts.sum()) >> 17)
        kept = [(names[x], n) for x, n in zip(held.keys[held.counts >= least].tolist(), held.counts[held.counts >= least].tolist(), strict=True) if x in names]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["piece", "n"])
        trim()

    counted = materialize(docs.select(F.col(text)).mapInArrow(summary, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    top = sorted(r.piece for r in most_counted(counted, most, key="piece").select("piece").collect())
    discard(counted)
    return top


class Counter:
    """Token counts of texts: the broadcast table first, then this worker's bounded cache, which encodes what it lacks."""

    def __init__(self, encoder: Encoder, kinds: np.ndarray, size: int = CACHE):
        self.encoder, self.cut, self.size = encoder, Cutter(kinds), size
        self.held: dict[int, int] = {}
        self.older: dict[int, int] = {}

    def _encode(self, joined: str, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Counts for distinct hashes that the table lacks."""
        if len(self.held) > self.size:
            self.older, self.held = self.held, {}
        keys, held, older = h.tolist(), self.held, self.older
        lack = []
        for i, x in enumerate(keys):
            if x not in held:
                if x in older:
                    held[x] = older[x]
                else:
                    lack.append(i)
        for at in range(0, len(lack), 4096):
            some = lack[at : at + 4096]
            _, found = self.encoder.by_pretoken([joined[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            held.update(zip([keys[i] for i in some], found.tolist(), strict=True))
        return np.array([held[x] for x in keys], np.int64)

    def counts(self, texts: list[str], table: Lengths) -> list[int]:
        out = np.zeros(len(texts), np.int64)
        plain, rest = self.encoder.apart(texts)
        if rest:
            out[rest] = [len(x) for x in self.encoder.ids([texts[i] for i in rest])]
        joined, starts, ends, first, h = self.cut([texts[i] for i in plain])
        n, missing = table.find(h)
        if missing.any():
            own, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
            places = np.flatnonzero(missing)[at]
            n[missing] = self._encode(joined, own, starts[places], ends[places])[back]
        total = np.concatenate([[0], np.cumsum(n)])
        out[plain] = total[first[1:]] - total[first[:-1]]
        return out.tolist()


class Ids:
    """Ids of texts from this worker's bounded cache of pre-tokens' ids."""

    def __init__(self, encoder: Encoder, kinds: np.ndarray, size: int = CACHE, most_ids: int = 8 * CACHE):
        self.encoder, self.cut, self.size, self.most_ids = encoder, Cutter(kinds), size, most_ids
        self._clear()

    def _clear(self) -> None:
        self.held: dict[int, int] = {}
        self.starts, self.flat, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _fill(self, joined: str, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entries of distinct hashes in `starts`, after encoding what the cache lacks."""
        if len(self.held) > self.size or self.used > self.most_ids:
            self._clear()
        keys, held = h.tolist(), self.held
        lack = [i for i, x in enumerate(keys) if x not in held]
        news = []
        for at in range(0, len(lack), 4096):
            some = lack[at : at + 4096]
            ids, n = self.encoder.by_pretoken([joined[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            first = len(held)
            held.update(zip([keys[i] for i in some], range(first, first + len(some)), strict=True))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            self.flat[self.used : self.used + len(ids)] = ids
            news.append(self.used + np.cumsum(n))
            self.used += len(ids)
        if news:
            self.starts = np.concatenate([self.starts, *news])
        return np.array([held[x] for x in keys], np.int64)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain, rest = self.encoder.apart(texts)
        for i, x in zip(rest, self.encoder.ids([texts[i] for i in rest]) if rest else [], strict=True):
            out[i] = x
        joined, starts, ends, first, h = self.cut([texts[i] for i in plain])
        own, at, back = np.unique(h, return_index=True, return_inverse=True)
        entry = self._fill(joined, own, starts[at], ends[at])[back]
        begin, n = self.starts[entry], self.starts[entry + 1] - self.starts[entry]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
        for i, a, b in zip(plain, total[first[:-1]].tolist(), total[first[1:]].tolist(), strict=True):
            out[i] = ids[a:b]
        return out


def token_counts(docs: DataFrame, path: str, over: int = 512, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Bytes and tokens of every whole text: (doc_id, n_bytes, n_tokens, over_limit).

    Tier one is a broadcast table of the lengths of the corpus's `frequent` most
    frequent pre-tokens, of 10 bytes each; tier two encodes what it misses and
    keeps the lengths in the worker's cache, a bounded number of hashes whatever
    the pre-tokens' sizes.  No pre-token is shuffled.  Texts with special strings
    or characters beyond the first plane, and all texts of files that aren't
    byte-level BPE, are encoded whole.  A null text counts as empty: 0 bytes, 0
    tokens; a long one is read whole.  A null doc_id is kept, repeated rows each
    give a row, an empty table gives no rows, and other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    own = Encoder(path)
    kinds, lengths = None, None
    if own.split:
        kinds = classes(own.model)
        top = frequent_pieces(docs, kinds, text, frequent) if frequent else []
        joined, starts, ends, _, h = Cutter(kinds)(top)
        if len(h) != len(top):
            raise ValueError("a pre-token was cut in two")
        lengths = Lengths(h, own.by_pretoken(top)[1])
    shared = spark.sparkContext.broadcast((kinds, lengths))

    def count(batches):
        encoder = worker_encoder(path, "counts")
        kinds, lengths = shared.value
        if lengths is not None and encoder.counter is None:
            encoder.counter = Counter(encoder, kinds)
        for batch in batches:
            texts, sizes, counts = batch.column(1).to_pylist(), [], []
            for _, run in text_runs(texts):
                sizes += [len(t.encode()) for t in run]
                counts += [len(x) for x in encoder.ids(run)] if lengths is None else encoder.counter.counts(run, lengths)
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([c > over for c in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
