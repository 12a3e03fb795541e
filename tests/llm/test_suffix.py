import random

import pytest

from partloom.llm import store, suffix


def brute(rows, length):
    """(id, start) of every byte in a string of `length` that starts earlier, by id and then start."""
    seen, gone = set(), {}
    for i, t in sorted(rows):
        raw = t.encode()
        for at in range(len(raw) - length + 1):
            own = raw[at : at + length]
            if own in seen:
                gone.setdefault(i, set()).update(range(at, at + length))
            seen.add(own)
    return gone


def texts(seed, n=60):
    """Texts around one passage with many surroundings, with copies and near copies."""
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcde") for _ in range(k))
    line = word(60)
    out = [word(r.randint(0, 80)) + line[: r.choice((60, 60, 45))] + word(r.randint(0, 80)) for _ in range(n)]
    return list(enumerate(out + out[:5] + [line * 3, "a" * 200, "", "ab" * 90]))


def covered(df):
    gone = {}
    for r in df.collect():
        gone.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
    return gone


@pytest.mark.parametrize(("hot", "shard", "batch", "flush"), [(4096, 1 << 20, 2000, 300_000), (4096, 300, 2000, 300_000), (4, 1 << 20, 2000, 300_000), (1, 200, 7, 50), (6, 500, 3, 20)])
def test_repeats_by_any_way(spark, monkeypatch, hot, shard, batch, flush):
    """Small shards, small batches, early flushes and hot fingerprints all give what brute force gives."""
    monkeypatch.setitem(store.BATCH, "spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    monkeypatch.setattr(suffix, "FLUSH_ROWS", flush)
    rows = texts(hot + batch)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    store.ship(spark)
    assert covered(suffix.repeats(docs, 40, 16, shard, hot)) == brute(rows, 40)


def test_a_hot_fingerprint_is_spread(spark, monkeypatch):
    """One passage in very many surroundings never comes whole into a shard."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(40))
    line = "".join(r.choice("xyz") for _ in range(44))
    rows = [(i, word() + line + word()) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    store.ship(spark)
    got = suffix.repeats(docs, 40, 16, 1 << 20, 100)
    assert covered(got) == brute(rows, 40)
    read = spark.createDataFrame(rows, "doc_id long, text string")
    strings = suffix._hot_repeats(read, spark.createDataFrame([(7, i, 24, 100) for i in range(1500)], "fp long, doc_id long, start long, stop long"), 40)
    assert strings.select("doc_id").distinct().count() == 1499


def test_recursion_reaches_every_level(monkeypatch):
    """A text with very many names is sorted by the same procedure level by level."""
    import numpy as np

    levels, old = [], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda text, depth=None: (levels.append((len(text), int(text.max()) + 1)), old(text, depth))[1])
    r = np.random.default_rng(3)
    body = r.integers(97, 123, 60_000)
    text = np.append(np.concatenate([body, body[5:50_000], body]), 0)
    order = suffix.suffix_array(text)
    assert len(levels) > 3 and levels[1][1] > 5000
    rank = np.empty(len(text), np.int64)
    rank[order] = np.arange(len(text))
    a, b = order[:-1], order[1:]
    tail = np.append(rank, -1)
    assert np.array_equal(np.sort(order), np.arange(len(text)))
    assert np.all((text[a] < text[b]) | ((text[a] == text[b]) & (tail[a + 1] < tail[b + 1])))
