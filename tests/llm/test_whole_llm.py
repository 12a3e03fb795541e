"""Whole jobs of the training-data operators, on small fixtures."""

import hashlib

import numpy as np
import pytest

from partloom.llm import audio, graph, jaccard, pii


@pytest.mark.parametrize("tag", [audio.MU_LAW, audio.A_LAW, audio.IMA_ADPCM])
def test_media_is_stored_as_pcm_of_twice_the_rate(spark, tag):
    texts = {1: None, 2: "", 3: "a" * 192, 4: "Some text \u00e9 of more than one block. " * 40}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in audio.media_digests(docs, tag, keep_media=True).collect():
        kind, rate, align, data = audio.read_wave(bytes(r.media))
        assert (kind, audio.read_payload(bytes(r.media))) == (tag, audio.payload_of(texts[r.doc_id]))
        want = audio.double_rate(audio.decode_ima(data, align) if tag == audio.IMA_ADPCM else audio.TABLES[tag][np.frombuffer(data, np.uint8)])
        assert audio.read_wave(bytes(r.pcm))[:3] == (audio.PCM, 2 * rate, 2)
        assert audio.decode(bytes(r.pcm))[1].tolist() == want.tolist()
        assert (r.pcm_bytes, r.pcm_sha256) == (len(r.pcm), hashlib.sha256(bytes(r.pcm)).hexdigest())
        told, wide = dict(x.split("=") for x in r.feature.split(";")), want.astype(np.int64)
        assert (told["rate"], int(told["samples"]), int(told["peak"])) == ("16000", len(want), np.abs(wide).max())
        assert int(told["rms"]) == int(((wide**2).sum() // len(wide)) ** 0.5) and int(told["crossings"]) == ((want[1:] < 0) != (want[:-1] < 0)).sum()


def test_every_text_of_a_shared_id_links(spark):
    rows = []
    for k in range(12):
        one, two, three = ([f"{c}{k}x{i}" for i in range(120 + 7 * j)] for j, c in enumerate("pqr"))
        mine, base = 1000 + k, 10_000 + 10 * k
        rows += [(mine, " ".join(w)) for w in (one, two, three)]
        rows += [(base + j, " ".join([*w, "tail"])) for j, w in enumerate((one, two, three))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.components(docs).collect()}
    assert got == {i: 1000 + (i - 10_000) // 10 if i >= 10_000 else i for i, _ in rows}


def test_a_shared_id_links_through_equal_texts_too(spark):
    """A document of several rows is one node: equal texts of any of them link it, and one row of the whole group stays."""
    a, b, c = ("text of document number %s with some words behind it to fill a few windows" % k for k in ("one", "two", "three"))
    rows = [(0, a), (1, a), (1, b), (5, b), (7, c), (7, None), (8, ""), (9, c), (9, c), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.components(docs).collect()), key=str)
    assert got == sorted([(0, 0), (1, 0), (1, 0), (5, 0), (7, 7), (7, 7), (8, 8), (9, 7), (9, 7), (None, 0)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(0, a), (7, c), (7, None), (8, ""), (None, b)], key=str)
    # an empty row of a document follows its other rows
    docs = spark.createDataFrame([(0, a), (3, a), (3, None), (3, " ")], "doc_id long, text string")
    assert {r.component_id for r in jaccard.components(docs).collect()} == {0} and jaccard.one_of_each(docs).count() == 1


def test_classes_of_very_many_rows_are_broadcast(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'the same few words again' ELSE concat('own words ', id, ' of a text') END AS text")
    out = jaccard.components(docs)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert all(r.component_id == (1 if r.doc_id % 3 == 1 else r.doc_id) for r in out.collect()) and out.count() == 3000


def test_components_finish_or_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.component for r in graph.connected_components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.connected_components(edges, rounds=1)


def test_training_windows_come_from_all_picked_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"reach {chr(97 + i)}{chr(97 + i)}@mail.example now") for i in range(20)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(pii.Tagger, "fit", lambda self, x, y, epochs: seen.append(x))
    pii.train(docs)
    pii.train(docs, windows_most=5)
    every, few = ([r.tobytes() for r in x] for x in seen)
    plain = {r.tobytes() for i in range(20) for r in pii.training_windows([(f"reach {chr(97 + i)}{chr(97 + i)}@mail.example now", [])])[0]}
    assert plain <= set(every) and len(few) == 5 and set(few) < set(every) and few != every[:5]


def test_stretch_bounds_are_parameters(spark, monkeypatch):
    text = "".join(f"{i} " + "word " * 30 for i in range(10)) + "7" * 500
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(pii.Tagger, "fit", lambda self, x, y, epochs: seen.append(len(x)))
    pii.train(docs, windows_most=10**6)
    pii.train(docs, stretches=100, longest=10_000, windows_most=10**6)
    whole = [text[a:b] for a, b in pii.regions(text)]
    assert seen[0] < seen[1] == len(pii.training_windows(pii.labelled(whole))[0])
