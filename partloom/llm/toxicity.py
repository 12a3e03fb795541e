"""Counterfactually regularised toxicity classifier (operator 9)."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U64, WORD_BYTES, blocks, mix, trim, word_hashes, word_spans
from .store import fresh, ship, table

#: Labelled rows that training reads at most, chosen by a hash of their id.
TRAIN_ROWS = 8_000
#: Labelled sentences of each class that get an identity term, at most.
MENTIONS = 600
#: What those sentences weigh beside whole documents.
MENTION_WEIGHT = 0.6
#: Features with a weight at most, and the least |z| of a feature's toxic share.
FEATURES, LEAST_Z = 1_000, 4.0
#: Bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
# Groups of identity terms that may stand for one another, in four languages.
IDENTITIES = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual", "homosexual", "queer"),
    ("black", "white", "asian", "african", "american", "european", "mexican", "arab", "latino"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("deaf", "blind", "disabled", "old", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("homosexuels", "hétérosexuels", "lesbiennes", "bisexuels"),
    ("noirs", "blancs", "asiatiques", "africains", "arabes", "européens"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "araber", "europäer"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("homosexuales", "heterosexuales", "lesbianas", "bisexuales"),
    ("negros", "blancos", "asiáticos", "africanos", "árabes", "europeos"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
_GROUP_OF = {term: k for k, group in enumerate(IDENTITIES) for term in group}


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of texts one after another, and their offsets."""
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _term_hashes() -> np.ndarray:
    data, offsets = packed([" ".join(group) for group in IDENTITIES])
    starts, ends, _ = word_spans(data, offsets, WORD_BYTES)
    return np.unique(word_hashes(data, starts, ends))


def sentence_of(text: str | None) -> str | None:
    """One sentence of 3 to 40 words, chosen by the text's checksum; None if there is none."""
    found = [m[0].strip() for m in _SENTENCE.finditer(text or "") if 3 <= len(m[0].split()) <= 40]
    return found[zlib.crc32((text or "").encode()) % len(found)] if found else None


def counterfactuals(sentence: str) -> list[str]:
    """The sentence with an identity term, its copies with every other term of the group, and last without any.

    A term that the sentence has already is swapped where it stands; any other
    sentence gets one, of a group and at a word that its checksum chooses.
    """
    for m in _WORD.finditer(sentence):
        k = _GROUP_OF.get(m[0].lower())
        if k is not None:
            own = m[0].lower()
            head, tail = sentence[: m.start()], sentence[m.end() :]
            return [head + t + tail for t in (own, *(t for t in IDENTITIES[k] if t != own))] + [f"{head.rstrip()} {tail.lstrip()}"]
    luck = zlib.crc32(sentence.encode())
    group, words = IDENTITIES[luck % len(IDENTITIES)], sentence.split()
    at, own = 1 + luck // 64 % len(words), luck // 8192 % len(group)
    turned = group[own:] + group[:own]
    return [" ".join([*words[:at], t, *words[at:]]) for t in turned] + [sentence]


def features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None, terms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of words and word beginnings; only the sorted `wanted`, if given.

    Identity terms have a whole-word feature alone, so a swap exchanges one feature.
    """
    starts, ends, first = word_spans(data, offsets, WORD_BYTES)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    screen = None
    if wanted is not None:
        screen = np.zeros(1 << 16, bool)
        screen[(wanted >> U64(48)).astype(np.int64)] = True

    def known(h: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if screen is None or not len(h):
            return o, h
        may = screen[(h >> U64(48)).astype(np.int64)]
        h, o = h[may], o[may]
        at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        hit = wanted[at] == h
        return o[hit], h[hit]

    whole = word_hashes(data, starts, ends)
    found = [known(whole, own)]
    plain = np.isin(whole, terms, invert=True) if terms is not None else np.ones(len(whole), bool)
    for n in BEGINNINGS:
        longer = (ends - starts > n) & plain
        found.append(known(mix(word_hashes(data, starts[longer], starts[longer] + n) + U64(n)), own[longer]))
    return np.concatenate([o for o, _ in found]), np.concatenate([h for _, h in found])


def _presence(own: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, feature) once."""
    if not len(own):
        return own, h
    by = np.lexsort((h, own))
    own, h = own[by], h[by]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    return own[new], h[new]


class Model:
    """Logistic regression over the presence of hashed features."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.terms = _term_hashes()

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.full(len(offsets) - 1, self.bias)
        if len(self.keys):
            own, h = _presence(*features(data, offsets, self.keys, self.terms))
            z += np.bincount(own, weights=self.weights[np.searchsorted(self.keys, h)], minlength=len(z))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(own: np.ndarray, h: np.ndarray, rows: int, kept: np.ndarray) -> np.ndarray:
    """Presence of the sorted features `kept` in rows."""
    x = np.zeros((rows, len(kept)), np.float32)
    if len(kept) and len(h):
        at = np.minimum(np.searchsorted(kept, h), len(kept) - 1)
        hit = kept[at] == h
        x[own[hit], at[hit]] = 1
    return x


def fit(
    features_: np.ndarray, counts: np.ndarray, labels: np.ndarray, sentences: list[str], toxic: np.ndarray, penalty: float = 1.0, weight: float = MENTION_WEIGHT, ridge: float = 0.01, least: int = 4, least_z: float = LEAST_Z, most: int = FEATURES, steps: int = 300
) -> Model:
    """Fit on rows of distinct features (all rows' features one after another, and how many each row has) and labelled sentences.

    Every sentence takes part with an identity term in it, `weight` of a row
    each.  The loss adds `penalty` times the mean squared change of the logit
    from a sentence to its counterfactuals: other terms of the group in the same
    slot, and the slot empty.  With one class or no rows the model is the
    constant rate.
    """
    n, positive = len(counts), int(labels.sum())
    rate = (positive + 0.5) / (n + 1)
    if not n or positive in (0, n):
        return Model(np.zeros(0, U64), np.zeros(0), float(np.log(rate / (1 - rate))))
    terms = _term_hashes()
    keys, seen = np.unique(features_, return_counts=True)
    common = seen >= least
    keys, seen = keys[common], seen[common]
    held, times = np.unique(features_[np.repeat(labels > 0, counts)], return_counts=True)
    toxic_seen = np.zeros(len(keys))
    own = np.isin(held, keys)
    toxic_seen[np.searchsorted(keys, held[own])] = times[own]
    z = np.abs(toxic_seen - seen * rate) / np.sqrt(seen * rate * (1 - rate) + 1e-9)
    z[z < least_z] = 0
    best = np.argsort(-z, kind="stable")[:most]
    variants = [counterfactuals(s) for s in sentences]
    first = np.concatenate([[0], np.cumsum([len(v) for v in variants])]).astype(np.int64)
    v_own, v_h = _presence(*features(*packed([t for v in variants for t in v]), None, terms)) if variants else (np.zeros(0, np.int64), np.zeros(0, U64))
    kept = np.union1d(keys[best[z[best] > 0]], np.intersect1d(terms, np.concatenate([v_h, features_])))
    x = _matrix(np.repeat(np.arange(n), counts), features_, n, kept)
    mention = np.isin(v_own, first[:-1])
    x_m = _matrix(np.searchsorted(first, v_own[mention]), v_h[mention], len(variants), kept)
    # a copy differs from its sentence in what the swap changes, mostly one or two features
    x_v = _matrix(v_own, v_h, int(first[-1]), kept)
    change = x_v - np.repeat(x_m, np.diff(first), axis=0)
    change = change[np.any(change != 0, axis=1)]
    del x_v
    y, y_m = labels.astype(np.float32), np.asarray(toxic, np.float32)
    w, bias = np.zeros(len(kept)), float(np.log(rate / (1 - rate)))
    m, v, t = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), 0
    for t in range(1, steps + 1):
        w32 = w.astype(np.float32)
        miss = 1 / (1 + np.exp(-np.clip(x @ w32 + bias, -30, 30))) - y
        miss_m = weight * (1 / (1 + np.exp(-np.clip(x_m @ w32 + bias, -30, 30))) - y_m)
        g = np.append((x.T @ miss + x_m.T @ miss_m) / n + ridge * w / np.sqrt(n), (miss.sum() + miss_m.sum()) / n)
        if len(change) and penalty:
            g[:-1] += 2 * penalty * (change.T @ (change @ w32)) / len(change)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(kept, w, bias)


def swap_report(model: Model, sentences: list[str], threshold: float = 0.3) -> dict[str, float]:
    """Mean absolute change of score from sentences with a term to their copies, and the share of both called toxic."""
    variants = [counterfactuals(s) for s in sentences]
    scores = model.score(*packed([t for v in variants for t in v]))
    first = np.concatenate([[0], np.cumsum([len(v) for v in variants])]).astype(int)
    mentions = np.delete(scores, first[1:] - 1)
    return {"change": float(np.abs(scores - np.repeat(scores[first[:-1]], np.diff(first))).mean()), "called_toxic": float((mentions >= threshold).mean()), "without_term": float((scores[first[1:] - 1] >= threshold).mean())}


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, penalty: float = 1.0, mentions: int = MENTIONS) -> Model:
    """Fit on at most `rows` labelled documents that are not held out, picked by a hash of their id.

    One sentence of each is taken with its document's label; the first
    `mentions` of each class, in the order of the ids' hash, get identity terms.
    Rows with a null id or label don't count; of contrary labels the toxic one.
    """
    ship(docs.sparkSession)
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    terms = _term_hashes()

    def describe(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column(1)):
                own, h = _presence(*features(data, offsets, None, terms))
                at = np.searchsorted(own, np.arange(end - first + 1))
                held = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
                sentences = [sentence_of(t.as_py()) for t in batch.column(1).slice(first, end - first)]
                told = [batch.column(k).slice(first, end - first) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([told[0], told[1], held, pa.array(sentences, pa.string())], names=["toxic", "luck", "h", "sentence"])

    # at most `rows` ids and labels: a bounded broadcast
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("toxic", "text", F.xxhash64("doc_id").alias("luck"))
    found = chosen.mapInArrow(describe, "toxic int, luck long, h array<long>, sentence string").toArrow()
    if not len(found):
        return fit(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0), [], np.zeros(0), penalty)
    lists, toxic = found.column("h").combine_chunks(), np.array(found.column("toxic").to_pylist(), np.float64)
    told = found.column("sentence").to_pylist()
    by = sorted((i for i, s in enumerate(told) if s), key=lambda i, luck=found.column("luck").to_pylist(): (luck[i], told[i]))
    own = [i for c in (0, 1) for i in [j for j in by if (toxic[j] > 0) == c][:mentions]]
    model = fit(lists.flatten().to_numpy().view(U64), np.diff(lists.offsets.to_numpy()), toxic, [told[i] for i in own], toxic[own], penalty)
    del found, lists
    trim()
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """`keep` columns (all by default) and two of the given `names`: score and prediction of every whole text.

    A null or empty text gets the score of no feature; a null doc_id is kept;
    repeated rows each give a row, an empty table none; long texts are scored
    whole.  A score equal to the threshold is toxic.  Columns that already have
    one of the `names` are replaced, all others stay.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (keep or docs.columns) if c not in names]

    def apply(batches):
        trim()
        for batch in batches:
            column, scores = batch.column(batch.num_columns - 1), np.zeros(batch.num_rows)
            for first, end, data, offsets in blocks(column):
                scores[first:end] = shared.value.score(data, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*kept, *names])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{names[0]}` double", f"`{names[1]}` int"])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias(fresh(docs.columns, "_text")[0])).mapInArrow(apply, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
