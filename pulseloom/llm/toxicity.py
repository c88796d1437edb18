"""Toxicity by a weighted finite-state pattern grammar.

Words become classes: insult, threat, target, negation, reported speech, other. Five transducers composed into
one read each clause: targets near an insult or threat address it, a negation shortly before cancels it, a
verb of reporting before it in the clause makes it reported. What comes out are matched clauses, and a
document's score is a logistic function of how many of each sort it holds and how heavy their words are.

The insult words are a seed list and what labelled documents teach: whole words and word beginnings that
are common in toxic training documents and rare in others.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.bpe import Remembered
from pulseloom.llm.common import byte_slices, small_batches, tidy, written
from pulseloom.llm.transducer import Transducer

#: Labelled rows learned from at most, those of the least hash of their id.
SAMPLE = 60_000
#: A learned entry: toxic documents with it at least, share of toxic ones at least, letters of a beginning. Entries of the lexicon at
#: most, and of those looked at to find them: the most frequent ones in toxic training documents.
SUPPORT, PRECISION, LETTERS, ENTRIES, LOOKED_AT = 5, 0.8, range(3, 10), 5000, 100_000
SLICE = 4 << 20
#: The seed words of each class; targets, negations and verbs of reporting in English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid dumb fool fools loser losers clown clowns scum trash worthless pathetic disgusting imbecile cretin filth vermin parasite degenerate bastard bitch asshole jerk retard subhuman".split()
    + "dummkopf trottel schwachkopf abschaum arschloch versager erbärmlich widerlich ungeziefer".split()
    + "imbécile crétin connard salaud ordure minable abruti débile vermine".split()
    + "idiota imbécil estúpido estúpida basura escoria cabrón gilipollas patético asqueroso".split()
)
THREATS = "kill hurt destroy burn beat shoot stab murder hang crush slaughter strangle".split() + "töten umbringen verprügeln erschießen vernichten".split() + "tuer frapper brûler égorger massacrer".split() + "matar matarte golpear quemar degollar".split()
TARGETS = (
    "you your yours yourself he him his she her they them their these those this that people everyone who i me we us".split()
    + "du dich dir dein deine deinen deiner ihr euch euer eure sie ihn ihm ihnen er wir uns ich mich mir leute alle jeder".split()
    + "tu te toi ton ta tes vous votre vos il elle ils elles lui leur leurs nous je moi gens tous".split()
    + "tú ti tus usted ustedes vosotros él ella ellos ellas les nosotros yo mí gente todos".split()
)
NEGATIONS = "not never no none neither nor without hardly".split() + "nicht nie niemals kein keine keinen keiner weder ohne kaum".split() + "ne pas jamais aucun aucune ni sans guère".split() + "nunca jamás ningún ninguna tampoco sin apenas".split()
REPORTS = (
    "said says say called calls told tells wrote writes quoted quotes claimed claims reported reports alleged according".split()
    + "sagt sagte sagten nannte nennt schrieb schreibt behauptete behauptet berichtete berichtet zitierte laut".split()
    + "dit disait appelé appelle écrit raconte racontait prétend prétendait rapporte rapportait selon cite citait".split()
    + "dijo dice decía llamó llama escribió escribe afirmó afirma contó cuenta informó según citó cita".split()
)
NEAR, BEFORE = 4, 3
_WORD, _CLAUSE = regex.compile(r"[^\W\d_]+"), regex.compile(r"[.!?;:\n]+")
CLASSES = ("insult", "threat", "target", "negation", "report", "other")
#: Sorts of matches, in the order of the features.
SORTS = ("insult", "insult-target", "insult-negated", "insult-reported", "threat", "threat-target", "threat-negated", "threat-reported")
#: Coefficients to which little data leaves the fit: base, a match of each sort, weight of the heaviest word.
START = np.array([-3.0, 2.5, 3.0, 0.5, 0.5, 0.3, 2.0, 0.0, 0.3, 0.5])
PULL = 0.05


def _window(opens: str, marks: tuple[str, ...], suffix: str, size: int) -> Transducer:
    """Marks the given labels when ``opens`` was among the ``size`` labels before."""
    labels = (*CLASSES, *SORTS)

    def step(left, label):
        out = label + suffix if label in marks and left else label
        return out, 0.0, size if label == opens else max(left - 1, 0)

    return Transducer.grown(0, labels, step)


def _renamed(labels, weigh) -> Transducer:
    return Transducer.grown(0, labels, lambda state, label: (*weigh(label), 0))


def grammar() -> Transducer:
    """insult and threat, then target, negation and reported speech, composed; outputs are CLASSES and SORTS."""
    insult = _renamed(CLASSES, lambda x: (x, 1.0 if x == "insult" else 0.0))
    threat = _renamed(CLASSES, lambda x: (x, 0.5 if x == "threat" else 0.0))
    target = _window("target", ("insult", "threat"), "-target", NEAR)
    plain = ("insult", "threat", "insult-target", "threat-target")

    def cancel(left, label):
        out = label.split("-")[0] + "-negated" if label in plain and left else label
        return out, -1.0 if out != label else 0.0, BEFORE if label == "negation" else max(left - 1, 0)

    def report(seen, label):
        out = label.split("-")[0] + "-reported" if label in plain and seen else label
        return out, -0.5 if out != label else 0.0, seen or label == "report"

    labels = (*CLASSES, *SORTS)
    return insult.compose(threat).compose(target).compose(Transducer.grown(0, labels, cancel)).compose(Transducer.grown(False, labels, report))


class Matcher:
    """Matched clauses of a text. lexicon: word + "$" or beginning of a word to weight."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.machine = lexicon, grammar()
        fixed = {w: "report" for w in REPORTS} | {w: "negation" for w in NEGATIONS} | {w: "target" for w in TARGETS} | {w: "threat" for w in THREATS}
        self.classes = Remembered(lambda w: fixed.get(w) or ("insult" if self.weight(w) > 0 else "other"))
        self.heavy = Remembered(lambda chunk: any(self.classes[w] in ("insult", "threat") for w in _WORD.findall(chunk)))

    def weight(self, word: str) -> float:
        return max(self.lexicon.get(word + "$", 0.0), *(self.lexicon.get(word[:k], 0.0) for k in LETTERS if k <= len(word)), 0.0)

    def features(self, text: str) -> list[float]:
        text = text.lower()
        heavy, counts, most = self.heavy, dict.fromkeys(SORTS, 0.0), 0.0
        if any(map(heavy.__getitem__, set(text.split()))):
            for clause in _CLAUSE.split(text):
                if any(map(heavy.__getitem__, clause.split())):
                    words = _WORD.findall(clause)
                    labels = [self.classes[w] for w in words]
                    # the target may follow as well: a second reading from the end
                    ahead = [out for out, _ in self.machine.run(reversed(labels))][::-1]
                    for word, back, (out, weight) in zip(words, ahead, self.machine.run(labels)):
                        if out in counts:
                            if out in ("insult", "threat") and back == out + "-target":
                                out = back
                            counts[out] += 1
                            most = max(most, weight * self.weight(word) if out.startswith("insult") else weight)
        return [1.0, *(math.log1p(counts[s]) for s in SORTS), most]


def held_out(doc_id: str) -> bool:
    return zlib.crc32(doc_id.encode()) % 5 == 0


def _learned(train: DataFrame, entries: int, looked_at: int) -> dict[str, float]:
    """Weights of insult entries from rows (text, toxic), by log-ratio of document frequencies."""

    def beginnings(text: str | None, known=None) -> set[str]:
        words = set(_WORD.findall((text or "").lower()))
        found = {w + "$" for w in words} | {w[:k] for w in words for k in LETTERS if k <= len(w)}
        return found if known is None else found & known

    def counted(known, label):
        def run(batches):
            counts: Counter = Counter()
            of = Remembered(lambda w: tuple(x for x in (w + "$", *(w[:k] for k in LETTERS if k <= len(w))) if x in known)) if known is not None else None
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    if of is None:
                        counts.update(beginnings(text))
                    else:
                        counts.update({x for w in set(_WORD.findall((text or "").lower())) for x in of[w]})
                if len(counts) > 400_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])
                    counts.clear()
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])

        return train.where(F.col("toxic") == label).select("text").mapInArrow(tidy(run), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    sizes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    common = counted(None, 1).where(F.col("n") >= SUPPORT).orderBy(F.desc("n"), "entry").limit(looked_at).collect() if toxic else []
    hits = {r.entry: r.n for r in common}
    known = frozenset(hits)
    misses = {r.entry: r.n for r in counted(known, 0).collect()} if hits and clean else {}
    ratio = lambda p, n: math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
    # a beginning that is nearly always one longer entry says no more than that one
    longer = {e[:k] for e in hits for k in range(3, len(e)) if hits[e] >= 0.9 * hits.get(e[:k], math.inf)}
    good = sorted((e for e, p in hits.items() if e not in longer and p / (p + misses.get(e, 0)) >= PRECISION), key=lambda e: (-hits[e] + misses.get(e, 0), len(e), e))
    out = {w + "$": 2.0 for w in INSULTS}
    out |= {e: max(0.0, min(8.0, ratio(hits[e], misses.get(e, 0)))) for e in good[:entries]}
    for w in INSULTS:  # a seed word that training documents contradict counts for less
        if (p := hits.get(w + "$", 0)) and (n := misses.get(w + "$", 0)):
            out[w + "$"] = max(0.0, ratio(p + 1, n))
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression drawn towards START."""
    w, n = START.copy(), max(1, len(y))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / n + PULL / np.sqrt(n) * (w - START)
        curve = (x.T * (p * (1 - p) / n)) @ x + PULL / np.sqrt(n) * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES, looked_at: int = LOOKED_AT) -> tuple[dict[str, float], list[float]]:
    """(lexicon, coefficients) from at most ``sample`` labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    The lexicon holds at most ``entries`` learned entries, those of the greatest surplus of toxic documents among the ``looked_at``
    most frequent ones in toxic documents. All three bounds are of the classifier's training only; every row is scored.

    docs: (doc_id, text); labels: (doc_id, toxic). Rows with a null id or label, or without a document, teach nothing; of
    documents with the same text one is taken. Without labels the seed words and START decide.
    """
    small_batches(docs.sparkSession)
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce("text", F.lit(""))
    joined = docs.join(F.broadcast(chosen), "doc_id").select(text.alias("text"), "toxic", F.xxhash64(text, F.lit(1)).alias("h"), F.xxhash64(text, F.lit(2)).alias("g"))
    first = written(joined.groupBy("h", "g").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("text", "toxic"), "train")
    lexicon = _learned(first, entries, looked_at)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        matcher = Matcher(sent.value)
        for batch in batches:
            rows = np.array([matcher.features(t or "") for t in batch.column(0).to_pylist()]).reshape(-1, len(START))
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], ["x", "toxic"])

    # rows with equal features are one: their number is what is collected, at most ``sample`` rows
    table = first.mapInArrow(tidy(run), "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    if not table:
        return lexicon, START.tolist()
    x = np.repeat(np.array([r.x for r in table]), [r["count"] for r in table], axis=0)
    y = np.repeat(np.array([r.toxic for r in table], float), [r["count"] for r in table])
    return lexicon, _fit(x, y).tolist()


def toxicity(docs: DataFrame, lexicon: dict[str, float], coefficients: list[float], text_col: str = "text", score: str = "score") -> DataFrame:
    """The rows of ``docs`` with a ``score`` from 0 to 1 (higher: toxic is likelier), from the text alone.

    Null and empty texts match nothing and have the base score. All columns come through, one named as ``score`` is
    replaced; repeated rows each give a row; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(score)
    at, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast((lexicon, coefficients))

    def run(batches):
        matcher, weights = Matcher(sent.value[0]), np.array(sent.value[1])
        for batch in batches:
            texts = batch.column(at)
            for a, b in byte_slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist(), SLICE):
                x = np.array([matcher.features(t or "") for t in texts.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))], [*batch.schema.names, score])

    shape = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return shape.mapInArrow(tidy(run), shape.withColumn(score, F.lit(0.0)).schema)
