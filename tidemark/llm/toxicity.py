"""Toxicity by weak supervision: voters, a generative model of their accuracies and correlations, a linear classifier on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Insults that are voters from the start, English, German, French, Spanish.
LEXICON = (
    "idiot idiots moron morons stupid dumb trash garbage scum loser losers pathetic worthless disgusting clown fool fools jerk creep "
    "freak ugly hate filth vermin imbecile cretin coward pig bastard bitch asshole "
    "dumm dummkopf trottel abschaum versager widerlich ekelhaft wertlos müll schwachkopf arschloch "
    "imbécile crétin abruti connard débile ordure minable dégoûtant salaud raclure "
    "estúpido estúpida imbécil basura escoria asqueroso patético inútil tonto cabrón"
).split()
#: Patterns that are voters, on the text as it stands: address in four languages, shouting, threats, stretched and masked words.
PATTERNS = [
    r"(?i)\byou(?:'re| are) (?:a|an|so|such)\b", r"(?i)\bdu bist (?:ein|eine|so)\b", r"(?i)\btu es (?:un|une|si)\b", r"(?i)\beres (?:un|una|tan)\b",
    r"!{3,}", r"[?!]{4,}", r"(?:\b\p{Lu}{3,}\b\W+){3}", r"(?i)\b(?:shut up|go away|get lost|kill yourself|hate you)\b",
    r"(?i)\b(?:halt die klappe|verpiss dich|ferme ta gueule|cállate|vete a la mierda)\b", r"\b\p{L}+[*#@$%]{2,}\p{L}*\b", r"(\p{L})\1{4,}",
]
#: Correlation inside the classes from which voters count as tied.
TIED = 0.25
#: Most that a given label may say, as log odds: what a voter of 98 % says. Voters that agree can outweigh it.
LABEL = 4.0
#: A voter goes whose rows are those of a surer one to this share, where one key holds the other.
NESTED = 0.8


@dataclass
class Model:
    """Keys are looked for in lower-case text of words between single spaces: " word " a word, " wor" a beginning of words."""

    keys: list[str]
    weights: np.ndarray  # of keys, patterns, log1p(hits), the constant
    accuracies: np.ndarray
    changed: int  # labels that the posterior overrules
    correlations: np.ndarray


def plain(text: Column) -> Column:
    """Lower-case words of letters and digits between single spaces, a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def votes(docs: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Adds fired (indexes of the voters that vote toxic) and hits (places where keys stand) to doc rows with a text column."""
    wanted = docs.select(*keep, plain(F.col("text")).alias("_plain"), *(F.col("text").rlike(p).alias(f"_p{k}") for k, p in enumerate(PATTERNS)))
    fields = [f for f in wanted.schema.fields if f.name in keep]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        trie = ahocorasick.Automaton()
        for k, key in enumerate(keys):
            trie.add_word(key, k)
        trie.make_automaton()
        at = len(keep)
        for batch in batches:
            fired, hits = [], []
            patterns = list(zip(*(batch.column(at + 1 + k).to_pylist() for k in range(len(PATTERNS)))))
            for text, p in zip(batch.column(at).to_pylist(), patterns):
                found = [k for _, k in trie.iter(text)] if keys else []
                fired.append(sorted(set(found)) + [len(keys) + k for k, x in enumerate(p) if x])
                hits.append(len(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(fired, pa.list_(pa.int32())), pa.array(hits, pa.int64())], [*keep, "fired", "hits"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return wanted.mapInArrow(vote, f"{kinds}, fired array<int>, hits long")


def label_model(fired: np.ndarray, given: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic for each row, P(vote | class) of every voter and, last, of the label, correlations of all inside the classes).

    Expectation maximisation over the class of every row, from the voters' majority: each voter fires with a rate of its own in either
    class, the rest is abstention. The given label is one more voter whose rates are estimated alike, but whose word is
    bounded by LABEL, so that voters can overrule it. Votes that move together inside the classes count as less than
    one voter each: a voter's evidence is divided by 1 + the sum of its correlations over TIED (weaker ones are mostly what is
    left of rows whose class is not settled).
    """
    x = np.column_stack((fired, given)).astype(float)
    p = np.array([0.03, 0.5, 0.95])[np.minimum(x.sum(1), 2).astype(int)]
    rates = correlation = None
    for _ in range(rounds):
        weight = np.stack((1 - p, p), 1)
        total = weight.sum(0)
        rates = (weight.T @ x + 0.5 * x.mean(0)) / (total[:, None] + 0.5)
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        left = x - weight @ rates
        covariance = left.T @ left / len(x)
        scale = np.sqrt(np.clip(np.diag(covariance), 1e-9, None))
        correlation = covariance / scale[:, None] / scale
        share = 1 / (1 + np.where(correlation - np.eye(len(correlation)) > TIED, correlation, 0).sum(1))
        share[-1] = 1.0
        fires, rests = share * np.log(rates[1] / rates[0]), share * np.log((1 - rates[1]) / (1 - rates[0]))
        fires[-1], rests[-1] = np.clip((fires[-1], rests[-1]), -LABEL, LABEL)
        p = 1 / (1 + np.exp(-np.clip(np.log(total[1] / total[0]) + rests.sum() + x @ (fires - rests), -30, 30)))
    return p, rates, correlation


def unnested(keys: list[str], fired: np.ndarray) -> list[int]:
    """Which keys to keep, surest first: none whose rows are those of a kept key that holds it or that it holds (NESTED)."""
    kept: list[int] = []
    for k, key in enumerate(keys):
        own = fired[:, k] > 0
        near = [j for j in kept if key.strip() in keys[j] or keys[j].strip() in key]
        if not any((own & (fired[:, j] > 0)).sum() >= NESTED * max(1, (own | (fired[:, j] > 0)).sum()) for j in near):
            kept.append(k)
    return kept


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 2.0, rounds: int = 25) -> np.ndarray:
    """Weights (the constant last) of a ridge logistic regression on soft targets, by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (target - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, bound: int = 12_000, voters: int = 400) -> Model | None:
    """A model from labelled rows that are not held out: about `bound` of them at most, by a hash of their id.

    `bound` is what the driver sees (each row as the few voters it fires) and what the model is fitted to. The learned part of
    the lexicon: words, and beginnings of words of 4 to 6 letters, that stand with toxic labels far more often than not (the
    `voters` surest). None where no row is toxic or none is not.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not toxic or toxic == n:
        return None
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, bound / n) * (1 << 20)))
    rows = docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))).join(F.broadcast(known), "doc_id").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    base = toxic / n
    found = F.array_distinct(F.split(F.trim(plain(F.col("text"))), " "))
    starts = [F.transform(F.filter(found, lambda w: F.length(w) >= k), lambda w: F.concat(F.lit(" "), F.substring(w, 1, k))) for k in (4, 5, 6)]
    features = F.array_distinct(F.concat(F.transform(found, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), *starts))
    seen = rows.select("toxic", F.explode(features).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    surely = (F.col("t") - base * F.col("n")) / F.sqrt(base * (1 - base) * F.col("n"))
    learned = seen.where((F.col("n") >= 4) & (F.col("t") >= 0.5 * F.col("n"))).withColumn("z", surely).where("z >= 4.5").orderBy(F.desc("z"), "key").limit(voters).collect()
    keys = list(dict.fromkeys([r["key"] for r in learned] + [f" {w} " for w in LEXICON]))
    sample = votes(rows, keys, ["doc_id", "toxic"]).orderBy("doc_id").collect()
    width = len(keys) + len(PATTERNS)
    fired = np.zeros((len(sample), width), np.float32)
    for k, r in enumerate(sample):
        fired[k, r["fired"]] = 1
    given = np.array([r["toxic"] for r in sample], float)
    if not len(given) or given.min() == given.max():
        return None
    kept = unnested(keys, fired)
    hits_ = [r["hits"] for r in sample]
    if len(kept) < len(keys):
        keys = [keys[k] for k in kept]
        fired = np.concatenate((fired[:, kept], fired[:, width - len(PATTERNS) :]), 1)
        hits_ = [r["hits"] for r in votes(rows, keys, ["doc_id"]).orderBy("doc_id").collect()]
    voting = fired.sum(0) > 0
    posterior, rates, correlation = label_model(fired[:, voting], given)
    hits = np.log1p(np.array(hits_, float))
    weights = logistic(np.column_stack((fired, hits)), posterior)
    return Model(keys, weights, rates, int(((posterior > 0.5) != (given > 0.5)).sum()), correlation)


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """Every document with its score: doc_id, held_out, score, predicted.

    Scores depend on the text alone; whole texts, one pass, no shuffle. Null and empty texts get the score of a text that fires no
    voter; without usable labels (none, or all of one kind) every score is 0. A null doc_id is scored and not held out. Repeated rows
    score alike; of repeated labels of a document the greater counts, and of its texts the least is learned from. Texts of any length count whole.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    model = fit(docs, labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).alias("toxic")))
    kept = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    if model is None:
        return docs.select("doc_id", kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    fired = votes(docs.withColumn("text", F.coalesce("text", F.lit(""))), model.keys, ["doc_id"])
    weights = F.lit(model.weights.tolist())
    sum_ = F.aggregate("fired", F.lit(float(model.weights[-1])), lambda a, k: a + F.get(weights, k))
    score = 1 / (1 + F.exp(-(sum_ + float(model.weights[-2]) * F.log1p(F.col("hits").cast("double")))))
    return fired.withColumn("score", score).select("doc_id", kept, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
