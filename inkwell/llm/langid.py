"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams (lengths 1 to 3 of the lower-cased text, digits and signs taken as one blank; a long text is taken in parts) over a
bounded sample of labelled rows, drawn language by language by a hash of the row, so that every part of the table has its share, rare languages
are learned and copies of one text aren't taken or left as a whole;
the log-probability matrix (BUCKETS x languages floats, a fixed size) is broadcast with the languages' prior probabilities, their
shares of all labelled rows; scoring is a sparse gather and a segmented sum in numpy over whole texts.

Defined cases: null text, or text without a letter, gives ``und`` with score 0; null labels are not learned;
with no labelled row at all every text is ``und``; rows repeat in the result as they repeat in the input; null
ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, load, mix, sole_memo, with_fields

U = np.uint64
#: Hash buckets of n-grams; the matrix has this many rows at any size of input.
BUCKETS = 1 << 16
#: At most about so many labelled rows are learned from (a hash threshold for each language; whole texts). Documented bound.
TRAIN_ROWS = 8_000
#: Longest n-gram.
ORDER = 3
#: Characters of a text that are taken at once.
PART = 1 << 18
UNDETERMINED = "und"


def _steps(texts: list[str], limit: int = 2 * PART) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Texts between two blanks, long ones in parts that share ORDER - 1 characters: (indices of the texts, parts, characters of each where an n-gram may begin), some at a time."""
    who, parts, own, size = [], [], [], 0
    for i, t in enumerate(texts):
        t = f" {t} "
        for at in range(0, len(t), PART):
            part = t[at : at + PART].lower()
            if size and size + len(part) > limit:
                yield who, parts, own
                who, parts, own, size = [], [], [], 0
            who.append(i)
            parts.append(part + t[at + PART : at + PART + ORDER - 1].lower())
            own.append(len(part))
            size += len(part)
    if parts:
        yield who, parts, own


def _grams(parts: list[str], own: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, offsets by part)."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    c = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c < 97) | (c > 122) & (c < 170), np.uint32(32), c).astype(U)
    ends = np.cumsum(sizes)
    last, at = np.repeat(ends, sizes), np.arange(len(c))
    begins = at < np.repeat(ends - sizes + np.array(own), sizes)
    h, buckets, keep = np.zeros(len(c), U), np.empty((len(c), ORDER), np.int32), np.empty((len(c), ORDER), bool)
    for n in range(1, ORDER + 1):
        shifted = np.zeros(len(c), U)
        shifted[: len(c) - n + 1] = c[n - 1 :]
        h = h * U(0x9E3779B97F4A7C15) + shifted + U(n)
        buckets[:, n - 1] = mix(h) >> U(48)
        keep[:, n - 1] = (at + n <= last) & begins
    return buckets[keep], np.concatenate([[0], np.cumsum(keep.sum(1))])[np.concatenate([[0], ends])]


def _letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's n-gram counts by language: (lang, bucket, n), a fixed number of rows at most."""
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        by: dict[str, list[str]] = {}
        for t, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
            by.setdefault(lang, []).append(t)
        for lang, some in by.items():
            for _, parts, own in _steps(some):
                grams, _ = _grams(parts, own)
                counts[lang] = counts.get(lang, 0) + np.bincount(grams, minlength=BUCKETS)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])


def _known(labelled: DataFrame) -> DataFrame:
    return labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())


def label_counts(labelled: DataFrame) -> dict[str, int]:
    """Labelled rows of each language, over the whole table."""
    return {r["lang"]: r["n"] for r in _known(labelled).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language


def sample(labelled: DataFrame, rows: int, counts: dict[str, int]) -> DataFrame:
    """(text, lang) of about ``rows`` labelled rows at most, equally many of each language; what a rare one doesn't use is shared by the others. Rows are told apart by all their columns."""
    known = _known(labelled)
    if sum(counts.values()) > rows:
        limits, left = [], rows
        for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
            share = min(n, left / (len(counts) - k))
            left -= share
            limits += [F.lit(lang), F.lit(math.ceil(share / n * (1 << 30)))]
        known = known.filter(F.pmod(F.xxhash64(F.lit("sample"), *labelled.columns), F.lit(1 << 30)) < F.element_at(F.create_map(*limits), F.col("lang")))
    return known.select("text", "lang")


Model = tuple[list[str], np.ndarray, np.ndarray]


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """(languages in order, float32 matrix BUCKETS x languages, log prior of each language) from rows with text, lang and what tells rows with one text apart, as ids."""
    known = label_counts(labelled)
    got = sample(labelled, rows, known).mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    langs = sorted(got["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    counts[got["bucket"].to_numpy(int), [langs.index(x) for x in got["lang"]]] = got["n"]
    smooth = counts + 0.5
    share = np.array([known[x] for x in langs], float)
    return langs, np.log(smooth / smooth.sum(0)).astype(np.float32), np.log(share / max(share.sum(), 1))


def predict(docs: DataFrame, model: Model, columns: list[str], named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``columns`` of docs (which has ``text``) with the prediction and its posterior, tempered by the text's length; ``named`` are their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in columns if c != "text"]
    kept = docs.select(*columns, *(["text"] if "text" not in columns else []))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo("language", lambda: None)
        langs, matrix, prior = shared.value
        for b in batches:
            texts = b["text"].to_pylist()
            pred, prob = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            able = [i for i, t in enumerate(texts) if langs and _letters(t)]
            total, size = np.zeros((len(able), len(langs))), np.zeros(len(able))
            for who, parts, own in _steps([texts[i] for i in able]):
                grams, at = _grams(parts, own)
                np.add.at(total, who, np.stack([np.add.reduceat(matrix[:, k][grams], at[:-1], dtype=np.float64) for k in range(len(langs))], 1))
                np.add.at(size, who, np.diff(at))
            if able:
                total += prior
                best = total.argmax(1)
                p = 1 / np.exp((total - total.max(1, keepdims=True)) / np.sqrt(size)[:, None]).sum(1)
                for i, k, x in zip(able, best, p, strict=True):
                    pred[i], prob[i] = langs[k], x
            cols = [b[c] for c in (columns if "text" in columns else names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(prob)], names=[*(columns if "text" in columns else names), *named])

    return kept.mapInArrow(score, with_fields(kept.select(*columns), f"{named[0]} string, {named[1]} double"))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model, ["doc_id"]).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


#: A document is rejected when no language is found or the posterior of the best one is below this.
LEAST_SCORE = 0.5


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, columns unchanged."""
    bounded(spark)
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    named = ("_inkwell_lang", "_inkwell_score")
    return predict(docs, model, docs.columns, named).filter((F.col(named[0]) != UNDETERMINED) & (F.col(named[1]) >= LEAST_SCORE)).select(*docs.columns)
