"""Quality classification by hierarchical empirical Bayes (operator 5).

1. A document classifier is fitted on at most ``max_labelled`` labelled rows (those with the smallest hashes of the id, so that
   every run takes the same): a
   logistic model of the text's shape for junk, and one of a learned lexicon for toxic
   texts.  The lexicon holds words and word beginnings that toxic texts have and few others do, found by a grouped count: the
   likelihood ratio must outweigh the number of terms that are tried (copies and most near copies of a text count once: of texts with one label
   and the same ``FOLD`` smallest shingle hashes only one is counted).  All terms that pass are used; there are no
   more than the labelled texts have.  The classifier gives each document a log-odds of being bad.
2. Sites: over all documents, grouped sums give each host's and each path's mean badness.  Between-site
   variances (method of moments) give the strength of the priors: hosts are shrunk to the global mean and
   paths to their host, sparse ones most.
3. Posterior log-odds = evidence + logit(path, without the document itself) - logit(global); documents of 0.5 or
   more are rejected.

Results: texts without words (null, empty, blank) have evidence 0, that is, their site decides; null hosts and paths are one
host and path named ''; rows with a null id are scored like others, labels without an id, text or value are ignored; repeated rows
are scored each; without labels of both kinds the evidence is 0; other columns are kept by ``classify``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, sifted, split_words, thrifty, without
from tidewright.llm.fingerprint import shingle_hashes

MAX_LABELLED = 20_000
FOLD = 3
MARGIN = 4.6  # in log-odds: a hundredth of a chance find in the whole lexicon
PRECISION = 0.5
BEGINNINGS = (4, 5, 6, 7)
_WORD = re.compile(r"\w+")
_KINDS = 0x10000  # characters beyond count as letters
_CLASS = np.array([1 if x.isupper() else 2 if x.isdigit() else 0 if x.isalpha() or unicodedata.category(x)[0] == "M" else 4 if x.isspace() else 3 for x in map(chr, range(_KINDS))] + [0], np.uint8)
SHAPES = 8


def shape(text: str) -> list[float]:
    """Length, capitals, marks, digits, distinct words, distinct lines, word length, bars."""
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = np.bincount(_CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), _KINDS)], minlength=5)
    return [float(np.log1p(len(words))), kinds[1] / n, kinds[3] / n, kinds[2] / n, len(set(words)) / m, len(set(lines)) / max(1, len(lines)), min(20.0, (n - kinds[4]) / m), text.count("|") / n]


def terms(text: str) -> set[str]:
    """Distinct words, lower case, and their beginnings (marked)."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:k]}~" for k in BEGINNINGS for w in words if len(w) > k}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights (with the constant last) by Newton's method; x is standardised by the caller."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x) ** 0.5)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _bent(x: np.ndarray) -> np.ndarray:
    """Shapes, their squares and the extremes, which single slopes can't separate."""
    return np.hstack([x, x**2, np.sqrt(np.abs(x))])


class Model:
    """Junk by shape and toxicity by lexicon, as log-odds of one document."""

    def __init__(self, junk: np.ndarray | None, middle: np.ndarray, scale: np.ndarray, lexicon: dict[str, float], toxic: np.ndarray | None):
        self.junk, self.middle, self.scale, self.lexicon, self.toxic = junk, middle, scale, lexicon, toxic

    def evidence(self, shapes: np.ndarray, hits: np.ndarray) -> np.ndarray:
        good = np.ones(len(shapes))
        if self.junk is not None:
            z = (_bent(shapes) - self.middle) / self.scale
            good *= 1 / (1 + np.exp(np.clip(z @ self.junk[:-1] + self.junk[-1], -30, 30)))
        if self.toxic is not None:
            good *= 1 / (1 + np.exp(np.clip(hits * self.toxic[0] + self.toxic[1], -30, 30)))
        if self.junk is None and self.toxic is None:
            return np.zeros(len(shapes))
        good = np.clip(good, 1e-9, 1 - 1e-9)
        return np.log((1 - good) / good)

    def hits(self, text: str) -> float:
        """Sum over the distinct words of the largest weight that a word or its beginning has."""
        get, total = self.lexicon.get, 0.0
        if self.lexicon:
            for w in set(_WORD.findall(text.lower())):
                total += max(get(w, 0.0), *[get(f"{w[:k]}~", 0.0) for k in BEGINNINGS if len(w) > k], 0.0)
        return total


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, margin: float = MARGIN) -> Model:
    """The document classifier, from at most ``max_labelled`` labelled rows of ``docs (doc_id, text)``."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "quality", "toxic")
    n = known.count()
    share = min(1.0, max_labelled / max(1, n))
    place = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 40))
    # a little more than needed passes the filter; the order settles the rest
    picked = known.withColumn("place", place).where(F.col("place") < int(min(1.0, 1.2 * share) * (1 << 40))).orderBy("place", "doc_id", "quality", "toxic").limit(max_labelled).drop("place")
    rows = docs.select(F.col("doc_id").alias("d_id"), "text").where("text IS NOT NULL").join(picked, F.col("d_id") == F.col("doc_id")).select("doc_id", "text", "quality", "toxic")
    rows = cut(rows)  # at most max_labelled texts, read three times

    def shapes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part["quality"].cast(pa.int32()), part["toxic"].cast(pa.int32()),
                pa.array([shape(t) for t in part["text"].to_pylist()], pa.list_(pa.float64()))], names=["quality", "toxic", "x"])

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for text, toxic in zip(part["text"].to_pylist(), part["toxic"].to_pylist(), strict=True):
                found = list(terms(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], names=["term", "toxic"])

    sample = rows.select("quality", "toxic", "text").mapInArrow(thrifty(shapes), "quality int, toxic int, x array<double>").collect()  # at most max_labelled rows of eight numbers
    if not sample:
        return Model(None, np.zeros(1), np.ones(1), {}, None)
    x = _bent(np.array([r.x for r in sample]))
    bad, toxic = np.array([r.quality == 0 for r in sample], float), np.array([r.toxic == 1 for r in sample], float)
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    junk = logistic((x - middle) / scale, bad) if 0 < bad.sum() < len(bad) else None
    if not 0 < toxic.sum() < len(toxic):
        return Model(junk, middle, scale, {}, None)
    base = float(toxic.mean())
    sketch = F.slice(F.array_sort(F.array_distinct(shingle_hashes(split_words(F.col("text"))))), 1, FOLD)
    first = F.min("text").alias("text")
    stats = cut(rows.select("text", "toxic", sketch.alias("sketch")).groupBy("sketch", "toxic").agg(first).select("text", "toxic").mapInArrow(thrifty(counted),
        "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n")))
    n0 = F.col("n") - F.col("n1")
    ratio = F.col("n1") * F.log(F.col("n1") / F.col("n") / base) + F.when(n0 > 0, n0 * F.log(n0 / F.col("n") / (1 - base))).otherwise(0.0)
    enough = float(np.log(max(1, stats.count()))) + margin
    sure = stats.where((F.col("n1") > 0) & (F.col("n1") >= PRECISION * F.col("n"))).where(ratio >= enough).orderBy(F.desc("n1"), "n", "term").collect()
    total, ones = len(toxic), toxic.sum()
    lexicon = {r.term: float(np.log((r.n1 + 0.5) / (ones + 1)) - np.log((r.n - r.n1 + 0.5) / (total - ones + 1))) for r in sure}
    model = Model(junk, middle, scale, lexicon, None)

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part["toxic"].cast(pa.int32()), pa.array([model.hits(t) for t in part["text"].to_pylist()], pa.float64())], names=["toxic", "hits"])

    told = rows.select("toxic", "text").mapInArrow(thrifty(scored), "toxic int, hits double").collect()  # two numbers a row, at most max_labelled
    model.toxic = logistic(np.array([[r.hits] for r in told]), np.array([r.toxic == 1 for r in told], float), ridge=1e-3)
    return model


def evidence(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``evidence``, the log-odds that a document is bad."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t or "" for t in part[text_col].to_pylist()]
            blank = np.array([not t.strip() for t in texts], bool)
            found = model.evidence(np.array([shape(t) for t in texts]).reshape(-1, SHAPES), np.array([model.hits(t) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.where(blank, 0.0, found), pa.float64())], names=[*part.schema.names, "__evidence"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(thrifty(run), f"{fields}, __evidence double")


def _strength(groups: DataFrame, prior: str) -> float:
    """How many documents a prior is worth: the mean within-site variance over the between-site variance.

    ``groups``: n, s (sum of p) and the prior mean of each site.
    """
    row = groups.agg(
        F.sum(F.when(F.col("n") > 1, F.col("n") * ((F.col("s") / F.col("n") - F.col(prior)) ** 2))).alias("between"),
        F.sum(F.when(F.col("n") > 1, F.col(prior) * (1 - F.col(prior)))).alias("chance"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("n"),
        F.sum(F.when(F.col("n") > 1, F.col("n") * F.col(prior) * (1 - F.col(prior)))).alias("within"),
    ).first()
    if not row.n or not row.within:
        return 1e6
    excess = (row.between - row.chance) / row.n
    return float(min(1e6, max(1.0, (row.within / row.n) / max(excess, 1e-9))))


def classify(docs: DataFrame, model: Model, *, host_col: str = "source", path_col: str = "lang", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``evidence, host_posterior, path_posterior, posterior, rejected`` (in place of columns so named).

    Texts are scored twice, for the sites and for the result; without ``keep_text`` the column is dropped and
    the scores are kept in the shared folder instead.
    """
    made = ("evidence", "host_posterior", "path_posterior", "posterior", "rejected")
    names = [c for c in docs.columns if c not in made]
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    scored = evidence(docs.select(*names), model, text_col=text_col).withColumns({"__host": site(host_col), "__path": site(path_col), "__p": 1 / (1 + F.exp(-F.col("__evidence")))})
    if not keep_text:
        names = [c for c in names if c != text_col]
        scored = cut(scored.drop(text_col))
    paths = cut(scored.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("n"), F.sum("__p").alias("s")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(1 - 1e-6, max(1e-6, (total.s or 0.0) / max(1, total.n or 0)))
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("prior", F.lit(mean))
    k = _strength(hosts, "prior")
    hosts = hosts.select(F.col("__host").alias("h"), ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_posterior"))
    placed = cut(paths.join(hosts, F.col("__host") == F.col("h")).drop("h"))
    j = _strength(placed, "host_posterior")
    placed = placed.select(F.col("__host").alias("__h"), F.col("__path").alias("__q"), "host_posterior", F.col("n").alias("__n"), F.col("s").alias("__s"))
    joined = scored.join(placed, (F.col("__host") == F.col("__h")) & (F.col("__path") == F.col("__q")))
    logit = lambda p: F.log(p / (1 - p))
    bound = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    path = bound((F.col("__s") - F.col("__p") + j * F.col("host_posterior")) / (F.col("__n") - 1 + j))
    posterior = 1 / (1 + F.exp(-(F.col("__evidence") + logit(path) - logit(F.lit(mean)))))
    out = joined.withColumns({"__path_posterior": path, "__posterior": posterior})
    return out.select(*names, F.col("__evidence").alias("evidence"), "host_posterior", F.col("__path_posterior").alias("path_posterior"),
        F.col("__posterior").alias("posterior"), (F.col("__posterior") >= 0.5).alias("rejected"))


def stage(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """For a pipeline: the documents that are not rejected, with their columns.

    Texts are scored once.  Equal rows have equal scores, so the rejected ones are told by a hash of id, text and site; rows
    that a sieve clears aren't shuffled.
    """
    row = F.xxhash64(*(x for c in (id_col, text_col, host_col, path_col) for x in (F.col(c).isNull(), F.col(c).cast("string"))))
    key, text = F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text")
    site = docs.select(key, text, F.col(host_col).alias("__source"), F.col(path_col).alias("__lang"), row.alias("__row"))
    scored = classify(site, fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels), host_col="__source", path_col="__lang", text_col="__text", keep_text=False)
    bad = cut(scored.where("rejected").select(F.col("__row").alias("__bad"), F.col("__id").alias("__bad_id")).distinct())
    rows = docs.withColumn("__row", row)
    same = (F.col("__row") == F.col("__bad")) & F.col(id_col).eqNullSafe(F.col("__bad_id"))
    doubtful = without(sifted(rows, "__row", bad, "__bad"), bad, same, "__bad")
    return sifted(rows, "__row", bad, "__bad", among=False).unionByName(doubtful).select(*docs.columns)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    made = classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep_text=False)
    return made.select("doc_id", "evidence", "host_posterior", "path_posterior", "posterior", "rejected")
