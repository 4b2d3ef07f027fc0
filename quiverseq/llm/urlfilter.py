"""URL filter: rules first, then a character language-model ratio.

Two variable-order Markov models over the bytes of a URL are trained, one on accepted and one on rejected URLs. Orders
0 to ORDER are interpolated by Witten-Bell smoothing, so a context never seen falls back to shorter ones. A URL is
judged by the difference of the two log-likelihoods per byte against a threshold that is calibrated on URLs held out
from training.

Training URLs are those that the rules decide. A rule such as example.com/en/ fits its host and all subdomains, if the
path starts with the rule's; the longest rule wins. Null URLs and those without "://" have empty host and path; they
have no evidence and keep the default verdict, allow. If rules decide no URL of one kind, no ratio exists and all the
rest is allowed. Repeated rows are judged alike. Empty tables give empty results. Extra columns pass through; host, path,
rule, verdict, score, seen and ruling are replaced or dropped.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: (verdict, rule): fixed values of the filter's contract.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
ORDER = 5
#: Distinct URLs of each kind that a model is trained and calibrated on at most; the least by hash are taken.
SAMPLE = 20_000
#: One in HELD of them calibrates.
HELD = 5
START = 2


def host_of(url: str) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and ruling (null where no rule fits) to rows with host and path."""
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, ruling = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return pages.withColumns({"rule": rule, "ruling": ruling})


class MarkovModel:
    """Interpolated Witten-Bell model of bytes. Contexts and n-grams of each order are sorted 64-bit codes."""

    def __init__(self, texts: list[bytes], order: int = ORDER):
        self.order, self.tables = order, []
        for o in range(order + 1):
            grams, row = self.codes(texts, o + 1)
            grams, counts = np.unique(grams, return_counts=True)
            contexts, at = np.unique(grams >> np.uint64(8), return_inverse=True)
            totals = np.bincount(at, weights=counts, minlength=len(contexts))
            kinds = np.bincount(at, minlength=len(contexts)).astype(float)
            self.tables.append((grams, counts.astype(float), contexts, totals, kinds))

    @staticmethod
    def codes(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The last n bytes at each byte of each text, as one number; before a text stands byte START."""
        pad = bytes([START]) * 7
        data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        row = np.repeat(np.arange(len(texts)), lengths)
        places = np.arange(len(row)) + 7 * (row + 1)
        out = np.zeros(len(row), np.uint64)
        for j in range(n - 1, -1, -1):
            out = (out << np.uint64(8)) | data[places - j].astype(np.uint64)
        return out, row

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def log_likelihoods(self, texts: list[bytes]) -> np.ndarray:
        """Natural log-likelihood of each text."""
        if not texts:
            return np.zeros(0)
        full, row = self.codes(texts, self.order + 1)
        p = np.full(len(full), 1 / 256)
        for o, (grams, counts, contexts, totals, kinds) in enumerate(self.tables):
            code = full & np.uint64((1 << 8 * (o + 1)) - 1)
            context = code >> np.uint64(8)
            seen, variety = self._look(contexts, totals, context), self._look(contexts, kinds, context)
            known = seen > 0
            p = np.where(known, (self._look(grams, counts, code) + variety * p) / np.where(known, seen + variety, 1), p)
        return np.bincount(row, weights=np.log(p), minlength=len(texts))


class UrlRatio:
    """The two models and the calibrated threshold; score() is positive for URLs to allow."""

    def __init__(self, accepted: list[bytes], rejected: list[bytes], order: int = ORDER):
        kept = [[t for i, t in enumerate(kind) if i % HELD] or kind for kind in (accepted, rejected)]
        held = [[t for i, t in enumerate(kind) if not i % HELD] for kind in (accepted, rejected)]
        self.models = [MarkovModel(kind, order) for kind in kept]
        self.threshold = 0.0
        good, bad = (np.sort(self.score(kind)) for kind in held)
        cuts = np.unique(np.concatenate([[0.0], good, bad]))
        cuts = np.concatenate([cuts, (cuts[1:] + cuts[:-1]) / 2])
        right = np.searchsorted(bad, cuts, "left") / max(len(bad), 1) + 1 - np.searchsorted(good, cuts, "left") / max(len(good), 1)
        best = np.flatnonzero(right >= right.max() - 1e-12)
        self.threshold = float(cuts[best[np.argmin(np.abs(cuts[best]))]])
        self.balanced_accuracy = float(right.max() / 2)

    def score(self, texts: list[bytes]) -> np.ndarray:
        lengths = np.array([max(len(t), 1) for t in texts])
        allow, block = (m.log_likelihoods(texts) for m in self.models)
        return (allow - block) / lengths - self.threshold


def trained(decided: DataFrame, sample: int = SAMPLE) -> UrlRatio | None:
    """Fits the ratio on (seen, ruling): at most sample distinct URLs of each kind, those with the least hashes."""
    kinds = []
    for verdict in ("allow", "block"):
        rows = decided.where(F.col("ruling") == verdict).select("seen").distinct().orderBy(F.xxhash64("seen"), "seen").limit(sample).collect()
        kinds.append([r[0].encode() for r in rows])
    return UrlRatio(*kinds) if all(kinds) else None


def judged(pages: DataFrame, url: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """Adds host, path, rule, verdict and score (log-likelihood difference per byte less the threshold; null if ruled).

    What the models see is the host and the path with runs of digits made one "0": numbers identify pages, not kinds.
    """
    seen = F.regexp_replace(F.concat("host", "path"), r"[0-9]+", "0")
    rows = ruled(pages.withColumns({"host": host_of(url), "path": path_of(url)}), rules).withColumn("seen", seen)
    ratio = trained(rows.where("ruling is not null"), sample)
    shared = pages.sparkSession.sparkContext.broadcast(ratio)  # two models of at most sample URLs each
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def score(column):
        texts = [(t or "").encode() for t in column]
        values = shared.value.score(texts) if shared.value else np.zeros(len(texts))
        return type(column)(np.where([len(t) > 0 for t in texts], values, 0.0))

    scored = rows.withColumn("score", score(F.when(F.col("ruling").isNull(), F.col("seen"))))
    own = F.when(F.col("score") >= 0, F.lit("allow")).otherwise(F.lit("block"))
    return scored.withColumns({"verdict": F.coalesce("ruling", own), "score": F.when(F.col("ruling").isNull(), F.col("score"))}).drop("seen", "ruling")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the five rules and, beyond them, by the ratio trained on what the rules decide."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", "score")
