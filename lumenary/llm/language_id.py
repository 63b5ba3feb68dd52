"""Language identification of pages by Bayesian fusion of evidence.

The text speaks by a character-trigram likelihood, the markup by the language that it declares, the address by its suffix
and by its host. Hosts' priors are smoothed along a hierarchy (host, domain, suffix, all pages) of grouped sums, from which
a page's own share is taken out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

#: Cells that trigrams are hashed to.
CELLS = 1 << 14
#: Labelled texts that the trigram model is fitted on, those of least hash: about so many, all where there are fewer.
FIT_ROWS = 2_000
#: Languages that a table of CELLS rows is made for; labels with more are refused, none is dropped.
MOST_LANGUAGES = 1000
#: How much a parent in the hierarchy weighs, in pages, and smoothing of declared languages and suffixes.
PARENT_WEIGHT, SMOOTH = 5.0, 1.0
#: Trigrams of one text overlap and are counted as fewer. All of a text's trigrams make its mean likelihood, but they aren't
#: independent, so that beyond some hundred of them a longer text is no surer: its weight is bounded, not its reading.
DISCOUNT, MOST_TRIGRAMS = 0.25, 400

TAGS = re.compile(r"<!--.*?-->|<(script|style|nav)\b[^>]*>.*?</\1\s*>|<[^>]*>", re.S | re.I)
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"


def cells(text: str) -> np.ndarray:
    """Hashed trigrams of lower-cased letters; other signs are one blank."""
    words = re.sub(r"[\W\d_]+", " ", text.lower())
    c = np.frombuffer(f" {words} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    return ((h ^ (h >> np.uint64(15))) % np.uint64(CELLS)).astype(np.int64)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (CELLS x languages) from a bounded sample of labelled texts, summed by the tasks."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(lang) > 0)).select(F.lower(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("_h"))
    last = known.select("_h").distinct().orderBy("_h").limit(rows).agg(F.max("_h")).first()[0]  # only hashes are sorted
    sample = known.where(F.col("_h") <= F.lit(last)).dropDuplicates(["_h", "lang"]).select("lang", "text") if last is not None else known.select("lang", "text")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang_, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = sums.setdefault(lang_, np.zeros(CELLS, np.int64))
                own += np.bincount(cells(t), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["lang", "counts"])

    found: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(run, "lang string, counts binary").collect():  # the sample is bounded
        found[r["lang"]] = found.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
    names = sorted(found)
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"the labels have more than {MOST_LANGUAGES} languages")
    if not names:
        return [], np.zeros((CELLS, 0), np.float32)
    counts = np.stack([found[k] for k in names], axis=1) + 0.5
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def features(pages: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, and loglik, the text's log likelihoods in the order of ``names``."""
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def make():
        logp = shared.value

        def step(batch):
            out = []
            for html in batch.column(4).to_pylist():
                c = cells(TAGS.sub(" ", html or ""))
                mean = logp[c].mean(axis=0) if len(c) else np.zeros(logp.shape[1], np.float32)
                out.append((mean.astype(np.float64) * min(len(c) * DISCOUNT, MOST_TRIGRAMS)).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.list_(pa.float64()))], ["page_id", "host", "declared", "suffix", "loglik"])

        return step

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    kind = pages.schema["page_id"].dataType.simpleString()
    plain = pages.select("page_id", host.alias("host"), F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1)).alias("declared"), F.substring_index(host, ".", -1).alias("suffix"), "html")
    got = map_batches(plain, f"page_id {kind}, host string, declared string, suffix string, loglik array<double>", make)
    return got.withColumn("domain", F.substring_index("host", ".", -2))


def _normal(logs: Column) -> Column:
    """Probabilities of an array of logarithms."""
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def identify(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang (by the text alone), declared and host of each page.

    Null and empty html says nothing by its text or markup, a null url nothing by its host; such pages are judged by what is
    left, in the end by the prior of all pages. Ties go to the first language in alphabetical order. Repeated rows are
    pages of their own. Grouped sums merge on the map side, so a host that a third of all pages have is a row a task; pages
    meet their host's row in a join whose hot host Spark can split. Suffixes, declared languages and hosts needn't fit on
    one machine. Without labelled texts no language is known: lang, confidence and text_lang are null. An empty table gives
    an empty result; other columns are left out.
    """
    names, table = fit(labelled)
    n = len(names)
    if not n:
        host, declared = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)), F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1))
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    rows = written(features(pages, names, table).withColumn("text_p", _normal(F.col("loglik"))), "features")
    sums = [F.sum(F.col("text_p")[k]).alias(f"s{k}") for k in range(n)]
    vector = lambda p, of="": F.array(*[F.col(f"{of}s{k}") for k in range(n)]).alias(p)
    hosts = rows.groupBy("host", "domain", "suffix").agg(*sums)
    up = lambda df, by: df.groupBy(*by).agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(n)])
    domains = up(hosts, ["domain", "suffix"])
    suffixes = up(domains, ["suffix"])
    all_v = F.array(*[F.lit(float(x or 0.0)) for x in up(suffixes, []).first()])  # one number a language
    tree = (
        hosts.select("host", "domain", "suffix", vector("host_v"))
        .join(domains.select("domain", "suffix", vector("domain_v")), ["domain", "suffix"])
        .join(suffixes.select("suffix", vector("suffix_v")), "suffix")
    )
    declared = rows.groupBy("declared").agg(*sums).select("declared", vector("declared_v"))
    met = rows.join(tree.drop("domain", "suffix"), "host").join(declared, "declared")
    minus = lambda v: F.zip_with(v, "text_p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)

    def smoothed(own: Column, parent: Column) -> Column:
        return F.zip_with(own, parent, lambda c, p: (c + PARENT_WEIGHT * p) / (total(own) + PARENT_WEIGHT))

    met = met.withColumn("all_v", all_v).withColumns({f"_{k}": minus(f"{k}_v") for k in ("host", "domain", "suffix", "all", "declared")})
    met = met.withColumn("_p0", F.transform("_all", lambda c: (c + SMOOTH) / (total(F.col("_all")) + SMOOTH * n)))
    met = met.withColumn("_p1", smoothed(F.col("_suffix"), F.col("_p0"))).withColumn("_p2", smoothed(F.col("_domain"), F.col("_p1"))).withColumn("_p3", smoothed(F.col("_host"), F.col("_p2")))
    # P(declared | language) up to a factor that is the same for all languages; none declared says nothing.
    says = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(F.col("declared") == "", F.lit(0.0)).otherwise(F.log((F.get("_declared", k) + SMOOTH * F.when(F.get(F.array(*map(F.lit, names)), k) == F.col("declared"), F.lit(float(n))).otherwise(F.lit(1.0))) / (F.get("_all", k) + SMOOTH * n))))
    met = met.withColumn("_log", F.zip_with(F.zip_with("loglik", F.transform("_p3", lambda p: F.log(p)), lambda a, b: a + b), says, lambda a, b: a + b))
    met = met.withColumn("_post", _normal(F.col("_log")))
    best = lambda p: F.get(F.array(*map(F.lit, names)), (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    return met.select("page_id", best(F.col("_post")).alias("lang"), F.array_max("_post").alias("confidence"), best(F.col("text_p")).alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), F.nullif("host", F.lit("")).alias("host"))
