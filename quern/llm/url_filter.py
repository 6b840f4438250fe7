"""URL verdicts: host and path rules, and for the rest a logistic regression on hashed character n-grams.

The rules and the parts of a URL are DataFrame expressions. The model is fitted on the driver from a labelled table
that is small by contract (``max_rows``), and its weights go to the tasks inside the function: 2**``bits`` floats.

Defined cases. A null URL or one without "://" has an empty host and path, fits no rule, and is judged by the model
from no n-grams (the prior). Of rules that fit, the longest wins; equal ones can't both fit unless they are the same.
Repeated rows are judged row by row. Other columns of the caller, whatever their names, are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import csv
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import col, map_text

#: (verdict, host, path prefix). A rule fits its host and all subdomains.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: The labelled table of this folder: label (1: unwanted), host, path; general kinds of sites, not given pages.
LABELS = Path(__file__).with_name("url_labels.csv")
#: Forms in which each of its hosts is learned, and paths that both labels have.
SUBDOMAINS = ("", "www.", "blog.", "m.")
PATHS = ("/", "/en/12", "/de/index", "/2019/05/3")


def labelled_urls(spark: SparkSession, path: str | Path = LABELS) -> DataFrame:
    """The small table that the model is trained from, of a CSV file (label, host, path) on the driver: url, label. Each host has its own path and one that both labels have."""
    with open(path, encoding="utf-8", newline="") as f:
        table = [(int(r["label"]), r["host"], r["path"]) for r in csv.DictReader(f)]
    rows = []
    for n, (label, host, own) in enumerate(table):
        for k, sub in enumerate(SUBDOMAINS):
            rows += [(f"https://{sub}{host}{own}", label), (f"https://{sub}{host}{PATHS[(n + k) % len(PATHS)]}", label)]
    return spark.createDataFrame(rows, "url string, label int")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path by the contract; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    found = said = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.lit(h + p)) if found is None else found.when(fits, F.lit(h + p))
        said = F.when(fits, F.lit(verdict)) if said is None else said.when(fits, F.lit(verdict))
    return found, said


def _grams(texts: list[str], bits: int, sizes=(3, 4, 5)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of each text: text number, slot, weight (n-grams of a text weigh 1 together)."""
    flat = [np.frombuffer(("\x02" + t + "\x03").encode("utf-32-le"), "<u4").astype(np.uint64) for t in texts]
    doc, slot, weight = [], [], []
    for i, a in enumerate(flat):
        got = []
        for n in sizes:
            if len(a) >= n:
                h = np.full(len(a) - n + 1, n, np.uint64)
                for j in range(n):
                    h = (h ^ a[j : len(a) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                got.append((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits))
        s = np.concatenate(got) if got else np.zeros(0, np.uint64)
        doc.append(np.full(len(s), i))
        slot.append(s.astype(np.int64))
        weight.append(np.full(len(s), 1 / np.sqrt(max(1, len(s)))))
    return np.concatenate(doc), np.concatenate(slot), np.concatenate(weight)


def fit_url_model(labelled: DataFrame, bits: int = 14, rounds: int = 300, rate: float = 2.0, l2: float = 1e-4, max_rows: int = 50_000) -> np.ndarray:
    """Weights of the n-gram slots, the bias last. ``labelled`` (host and path as text, label) must be small: max_rows at most."""
    host, path = url_parts(F.col("url"))
    rows = labelled.select(F.concat(host, path).alias("t"), "label").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"the labelled URL table has more than {max_rows} rows")
    rows = sorted((r.t, r.label) for r in rows)
    y = np.array([v for _, v in rows], float)
    doc, slot, weight = _grams([t for t, _ in rows], bits)
    w, bias, g2 = np.zeros(1 << bits), 0.0, np.full(1 << bits, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(doc, w[slot] * weight, len(y)) + bias)))
        e = (p - y) / len(y)
        g = np.bincount(slot, e[doc] * weight, 1 << bits) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2) * 0.1
        bias -= rate * e.sum()
    return np.append(w, bias).astype(np.float32)


class Score:
    """Probability that a URL is unwanted, from host and path."""

    def __init__(self, weights: np.ndarray, bits: int):
        self.weights, self.bits = weights, bits

    def __call__(self, texts: list[str]) -> dict:
        doc, slot, weight = _grams(texts, self.bits)
        z = np.bincount(doc, self.weights[slot] * weight, len(texts)) + self.weights[-1]
        return {"p_unwanted": 1 / (1 + np.exp(-z))}


def judge_urls(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5, bits: int = 14) -> DataFrame:
    """Per page: id, host, path, rule, verdict (the rule's, else the model's), p_unwanted."""
    host, path = url_parts(col(url_col))
    parts = pages.select(col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("said", F.concat("host", "path"))
    scored = map_text(parts, "said", ["id", "host", "path"], Score(weights, bits), "p_unwanted double")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("p_unwanted") >= threshold, "block").otherwise("allow")).alias("verdict"), "p_unwanted")
