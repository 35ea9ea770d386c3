"""Language of web pages by Bayesian fusion of evidence (operator 10).

Four sources are taken as independent given the language: the page's text (naive Bayes over hashed character trigrams,
learned from documents whose language is known), the language its markup declares, the suffix of its address, and a
prior of its host. How far declarations and suffixes can be trusted, and the priors, come from grouped counts of what the
text alone says over all other pages; a host's prior leans on its domain's as far as the host is small, and a domain's on
that of all pages.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerlake.llm.common import Scratch, arrow_map

SLOTS = 1 << 15
#: Labelled rows of each language that the text model learns from: a bounded sample, by hash of doc_id.
ROWS = 6_000
EFFECTIVE = 60  # trigrams as which a longer text counts, as neighbours aren't independent: some ten words, by hand
SMOOTH = 20.0  # pages as which the prior of all pages counts against a host's own

#: What holds no text and no tags of the page: comments (also "<!-->") and raw text; those that never end hide the rest.
UNTAGGED = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
TAG = re.compile(r"<[/!?A-Za-z][^>]*(?:>|\Z)")
ROOT = re.compile(r"<html\b[^>]*", re.I)
DECLARED = re.compile(r"[\s\"'/]lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)
SPACE = re.compile(r"[\W\d_]+")


def visible(tagged: str) -> str:
    """The text of a page without comments and raw text."""
    return markup.unescape(TAG.sub(" ", tagged))


def declared(tagged: str) -> str | None:
    """Main language subtag of the html element, wherever it stands in a page without comments and raw text."""
    for tag in ROOT.finditer(tagged):
        if found := DECLARED.search(tag[0]):
            return found[1].lower()
    return None


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, its domain and its last label. A domain is the last two labels, or three if the last but one is as short as
    those under which countries register names (`co`, `com`, `ac`).
    """
    try:
        host = urlsplit(url or "").hostname
    except ValueError:
        host = None
    if not host:
        return None, None, None
    labels = host.split(".")
    wide = 3 if len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3 else 2
    return host, ".".join(labels[-wide:]), labels[-1]


def trigrams(text: str) -> np.ndarray:
    """Slots of the text's character trigrams; letters in lower case, all else one space."""
    x = np.frombuffer(f" {SPACE.sub(' ', text.lower())} ".encode("utf-32-le", "surrogatepass"), "<u4")
    if len(x) < 3:
        return np.empty(0, np.int64)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) % np.uint32(SLOTS)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # SLOTS rows; a column for each language


def train(documents: DataFrame, rows: int = ROWS) -> TextModel:
    """Trigram log-probabilities from at most about `rows` documents of each language in `lang`.

    Rows without a language, id or text are passed over.
    """
    known = documents.where("lang is not null and doc_id is not null and text is not null").select(F.col("lang").cast("string"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return TextModel([], np.zeros((SLOTS, 0)))
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / sizes[lang]))).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000 < share)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(SLOTS, np.int64))
                own += np.bincount(trigrams(text), minlength=SLOTS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "slot", "n"])

    counted = arrow_map(sample.select("lang", "text"), work, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows a language
    table = np.zeros((SLOTS, len(languages)))
    of = {lang: i for i, lang in enumerate(languages)}
    table[counted.column("slot").to_numpy(), [of[x] for x in counted.column("lang").to_pylist()]] = counted.column("n").to_numpy()
    return TextModel(languages, np.log((table + 0.1) / (table + 0.1).sum(axis=0)))


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, suffix, declared, logs (of the text under each language, as EFFECTIVE trigrams at most),
    said (place of the text's own language; null without letters).
    """
    kept = pages.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers a language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, width = kept.value.logs, len(kept.value.languages)
        for batch in batches:
            hosts = list(zip(*[address(x) for x in batch.column("url").to_pylist()], strict=True)) or [[]] * 3
            tagged = [UNTAGGED.sub(" ", x or "") for x in batch.column("html").to_pylist()]
            seen = [visible(x) for x in tagged]
            found = [trigrams(x) if SPACE.sub("", x) else np.empty(0, np.int64) for x in seen]
            sums = [logs[x].sum(axis=0) * min(1.0, EFFECTIVE / max(1, len(x))) if len(x) else np.zeros(width) for x in found]
            said = [int(s.argmax()) if len(x) else None for x, s in zip(found, sums, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(list(h), pa.string()) for h in hosts), pa.array([declared(x) for x in tagged], pa.string()), pa.array([x.tolist() for x in sums], pa.list_(pa.float64())), pa.array(said, pa.int32())], ["page_id", "host", "domain", "suffix", "declared", "logs", "said"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return arrow_map(rows, work, "page_id long, host string, domain string, suffix string, declared string, logs array<double>, said int")


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, lang, confidence (posterior), text_lang (of the text alone), declared, host of every page.

    With n(x, l) pages of value x of which the text says l, and n(l) of all pages:
    prior of all pages p(l) = (n(l) + 1) / (n + languages); of a domain (n(domain, l) + SMOOTH p(l)) / (n(domain) + SMOOTH);
    of a host (n(host, l) + SMOOTH p(domain, l)) / (n(host) + SMOOTH); likelihood of a declaration or suffix
    (n(x, l) + 1) / (n(l) + 1). A page's own text is taken out of all counts before it is judged, as it is evidence of its
    own. A page without text, declaration or address is judged by what is left, in the end by the prior of all pages.
    Without any language to choose from, lang is null. Null ids stay null; repeated rows are judged each. Ties go to the
    language that comes first in the alphabet.
    """
    languages, m = model.languages, len(model.languages)
    if not languages:
        rows = pages.select(F.col("page_id").cast("long"))
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), *(F.lit(None).cast("string").alias(x) for x in ("text_lang", "declared", "host")))
    scratch = Scratch(pages.sparkSession, "langid")
    found = scratch.keep(evidence(pages, model))

    def counted(*by: str) -> DataFrame:
        rows = found.where("said is not null").groupBy(*by).agg(*(F.count(F.when(F.col("said") == i, 1)).cast("double").alias(f"_{i}") for i in range(m)))
        return rows.select(*by, F.array(*(f"_{i}" for i in range(m))).alias("n_" + (by[0] if by else "all")))

    everywhere = counted().first()[0]
    joined = found
    for by in ("declared", "suffix", "domain", "host"):
        joined = joined.join(scratch.keep(counted(by).where(F.col(by).isNotNull())), by, "left")

    def n(name: str, i: int) -> Column:
        """Pages of the same value of which the text says language i, without this page."""
        return F.coalesce(F.col(f"n_{name}")[i] - own(i), F.lit(0.0))

    def own(i: int) -> Column:
        return F.coalesce((F.col("said") == i).cast("double"), F.lit(0.0))

    def total(name: str) -> Column:
        return F.coalesce(F.aggregate(f"n_{name}", F.lit(0.0), lambda a, x: a + x) - F.col("said").isNotNull().cast("double"), F.lit(0.0))

    logs = []
    for i in range(m):
        same = F.lit(everywhere[i]) - own(i)
        prior = (same + 1) / (F.lit(sum(everywhere) + m) - F.col("said").isNotNull().cast("double"))
        for level in ("domain", "host"):
            prior = (n(level, i) + SMOOTH * prior) / (total(level) + SMOOTH)
        likely = [F.when(F.col(f"n_{x}").isNotNull(), F.log((n(x, i) + 1) / (same + 1))).otherwise(0.0) for x in ("declared", "suffix")]
        logs.append(F.col("logs")[i] + likely[0] + likely[1] + F.log(prior))
    scored = joined.withColumn("each", F.array(*logs)).withColumn("top", F.array_max("each"))
    names = F.array(*map(F.lit, languages))
    confidence = 1 / F.aggregate("each", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return scratch.result(scored.select("page_id", F.element_at(names, F.array_position("each", F.col("top")).cast("int")).alias("lang"), confidence.alias("confidence"), F.get(names, F.col("said")).alias("text_lang"), "declared", "host"))
