"""Corpus maintenance: identities, incremental indexing, OCR merging, coverage, conflicts, metadata repair."""

from __future__ import annotations

import difflib
import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specaudit.functions import text
from specaudit.sources.versions import cut

IDENTITY_VERSION = "registry-first-v1"
SUPPLEMENT = "[OCR figure/table supplement]"
OCR_SHARE = 0.25
#: Characters of a cover in which a standard is looked for.
COVER_CHARS = 12_000


# --- identity ------------------------------------------------------------------------------------------------------


def resolve_policies(documents: DataFrame, policies: DataFrame) -> DataFrame:
    """``source_path, standard_id, edition_year, method``: by digest, else by file name, else by alias; only if exactly one policy matches.

    documents: ``source_path, source, document_sha256``; policies: ``standard_id, active_edition_year, approved_sha256, approved_sources, source_aliases``.
    """

    def unique(key: str, values: str, method: str) -> DataFrame:
        own = policies.select(F.explode(F.array_distinct(F.transform(values, lambda x: F.lower(x)))).alias("__k"), "standard_id", "active_edition_year")
        one = own.groupBy("__k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("standard_id", "active_edition_year")).alias(method)).where("n = 1").drop("n")
        return one.withColumnRenamed("__k", f"__{method}")

    ways = (("document_sha256", "approved_sha256", "registry_sha256"), ("source", "approved_sources", "registry_source"), ("source", "source_aliases", "registry_alias"))
    out = documents
    for key, values, method in ways:
        out = out.join(unique(key, values, method), F.lower(F.col(key)) == F.col(f"__{method}"), "left").drop(f"__{method}")
    best = F.coalesce(*(m for _, _, m in ways))
    method = F.coalesce(*(F.when(F.col(m).isNotNull(), m) for _, _, m in ways))
    return out.select("source_path", best["standard_id"].alias("standard_id"), best["active_edition_year"].alias("edition_year"), method.alias("method"))


def identify(documents: DataFrame, policies: DataFrame) -> DataFrame:
    """Identity of each document: the registry first, then the cover, the file name, and both with OCR repair.

    documents: ``source_path, source, document_sha256, cover``.
    """
    registered = resolve_policies(documents, policies).select(F.col("source_path").alias("__p"), F.col("standard_id").alias("__id"), F.col("edition_year").alias("__year"), F.col("method").alias("__m"))
    cover, name = F.coalesce("cover", F.lit("")), F.col("source")
    head = F.substring(cover, 1, 12_000)
    steps = (("cover_regex", 0.95, head), ("filename_regex", 0.82, name), ("ocr_normalized_cover", 0.88, text.repair_ocr(head)), ("ocr_normalized_filename", 0.78, text.repair_ocr(name)))

    def found(sample: Column, method: str, confidence: float) -> Column:
        own = text.standard_identity(sample, cover)
        return F.when(own.isNotNull(), F.struct(own["standard_id"].alias("standard_id"), own["edition_year"].alias("edition_year"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")))

    by_registry = F.when(F.col("__id").isNotNull(), F.struct(F.col("__id").alias("standard_id"), F.col("__year").cast("int").alias("edition_year"), F.col("__m").alias("method"), F.when(F.col("__m") == "registry_sha256", 1.0).otherwise(0.98).alias("confidence")))
    unknown = F.struct(F.lit(None).cast("string").alias("standard_id"), F.lit(None).cast("int").alias("edition_year"), F.lit("unknown").alias("method"), F.lit(0.0).alias("confidence"))
    best = F.coalesce(by_registry, *(found(s, m, c) for m, c, s in steps), unknown)
    return documents.join(registered, F.col("source_path") == F.col("__p"), "left").withColumn("identity", best).select(*documents.columns, "identity.*")


def strict_identity(documents: DataFrame) -> DataFrame:
    """``standard_id, edition_year`` by patterns alone, without a registry: cover, file name, then both with misread prefixes repaired.

    documents: ``source_path, source, cover``.
    """
    cover = F.coalesce("cover", F.lit(""))
    samples = [F.substring(cover, 1, COVER_CHARS), F.col("source")]
    found = [text.standard_identity(s, cover) for s in (*samples, *(text.repair_ocr(s) for s in samples))]
    best = F.coalesce(*(F.when(x["standard_id"].isNotNull(), x) for x in found))
    return documents.withColumn("__x", best).select(*documents.columns, F.col("__x.standard_id").alias("standard_id"), F.col("__x.edition_year").alias("edition_year"))


#: Widths of windows differ by so much at most.
SPREAD = 4


def window_score(needle: str, hay: str, least: float, whole: int | None = None, sums: dict[str, np.ndarray] | None = None) -> float:
    """Best ratio of ``needle`` to a window of ``hay`` about as wide; 0 where none reaches ``least``.

    ``whole`` is the length of the text that ``hay`` is a stretch of; ``sums`` keeps what is counted in ``hay`` from needle to needle.
    A window's shared characters bound its ratio, so only windows whose bound reaches ``least`` are matched.  A window shares no more than the
    widest from the same place does, so the other widths are looked at only where the widest may reach it.
    """
    most = sum(min(needle.count(c), hay.count(c)) for c in set(needle))
    # no window shares more characters than the whole does, which rules out most widths before any window is looked at
    widths = [w for w in sorted({min(w, len(hay) if whole is None else whole) for w in range(max(3, len(needle) - 2), len(needle) + 3)}) if w <= len(hay) and 2.0 * most + 1e-9 >= least * (len(needle) + w)]
    windows: dict[str, float] = {}
    if widths:
        sums = {} if sums is None else sums
        if fresh := set(needle) - sums.keys():
            codes = np.frombuffer(hay.encode("utf-32-le"), "<u4")
            for c in fresh:
                sums[c] = np.zeros(len(hay) + 1 + SPREAD, np.int32)
                np.cumsum(codes == ord(c), out=sums[c][1 : len(hay) + 1])
                sums[c][len(hay) + 1 :] = sums[c][len(hay)]  # windows that would reach past the end
        counted = [(sums[c], needle.count(c)) for c in set(needle)]
        starts, wide = len(hay) - widths[0] + 1, widths[-1]
        shared = sum((np.minimum(own[wide : wide + starts] - own[:starts], n) for own, n in counted), np.zeros(starts, np.int32))
        places = np.flatnonzero(2.0 * shared + 1e-9 >= least * (len(needle) + widths[0]))
        for wide in widths if len(places) else ():
            at = places[places <= len(hay) - wide]
            bound = 2.0 * sum((np.minimum(own[at + wide] - own[at], n) for own, n in counted), np.zeros(len(at), np.int32)) / (len(needle) + wide)
            good = bound >= least
            windows.update((hay[k : k + wide], b) for k, b in zip(at[good].tolist(), bound[good].tolist(), strict=True))
    matcher = difflib.SequenceMatcher(None, needle, "")
    score = 0.0
    for window, bound in sorted(windows.items(), key=lambda x: -x[1]):
        if bound <= score:
            break
        # the seeker stays the first sequence: the ratio is not symmetric
        matcher.set_seqs(needle, window)
        score = max(score, matcher.ratio())
    return score if score >= least else 0.0


def alignments(m: int, least: float, short: bool = False) -> list[tuple[int, int]]:
    """Widths of windows that can reach ``least`` against ``m`` characters, each with the fewest characters that must match.

    A ratio is 2 M / (m + w) with M matched characters; windows are at most two characters narrower or wider than the needle, or all of a ``short`` text.
    A needle that stands whole in the text counts at any length.
    """
    low = max(3, m - 2)
    fewest = {w: math.ceil(least * (m + w) / 2 - 1e-9) for w in (range(1, low) if short else range(low, max(3, m + 2) + 1))}
    if not short and m < low:
        fewest[m] = m
    return [(w, matched) for w, matched in fewest.items() if matched <= min(m, w)]


def least_shared(m: int, widths: list[tuple[int, int]], size: int) -> int:
    """How many of the ``m - size + 1`` grams of a needle stand unbroken in any of the windows.

    Each of the m - M unmatched characters breaks at most ``size`` grams, each of the window's w - M at most ``size - 1``.
    """
    return min(m - size + 1 - size * (m - matched) - (size - 1) * (w - matched) for w, matched in widths)


def common_subsequence(needle: str, hay: str) -> int:
    """Length of the longest common subsequence, a bit a character of ``needle``."""
    at: dict[str, int] = {}
    for k, c in enumerate(needle):
        at[c] = at.get(c, 0) | 1 << k
    rows, every = (1 << len(needle)) - 1, (1 << len(needle)) - 1
    for c in hay:
        both = rows & at.get(c, 0)
        rows = (rows + both | rows - both) & every
    return len(needle) - rows.bit_count()


def gram_index(known: DataFrame, least: float) -> DataFrame:
    """``needle, gram, place, slack``: the rarest grams of each needle, one of which stands unbroken in any window that reaches ``least``.

    That window holds at most ``slack`` characters of its own.  If n grams are known to stand in it, all but n - 1 of a needle's grams are enough, and the commonest are left out.
    Grams are pairs of characters, or single characters where no pair is certain; those for texts too short for a window begin with ``~``.  known: ``needle``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for needle in pdf["needle"]:
                m = len(needle)
                for short in (False, True):
                    if not (widths := alignments(m, least, short)):
                        continue
                    size = 2 if least_shared(m, widths, 2) > 0 else 1
                    wanted, slack = max(1, least_shared(m, widths, size)), max(w - matched for w, matched in widths)
                    own = [needle[k : k + size] for k in range(m - size + 1)]
                    rows += [(needle, "~" * short + g, k, len(own) - wanted + 1, slack) for k, g in enumerate(own)]
            yield pd.DataFrame(rows, columns=["needle", "gram", "place", "kept", "slack"])

    own = cut(known.select("needle").distinct().mapInPandas(run, "needle string, gram string, place int, kept int, slack int"))
    common = own.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("needle", F.col("gram").startswith("~")).orderBy("n", "place"))
    return own.join(common, "gram").withColumn("rank", rank).where(F.col("rank") <= F.col("kept")).drop("rank", "n", "kept")


def fuzzy_candidates(unknown: DataFrame, known_ids: list[str], least: float = 0.78) -> DataFrame:
    """A likely standard for documents without identity; a suggestion that is never taken for a fact.

    known_ids is the registry's list (tens); :func:`indexed_candidates` takes a table of many.  Gives ``source_path, candidate_standard_id, candidate_score``.
    """
    squeezed = {i: re.sub(r"[^A-Z0-9]", "", i.upper()) for i in known_ids}

    def best(hay: str) -> tuple[str | None, float | None]:
        numbers = {int(x) for x in re.findall(r"SP0*(\d{1,3})", hay)}
        named = [i for i in known_ids if i.upper() in {f"IRC:SP:{n}" for n in numbers}]
        if len(named) == 1:
            return named[0], 0.96
        top: tuple[float, str | None] = (0.0, None)
        sums: dict[str, np.ndarray] = {}
        for i, needle in squeezed.items():
            if needle in hay:
                score = 1.0 if needle else 0.0
            else:
                # an id that only ties with an earlier one isn't taken, so none below the best so far is matched
                score = window_score(needle, hay, max(least, top[0]), sums=sums)
            top = max(top, (score, i), key=lambda x: x[0])
            if top[0] >= 1.0:
                break
        return (None, None) if top[0] < least else (top[1], round(top[0], 4))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *best(h or "")) for p, h in pdf.itertuples(index=False)], columns=["source_path", "candidate_standard_id", "candidate_score"])

    hay = F.regexp_replace(F.upper(text.repair_ocr(F.concat_ws(" ", "source", F.substring(F.coalesce("cover", F.lit("")), 1, 3000)))), "[^A-Z0-9]", "")
    return unknown.select("source_path", hay.alias("hay")).mapInPandas(run, "source_path string, candidate_standard_id string, candidate_score double")


def indexed_candidates(unknown: DataFrame, known: DataFrame, least: float = 0.78) -> DataFrame:
    """As :func:`fuzzy_candidates`, for thousands of known ids: each costs something only where a text looks like it.

    known: ``position, standard_id``, the position being the order at ties.  Gives ``source_path, candidate_standard_id, candidate_score``, a row
    a row of ``unknown``.  One id whose SP number the text names scores 0.96; else the best ratio of an id to a window of the text counts, the first id at ties, if it reaches ``least``.

    Places are found by an index of the ids' rarest grams; what they could be part of is a stretch little longer than the id, and only
    stretches with a common subsequence long enough meet the sequence matcher.  So the work grows with places that look like an id, not with documents times ids.  Null texts are empty; repeated ids count once; ids without a letter or digit are never suggested.
    """
    ids = known.where("standard_id is not null")
    ids = ids.groupBy("standard_id").agg(F.min("position").alias("position")).withColumn("needle", F.regexp_replace(F.upper("standard_id"), "[^A-Z0-9]", ""))
    needles = ids.where("needle <> ''").groupBy("needle").agg(F.min(F.struct("position", "standard_id")).alias("first"))
    index = gram_index(needles, least)
    reach = index.agg(F.max(F.greatest(F.length("needle"), F.lit(3)) + F.col("slack"))).first()[0] or 1

    hay = F.regexp_replace(F.upper(text.repair_ocr(F.concat_ws(" ", "source", F.substring(F.coalesce("cover", F.lit("")), 1, 3000)))), "[^A-Z0-9]", "")
    documents = unknown.select("source_path", hay.alias("hay")).withColumn("key", F.sha2("hay", 256))
    texts = documents.groupBy("key").agg(F.first("hay").alias("hay"))

    numbers = F.array_distinct(F.transform(F.regexp_extract_all("hay", F.lit(r"SP0*(\d{1,3})"), F.lit(1)), lambda n: F.concat(F.lit("IRC:SP:"), n.cast("int").cast("string"))))
    named = texts.select("key", F.explode(numbers).alias("named")).join(ids.select("standard_id", F.upper("standard_id").alias("named")), "named")
    named = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("standard_id").alias("__named")).where("n = 1").drop("n")

    pairs = F.transform(F.sequence(F.lit(1), F.length("hay")), lambda k: F.col("hay").substr(k, F.lit(2)))
    places = texts.where("hay <> ''").select("key", "hay", F.posexplode(pairs).alias("at", "pair"))
    # what a window around the place can hold, so that no text travels with each of its places
    before = F.least("at", F.lit(reach))
    around = F.col("hay").substr(F.col("at") - before + 1, before + F.lit(reach))
    grams = F.array_distinct(F.array("pair", F.substring("pair", 1, 1)))
    grams = F.when(F.length("hay") < reach, F.concat(grams, F.transform(grams, lambda g: F.concat(F.lit("~"), g)))).otherwise(grams)
    places = places.select("key", F.length("hay").alias("whole"), around.alias("around"), before.alias("before"), F.explode(grams).alias("gram"))
    own = F.least("before", F.col("place") + F.col("slack"))
    window = F.col("around").substr(F.col("before") - own + 1, own - F.col("place") + F.length("needle") + F.col("slack"))
    likely = places.join(index, "gram").select("key", "needle", window.alias("window"), F.least("whole", F.length("needle") + 2).alias("whole")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @functools.lru_cache(maxsize=100_000)
        def score(needle: str, window: str, whole: int) -> float:
            if needle in window:
                return 1.0
            return window_score(needle, window, least, whole) if common_subsequence(needle, window) >= fewest(len(needle), whole) else 0.0

        @functools.cache
        def fewest(m: int, whole: int) -> int:
            return min((matched for _, matched in alignments(m, least, whole < max(3, m - 2))), default=m + 1)

        for pdf in batches:
            scores = [score(*x) for x in zip(pdf["needle"], pdf["window"], pdf["whole"], strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "needle": pdf["needle"], "score": scores, "shown": [round(x, 4) for x in scores]})

    scored = likely.mapInPandas(run, "key string, needle string, score double, shown double").where(F.col("score") >= least)
    best = scored.join(needles, "needle").groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "first", "shown")).alias("__best"))
    out = documents.select("source_path", "key").join(best, "key", "left").join(named, "key", "left")
    standard = F.coalesce("__named", "__best.first.standard_id").alias("candidate_standard_id")
    return out.select("source_path", standard, F.when(F.col("__named").isNotNull(), 0.96).otherwise(F.col("__best.shown")).alias("candidate_score"))


def covers(pages: DataFrame, first: int = 4) -> DataFrame:
    """``source_path, cover``: text of the first pages in order."""
    own = pages.where(F.col("page") <= first).groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return own.select("source_path", F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("cover"))


def source_approved(source: Column, sha: Column, approved_sources: Column, approved_sha: Column) -> Column:
    return F.coalesce(F.array_contains(approved_sources, source) & F.array_contains(approved_sha, sha), F.lit(False))


def policy_verified(p: str = "") -> Column:
    """A policy counts only with year, sources, digests, address, licence, reviewer and date."""
    c = lambda n: F.col(f"{p}{n}")
    filled = [c("active_edition_year").isNotNull(), F.size(c("approved_sources")) > 0, F.size(c("approved_sha256")) > 0, *(text.known(c(n)).isNotNull() for n in ("official_source_url", "licence_basis", "reviewed_by", "reviewed_on"))]
    out = filled[0]
    for x in filled[1:]:
        out = out & x
    return F.coalesce(out, F.lit(False))


# --- incremental indexing ------------------------------------------------------------------------------------------


def unchanged(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose path, digest and versions are in the manifest."""
    keys = ["source_path", "document_sha256", "chunking_version", "identity_version"]
    return found.join(manifest.select(*keys), keys, "left_semi")


def to_index(found: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Documents to index: neither unchanged (unless forced) nor the same content under another path.

    Of equal content within ``found`` the first path goes; the rest are duplicates even when forced.
    """
    keys = ["source_path", "document_sha256", "chunking_version", "identity_version"]
    fresh = found if force else found.join(manifest.select(*keys), keys, "left_anti")
    elsewhere = manifest.select(F.col("document_sha256").alias("__sha"), F.col("source_path").alias("__path"))
    alone = fresh.join(elsewhere, (F.col("document_sha256") == F.col("__sha")) & (F.col("source_path") != F.col("__path")), "left_anti")
    first = alone.groupBy("document_sha256").agg(F.min("source_path").alias("source_path"))
    return alone.join(first, ["document_sha256", "source_path"], "left_semi")


def duplicate_content(found: DataFrame) -> DataFrame:
    """``source_path, first_path``: documents whose content stands under an earlier path."""
    first = found.groupBy("document_sha256").agg(F.min("source_path").alias("first_path"))
    return found.join(first, "document_sha256").where(F.col("source_path") != F.col("first_path")).select("source_path", "first_path")


def to_prune(manifest: DataFrame, active: DataFrame, folders: list[str]) -> DataFrame:
    """Indexed sources under one of the folders that are gone."""
    inside = F.lit(False)
    for f in folders:
        inside = inside | F.col("source_path").startswith(f.rstrip("/") + "/")
    return manifest.where(inside).join(active.select("source_path"), "source_path", "left_anti")


# --- pages ---------------------------------------------------------------------------------------------------------


def needs_ocr(pages: DataFrame) -> DataFrame:
    """``source_path, weak_share, ocr``: documents with more than a quarter of weak pages."""
    share = F.avg(text.weak_page(F.col("text")).cast("int"))
    return pages.groupBy("source_path").agg(share.alias("weak_share")).withColumn("ocr", F.col("weak_share") > OCR_SHARE)


def merge_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Base pages with what OCR adds: whole text on weak pages, else new lines with a dimension or a figure label.

    Both: ``source_path, page, text, parser``.  Pages that only OCR knows are kept.
    """
    o = ocr.select("source_path", "page", F.col("text").alias("o_text"), F.col("parser").alias("o_parser"))
    j = pages.join(o, ["source_path", "page"], "full")
    base = F.lower(text.normalize_text(F.col("text")))
    lines = F.transform(F.split("o_text", "\n"), lambda x: text.normalize_text(x))
    # the page is normalised once, not for each line, and only lines of interest are looked for in it
    wanted = F.array_distinct(F.filter(lines, lambda x: (F.length(x) >= 4) & (x.rlike(text.DIMENSION_LINE) | x.rlike(text.LOCATOR_LINE))))
    new = text.let(base, lambda own: F.filter(wanted, lambda x: ~F.contains(own, F.lower(x))))
    longer = F.length("o_text") > F.length("text")
    weak = text.weak_page(F.col("text"))
    # the new lines are worked out once; text and parser follow from them
    j = j.withColumn("__new", F.array_join(new, "\n")).withColumn("__takes", F.when(F.col("text").isNull() | (F.col("o_text").isNotNull() & weak & longer), "ocr").when(F.col("o_text").isNull() | weak | (F.col("__new") == ""), "base").otherwise("both"))
    merged = text.normalize_text(F.concat(F.col("text"), F.lit(f"\n\n{SUPPLEMENT}\n"), F.col("__new")))
    takes = F.col("__takes")
    body = F.when(takes == "ocr", F.col("o_text")).when(takes == "both", merged).otherwise(F.col("text"))
    parser = F.when(takes == "ocr", F.col("o_parser")).when(takes == "both", F.concat_ws("+", "parser", "o_parser")).otherwise(F.col("parser"))
    return j.select("source_path", "page", body.alias("text"), parser.alias("parser"))


def page_coverage(pages: DataFrame, key: str = "source_path") -> DataFrame:
    """Pages, weak pages, coverage (four places) and parsers of each document."""
    weak = text.weak_page(F.col("text")).cast("int")
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.sum(weak).alias("low_text_pages"), F.bround(F.lit(1.0) - F.avg(weak), 4).alias("coverage"), F.array_sort(F.collect_set("parser")).alias("parsers"))


# --- health --------------------------------------------------------------------------------------------------------


def editions(chunks: DataFrame) -> DataFrame:
    """Editions of each standard in the corpus."""
    return chunks.where("standard_id is not null and edition_year is not null").groupBy("standard_id").agg(F.array_sort(F.collect_set("edition_year")).alias("editions"))


def edition_conflicts(documents: DataFrame) -> DataFrame:
    """Standards with more than one document: their editions and the number of documents."""
    own = documents.where("standard_id is not null").groupBy("standard_id").agg(F.count(F.lit(1)).alias("documents"), F.array_sort(F.collect_set("edition_year")).alias("editions"))
    return own.where("documents > 1")


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """One row of counters for a health check."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return manifest.agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("low_text_pages"), F.lit(0)).alias("low_text_pages"),
        n(F.col("failed")).alias("failed"), n(F.col("standard_id").isNull()).alias("unknown_identity"), n(F.col("identity_version") != IDENTITY_VERSION).alias("stale_identity"),
    )


def uncovered_metrics(metrics: DataFrame, policies: DataFrame) -> DataFrame:
    """Metrics that no verified policy of a preferred standard covers.  Both are catalogues of tens of rows."""
    verified = policies.where(policy_verified()).select(F.upper("standard_id").alias("__s"))
    wanted = metrics.select("key", F.explode("preferred").alias("p"))
    return metrics.select("key").join(wanted.join(verified, F.col("__s").startswith(F.upper("p"))), "key", "left_anti")


def repair_metadata(chunks: DataFrame, identities: DataFrame) -> DataFrame:
    """Chunks whose standard or edition changes under the documents' new identities; unknown new values keep the only old one.

    identities: ``document_sha256, standard_id, edition_year``.
    """
    old = chunks.groupBy("document_sha256").agg(F.collect_set("standard_id").alias("ids"), F.collect_set("edition_year").alias("years"))
    only = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    new = old.join(identities.withColumnRenamed("standard_id", "i").withColumnRenamed("edition_year", "y"), "document_sha256", "left").select("document_sha256", F.coalesce("i", only("ids")).alias("new_id"), F.coalesce("y", only("years")).alias("new_year"))
    j = chunks.join(new, "document_sha256").where(~F.col("standard_id").eqNullSafe(F.col("new_id")) | ~F.col("edition_year").eqNullSafe(F.col("new_year")))
    return j.withColumn("standard_id", F.col("new_id")).withColumn("edition_year", F.col("new_year")).drop("new_id", "new_year")


def repair_counts(chunks: DataFrame, identities: DataFrame) -> DataFrame:
    """One row: ``passages, documents, standards, editions`` that :func:`repair_metadata` changes."""
    new = repair_metadata(chunks, identities).select("chunk_id", "document_sha256", F.col("standard_id").alias("s"), F.col("edition_year").alias("y"))
    both = new.join(chunks.select("chunk_id", "standard_id", "edition_year"), "chunk_id")
    n = lambda a, b: F.coalesce(F.sum((~F.col(a).eqNullSafe(F.col(b))).cast("long")), F.lit(0))
    return both.agg(F.count(F.lit(1)).alias("passages"), F.countDistinct("document_sha256").alias("documents"), n("s", "standard_id").alias("standards"), n("y", "edition_year").alias("editions"))


def structured_hits(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Transcribed evidence whose document is in the manifest with the same digest."""
    own = manifest.where("document_sha256 is not null and document_sha256 <> ''").select(F.col("document_sha256").alias("source_sha256")).distinct()
    return records.join(own, "source_sha256", "left_semi")
