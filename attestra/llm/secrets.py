"""Secret scans: fixed formats, and novelty against a primed compressor.

Base spans come from three formats.  The method adds spans: a candidate is a long
unbroken string anywhere on a line with a sensitive word, or within a key block.  Its
novelty is what it costs a zstandard compressor that already knows the identifier
dictionary and the text around it: the compressed bytes of surroundings and candidate,
less those of the surroundings alone.  Prose, paths and identifiers repeat what the
compressor has seen; keys do not.  Candidates whose marginal bytes come close to their
entropy limit are reported, unless a base span covers them.  Base spans are weighed
alike, and stay whatever they weigh.

The surroundings are ``AROUND`` characters on each side, which is part of the measure;
so a candidate costs the same work in a text of any length.

Defined results: null text is the empty text, with no spans; repeated rows give
repeated rows; an empty table gives no rows; extra columns are ignored; texts of
any length are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
SENSITIVE = re.compile(r"pass|secret|token|key|auth|cred|bearer|private|signature|login|pwd", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "key")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]+-----(.*?)(?:-----END|\Z)", re.DOTALL)
SHORTEST = 16
#: Characters of surroundings on each side that the compressor knows.
AROUND = 2048
#: Share of its entropy limit from which a candidate counts as novel: 4 bits a character in hexadecimal, else 6.
NOVEL = 0.82
HEXADECIMAL = re.compile(r"[0-9a-fA-F-]+")
#: Words of code and prose that surround secrets.
DICTIONARY = (
    "password passwd secret token api_key apikey access_key private_key client_secret authorization bearer signature "
    "login username user account config settings default value return import from class function const static public "
    "private string import os environ getenv http https localhost example com org net json yaml true false none null "
    "database connection host port server client request response session cookie header content type length encoding "
    "the and of to in is it that was for on are with as his they be at one have this or had by not but what some we "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 deadbeef 0000000000000000 ================ ----------------"
).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), in that order."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Marginal compressed bytes of a string in its surroundings."""

    def __init__(self, level: int = 3):
        import zstandard

        primed = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False).compress

    def __call__(self, text: str, start: int, end: int) -> int:
        around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode("utf-8", "surrogatepass")
        return len(self.compress(around + text[start:end].encode("utf-8", "surrogatepass"))) - len(self.compress(around))


def places(text: str) -> Iterator[tuple[int, int]]:
    """[start, end) of the lines with a sensitive word and of the key blocks, none twice, in order."""
    found = [m.span(1) for m in BLOCK.finditer(text)] if "-----BEGIN " in text else []
    end = 0
    for word in SENSITIVE.finditer(text):
        if word.start() >= end:
            end = text.find("\n", word.end())
            end = len(text) if end < 0 else end
            found.append((text.rfind("\n", 0, word.start()) + 1, end))
    at = 0
    for start, end in sorted(found):
        if end > max(at, start):
            yield max(at, start), end
            at = end


def novel_spans(text: str, covered: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, marginal bytes) of what is novel and overlaps none of ``covered``, which is sorted."""
    found, ends = [], list(accumulate((e for _, _, e in covered), max))
    for start, stop in places(text):
        for m in RUN.finditer(text, start, stop):
            own = m[0]
            # a run of letters in one case, as in prose, holds no key
            if len(own) < SHORTEST or own.isalpha() and (own[1:].islower() or own.isupper()):
                continue
            before = bisect_left(covered, (m.end(),))
            if before and ends[before - 1] > m.start():
                continue
            limit = (4 if HEXADECIMAL.fullmatch(own) else 6) / 8 * len(own)
            if (cost := novelty(text, *m.span())) >= NOVEL * limit:
                found.append((m.start(), 3, m.end(), cost))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and its spans: array of (kind, start, end, novelty), code points, by start and kind; novelty is in marginal bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = Novelty()
        for batch in batches:
            spans = []
            for text in batch["text"].fillna(""):
                base = base_spans(text)
                weighed = [(s, k, e, novelty(text, s, e)) for s, k, e in base]
                spans.append([{"kind": KINDS[k], "start": s, "end": e, "novelty": c} for s, k, e, c in sorted(weighed + novel_spans(text, base, novelty))])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "spans": spans})

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,novelty:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, all spans as text, and their novelty in the same order."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        count("novel").alias("n_novel"), F.array_join(F.transform("spans", lambda s: s["novelty"].cast("string")), ",").alias("novelty"),
    )
