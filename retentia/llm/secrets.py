"""Secret scan: fixed patterns, and strings in a sensitive context that a primed compressor finds new.

A candidate is a run of key-like characters that begins shortly after a word
such as "token" or "private key", on the same line.  What it adds to the
compressed size of the text around it is measured by zstandard, primed with a
dictionary of the corpus's common identifiers.  Names, paths and strings that
the text repeats cost little; a random string costs nearly as many bytes as it
has characters.  Candidates that cost enough are reported beside the matches
of the patterns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.base import pieces
from retentia.session import materialise

KINDS = ("assign", "access", "hex", "novel")
# Bound of the dictionary: the commonest identifiers, and bytes of them.
IDENTIFIERS, DICTIONARY = 20_000, 1 << 16
LEVEL = 19
# Characters of text on each side, and the farthest a candidate begins after a sensitive word.
AROUND, NEAR = 256, 64
# A report needs so many bytes more than so many for each character: a name of two known words stays below, a
# random hexadecimal string of sixteen digits is above.
OVERHEAD, RATE = 3, 0.7
SHORTEST = 12
# Distinct identifiers a task counts before it passes them on.
HELD = 200_000

_ASSIGN = re.compile(
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SENSITIVE = re.compile(
    r"(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credential|bearer|auth(?:orization)?|signature|"
    r"(?:api|access|private|signing|encryption|account|secret)[\x20_-]?key|client[\x20_-]?id|connection[\x20_-]?string)s?(?![a-z])",
    re.ASCII | re.IGNORECASE,
)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_IDENTIFIER = re.compile(r"[A-Za-z_]{3,32}")
_CASES = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")


def identifiers(docs: DataFrame, text: str = "text", most: int = IDENTIFIERS) -> DataFrame:
    """The commonest runs of 3 to 32 letters and underscores, ``word`` and ``n``: at most ``most``.

    A run with digits or key-like signs is none, nor are its parts: pieces of a
    secret that is copied about must not make it look known.
    All texts are counted, first per task, then by word.  Words of equal count
    are in or out together: how many words have each count is counted first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()

        def frames() -> Iterator[pd.DataFrame]:
            found = [(w, n) for w, n in counts.items() if _IDENTIFIER.fullmatch(w)]
            counts.clear()
            if found:
                yield pd.DataFrame(found, columns=["word", "n"])

        for batch in batches:
            for value in batch["text"]:
                counts.update(_RUN.findall(value or ""))
                if len(counts) > HELD:
                    yield from frames()
        yield from frames()

    counted = docs.select(F.col(text).alias("text")).mapInPandas(run, "word string, n long")
    counts = materialise(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    # Different counts are few: their sum is at most the number of all words.
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    upto = sizes.withColumn("upto", F.sum("words").over(Window.orderBy(F.col("n").desc())))
    cut = upto.where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    return counts.where(F.col("n") >= cut) if cut else counts.limit(0)


def dictionary(words: DataFrame, size: int = DICTIONARY) -> bytes:
    """Identifiers as the content of a compression dictionary, the commonest last, where they are cheapest."""
    chosen, left = [], size
    for row in sorted(words.collect(), key=lambda r: (-r["n"], r["word"])):
        left -= len(row["word"]) + 1
        if left < 0:
            break
        chosen.append(row["word"])
    return "\n".join(reversed(chosen)).encode()


class Novelty:
    """Bytes that a string adds to the compressed size of the text around it."""

    def __init__(self, primer: bytes, level: int = LEVEL) -> None:
        options = {}
        if len(primer) >= 8:  # zstandard's least
            primed = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=level)
            options = {"dict_data": primed}
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=False, write_dict_id=False, **options)

    def __call__(self, text: str, start: int, end: int) -> int:
        around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode("utf-8", "replace")
        string = text[start:end].encode("utf-8", "replace")
        return len(self.packer.compress(around + string)) - len(self.packer.compress(around))


def patterns(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of the fixed patterns' matches, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, shortest: int = SHORTEST) -> Iterator[tuple[int, int]]:
    """Runs with both letters and digits, or of changing case, that begin near after a sensitive word."""
    seen = -1
    for word in _SENSITIVE.finditer(text):
        at = max(word.end(), seen)
        line = text.find("\n", word.end(), word.end() + NEAR)
        limit = line if line >= 0 else word.end() + NEAR
        while at < limit and (run := _RUN.search(text, at)) and run.start() < limit:
            at = seen = run.end()
            string = run[0]
            if len(string) >= shortest and not string.isdigit():
                if any(c.isdigit() for c in string) and any(c.isalpha() for c in string) or _CASES.search(string):
                    yield run.start(), run.end()


def spans(text: str, novelty: Novelty, overhead: int = OVERHEAD, rate: float = RATE) -> list[tuple[str, int, int, int]]:
    """All reports of a text in order: kind, start, end, and the bytes that the string adds."""
    base = patterns(text)
    found = [(start, kind, end, novelty(text, start, end)) for start, kind, end in base]
    # Patterns' matches may overlap; what they cover is merged for the search.
    starts, ends = [], []
    for start, _, end in base:
        if starts and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for start, end in candidates(text):
        before = bisect_right(starts, end - 1) - 1
        if before >= 0 and ends[before] > start:
            continue
        added = novelty(text, start, end)
        if added >= overhead + rate * (end - start):
            found.append((start, 3, end, added))
    return [(KINDS[kind], start, end, added) for start, kind, end, added in sorted(found)]


def scan(docs: DataFrame, primer: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` of every row: an array of ``kind``, ``start``, ``stop`` and ``bytes``.

    Kinds are ``assign``, ``access``, ``hex`` for the fixed patterns, leftmost and
    without overlap within a kind, and ``novel`` for candidates that no pattern's
    match overlaps and that cost at least 0.7 bytes a character and three more.
    Places count code points, the end excluded; spans are in order of start, then
    of the kinds as listed.  A null or empty text has none; texts are scanned
    whole, and what is measured around a candidate is bounded.  Repeated rows
    come out each, null ids stay, other columns are ignored, an empty table
    gives no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = Novelty(primer)
        for batch in batches:
            for part in pieces(batch):
                found = [
                    [{"kind": k, "start": s, "stop": e, "bytes": b} for k, s, e, b in spans(value or "", novelty)]
                    for value in part["_text"]
                ]
                yield pd.DataFrame({"doc_id": part["_id"], "spans": found})

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    # Ids go through pandas as text, so that a null among them stays a null.
    as_text = rows.withColumn("_id", F.col("_id").cast("string"))
    scanned = as_text.mapInPandas(run, "doc_id string, spans array<struct<kind:string,start:int,stop:int,bytes:int>>")
    return scanned.select(F.col("doc_id").cast(kind).alias("doc_id"), "spans")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``scan`` with the dictionary of the documents themselves; it is bounded and goes through the driver."""
    return scan(docs, dictionary(identifiers(docs, text)), doc_id, text)
