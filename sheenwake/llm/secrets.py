"""Secrets found by rules and by zstandard novelty (operator 13).

Rules find assignments to sensitive names, access keys and long hexadecimal runs. The method adds strings by
their novelty: a candidate is a run of key characters in a sensitive context, that is, shortly behind a word such as
"credential" on its line, behind the mark of a private key, or right behind another such string. Its novelty
is the number of compressed bytes it adds to the text around it,

    size(before + candidate + after) - size(before + after)

by a compressor that is primed with a dictionary of identifiers: names common in code, and the commonest words
of all documents. Names, words and what stands in the text already cost a reference; a key has to be spelled out.
A candidate is reported if it adds at least ``LEAST_BYTES`` and ``LEAST_SHARE`` of its length, unless it is put
together from words alone: no digit, and ``LETTERS_A_WORD`` letters or more to a piece of one case.

Words are counted in tasks and added up by Spark; the dictionary is bounded by ``DICTIONARY_BYTES``.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import kept, raw

# The three rules and the order of their kinds.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "novel"]
BASE = KINDS[:3]

#: Words that make what follows them on the line sensitive, where they stand as a part of a name of their own.
SENSITIVE = re.compile(
    rb"(?<![A-Za-z])(?:passwords?|passwd|passphrase|pwd|secrets?|tokens?|credentials?|auth|authorization|bearer|signature"
    rb"|(?:api|access|private|secret|signing|encryption|client|account|master|deploy|ssh)[ _-]?keys?)(?![A-Za-z])"
    rb"|-----BEGIN [A-Z ]*PRIVATE KEY-----", re.IGNORECASE)
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=~$!@#%^&*-]{10,}")
#: Bytes between a sensitive word and the candidate, on one line but for the mark of a private key.
REACH = 48
#: Bytes of text on each side of a candidate that it is compressed with.
AROUND = 400
LEAST_BYTES = 9
LEAST_SHARE = 0.62
#: Letters of one case (the first may be large) that a piece of a name has in the mean; random letters change sooner.
LETTERS_A_WORD = 4
PIECE = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+")
LEVEL = 3
DICTIONARY_BYTES = 65_536
WORDS_HELD = 300_000
#: Sizes of count to a doubling, by which the dictionary is cut off.
RANKS = 32

#: Names common in code and settings.
IDENTIFIERS = """
    access account active address admin alias allow amazon app application argument args array async attribute
    auth authorization await backend base batch begin bearer bool boolean bucket buffer build byte cache callback
    catch certificate char class client cloud cluster code column command comment commit component config
    configuration connect connection const constant constructor container content context cookie copy count create
    credential credentials current data database date debug default define delete deploy description development
    device dictionary directory disable document domain double double download element email enable encoding
    encrypt encryption endpoint engine entry environment error event example exception execute export expression
    extends extension external false field file filter final finally firewall float folder format forward from
    function generate get global group handler hash header host identifier image implement import include index
    info initialize input instance int integer interface internal item iterator java javascript json key keyword
    label language length level library license line link list listener load local location log logger login
    logout long manager master message metadata method middleware mode model modify module monitor name namespace
    network node null number object offset open operation option order output override package page parameter
    parent parse password path pattern permission placeholder plugin point policy port position prefix print
    private process production profile program project property protected protocol provider proxy public publish
    python query queue random read record redirect reference region register release remote remove render replace
    repository request require reset resolve resource response result return role root route router sample schema
    script search secret section secure security select sequence server service session setting settings shared
    signature size socket source staging start state static status storage stream string struct super support
    switch sync system table tag target template temporary test text thread throw timeout timestamp title token
    topic transaction transfer trigger true type undefined update upload url user username utils validate value
    variable vector verify version view virtual void volume warning webhook width window worker workspace wrapper
    write your_api_key your_secret_here changeme placeholder example_token insert_token_here
    abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 xxxxxxxxxxxxxxxx ****************
""".split()

#: Everything but letters becomes a space, and letters small; bytes above ASCII count as letters.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): small-letter words of 4 to 16 bytes of all texts and how often they occur."""
    def run(batches):
        counts: Counter = Counter()

        def flush():
            words = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in raw(batch.column(0)):
                for k in range(0, len(text), 1 << 20):  # a word cut at a megabyte counts as two
                    counts.update(text[k:k + (1 << 20)].translate(_TO_WORDS).split())
                    if len(counts) > WORDS_HELD:
                        yield flush()
        if counts:
            yield flush()

    return (docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary, n bigint")
            .where(F.length("word").between(4, 16)).groupBy("word").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, text_col: str = "text", dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    """The dictionary: the commonest words of all texts, then names of code, the most useful last.

    The number of words and their bytes are added up by size of count first; the words down to the last size that
    still fits are then read, so the driver never holds more than ``dictionary_bytes``. That bounds a table of
    common words by its nature; a word left out only costs a candidate that holds it a few bytes more.
    """
    names = " ".join(IDENTIFIERS).encode()
    room = dictionary_bytes - len(names)
    counts = cut_lineage(word_counts(docs, text_col).where("n > 1").withColumn("rank", F.floor(F.log2("n") * RANKS)))
    sizes = counts.groupBy("rank").agg(F.sum(F.length("word") + 1).alias("bytes")).orderBy(F.desc("rank")).collect()
    least = None
    for r in sizes:  # one row for each of the RANKS sizes of a doubling, 2,000 at the most
        room -= r["bytes"]
        if room < 0:
            break
        least = r["rank"]
    if least is None:
        return names
    found = counts.where(F.col("rank") >= least).select("word", "n").collect()
    words = [bytes(r["word"]) for r in sorted(found, key=lambda r: (r["n"], bytes(r["word"])))]
    return b" ".join([*words, names])


class Novelty:
    """Marginal compressed bytes by a compressor primed with ``dictionary``."""

    def __init__(self, dictionary: bytes):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(
            dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def marginal(self, before: bytes, candidate: bytes, after: bytes) -> int:
        size = self.compressor.compress
        return len(size(before + candidate + after)) - len(size(before + after))

    def is_new(self, text: bytes, start: int, end: int) -> bool:
        """Whether text[start:end] adds enough and is no name; a candidate as a whole, however long, and the text next to it."""
        if is_name(text[start:end]):
            return False
        added = self.marginal(text[max(0, start - AROUND):start], text[start:end], text[end:end + AROUND])
        return added >= LEAST_BYTES and added >= LEAST_SHARE * (end - start)


def is_name(candidate: bytes) -> bool:
    pieces = PIECE.findall(candidate)
    digits = sum(map(candidate.count, b"0123456789"))
    return not digits and bool(pieces) and sum(map(len, pieces)) >= LETTERS_A_WORD * len(pieces)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules, in bytes; leftmost, not overlapping within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def novel_spans(text: bytes, novelty: Novelty, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of strings that are new in a sensitive context and that no span of the rules overlaps."""
    covered = sorted((s, e) for s, _, e in base)
    out, done, at = [], 0, 0
    for word in SENSITIVE.finditer(text):
        if word.start() < done:  # inside a string reported, or before a place looked at already
            continue
        private_key = word.group().startswith(b"-----")
        place, last = word.end(), word.end() + REACH
        while m := CANDIDATE.search(text, place, _end_of_run(text, last)):
            between = text[place:m.start()]
            if m.start() > last or (b"\n" in between and not private_key):
                break
            start, end = m.start(), m.end()
            place = done = end
            while at < len(covered) and covered[at][1] <= start:
                at += 1
            if at < len(covered) and covered[at][0] < end:
                continue
            if novelty.is_new(text, start, end):
                out.append((start, 3, end))
                last = end + (REACH if not private_key else 2 * REACH)  # the next one is in its context
    return out


def _end_of_run(text: bytes, at: int) -> int:
    """Where the run of candidate characters that reaches place ``at`` ends."""
    m = RUN.match(text, min(at, len(text)))
    return m.end()


RUN = re.compile(rb"[A-Za-z0-9+/_=~$!@#%^&*-]*")


def _code_points(text: bytes, places: list[int]) -> list[int]:
    """Code points in front of each byte place of UTF-8 text."""
    if not places or text.isascii():
        return places
    starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [int(starts[p - 1]) if p else 0 for p in places]


def scan(docs: DataFrame, dictionary: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with secret_spans, an array of (kind, start, end) by start and kind, in code points, end exclusive.

    kind is the place in ``KINDS``. Every whole text is read; null and empty texts have no spans. Rows that repeat
    are scanned each. A column named secret_spans is replaced, all others are kept.
    """
    kind = "array<struct<kind:int,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        novelty = kept(("novelty", hash(dictionary)), lambda: Novelty(dictionary))
        out = []
        for k in range(0, len(texts), 200):
            for text in raw(texts.slice(k, 200)):
                base = base_spans(text)
                found = sorted(base + novel_spans(text, novelty, base))
                at = _code_points(text, [s for s, _, _ in found] + [e for _, _, e in found])
                out.append([{"kind": f[1], "start": a, "end": b} for f, a, b in zip(found, at, at[len(found):])])
        return pa.array(out, arrow)

    return docs.withColumn("secret_spans", run(F.col(text_col).cast("string")))


def digest(spans_col: str = "secret_spans", base_only: bool = False) -> Column:
    """kind:start:end of the spans by start and kind, comma-joined."""
    spans = F.col(spans_col)
    if base_only:
        spans = F.filter(spans, lambda x: x["kind"] < len(BASE))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")
