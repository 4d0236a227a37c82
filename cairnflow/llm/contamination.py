"""Problem 7: evaluation texts leaking into training text.

Texts are read as words: letter case, accents, punctuation and white space do not count. Every word of the test items has
a number, so a text is a string of word numbers. One Aho-Corasick automaton holds every run of SEED words of the items'
texts and reference texts; a document is scanned once. A run of RUN item words with at most one word in ten changed,
missing or added must hold SEED words in a row untouched, and three such seeds or more, so no case is missed by the seeds.
How many of an item's seeds a text holds bounds the edits of any passage in it. From a seed, the furthest
reach to both sides with 0, 1, 2 ... edits is computed, and the best passage is accepted if it is long and clean enough.
Places are mapped back to the characters of the original text.

Defined cases. Null or empty text: no row. Items shorter than RUN words: never found. Repeated rows and repeated items
are each reported. A document that holds several items, or an item several times, gives one row per item. An automaton
holds at most MAX_ITEM_CHARS characters of items; more items are dealt to several automata, and the texts run through each.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

RUN = 30
ONE_IN = 10
#: Words in a row that survive in any passage of RUN words or more with one edit in ten: (30 - 3) / 4, rounded up.
SEED = 7
#: Characters of items in one automaton, which every task holds; so its words are fewer than there are code points.
MAX_ITEM_CHARS = 2_000_000
#: Spellings remembered by a worker.
SPELLINGS = 400_000

_WORD = re.compile("[^\\W_]+(?:[̀-ͯ­​-‍⁠﻿][^\\W_]*)*")
_FIRST = 0x100  # word numbers are code points from here; 1 stands for every other word


def plain(word: str) -> str:
    """A word without letter case and accents."""
    w = unicodedata.normalize("NFKD", word.casefold())
    w = "".join(c for c in w if c.isalnum())
    return w.replace("ł", "l").replace("ø", "o").replace("đ", "d").replace("ı", "i")


def words(text: str) -> list[str]:
    """Plain words of a text."""
    return [w for w in map(plain, _WORD.findall(text)) if w]


def code_point(i: int) -> str:
    i += _FIRST
    return chr(i if i < 0xD800 else i + 0x800)  # surrogates are no characters


class Codes(dict):
    """The character that stands for a word as it is spelled; the empty string where nothing of it counts."""

    def __init__(self, numbers: dict[str, str]):
        self.numbers = numbers

    def __missing__(self, word: str) -> str:
        w = plain(word)
        code = self.numbers.get(w, "\x01") if w else ""
        if len(self) >= SPELLINGS:
            self.clear()
        self[word] = code
        return code


class Items:
    """The automaton and the numbered words of the test items."""

    def __init__(self, rows: list[tuple[int, str]]):
        import ahocorasick

        self.ids: list[int] = []
        self.texts: list[str] = []
        self.numbers: dict[str, str] = {}
        for item, text in rows:
            ws = words(text or "")
            if len(ws) >= RUN:
                self.ids.append(item)
                self.texts.append("".join(self.numbers.setdefault(w, code_point(len(self.numbers))) for w in ws))
        places: dict[str, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.texts):
            for q in range(len(t) - SEED + 1):
                places.setdefault(t[q : q + SEED], []).append((k, q))
        self.automaton = ahocorasick.Automaton() if places else None
        for seed, at in places.items():
            self.automaton.add_word(seed, at)
        if self.automaton is not None:
            self.automaton.make_automaton()
        self.codes = Codes(self.numbers)

    def encode(self, text: str) -> str:
        """A character for each word of the text."""
        return "".join(map(self.codes.__getitem__, _WORD.findall(text)))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The characters that each word of the text covers."""
        return [m.span() for m in _WORD.finditer(text) if self.codes[m.group()]]


def reach(a: str, b: str, edits: int) -> list[tuple[int, int]]:
    """For 0, 1, ... edits, the most characters of b that a's beginning can match, and how many of a it takes."""
    la, lb = len(a), len(b)
    out: list[tuple[int, int]] = []
    front = {0: 0}  # diagonal (place in a minus place in b) to place in b
    for e in range(edits + 1):
        if e:
            wider: dict[int, int] = {}
            for k, i in front.items():
                for kk, ii in ((k, i + 1), (k + 1, i), (k - 1, i + 1)):
                    if ii <= lb and 0 <= ii + kk <= la and wider.get(kk, -1) < ii:
                        wider[kk] = ii
            front = wider
        best = (-1, 0)
        for k in list(front):
            i = front[k]
            j = i + k
            while i < lb and j < la and a[j] == b[i]:
                i, j = i + 1, j + 1
            front[k] = i
            best = max(best, (i, -j))
        if best[0] < 0:
            break
        out.append((best[0], -best[1]))
        if best[0] == lb:
            break
    return out


def passage(doc: str, p: int, item: str, q: int, edits: int) -> tuple[int, int, int, int] | None:
    """The longest passage around the seed at doc[p], item[q]: (item words, edits, first and last word of the document)."""
    right = reach(doc[p + SEED : p + SEED + len(item) + edits], item[q + SEED :], edits)
    left = reach(doc[max(0, p - len(item) - edits) : p][::-1], item[:q][::-1], edits)
    best = None
    for e1, (l, lj) in enumerate(left):
        for e2, (r, rj) in enumerate(right):
            n = l + SEED + r
            if n >= RUN and (e1 + e2) * ONE_IN <= n and (best is None or (n, -(e1 + e2)) > (best[0], -best[1])):
                best = (n, e1 + e2, p - lj, p + SEED + rj - 1)
    return best


def leaks(items: Items, text: str) -> dict[int, tuple[int, int, int, int]]:
    """Item id to (item words, edits, first character, character after the last) of its longest passage in the text."""
    if items.automaton is None:
        return {}
    doc = items.encode(text)
    if len(doc) < RUN - RUN // ONE_IN:
        return {}
    hits: dict[int, list[tuple[int, int]]] = {}
    for end, at in items.automaton.iter(doc):
        for k, q in at:
            hits.setdefault(k, []).append((end - SEED + 1, q))
    found: dict[int, tuple[int, int, int, int]] = {}
    for k, seeds in hits.items():
        # of a passage of n words at least n - SEED + 1 - SEED * edits seeds are untouched, and edits are at most n / ONE_IN
        if len(seeds) < RUN - SEED + 1 - SEED * (RUN // ONE_IN):
            continue
        edits = min(len(items.texts[k]) // ONE_IN, (len(seeds) + SEED - 1) // (ONE_IN - SEED))
        until: dict[int, int] = {}
        for p, q in seeds:
            # seeds that follow each other on a diagonal are one run, and were extended from its start
            fresh = until.get(p - q, -1) < p
            until[p - q] = p + 1
            if fresh and (got := passage(doc, p, items.texts[k], q, edits)) and ((old := found.get(items.ids[k])) is None or got[0] > old[0]):
                found[items.ids[k]] = got
    if not found:
        return {}
    spans = items.spans(text)
    return {item: (n, edits, spans[a][0], spans[b][1]) for item, (n, edits, a, b) in found.items()}


_held: dict[str, Items] = {}  # automata of this worker, the latest few


def _automaton(name: str, shared) -> Items:
    if name not in _held:
        while len(_held) >= 4:
            del _held[next(iter(_held))]
        _held[name] = Items(shared.value)
    return _held[name]


def item_shards(items: DataFrame, item_key: str, item_texts: list[str]) -> tuple[DataFrame, int]:
    """items with the number of their automaton (_shard), and how many there are; none holds more than MAX_ITEM_CHARS, but for a single item."""
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in item_texts), F.lit(0))
    shards = 1
    while True:
        dealt = items.withColumn("_shard", F.pmod(F.xxhash64(item_key), F.lit(shards)).cast("int"))
        most = dealt.groupBy("_shard").agg(F.sum(size).alias("n"), F.countDistinct(item_key).alias("k")).where(f"n > {MAX_ITEM_CHARS} and k > 1").agg(F.max("n").alias("n")).first()["n"]
        if most is None:
            return dealt, shards
        shards *= 2


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_texts: list[str]) -> DataFrame:
    """(key, item_key, words, edits, first, last): the passages of items in the documents."""
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    dealt, shards = item_shards(items.select(item_key, *item_texts), item_key, item_texts)
    found = None
    for shard in range(shards):
        rows = [(r[0], r[1]) for c in item_texts for r in dealt.where((F.col("_shard") == shard) & F.col(c).isNotNull()).select(item_key, c).collect()]  # bounded, see item_shards
        part = _find(docs, key, text, docs.sparkSession.sparkContext.broadcast(rows), item_key, kinds)
        found = part if found is None else found.unionByName(part)
    return found


def _find(docs: DataFrame, key: str, text: str, shared, item_key: str, kinds: tuple[str, str]) -> DataFrame:
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _automaton(name, shared)
        for b in batches:
            out: list[tuple] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    out += [(i, item, *x) for item, x in leaks(items, t).items()]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], kind), *(pa.array(c, pa.int32()) for c in cols[2:])],
                names=[key, item_key, "words", "edits", "first", "last"])

    kind = pa.string() if kinds[1] == "string" else pa.int32() if kinds[1] == "int" else pa.int64()
    return docs.select(key, text).mapInArrow(run, f"{key} {kinds[0]}, {item_key} {kinds[1]}, words int, edits int, first int, last int")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked passages with their length, edits and place in the document's text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return find_leaks(docs, "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", ["text", "text_ref"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items they give away."""
    return p7_passages(spark, sf_dir).select("doc_id", "item_id")


QUERIES = {"p7_found": p7_found, "p7_passages": p7_passages}
