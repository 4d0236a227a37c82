"""Problem 8: garbled text from wrong character encoding.

A character trigram model, smoothed by its bigrams and these by single characters, is trained on clean records: on a column known to be clean, and on
the texts that show no sign of damage. Its counts cover all records and live in a table of fixed size, indexed by hash,
so its size does not grow with the data. Every candidate chain of decoding (what bytes meant) and encoding (what they
were read as) is scored:

* UTF-8 read as a single-byte encoding, once or several times over, also where the text was put in small letters
  afterwards: the places whose bytes are valid UTF-8 are candidates;
* one single-byte encoding read as another: all words with characters outside ASCII are candidates under every chain that
  changes them into characters that clean records hold. Words are scored many at once, each spelling once.

No character is taken for less likely than NOVEL, since authors write rare ones too. What follows the last word of a record
is not known, since records are cut. The gain of a chain is the log likelihood of what it restores less that of what stands, over the places it improves.
The likeliest chain is accepted beyond a margin, which is validated on all clean records, each under a model of the
parts of the records that hold neither it nor its repeats: it exceeds any gain seen there. Chains are undone until none
gains the margin. Damage may cover the whole text or some places; only those are restored. Replacement
characters and control characters left by a decoder mark a text, though nothing restores what they stand for.

Defined cases. Null or empty text: no row. Text in ASCII only: never found. Long texts are read whole. Repeated rows
each get their row. No clean records: only replacement and control characters are found.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Buckets of the trigram, bigram and character tables; the model's size for any corpus. Trigrams stand in two tables
#: under different hashes, and the lesser count is taken, so that a shared bucket does not make a strange trigram likely.
TRI, BI, UNI = 1 << 21, 1 << 20, 1 << 16
AT_BI = 2 * TRI
AT_UNI = AT_BI + BI
SIZE = AT_UNI + UNI
#: A restored text only holds characters that clean records hold at least so often.
SEEN = 3
#: The least likelihood of a character in its context.
NOVEL = 1e-6
#: Words of an encoding pair count if they gain more than this.
WORD_GAIN = 3.0
#: Characters of text whose words are scored at once, about; and words remembered by a worker.
SLICE, WORDS = 2_000_000, 500_000
#: Parts of the records, by hash of the text. All clean records validate the margin, each by a model of the other parts.
FOLDS = 4
#: The least margin, in natural logs, for valid UTF-8 and for single bytes, whatever the validation says.
LEAST_UTF8, LEAST_BYTES = 3.0, 9.0
#: Readings of a run that are listed one by one; of more, the likeliest is found without listing them.
MANY = 64

# Encodings that UTF-8 is commonly read as, and the single-byte encodings taken for each other.
READ_AS = ("cp1252", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "iso8859_2", "iso8859_15", "cp1254", "cp1257", "mac_cyrillic", "cp852")
LATIN = ("cp1252", "cp1250", "iso8859_2", "mac_roman", "cp850", "cp437", "cp852", "mac_latin2")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")


def _byte_of(encoding: str) -> dict[str, int]:
    """Character to byte for bytes above ASCII; undefined bytes stand for the control characters of their number."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    used = set(out.values())
    for b in range(0x80, 0x100):
        if b not in used or (encoding == "cp1252" and b < 0xA0):
            out.setdefault(chr(b), b)
    return out


class Reader:
    """UTF-8 read as an encoding: finds places whose bytes are valid UTF-8, and decodes them."""

    def __init__(self, encoding: str, small: bool = False):
        self.name = encoding + ("+lower" if small else "")
        self.small = small
        self.byte: dict[str, list[int]] = {}
        for c, b in _byte_of(encoding).items():
            for x in {c.lower()} if small else {c}:
                if len(x) == 1 and ord(x) > 127:
                    self.byte.setdefault(x, []).append(b)
        group = {k: "".join(re.escape(c) for c, bs in self.byte.items() if any(lo <= b <= hi for b in bs)) for k, (lo, hi) in {"c": (0x80, 0xBF), "2": (0xC2, 0xDF), "3": (0xE0, 0xEF), "4": (0xF0, 0xF4)}.items()}
        parts = [f"[{group[k]}][{group['c']}]{{{n}}}" for k, n in (("2", 1), ("3", 2), ("4", 3)) if group[k]]
        if encoding == "cp1252":
            parts.append("ã " if small else "Ã ")  # the second byte of à is a no-break space, often made a plain one
            self.byte[" "] = [0xA0]
        self.leads = {c for c, bs in self.byte.items() if any(0xC2 <= b <= 0xF4 for b in bs)}
        self.follows = {c for c, bs in self.byte.items() if any(0x80 <= b <= 0xBF for b in bs)}
        # where a character stands for several bytes, short forms must not hide the longer ones
        self.pattern = re.compile(f"(?:{'|'.join(parts[::-1] if small else parts)})+")

    def decode(self, run: str) -> list[str] | None:
        """What a run of matched characters may have been; several readings only where small letters hide the bytes.

        None where there are more than MANY: likeliest() then finds the best of them.
        """
        options = [self.byte[c] for c in run]
        if all(len(o) == 1 for o in options):
            try:
                return [bytes(o[0] for o in options).decode("utf-8")]
            except UnicodeDecodeError:
                return []
        out = {(0, 0, b"", "")}  # (bytes still wanted, length, the open character's bytes, text so far); no prefix that is not UTF-8 stays
        for o in options:
            out = {y for x in out for b in o if (y := self._with(x, b))}
            if len(out) > MANY:
                return None
        return sorted(t for wanted, _, _, t in out if not wanted)

    def _with(self, x: tuple[int, int, bytes, str], b: int) -> tuple[int, int, bytes, str] | None:
        """A partial reading with one byte more; None where it is no beginning of UTF-8."""
        wanted, size, open_, text = x
        if not wanted:
            size = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
            return (size - 1, size, bytes([b]), text) if size else None
        if not 0x80 <= b <= 0xBF:
            return None
        if wanted > 1:
            return wanted - 1, size, open_ + bytes([b]), text
        try:
            c = (open_ + bytes([b])).decode("utf-8")
        except UnicodeDecodeError:
            return None
        return 0, 0, b"", text + (c.lower() if self.small else c)

    def likeliest(self, model: "Model", run: str, before: str, after: str) -> list[str]:
        """The likeliest of all readings of a run in characters that clean records hold, one character at a time; or none.

        Of the readings that end at a place in the same two characters only the best can win, as the model sees no further.
        """
        best: list[dict[str, tuple[float, str]]] = [{} for _ in range(len(run) + 1)]
        best[0][before[-2:]] = (0.0, "")
        for i, states in enumerate(best[:-1]):
            if not states:
                continue
            open_ = {(0, 0, b"", "")}
            for j in range(i, min(i + 4, len(run))):
                open_ = {y for x in open_ for b in self.byte[run[j]] if (y := self._with(x, b))}
                for c in sorted({t for wanted, _, _, t in open_ if not wanted and model.known(t)}):
                    for two, (gain, text) in states.items():
                        new = (gain + model.score(two + c), text + c)
                        at = (two + c)[-2:]
                        if at not in best[j + 1] or new > best[j + 1][at]:
                            best[j + 1][at] = new
                open_ = {x for x in open_ if x[0]}
        ends = [(gain + model.score(two + after), text) for two, (gain, text) in best[-1].items()]
        return [max(ends)[1]] if ends else []


def undone(model: "Model", reader: Reader, run: str, before: str = "  ", after: str = "  ") -> list[str]:
    """What clean text a run may have been, also where it was read wrongly several times over; each time makes it shorter.

    Of more than MANY readings the likeliest; such a run is not tried as read wrongly several times over.
    """
    got = reader.decode(run)
    if got is None:
        return reader.likeliest(model, run, before, after)
    out = [o for o in got if model.known(o)]
    if out:
        return out
    for o in got:
        for r in possible_readers(o):
            new = r.pattern.sub(lambda m: next(iter(undone(model, r, m.group())), m.group()), o)
            if new != o and model.known(new):
                out.append(new)
    return list(dict.fromkeys(out))


READERS = [Reader(e) for e in READ_AS] + [Reader("cp1252", small=True)]


def _bits(sets: list[set[str]]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, chars in enumerate(sets):
        for c in chars:
            out[c] = out.get(c, 0) | 1 << i
    return out


_LEADS, _FOLLOWS = _bits([r.leads for r in READERS]), _bits([r.follows for r in READERS])
_SPACED = sum(1 << i for i, r in enumerate(READERS) if " " in r.byte)
#: Words with a character above ASCII. No-break spaces and soft hyphens may be damaged letters, so they end no word.
_WORD = re.compile("(?<![^ \t\r\n])[^ \t\r\n\x80-\U0010ffff]*+[\x80-\U0010ffff][^ \t\r\n]*+")
_bits_of: dict[str, int] = {}  # readers that find a place in a word, by spelling


def _reader_bits(word: str) -> int:
    """The readers that find a place in a word, a bit each; those that read a blank only find it in a text."""
    got = _bits_of.get(word)
    if got is None:
        maybe = 0
        for a, b in zip(word, word[1:]):
            if a > "\x7f" and b > "\x7f":
                maybe |= _LEADS.get(a, 0) & _FOLLOWS.get(b, 0)
        got = sum(1 << i for i, r in enumerate(READERS) if maybe >> i & 1 and r.pattern.search(word))
        if len(_bits_of) > WORDS:
            _bits_of.clear()
        _bits_of[word] = got
    return got


def possible_readers(text: str, words: list[str] | None = None) -> list["Reader"]:
    """The readers that find a place in a text, by the words with characters above ASCII that it holds."""
    bits = 0
    for w in _WORD.findall(text) if words is None else words:
        bits |= _reader_bits(w)
    return [r for i, r in enumerate(READERS) if bits >> i & 1 or _SPACED >> i & 1 and r.pattern.search(text)] if bits or "Ã " in text or "ã " in text else []


def _swaps() -> list[tuple[str, dict[int, str]]]:
    """(name, map of characters) for one single-byte encoding read as another."""
    out, seen = [], set()
    for family, others in ((LATIN, LATIN), (CYRILLIC, (*CYRILLIC, "cp1252", "mac_roman", "cp437"))):
        for meant in family:
            for read in others:
                if meant == read:
                    continue
                m: dict[int, str] = {}
                for c, b in _byte_of(read).items():
                    try:
                        d = bytes([b]).decode(meant)
                    except UnicodeDecodeError:
                        continue
                    if ord(d) > 127 or d.isalpha():
                        m[ord(c)] = d
                key = tuple(sorted(m.items()))
                if m and key not in seen:
                    seen.add(key)
                    out.append((f"{meant} read as {read}", m))
    return out


SWAPS = _swaps()
_MAPS = [m for _, m in SWAPS]
_CHANGED = _bits([{chr(c) for c, d in m.items() if chr(c) != d} for m in _MAPS])
_HIGH = re.compile("[^\x00-\x7f]")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f�]")
_SIGNS = 1 << 0 | 1 << 1 | 1 << 3 | 1 << 4  # the commonest readings
_LEFT = re.compile("[\x80-\x9f�]|Ã ")


def shows_damage(text: str) -> bool:
    """What no clean record is trained on with: two or more characters that are valid UTF-8 in the commonest readings, or what decoders leave."""
    if text.isascii():
        return False
    return _LEFT.search(text) is not None or any(_reader_bits(w) & _SIGNS for w in _WORD.findall(text))


_M32 = 0xFFFFFFFF
# Multipliers of the hashes; the same for single characters and for arrays of them.
_A, _B, _C, _D, _E, _F, _G, _H = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0x2545F491
_A64, _B64, _C64, _D64, _E64, _F64, _G64, _H64, _M64 = (np.uint64(v) for v in (_A, _B, _C, _D, _E, _F, _G, _H, _M32))


def _hash3(a, b, c):
    return (a * _A + b * _B + c * _C & _M32) * _D >> 11 & TRI - 1


def _hash3b(a, b, c):
    return (a * _E + b * _F + c * _G & _M32) * _H >> 9 & TRI - 1


def _hash2(a, b):
    return (a * _A + b * _B & _M32) * _D >> 13 & BI - 1


def _hashes3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (
        ((a * _A64 + b * _B64 + c * _C64 & _M64) * _D64 >> np.uint64(11)) & np.uint64(TRI - 1),
        ((a * _E64 + b * _F64 + c * _G64 & _M64) * _H64 >> np.uint64(9)) & np.uint64(TRI - 1),
    )


def _hashes2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * _A64 + b * _B64 & _M64) * _D64 >> np.uint64(13)) & np.uint64(BI - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


Word = tuple[str, bool]  # a word, and whether it is known that a blank follows


class Model:
    """Trigram counts by hash, backed by bigrams and single characters; scores strings by their natural log likelihood."""

    def __init__(self, counts: np.ndarray):
        self.tri, self.tri2 = counts[:TRI], counts[TRI:AT_BI]
        self.bi, self.uni = counts[AT_BI:AT_UNI], counts[AT_UNI:]
        self.total = int(self.uni.sum())
        self.empty = self.total == 0
        self.one = [memoryview(np.ascontiguousarray(x)) for x in (self.tri, self.tri2, self.bi, self.uni)]
        self.cache: dict[str, float] = {}
        self.words: dict[Word, list[tuple[int, float, str]]] = {}
        # for each character, the single-byte chains that turn it into one that clean records do not hold
        self.strange = _bits([{chr(c) for c, d in m.items() if not self.known(d)} for m in _MAPS])

    def score(self, s: str) -> float:
        """log P of the characters after the first two, each given the two before it."""
        got = self.cache.get(s)
        if got is None:
            x = [ord(c) for c in s]
            got = 0.0
            tri, tri2, bi, uni = self.one
            for a, b, c in zip(x, x[1:], x[2:]):
                abc = min(tri[_hash3(a, b, c)], tri2[_hash3b(a, b, c)])
                share = (uni[c & UNI - 1] + 0.02) / (self.total + 1.0)
                back = min((bi[_hash2(b, c)] + 2.0 * share) / (uni[b & UNI - 1] + 2.0), 1.0)  # about P(c | b)
                got += math.log(max((abc + 2.0 * back) / (bi[_hash2(a, b)] + 2.0), NOVEL))
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[s] = got
        return got

    def known(self, s: str) -> bool:
        """Whether clean records hold every character above ASCII."""
        return all(c < "\x80" or self.uni[ord(c) & UNI - 1] >= SEEN for c in s)

    def likely(self, s: str) -> float:
        """The score, or nearly that of the text in small letters: capitals alone are no damage."""
        low = s.lower()
        return self.score(s) if low == s or len(low) != len(s) else max(self.score(s), self.score(low) - 1.0)

    def scores(self, words: list[str], closed: list[bool]) -> np.ndarray:
        """log P of words, all at once: their first character after a blank, then trigrams, with a blank after the closed ones."""
        if not words:
            return np.zeros(0)
        size = np.array([len(w) + 2 for w in words])
        first = np.cumsum(size) - size
        x = _codes("".join(f" {w} " for w in words))
        a, b, c = x[:-2], x[1:-1], x[2:]
        h, h2 = _hashes3(a, b, c)
        abc = np.minimum(self.tri[h], self.tri2[h2])
        share = (self.uni[c & np.uint64(UNI - 1)] + 0.02) / (self.total + 1.0)
        back = np.minimum((self.bi[_hashes2(b, c)] + 2.0 * share) / (self.uni[b & np.uint64(UNI - 1)] + 2.0), 1.0)
        p = np.append(np.log(np.maximum((abc + 2.0 * back) / (self.bi[_hashes2(a, b)] + 2.0), NOVEL)), (0.0, 0.0))
        end = first + size - 1
        p[end] = p[end - 1] = 0.0  # these lead from one word to the next
        p[(end - 2)[~np.array(closed)]] = 0.0
        begun = np.maximum((self.bi[_hashes2(x[first], x[first + 1])] + 0.05) / (self.uni[32] + 1.0), NOVEL)
        return np.add.reduceat(p, first) + np.log(begun)

    def learn(self, words: Iterable[Word]) -> None:
        """Scores each word under every single-byte chain that makes another of it; keeps (chains as bits, gain, word) of the gains that count."""
        words = list(words)
        if len(self.words) > WORDS:
            self.words.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if not new:
            return
        texts: list[str] = []
        closed: list[bool] = []
        tried: list[dict[str, int]] = []

        def ask(s: str, c: bool) -> None:
            low = s.lower()
            for x in (s, low) if len(low) == len(s) else (s, s):
                texts.append(x)
                closed.append(c)

        for w, c in new:
            bits = strange = 0
            for x in set(w):
                if x > "\x7f":
                    bits |= _CHANGED.get(x, 0)
                    strange |= self.strange.get(x, 0)
            bits &= ~strange
            to: dict[str, int] = {}
            while bits:
                low = bits & -bits
                bits ^= low
                v = w.translate(_MAPS[low.bit_length() - 1])
                to[v] = to.get(v, 0) | low
            to = {v: k for v, k in to.items() if self.known(v)}
            tried.append(to)
            if to:
                for s in (w, *to):
                    ask(s, c)
        got = self.scores(texts, closed).reshape(-1, 2)
        best = np.maximum(got[:, 0], got[:, 1] - 1.0).tolist()  # capitals alone are no damage
        at = 0
        for key, to in zip(new, tried):
            out = []
            if to:
                for i, (v, k) in enumerate(to.items(), at + 1):
                    if best[i] - best[at] > WORD_GAIN:
                        out.append((k, best[i] - best[at], v))
                at += 1 + len(to)
            self.words[key] = out


def odd_words(text: str) -> list[tuple[int, int, Word]]:
    """Words with characters above ASCII and where they stand."""
    return [(*m.span(), (m.group(), m.end() < len(text))) for m in _WORD.finditer(text)]


def slices(texts: list[str | None]) -> Iterator[list[int]]:
    """Places of texts above ASCII, so many at once as hold about SLICE characters."""
    part: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        if t and not t.isascii():
            part.append(i)
            held += len(t)
            if held > SLICE:
                yield part
                part, held = [], 0
    if part:
        yield part


def counts_of(texts: list[str]) -> np.ndarray:
    """Trigram and bigram counts of texts, by hash."""
    x = _codes("\n".join(f"  {t}  " for t in texts))
    out = np.zeros(SIZE, dtype=np.int64)
    if len(x) > 2:
        h, h2 = _hashes3(x[:-2], x[1:-1], x[2:])
        for at, size, k in ((0, TRI, h), (TRI, TRI, h2), (AT_BI, BI, _hashes2(x[:-2], x[1:-1])), (AT_UNI, UNI, x & np.uint64(UNI - 1))):
            out[at : at + size] = np.bincount(k.astype(np.int64), minlength=size)
    return out


def _fold(text: str) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def train(clean: DataFrame, suspect: DataFrame | None = None) -> np.ndarray:
    """Counts by part, over a clean column and over those records of another that show no sign of damage. Single text columns."""
    c = clean.columns[0]
    both = clean.select(F.col(c).alias("t"), F.lit(True).alias("ok"))
    if suspect is not None:
        both = both.unionByName(suspect.select(F.col(suspect.columns[0]).alias("t"), F.lit(False).alias("ok")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, SIZE), dtype=np.int64)
        part: list[list[str]] = [[] for _ in range(FOLDS)]
        held = [0] * FOLDS
        for b in batches:
            for t, ok, k in zip(*(c.to_pylist() for c in b.columns)):
                if not t or not ok and shows_damage(t):
                    continue
                part[k].append(t)
                held[k] += len(t)
                if held[k] > SLICE:
                    total[k] += counts_of(part[k])
                    part[k], held[k] = [], 0
        for k in range(FOLDS):
            if part[k]:
                total[k] += counts_of(part[k])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["bucket", "n"])

    rows = both.withColumn("k", _fold("t")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most FOLDS * SIZE rows
    out = np.zeros(FOLDS * SIZE, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(FOLDS, SIZE)


def _utf8_gain(model: Model, text: str, reader: Reader) -> tuple[float, list[tuple[int, int, str]]]:
    """Gain of undoing one wrong reading of UTF-8, and the places to replace."""
    places: list[list[tuple[int, int, str]]] = []
    for m in reader.pattern.finditer(text):
        a, b = m.span()
        before, after = ("  " + text[max(0, a - 2) : a])[-2:], (text[b : b + 2] + "  ")[:2]
        options = undone(model, reader, m.group(), before=before, after=after)
        if not options:
            continue
        best = options[0] if len(options) == 1 else max(options, key=lambda o: max(model.likely(before + x + after) for x in {o, o.upper()} if len(x) == len(o)))
        if places and a - places[-1][-1][1] <= 3:
            places[-1].append((a, b, best))  # judged together, as each stands in the other's context
        else:
            places.append([(a, b, best)])
    total, edits = 0.0, []
    for place in places:
        a, b = place[0][0], place[-1][1]
        before, after = ("  " + text[max(0, a - 2) : a])[-2:], (text[b : b + 2] + "  ")[:2]
        new = _apply(text[:b], place)[a:]
        gain = max(model.likely(before + x + after) for x in ({new, new.capitalize()} if reader.small else {new})) - model.likely(before + text[a:b] + after)
        if gain > 0:
            total += gain
            edits += place
    return total, edits


def _swap_gains(model: Model, words: list[tuple[int, int, Word]]) -> dict[int, float]:
    """Gain of each single-byte chain (a bit each) over the words it improves; the model has learnt them."""
    total: dict[int, float] = {}
    for _, _, w in words:
        for bits, gain, _ in model.words[w]:
            while bits:
                low = bits & -bits
                bits ^= low
                total[low] = total.get(low, 0.0) + gain
    return total


def _apply(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, s in edits:
        out += [text[at:a], s]
        at = b
    return "".join(out) + text[at:]


def restore(model: Model, text: str, margins: tuple[float, float], words: list[tuple[int, int, Word]] | None = None) -> tuple[str, list[str], float]:
    """(restored text, chains undone, gain); no chains where nothing was found. words: those of odd_words(text), where at hand."""
    chains: list[str] = []
    gained = 0.0
    while _HIGH.search(text):  # every round gains more than a margin, and likelihoods end at 0
        words = odd_words(text) if words is None else words
        best = (0.0, [], "")
        for r in possible_readers(text, [w for _, _, (w, _) in words]):
            g, e = _utf8_gain(model, text, r)
            if g > best[0]:
                best = (g, e, f"utf_8 read as {r.name}")
        margin = margins[0]
        model.learn([w for _, _, w in words])
        total = _swap_gains(model, words)
        if total:
            chain = max(total, key=lambda k: (total[k], -k))
            if total[chain] > margins[1] and (total[chain] > best[0] or best[0] <= margins[0]):
                edits = [(a, b, v) for a, b, w in words for bits, _, v in model.words[w] if bits & chain]
                best, margin = (total[chain], edits, SWAPS[chain.bit_length() - 1][0]), margins[1]
        if best[0] <= margin:
            break
        text, gained, words = _apply(text, best[1]), gained + best[0], None
        chains.append(best[2])
    return text, chains, gained


def most_gains(model: Model, texts: list[str]) -> list[tuple[float, float]]:
    """The greatest gains, as valid UTF-8 and as single bytes, that each text shows; none for texts with control characters."""
    out = [(0.0, 0.0)] * len(texts)
    for part in slices(texts):
        part = [i for i in part if not _CONTROL.search(texts[i])]
        words = {i: odd_words(texts[i]) for i in part}
        model.learn(w for ws in words.values() for _, _, w in ws)
        for i in part:
            readers = possible_readers(texts[i], [w for _, _, (w, _) in words[i]])
            out[i] = (max((_utf8_gain(model, texts[i], r)[0] for r in readers), default=0.0), max(_swap_gains(model, words[i]).values(), default=0.0))
    return out


def _margins(utf8: float, single: float) -> tuple[float, float]:
    return max(LEAST_UTF8, utf8 * 1.25 + 0.5), max(LEAST_BYTES, single * 1.25 + 0.5)


def validated_margins(model: Model, clean: list[str]) -> tuple[float, float]:
    """Margins above every gain that clean records show."""
    most = most_gains(model, clean)
    return _margins(max((m[0] for m in most), default=0.0), max((m[1] for m in most), default=0.0))


def _packed(parts: np.ndarray) -> list[tuple]:
    """Each row of counts for the way to the workers: the buckets in use, or all where that is shorter."""
    out: list[tuple] = []
    for row in parts:
        kind = np.int32 if row.max(initial=0) < 2**31 else np.int64
        at = np.flatnonzero(row).astype(np.int32)
        out.append((at, row[at].astype(kind)) if 2 * len(at) < len(row) else (None, row.astype(kind)))
    return out


_held: dict[str, list["Model"]] = {}  # models of this worker, the latest two


def _models(name: str, shared) -> list[Model]:
    if name not in _held:
        while len(_held) >= 2:
            del _held[next(iter(_held))]
        out = []
        for at, counts in shared.value:
            if at is not None:
                row = np.zeros(SIZE, dtype=counts.dtype)
                row[at] = counts
            out.append(Model(counts if at is None else row))
        _held[name] = out
    return _held[name]


def clean_gains(clean: DataFrame, parts: np.ndarray) -> DataFrame:
    """(t, utf8, single): the greatest gains of every clean record above ASCII, under the counts of the parts it is not in."""
    shared = clean.sparkSession.sparkContext.broadcast(_packed(parts.sum(axis=0) - parts))  # FOLDS * SIZE numbers
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(name, shared)
        for b in batches:
            by: dict[int, list[str]] = {}
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t.isascii() and not models[k].empty:
                    by.setdefault(k, []).append(t)
            rows = [(t, *most) for k, texts in by.items() for t, most in zip(texts, most_gains(models[k], texts))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))], names=["t", "utf8", "single"])

    texts = clean.select(F.col(clean.columns[0]).alias("t")).where("t is not null").withColumn("k", _fold("t"))
    return texts.mapInArrow(run, "t string, utf8 double, single double")


def find_garbled(docs: DataFrame, key: str, text: str, clean: DataFrame) -> DataFrame:
    """(key, chains, gain, restored) of the records whose text was decoded wrongly; restored is null where nothing could be."""
    parts = train(clean, docs.select(text))
    most = clean_gains(clean, parts).agg(F.max("utf8"), F.max("single")).first()
    margins = _margins(most[0] or 0.0, most[1] or 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(_packed(parts.sum(axis=0)[None]))  # SIZE numbers
    kind = dict(docs.dtypes)[key]
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _models(name, shared)[0]
        for b in batches:
            rows, chains, gains, texts = [], [], [], []
            every = b.column(1).to_pylist()
            for part in slices(every):
                words = {i: odd_words(every[i]) for i in part}
                m.learn(w for ws in words.values() for _, _, w in ws)
                for i in part:
                    t = every[i]
                    new, undone, gain = (t, [], 0.0) if m.empty else restore(m, t, margins, words[i])
                    if undone or _CONTROL.search(t):
                        rows.append(i), chains.append(undone), gains.append(gain), texts.append(new if undone else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(chains, pa.list_(pa.string())), pa.array(gains, pa.float64()), pa.array(texts, pa.string())], names=[key, "chains", "gain", "restored"])

    return docs.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"{key} {kind}, chains array<string>, gain double, restored string")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled records with the chains undone and the restored text; the model learns from the translations, which are clean."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "text_tgt")
    return find_garbled(docs.select("doc_id", "text"), "doc_id", "text", docs.select("text_tgt"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text was decoded wrongly, in all of it or in places."""
    return p8_restored(spark, sf_dir).select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_restored": p8_restored}
