"""Evaluation items quoted in corpus texts, wholly or in good part.

One Aho-Corasick automaton holds the words of all items, normalised. Each text is normalised and scanned once: what only
lays the text out (cue heads, markup, position codes) is blanked in place, so that offsets stay those of the original; words
are lower-cased and brought to a form in which misreadings and letters lost to a wrong encoding are alike. An item is looked
at where a quarter of its words are met within its stretch, in any order: that is half of the half that makes a quotation, so
none is lost while every second of its words stands without a slip. Of items of few words the halves of words are in
the automaton, too, one of which any slip leaves whole. There the words are aligned with small slips: the longest run of words
in the item's order, within a stretch at most twice as long as the item. An item is quoted if that run holds half of its words.

Items of the same words are one. The items are a bounded set, broadcast to every task; a larger set is taken in chunks.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.residue import repairs

#: Items of one automaton; more are scanned for in further passes, which loses nothing.
CHUNK = 50_000
#: Words of texts whose likenesses are kept in a Python worker.
KNOWN_WORDS = 300_000
#: An item whose quotation needs no more words than this is met by halves of words.
FEW = 3
#: Share of an item's words that a quotation holds, and its length in words against the item's.
SHARE, STRETCH = 0.5, 2
# Written for this module: cue heads with the number before, markup and codes of subtitle files.
LAYOUT = re.compile(
    r"(?m)^[ \t﻿]*(?:\d+[ \t]*\r?\n[ \t]*)?\d{1,2}:\d\d(?::\d\d)?[,.:]\d{1,3}[^\n]*\d\d[,.:]\d{1,3}[^\n]*$"
    r"|</?(?:[ibus]|font|c|v|lang|ruby|rt)(?:[ .][^<>\n]*)?>|\{\\[^{}\n]*\}"
)
# Written for this module: letters that character recognition takes for one another, after lower-casing.
ALIKE = bytes.maketrans(b"i1|05fe", b"lllostc")
KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789| \t\r\n\x0b\x0c"
DROPPED = bytes(c for c in range(256) if c not in KEPT)


def blanked(text: str) -> str:
    """The text with blanks in place of what only lays it out; all offsets stay."""
    return LAYOUT.sub(lambda m: " " * len(m[0]), text)


def _alike(words: bytes) -> bytes:
    return words.translate(ALIKE, DROPPED).replace(b"rn", b"m").replace(b"ll", b"h")


# Written for this module: a letter beyond the Latin ones, and a run that may be a word read in a wrong encoding.
OTHER_SCRIPT = re.compile("[^\\W\\d_\u0000-\u036f]")
BEYOND_ASCII = re.compile("[^\u0000-\u007f]{3}")


def _other_script(token: str) -> list[str]:
    """The words of a token without letters a-z: its letters of other scripts in lower case, repaired if misread.

    Fewer than three letters are no word, as a misread letter can't be told from an accented one; of scripts
    written without blanks each letter is a word.
    """
    if not OTHER_SCRIPT.search(token):
        if not BEYOND_ASCII.search(token):
            return []
        token = next((x for x in repairs(token) if OTHER_SCRIPT.search(x)), "")
    letters = "".join(re.findall(r"[^\W\d_]", token)).lower().replace("ё", "е")
    if not OTHER_SCRIPT.search(letters):
        return []
    if any("\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u2e80" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" for c in letters):
        return list(letters)
    return [letters] if len(letters) >= 3 else []


def words_of(text: str) -> list[str]:
    """The words of a text as they are compared; a word without a letter a-z or digit is one if it is of another script."""
    if text.isascii():
        return _alike(text.lower().encode("ascii")).decode("ascii").split()
    return [word for word, _, _ in _placed(text)]


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """(word as compared, start, end) with the offsets in the original text."""
    return list(_placed(blanked(text)))


def _placed(text: str) -> Iterator[tuple[str, int, int]]:
    for m in re.finditer(r"[^ \t\r\n\x0b\x0c\xa0]+", text):
        token = m[0]
        if token.isascii():
            word = _alike(token.lower().encode("ascii")).decode("ascii")
        else:
            word = _alike(token.lower().encode("ascii", "ignore")).decode("ascii")
            if not word:
                for word in _other_script(token):
                    yield word, m.start(), m.end()
                continue
        if word:
            yield word, m.start(), m.end()


def slips(word: str) -> list[str]:
    """The word and, from four letters on, what is left without any one letter.

    Two words that differ by one letter put in, left out or changed, or by two swapped, share a form.
    """
    return [word] if len(word) < 4 else [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


class Items:
    """The automaton over the items' words, and each item's words for the alignment."""

    def __init__(self, items: list[tuple[int, str]]):
        same: dict[tuple[str, ...], list[int]] = {}
        for item, text in items:
            if words := tuple(words_of(text or "")):
                same.setdefault(words, []).append(item)
        self.ids, self.words = list(same.values()), list(same)
        sizes = np.array([len(words) for words in self.words], dtype=np.int64)
        self.need = np.ceil(sizes * SHARE).astype(np.int64)
        self.seeds = (self.need + 1) // 2
        #: Places of all items are numbered through; an item's begin at its start.
        self.starts = np.cumsum(sizes) - sizes
        self.size = int(sizes.sum())
        places: dict[str, list[int]] = defaultdict(list)
        for start, need, words in zip(self.starts.tolist(), self.need.tolist(), self.words):
            for at, word in enumerate(words):
                places[f" {word} "].append(start + at)
                if need <= FEW and len(word) >= 4:
                    places[f" {word[: len(word) // 2]}"].append(start + at)
                    places[f"{word[len(word) // 2 :]} "].append(start + at)
        self.automaton = ahocorasick.Automaton()
        for no, pattern in enumerate(places):
            self.automaton.add_word(pattern, no)
        if places:
            self.automaton.make_automaton()
        self.places = [np.array(some, dtype=np.int64) for some in places.values()]
        self.word_places = {pattern[1:-1]: some for pattern, some in zip(places, self.places) if pattern[0] == pattern[-1] == " "}
        #: The items' words by the forms that a slip leaves.
        self.by_form: dict[str, list[str]] = defaultdict(list)
        for word in {word for words in self.words for word in words}:
            for form in set(slips(word)):
                self.by_form[form].append(word)
        self.known: dict[str, tuple[str, ...]] = {}
        self.own: dict[int, dict[str, list[int]]] = {}

    def _near(self, word: str) -> tuple[str, ...]:
        """The items' words that a word of a text may stand for."""
        near = self.known.get(word)
        if near is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            near = self.known[word] = tuple({x for form in set(slips(word)) if form in self.by_form for x in self.by_form[form]})
        return near

    def _own(self, no: int) -> dict[str, list[int]]:
        """Places of each of the item's words, last first."""
        if no not in self.own:
            own: dict[str, list[int]] = defaultdict(list)
            for at in range(len(self.words[no]) - 1, -1, -1):
                own[self.words[no][at]].append(at)
            self.own[no] = dict(own)
        return self.own[no]

    def quoted(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """(item number, first word, word after the last, words in common) of the items that the words of a text quote."""
        if not words or not self.places:
            return []
        met = list(self.automaton.iter(f" {' '.join(words)} "))
        if not met:
            return []
        likely = self._with({no for _, no in met}, self.places, self.seeds)
        if not likely.any():
            return []
        # with slips, half of an item's words must be met
        near = [(at, some) for at, word in enumerate(words) if (some := self._near(word))]
        likely &= self._with({word for some in dict.fromkeys(x for _, x in near) for word in some}, self.word_places, self.need)
        out = []
        for no in np.flatnonzero(likely).tolist():
            own, size = self._own(no), len(self.words[no])
            hits = [(at, place) for at, some in near for word in some if word in own for place in own[word]]
            for first_at, last_at in _dense(hits, int(self.need[no]), STRETCH * size):
                best = self._aligned(no, near, first_at - STRETCH * size, last_at + STRETCH * size)
                if best and 2 * best[2] >= 2 * SHARE * size:
                    out.append((no, *best))
                    break
        return out

    def _with(self, met: set, places: list[np.ndarray] | dict[str, np.ndarray], least: np.ndarray) -> np.ndarray:
        """Of each item whether at least so many of its places are among those of what was met."""
        mark = np.zeros(self.size, dtype=np.int32)
        if met:
            mark[np.concatenate([places[x] for x in met])] = 1
        return np.add.reduceat(mark, self.starts) >= least

    def _aligned(self, no: int, near: list[tuple[int, tuple[str, ...]]], start: int, end: int) -> tuple[int, int, int] | None:
        """The first stretch from ``start`` to ``end`` that holds enough of the item's words in order: first word, end and number."""
        own, size = self._own(no), len(self.words[no])
        need = -(-size * SHARE // 1)
        hits: list[tuple[int, list[int]]] = []
        for at, some in near[bisect_left(near, (start,)) : bisect_left(near, (end,))]:
            places = [own[word] for word in some if word in own]
            if places:
                hits.append((at, places[0] if len(places) == 1 else sorted({x for p in places for x in p}, reverse=True)))
        if len(hits) < need or _in_order(hits) < need:
            return None
        for first, (at, _) in enumerate(hits):
            last = bisect_left(hits, at + STRETCH * size, key=lambda h: h[0])
            if last - first < need:
                continue
            common = _in_order(hits[first:last])
            if common >= need:
                return at, hits[last - 1][0] + 1, common
        return None


def _dense(hits: list[tuple[int, int]], needed: int, stretch: int) -> list[tuple[int, int]]:
    """(first, last) of the parts of a text where so many different places are met within a stretch, neighbouring ones joined."""
    out: list[list[int]] = []
    inside: Counter[int] = Counter()
    first = 0
    for at, place in hits:
        inside[place] += 1
        while at - hits[first][0] >= stretch:
            left = hits[first][1]
            inside[left] -= 1
            if not inside[left]:
                del inside[left]
            first += 1
        if len(inside) >= needed:
            if out and hits[first][0] - out[-1][1] <= 2 * stretch:
                out[-1][1] = at
            else:
                out.append([hits[first][0], at])
    return [(a, b) for a, b in out]


def _in_order(hits: list[tuple[int, list[int]]]) -> int:
    """Length of the longest run of hits whose item places increase; places come last first."""
    tails: list[int] = []
    for _, places in hits:
        for place in places:
            at = bisect_left(tails, place)
            if at == len(tails):
                tails.append(place)
            else:
                tails[at] = place
    return len(tails)


_BUILT: dict[int, Items] = {}


def _built(shared) -> Items:
    """The automaton of broadcast items, built once in each Python worker."""
    if shared.id not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.id] = Items(shared.value)
    return _BUILT[shared.id]


class _Shared:
    """Broadcast items with a name that tells them from others in a worker."""

    def __init__(self, spark, items: list[tuple[int, str]]):
        self.id, self.items = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    @property
    def value(self) -> list[tuple[int, str]]:
        return self.items.value


def _scan(shared: _Shared):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _built(shared)
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
                clear = blanked(text)
                found = held.quoted(words_of(clear))
                places = list(_placed(clear)) if found else []
                for no, first, end, common in found:
                    rows += [(doc, item, common, len(held.words[no]), places[first][1], places[end - 1][2]) for item in held.ids[no]]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words_common", "words_item", "start", "end"])

    return scan


def quotations(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words_common, words_item, start, end) of every quotation, once per document row and item.

    documents: doc_id LONG, text; items: item_id LONG, item_text. start and end are offsets of the first
    stretch found in the original text, in code points. Null and empty texts quote nothing, items without words
    are never quoted, repeated rows give their own rows; other columns play no part.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "item_text").dropna().distinct()
    schema = "doc_id long, item_id long, words_common int, words_item int, start int, end int"
    chunks = max(1, -(-wanted.count() // CHUNK))
    scans = []
    for chunk in range(chunks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(chunks)) == chunk).collect()  # about CHUNK rows
        scans.append(texts.mapInPandas(_scan(_Shared(spark, sorted((r["item_id"], r["item_text"]) for r in rows))), schema))
    found = scans[0]
    for other in scans[1:]:
        found = found.unionByName(other)
    return found
