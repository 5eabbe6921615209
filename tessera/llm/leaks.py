"""Problem 8: evaluation passages in a corpus, by q-gram lemma filtering and banded alignment.

Texts are reduced to their words: lower case, without markup, line prefixes, punctuation and invisible characters; where words
are written without blanks (Han, kana) a character is a word. The items' character q-grams form an index of bounded size: the
items' lengths are summed first, and items beyond the bound are taken in parts. A document's q-grams are looked up in it; each
hit lies on a diagonal (document position minus item position). A passage of w words that holds by the rule below has m
characters, at most e damaged words and one remark, so it falls into at most e + 2 undamaged runs, each on one diagonal, which
keep m - q + 1 - e (longest word + q) - (q - 1) of its q-grams; the least such number over an item's passages is its bound. Hits
are counted in bands of diagonals (a band of one item spans no more of the document than the item's length), and an item is
kept for a document only if its best e + 2 bands together hold as many hits as the bound, for bands cut at both of two
places half a band apart: neither loses a passage, as a run lies in one band of each. What is left is aligned word by word in a band: runs of equal words are chained while the diagonal moves by no more than SLIP words and at most
one word in eight is changed, dropped or added; one remark may stand between two runs.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q, BAND = 12, 48
STRETCH, PART, EDIT_SHARE = 14, 8, 8
SLIP, REMARK = 3, 60
MAX_ITEM_CHARS = 64_000_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_GATE = 22  # bits of the first, approximate lookup
_GAP = b"\n" * Q

_TAG = re.compile(r"</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_BREAK = re.compile(r"(?<=\w)-\r?\n[ \t>#*/|]*(?=[a-z])")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_MARKS = re.compile(r"(?<!\w)[*_`~]+(?=\w)|(?<=\w)[*_`~]+(?!\w)")


def words(text: str) -> list[str]:
    """The words of a text without markup, in lower case."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    text = _BREAK.sub("", _INVISIBLE.sub("", text))
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return _WORD.findall(text.lower().replace("’", "'"))


def grams(text: bytes) -> np.ndarray:
    """Hashes of all q-grams of a byte string."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    first = np.ndarray((n,), "<u8", text, 0, (1,))
    last = np.ndarray((n,), "<u8", text, Q - 8, (1,))
    h = first * _M1 + last * _M2
    return h ^ (h >> np.uint64(29))


def needs(item: list[str]) -> tuple[int, int]:
    """(words of a stretch that counts, least words of an item); twice as many where a word is a character."""
    twice = 2 * sum(map(bool, map(_UNSPACED.match, item))) > len(item)
    return (2 * STRETCH, 2 * PART) if twice else (STRETCH, PART)


def least_hits(item: list[str]) -> tuple[int, int]:
    """(the bound of the module's text, over an item's passages, the number of runs it may be spread over)."""
    need = min(needs(item)[0], len(item))
    edits = need // EDIT_SHARE
    w = max(1, need - 1)  # an edit at an end leaves no run there
    size = [len(x.encode()) for x in item]
    bound = min((sum(size[i : i + w]) + w - 1 - Q + 1 - edits * (max(size[i : i + w]) + Q) - (Q - 1) for i in range(len(size) - w + 1)), default=1)
    return max(1, bound), edits + 2


def item_bodies(items: list[tuple[int, str]]) -> dict[int, list[str]]:
    """Words of each item, without a first line that several items share."""
    first: dict[tuple[str, ...], int] = defaultdict(int)
    for _, text in items:
        if text and "\n" in text.strip():
            first[tuple(words(text.strip().split("\n", 1)[0]))] += 1
    out = {}
    for i, text in items:
        body = (text or "").strip()
        if "\n" in body and first[tuple(words(body.split("\n", 1)[0]))] > 1:
            body = body.split("\n", 1)[1]
        w = words(body)
        if w:
            out[i] = w
    return out


class ItemIndex:
    """Q-grams of all items, sorted by hash, with their item and position."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words = {i: w for i, w in item_bodies(items).items() if len(w) >= needs(w)[1]}
        keys, owners, places = [], [], []
        self.ids = list(self.words)
        for o, w in enumerate(self.words.values()):
            g = grams(" ".join(w).encode())
            keys.append(g)
            owners.append(np.full(len(g), o, np.int64))
            places.append(np.arange(len(g), dtype=np.int64))
        none = [np.empty(0, np.int64)]
        key = np.concatenate(keys or [np.empty(0, np.uint64)])
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.place = key[order], np.concatenate(owners or none)[order], np.concatenate(places or none)[order]
        bounds = [least_hits(w) for w in self.words.values()]
        self.least, self.spread = np.array([b for b, _ in bounds], np.int64), np.array([r for _, r in bounds], np.int64)
        self.where: dict[int, dict[str, list[int]]] = {}
        for i, w in self.words.items():
            self.where[i] = defaultdict(list)
            for k, x in enumerate(w):
                self.where[i][x].append(k)
        self.gate = np.zeros(1 << _GATE, bool)
        self.gate[key >> np.uint64(64 - _GATE)] = True

    def candidates(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(text number, item number) where the best bands of diagonals hold enough q-grams; all texts in one pass."""
        if not texts or not len(self.key):
            return []
        starts = np.cumsum([0] + [len(t) + Q for t in texts[:-1]])
        g = grams(_GAP.join(texts) + _GAP)
        at = np.flatnonzero(self.gate[g >> np.uint64(64 - _GATE)])
        lo, hi = np.searchsorted(self.key, g[at], "left"), np.searchsorted(self.key, g[at], "right")
        met = hi > lo
        at, lo, n = at[met], lo[met], (hi - lo)[met]
        if not len(at):
            return []
        slot = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        at = np.repeat(at, n)
        doc = np.searchsorted(starts, at, "right") - 1
        owner = self.owner[slot]
        pair = doc * len(self.ids) + owner
        # hits of the pair at all, then of its best bands
        order = np.argsort(pair, kind="stable")
        pair, owner, diagonal = pair[order], owner[order], (at - starts[doc] - self.place[slot])[order]
        head = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        size = np.diff(np.r_[head, len(pair)])
        keep = np.repeat(size >= self.least[owner[head]], size)
        pair, diagonal = pair[keep], diagonal[keep]
        for shift in (0, BAND // 2):
            if not len(pair):
                return []
            band = (diagonal - diagonal.min() + shift) // BAND
            bands = int(band.max()) + 1
            kinds, count = np.unique(pair * bands + band, return_counts=True)
            of = kinds // bands
            order = np.lexsort((-count, of))
            of, count = of[order], count[order]
            head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            rank = np.arange(len(of)) - np.repeat(head, np.diff(np.r_[head, len(of)]))
            item = of % len(self.ids)
            best = np.add.reduceat(np.where(rank < self.spread[item], count, 0), head)
            good = of[head][best >= self.least[item[head]]]
            keep = np.isin(pair, good)
            pair, diagonal = pair[keep], diagonal[keep]
        return [divmod(int(p), len(self.ids)) for p in np.unique(pair)]


def runs(item: list[str], doc: list[str], where: dict[str, list[int]] | None = None) -> list[tuple[int, int, int]]:
    """(item start, document start, length) of the maximal runs of equal words; ``where`` are the places of the item's words."""
    if where is None:
        where = defaultdict(list)
        for i, w in enumerate(item):
            where[w].append(i)
    open_: dict[int, tuple[int, int, int]] = {}
    out = []
    for j, w in enumerate(doc):
        now = {}
        for i in where.get(w, ()):
            r = open_.pop(i - 1, None)
            now[i] = (r[0], r[1], r[2] + 1) if r else (i, j, 1)
        out += [r for r in open_.values() if r[2] > 1]
        open_ = now
    return out + [r for r in open_.values() if r[2] > 1]


def holds(item: list[str], doc: list[str], where: dict[str, list[int]] | None = None) -> bool:
    """Whether the document holds a stretch of at least STRETCH words of the item (or all of a shorter one), in order, with at
    most one word in EDIT_SHARE changed, dropped or added, and at most one remark between two parts of it."""
    stretch, part_least = needs(item)
    need = min(stretch, len(item))
    if need < part_least:
        return False
    rs = sorted(runs(item, doc, where), key=lambda r: (r[1], r[0]))
    best: list[dict[int, tuple[int, int, int, int]]] = []  # per run and remarks used: (matched, edits, first item word, first part)
    for k, (i, j, n) in enumerate(rs):
        own = {0: (n, 0, i, n)}
        for p in range(k - 1, -1, -1):
            pi, pj, pn = rs[p]
            gj = j - pj - pn
            if gj > REMARK:
                if j - pj > REMARK + 200:
                    break
                continue
            gi = i - pi - pn
            cut = max(0, -gi, -gj)
            if cut >= n or cut >= 3:
                continue
            gi, gj = gi + cut, gj + cut
            for used, (m, e, first, part) in list(best[p].items()):
                if max(gi, gj) <= SLIP:
                    new, u = (m + n - cut, e + max(gi, gj), first, part), used
                elif gi <= 1 and not used:
                    new, u = (m + n - cut, e + gi, first, m), 1
                else:
                    continue
                if new[1] * EDIT_SHARE > (i + n - new[2]) + EDIT_SHARE:  # hopeless already
                    continue
                old = own.get(u)
                if old is None or new[0] - 4 * new[1] > old[0] - 4 * old[1]:
                    own[u] = new
        best.append(own)
        for used, (m, e, first, part) in own.items():
            span = i + n - first
            if used and (min(part, m - part) < 5 or e * EDIT_SHARE > span):
                continue
            whole = need - (1 if e else 0) - max(0, (need - 1) // EDIT_SHARE - e)  # an edit at an end of the stretch leaves no run there
            if span >= whole and m >= whole - e and e * EDIT_SHARE <= span + EDIT_SHARE - 1:
                return True
    return False


def _item_parts(items: DataFrame, most: int) -> list[list[tuple[int, str]]]:
    """The items as lists of at most ``most`` characters (or one item); one list if all fit, which is asked before any is fetched."""
    rows = items.select("item_id", "text").where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    n = -(-total // most) * 2 if total > most else 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    return [[(r.item_id, r.text) for r in (rows if n == 1 else rows.where(part == k)).collect()] for k in range(n)]


def find_leaks(docs: DataFrame, items: DataFrame, most: int = MAX_ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id): documents that hold an item's own wording. Null and blank texts and items give no row.

    Items of more than ``most`` characters in all are taken in parts, each a pass over the documents. A first line that
    several items share is cut off only where they fall into one part.
    """
    out = None
    for rows in _item_parts(items, most):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(rows))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            ix = index.value
            for batch in batches:
                ids, ws = [], []
                for d, text in zip(batch["doc_id"], batch["text"]):
                    w = words(text)
                    if len(w) >= PART:
                        ids.append(d)
                        ws.append(w)
                at = 0
                while at < len(ws):  # some MB of text in one pass
                    end, size = at, 0
                    while end < len(ws) and (end == at or size < 1 << 20):
                        size += sum(map(len, ws[end]))
                        end += 1
                    met = ix.candidates([" ".join(w).encode() for w in ws[at:end]])
                    rows = [(ids[at + k], ix.ids[o]) for k, o in met if holds(ix.words[ix.ids[o]], ws[at + k], ix.where[ix.ids[o]])]
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "item_id"], dtype="int64")
                    at = end

        found = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(run, "doc_id bigint, item_id bigint")
        out = found if out is None else out.union(found)
    return out.distinct()


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, documents) of every leaked item."""
    found = find_leaks(docs, items)
    return found.groupBy("item_id").agg(F.count("*").alias("documents")).join(items.select("item_id", "suite").dropDuplicates(["item_id"]), "item_id").select("item_id", "suite", "documents")
