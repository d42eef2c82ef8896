"""Test items leaking into a corpus: Wu-Manber multi-pattern search over squashed text, then alignment of the finds."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chalkline.llm.texts import chunks

#: A line that only numbers a page: "- 7 -", "[page 7]", "Page 7 / K 12/03", "Some Court · K 12/03 · page 7".
PAGE_LINE = re.compile(
    r"^[ \t]*(?:[—–-][ \t]*\d+[ \t]*[—–-]|\[[ \t]*[^\W\d]+[ \t]+\d+[ \t]*\]|[^\W\d]+[ \t]+\d+[ \t]*/[^\n]{1,40}"
    r"|[^\n·]{1,120}·[^\n·]{1,60}·[ \t]*[^\W\d]+[ \t]+\d+)[ \t]*$",
    re.MULTILINE,
)
#: Characters kept by squashing, as small codes: digits, then letters.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"


def _fold_table() -> np.ndarray:
    """For each character of the basic plane the code of its letter or digit without accent and case, 0 to drop it.

    Characters that fold to several letters (ligatures, sharp s) are replaced before, see `squash`.
    """
    table = np.zeros(0x10000, np.uint8)
    code = {c: i + 1 for i, c in enumerate(ALPHABET)}
    for point in range(0x10000):
        base = unicodedata.normalize("NFKD", chr(point)).casefold()
        letters = [c for c in base if not unicodedata.combining(c)]
        if len(letters) == 1 and letters[0] in code:
            table[point] = code[letters[0]]
    return table


FOLD = _fold_table()
_WIDE = re.compile(r"[ßẞæÆœŒøØłŁđĐĳĲﬀ-ﬆ]")
_SPELLED = {"ß": "ss", "ẞ": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ĳ": "ij", "Ĳ": "ij"}


def clean(text: str) -> str:
    """The text without page lines, with wide letters spelled out. Line ends keep hyphens; squashing drops both."""
    if "\n" in text:
        text = PAGE_LINE.sub("", text)
    return _WIDE.sub(lambda m: _SPELLED.get(m[0]) or unicodedata.normalize("NFKD", m[0]), text)


def squash(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of letter codes, without anything else, and where each begins (one more for the end)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = FOLD[np.minimum(points, 0xFFFF)]
    kept = codes != 0
    upto = np.concatenate([[0], np.cumsum(kept)])
    starts = upto[np.concatenate([[0], np.cumsum(lengths)])]
    return codes[kept], starts


#: Letters of a block of the shift table, and of a search string.
BLOCK = 5
MATCH = 16
#: Words before and after a passage's long equal stretches that are looked for one by one.
EDGE = 8
#: Stands for no number of finds.
NONE = 10_000
#: Letters by which lost or added words move a passage.
DRIFT = 64
#: Places among the items that are looked at in one go.
EXPANDED = 4_000_000
#: Pairs of words that are looked at in one go.
PAIRS = 1_000_000
_TABLE_BITS = 20


class WuManber:
    """Search for many strings of MATCH letter codes at once.

    `shift` holds, for each hashed block of BLOCK codes, how far the window may move; where it is 0 the block ends some
    string: the strings of that suffix are found by their sorted keys and compared in full.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray) -> None:
        """The strings are codes[s : s + MATCH] for s in starts."""
        windows = codes[starts[:, None] + np.arange(MATCH)[None, :]]
        high, low = _pack(windows)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        first = np.ones(len(order), bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        #: Start in `codes` of each occurrence, grouped by string; string k has occurrences[offsets[k] : offsets[k + 1]].
        self.occurrences = starts[order]
        self.offsets = np.append(np.flatnonzero(first), len(order))
        self.high, self.low = high[first], low[first]
        mixed = _mix(self.high, self.low)
        self.by_key = np.argsort(mixed, kind="stable")
        self.keys = mixed[self.by_key]
        self.shift = np.full(1 << _TABLE_BITS, MATCH - BLOCK + 1, np.int16)
        for end in range(BLOCK, MATCH + 1):
            blocks = _block_hash([windows[:, end - BLOCK + j] for j in range(BLOCK)])
            np.minimum.at(self.shift, blocks, np.int16(MATCH - end))

    def find(self, codes: np.ndarray, lane: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `codes` where a string begins, and the string's number, in order of position.

        The array is searched in lanes of equal length that move on together, each by its own shift.
        """
        n = len(codes) - MATCH + 1
        if n <= 0 or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(0, n, lane)
        stop = np.minimum(at + lane, n)
        found = []
        while len(at):
            tail = at + MATCH - BLOCK
            jump = self.shift[_block_hash([codes[tail + j] for j in range(BLOCK)])]
            zero = jump == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(jump, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.sort(np.concatenate(found))
        high, low = _pack(codes[place[:, None] + np.arange(MATCH)[None, :]])
        mixed = _mix(high, low)
        left = np.searchsorted(self.keys, mixed)
        left[left == len(self.keys)] = 0
        which = self.by_key[left]
        same = (self.high[which] == high) & (self.low[which] == low)
        return place[same], which[same]


def _block_hash(columns: Sequence[np.ndarray]) -> np.ndarray:
    h = columns[0].astype(np.uint32)
    for c in columns[1:]:
        h = h * np.uint32(37) + c
    return (h * np.uint32(2654435761)) >> np.uint32(32 - _TABLE_BITS)


def _pack(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of codes as two numbers, without loss."""
    parts = []
    for a, b in ((0, 10), (10, MATCH)):
        h = np.zeros(len(windows), np.uint64)
        for j in range(a, b):
            h = (h << np.uint64(6)) | windows[:, j].astype(np.uint64)
        parts.append(h)
    return parts[0], parts[1]


def _mix(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high * np.uint64(0x9E3779B97F4A7C15)) ^ (low * np.uint64(0xC2B2AE3D27D4EB4F))


class Items:
    """The test items' letter codes, word starts and the search for their strings."""

    #: A word in at most so many items tells items apart.
    RARE = 3

    def __init__(self, ids: Sequence[int], texts: Sequence[str]) -> None:
        cleaned = [clean(t or "") for t in texts]
        same: dict[bytes, list[int]] = {}
        for i, t in zip(ids, cleaned):
            same.setdefault(squash([t])[0].tobytes(), []).append(i)
        distinct = {squash([t])[0].tobytes(): t for t in cleaned}
        cleaned = [distinct[k] for k in same]
        #: Ids of the items with each distinct text.
        self.ids = list(same.values())
        self.codes, self.starts = squash(cleaned)
        words = [w for t in cleaned for w in t.split()]
        sizes = np.diff(squash(words)[1]) if words else np.empty(0, np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1] if words else np.empty(0, np.int64)
        #: Where each word begins in `codes`; words of punctuation only have no letters and do not count.
        self.words = begins[sizes > 0].astype(np.int64)
        ends = np.append(self.starts, len(self.codes))[np.searchsorted(self.starts, self.words, side="right")]
        self.search = WuManber(self.codes, self.words[self.words + MATCH <= ends])
        #: Item and word of each place at which a string of the search begins.
        self.place_item = np.searchsorted(self.starts, self.search.occurrences, side="right") - 1
        self.place_word = np.searchsorted(self.words, self.search.occurrences)
        self.bytes = self.codes.tobytes()
        self.bounds = np.append(self.words, len(self.codes))
        self.starts = np.asarray(self.starts)
        self.ends = np.append(self.starts[1:], len(self.codes))
        spelled = [self.bytes[a:b] for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())]
        owner = np.searchsorted(self.starts, self.words, side="right") - 1
        holders: dict[bytes, set[int]] = {}
        for word, item in zip(spelled, owner.tolist()):
            holders.setdefault(word, set()).add(item)
        #: Words that few items have: names, numbers, dates.
        self.rare = np.array([len(holders[w]) <= self.RARE for w in spelled], bool)
        self._bounds: dict[int, tuple[int, int, list[int]]] = {}
        self._least: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]] = {}

    def word_bounds(self, i: int) -> tuple[int, int, list[int]]:
        """First word of an item, the one after its last, and where each begins in `codes` (one more for the end)."""
        if i not in self._bounds:
            first, last = np.searchsorted(self.words, self.starts[i : i + 2]).tolist()
            self._bounds[i] = first, last, self.bounds[first : last + 1].tolist()
        return self._bounds[i]

    def least(self, min_words: int, error_share: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(n, finds from each word, the same over the n windows up to it) for the lengths n that bound all passages.

        The finds from a word are those that n words from there keep at least, whichever n // error_share of them are
        wrong; 1 at least, NONE where fewer than n words follow. A passage of 2 * min_words or more has a part of
        min_words or more with no larger a share wrong, and one of other length holds one of the lengths n.
        """
        if (min_words, error_share) not in self._least:
            lengths = [min_words, *(n for n in range(min_words + 1, 2 * min_words) if n % error_share == 0)]
            found = []
            for n in lengths:
                g = self._kept(n, n // error_share)
                around = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, NONE, np.int16), g]), n).min(1)
                found.append((n, g, around))
            self._least[min_words, error_share] = found
        return self._least[min_words, error_share]

    def _kept(self, n: int, wrong: int) -> np.ndarray:
        out = np.full(len(self.words), NONE, np.int16)
        ends = np.searchsorted(self.words, np.append(self.starts, len(self.codes))[np.searchsorted(self.starts, self.words, side="right")])
        a = np.flatnonzero(np.arange(len(self.words)) + n <= ends)
        if not len(a):
            return out
        # First word whose string reaches beyond the start of each word, by place in the window.
        reach = np.searchsorted(self.words, self.bounds - MATCH, side="right")
        reach = np.stack([np.clip(reach[a + e] - a, 0, n) for e in range(n + 1)]).astype(np.int16)
        after = np.arange(1, n + 1, dtype=np.int16)[:, None]
        best = reach[:n]
        least = reach[n].copy()
        for k in range(wrong):
            np.minimum(least, (best + np.maximum(reach[n] - after, 0)).min(0), out=least)
            if k < wrong - 1:
                best = np.stack([np.full(len(a), NONE, np.int16), *((best[:e] + np.maximum(reach[e] - after[:e], 0)).min(0) for e in range(1, n))])
        out[a] = np.maximum(least, 1)
        return out


def find_leaks(items: Items, texts: Sequence[str], min_words: int = 25, error_share: int = 8) -> list[tuple[int, int, int]]:
    """(index of text, item id, words of the longest passage) for each text that holds a passage of an item.

    See `leaked_items` for what counts.
    """
    codes, starts = squash([clean(t or "") for t in texts])
    place, string = items.search.find(codes)
    longest: dict[tuple[int, int], int] = {}
    for d, i, n in _passages(items, codes, starts, place, string, min_words, error_share):
        longest[d, i] = max(n, longest.get((d, i), 0))
    return [(d, item_id, n) for (d, i), n in longest.items() for item_id in items.ids[i]]


def _expand(search: WuManber, place: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each find with the number of each of its string's places among the items."""
    many = search.offsets[string + 1] - search.offsets[string]
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(place, many), np.repeat(search.offsets[string], many) + nth


def _passages(items, codes, starts, place, string, min_words, error_share):
    """(text, item, words) for each chain of finds that makes a passage.

    Finds are told by item and by diagonal (place in the texts less place in the item). A string counts for every item
    that has it, however many they are; the alignment decides for each text and item by itself.
    """
    doc = np.searchsorted(starts, place, side="right") - 1
    within = place + MATCH <= starts[doc + 1]
    place, string, doc = place[within], string[within], doc[within]
    for part in _whole_texts(doc, items.search.offsets[string + 1] - items.search.offsets[string]):
        for d, i, there, diagonal, text in _candidates(items, codes, starts, doc[part], place[part], string[part], min_words, error_share):
            order = np.lexsort((there, diagonal))
            length = _longest(items, text, int(starts[d]), int(starts[d + 1]), i, there[order], diagonal[order], min_words, error_share)
            if length:
                yield d, i, length


def _whole_texts(doc: np.ndarray, many: np.ndarray) -> Iterator[slice]:
    """Slices of the finds by whole texts, of about EXPANDED places among the items each, or of one text."""
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)) if len(doc) else np.empty(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(many)])
    a = 0
    while a < len(doc):
        b = int(ends[max(np.searchsorted(upto[ends], upto[a] + EXPANDED, side="right") - 1, np.searchsorted(ends, a, side="right"))])
        yield slice(a, b)
        a = b


def _candidates(items, codes, starts, doc, place, string, min_words, error_share):
    """(text, item, places in the item, diagonals, all texts) of each chain with the finds that a passage keeps at least."""
    many = items.search.offsets[string + 1] - items.search.offsets[string]
    here, nth = _expand(items.search, place, string)
    doc, item, word = np.repeat(doc, many), items.place_item[nth], items.place_word[nth]
    there = items.search.occurrences[nth]
    diagonal = here - there
    order = np.lexsort((diagonal, doc * len(items.starts) + item))
    doc, item, there, diagonal, word = (x[order] for x in (doc, item, there, diagonal, word))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > DRIFT)
    begin = np.flatnonzero(fresh)
    finish = np.append(begin[1:], len(doc))
    total = len(items.words) + 2 * min_words
    at = np.sort((np.cumsum(fresh) - 1) * total + word)
    at = at[np.diff(at, prepend=-1) > 0]
    chain, word = at // total, at % total
    alone = np.ones(len(at), bool)
    alone[1:] = np.diff(at) > 1
    good = np.zeros(len(begin), bool)
    for n, exact, around in items.least(min_words, error_share):
        finds = np.searchsorted(at, at + n) - np.arange(len(at))
        good[chain[finds >= np.where(alone, around[word], exact[word])]] = True
    begin, finish = begin[good], finish[good]
    room, single, low, high = _room(items, codes, starts, doc[begin], item[begin], there, diagonal, begin, finish)
    wide = np.flatnonzero(room >= min_words)
    if not len(wide):
        return
    begin, finish, single, low, high = begin[wide], finish[wide], single[wide].tolist(), low[wide].tolist(), high[wide].tolist()
    docs, owners, shifts = doc[begin].tolist(), item[begin].tolist(), diagonal[begin].tolist()
    from_, upto = starts[doc[begin]].tolist(), starts[doc[begin] + 1].tolist()
    text, needed = codes.tobytes(), min_words - min_words // error_share
    for k, (a, b) in enumerate(zip(begin.tolist(), finish.tolist())):
        if single[k] and _too_few(items, text, from_[k], upto[k], owners[k], low[k], high[k], shifts[k], needed):
            continue
        yield docs[k], owners[k], there[a:b], diagonal[a:b], text


def _room(items, codes, starts, doc, item, there, diagonal, begin, finish):
    """Words that a passage of each chain can have at most, whether its finds make one equal stretch, and that stretch.

    Most chains are such: a formula that the item shares with many texts, and nothing else beside it.
    """
    first, last = there[begin], np.maximum.reduceat(np.append(there, 0), np.stack([begin, finish], 1).ravel())[::2] if len(begin) else there[begin]
    shift = diagonal[begin]
    upper = np.minimum(items.ends[item], starts[doc + 1] - shift)
    lower = np.maximum(items.starts[item], starts[doc] - shift)
    b, a = first + MATCH, first.copy()
    live = np.flatnonzero(b < upper)
    while len(live):
        live = live[items.codes[b[live]] == codes[b[live] + shift[live]]]
        b[live] += 1
        live = live[b[live] < upper[live]]
    live = np.flatnonzero(a > lower)
    while len(live):
        live = live[items.codes[a[live] - 1] == codes[a[live] - 1 + shift[live]]]
        a[live] -= 1
        live = live[a[live] > lower[live]]
    begins, ends = np.searchsorted(items.words, items.starts[item]), np.searchsorted(items.words, items.ends[item])
    left = np.maximum(np.searchsorted(items.bounds, a, side="right") - 1 - EDGE, begins)
    right = np.minimum(np.searchsorted(items.bounds, b, side="left") + EDGE, ends)
    single = (diagonal[finish - 1] == shift) & (last + MATCH <= b)
    return np.where(single, right - left, ends - begins), single, a, b


def _too_few(items, text, lo, hi, i, a, b, g, needed):
    """Whether the words of one equal stretch and those found next to it (as `_fill_gaps` does) stay under `needed`."""
    first, last, bounds = items.word_bounds(i)
    begin, end = bisect_left(bounds, a), bisect_right(bounds, b) - 1
    right = bisect_left(bounds, b)
    left = bisect_right(bounds, a) - 1
    after, before = range(right, min(last - first, right + EDGE)), range(min(left, begin - 1), max(left - EDGE, -1), -1)
    spare = end - begin + len(after) + len(before) - needed
    at, until = b + g, min(hi, b + g + 60)
    for w in after:
        word = items.bytes[bounds[w] : bounds[w + 1]]
        near = text.find(word, at, min(until, at + 24 + len(word)))
        if near >= 0 and (len(word) > 2 or near == at):
            at = near + len(word)
        else:
            spare -= 1
            if spare < 0:
                return True
    at = a + g
    for w in before:
        word = items.bytes[bounds[w] : bounds[w + 1]]
        near = text.rfind(word, max(lo, at - 24 - len(word)), at)
        if near >= 0 and (len(word) > 2 or near + len(word) == at):
            at = near
        else:
            spare -= 1
            if spare < 0:
                return True
    return spare < 0


def _segments(items, text, lo, hi, i, there, diagonal):
    """Longest equal stretches (item start, item end, diagonal) around the finds, by item position."""
    begin, end = int(items.starts[i]), int(items.starts[i + 1])
    out, upto = [], {}
    for o, g in zip(there.tolist(), diagonal.tolist()):
        if o < upto.get(g, -1):
            continue
        a, b = o, o + MATCH
        while a > begin and a + g > lo and items.bytes[a - 1] == text[a + g - 1]:
            a -= 1
        while b < end and b + g < hi and items.bytes[b] == text[b + g]:
            b += 1
        upto[g] = b
        out.append((a, b, g))
    out.sort()
    return out


def _longest(items, text, lo, hi, i, there, diagonal, min_words, error_share):
    """Words of the longest admissible passage, 0 if none."""
    segments = _segments(items, text, lo, hi, i, there, diagonal)
    first, last, bounds = items.word_bounds(i)
    best = 0
    for chain in _chains(segments):
        # Words next to the segments are filled in for EDGE words at most.
        left = max(bisect_right(bounds, chain[0][0]) - 1 - EDGE, 0)
        right = min(max(bisect_left(bounds, b) for _, b, _ in chain) + EDGE, last - first)
        if right - left < min_words:
            continue
        known = bytearray(last - first)
        for a, b, _ in chain:
            for w in range(bisect_left(bounds, a), bisect_right(bounds, b) - 1):
                known[w] = 1
        _fill_gaps(items, text, lo, hi, chain, known, bounds)
        if known.count(1) >= min_words - min_words // error_share:
            best = max(best, _admissible(np.frombuffer(known, bool), items.rare[first:last], min_words, error_share))
    return best


def _chains(segments):
    """Segments in the same order in item and text, each next one a few lost, added or changed words further."""
    left = list(segments)
    while left:
        chain, rest = [left[0]], []
        for a, b, g in left[1:]:
            pa, pb, pg = chain[-1]
            item_gap, text_gap = a - pb, a + g - pb - pg
            if b > pb and b + g > pb + pg and a > pa and a + g > pa + pg and item_gap <= 60 and -12 <= text_gap <= max(item_gap, 0) + 40:
                chain.append((a, b, g))
            else:
                rest.append((a, b, g))
        yield chain
        left = rest


def _fill_gaps(items, text, lo, hi, chain, known, bounds):
    """Mark words between and next to the segments that the search's minimum length left out."""
    for (a, b, g), following in zip(chain, [*chain[1:], None]):
        at = b + g
        until = following[0] + following[2] if following else min(hi, at + 60)
        w = bisect_left(bounds, b)
        stop = bisect_left(bounds, following[0]) if following else min(len(known), w + EDGE)
        while w < stop:
            if not known[w]:
                word = items.bytes[bounds[w] : bounds[w + 1]]
                near = text.find(word, at, min(until, at + 24 + len(word)))
                if near >= 0 and (len(word) > 2 or near == at):
                    known[w] = 1
                    at = near + len(word)
            w += 1
    a, b, g = chain[0]
    at, w = a + g, bisect_right(bounds, a) - 1
    for w in range(w, max(w - EDGE, -1), -1):
        if not known[w]:
            word = items.bytes[bounds[w] : bounds[w + 1]]
            near = text.rfind(word, max(lo, at - 24 - len(word)), at)
            if near >= 0 and (len(word) > 2 or near + len(word) == at):
                known[w] = 1
                at = near


def _admissible(known, rare, min_words, error_share):
    """Length of the longest run of words that is a passage, 0 if none.

    It has `min_words` or more, begins and ends with a known word, and at most one in `error_share` is unknown; of its
    rare words at least half are known, or it is a text told alike with other names.
    """
    n = len(known)
    hits = np.flatnonzero(known)
    if len(hits) < min_words - min_words // error_share or n < min_words:
        return 0
    bad = np.concatenate([[0], np.cumsum(~known)])
    named = np.concatenate([[0], np.cumsum(rare)])
    met = np.concatenate([[0], np.cumsum(rare & known)])
    best, step = 0, max(1, PAIRS // len(hits))
    # Beginnings in order, as many at once as memory allows, until no later one can give a longer run.
    for k in range(0, len(hits), step):
        if hits[-1] + 1 - hits[k] <= best:
            break
        a, b = hits[k : k + step, None], hits[None, k:] + 1
        size = b - a
        fine = (size >= max(min_words, best + 1)) & ((bad[b] - bad[a]) * error_share <= size) & (2 * (met[b] - met[a]) >= named[b] - named[a])
        best = int(size[fine].max()) if fine.any() else best
    return best


def _items_of(shared) -> Items:
    """The items of a broadcast, prepared once by each worker, whatever the number of its tasks."""
    known = getattr(shared, "prepared", None)
    if known is None:
        known = shared.prepared = Items(*shared.value)
    return known


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = 25, error_share: int = 8, max_item_bytes: int = 64_000_000) -> DataFrame:
    """Documents that hold passages of test items: `doc_id`, `item_id`, `n_words` (of the longest passage).

    A passage is `min_words` or more of the item's words in order, of which at most one in `error_share` is lost,
    misspelled or replaced. Case, accents, punctuation, spacing, hyphens, line ends and lines that only number a page
    do not matter. A passage that many items share is found for each of them. A text told alike with other names is no
    passage: of the words that tell items apart at least half must be there.

    documents has `doc_id`, `text`; items has `item_id`, `text`; other columns are ignored. Null and empty texts hold
    nothing; an item shorter than `min_words` is found nowhere; items of equal text are all reported; repeated rows
    of documents give repeated rows. Whole texts are searched, however long.

    The items are the broadcast side; their size is checked against `max_item_bytes` and beyond it they are searched
    for in several passes over the documents, each with a part of the items. The documents are not shuffled.
    """
    spark = documents.sparkSession
    wanted = items.select("item_id", "text").where("text is not null")
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // max_item_bytes))
    out = None
    for part in range(parts):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        shared = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = _items_of(shared)
            kind = pa.array(shared.value[0], item_kind).type
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                found = [x for a, b in chunks(texts) for x in ((a + d, i, n) for d, i, n in find_leaks(known, texts[a:b], min_words, error_share))]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([d for d, _, _ in found], pa.int64())), pa.array([i for _, i, _ in found], kind), pa.array([n for _, _, n in found], pa.int32())],
                    names=["doc_id", "item_id", "n_words"],
                )

        item_kind = to_arrow_type(items.schema["item_id"].dataType)
        kinds = dict(documents.dtypes), dict(items.dtypes)
        found = documents.select("doc_id", "text").where("text is not null").mapInArrow(
            search, f"doc_id {kinds[0]['doc_id']}, item_id {kinds[1]['item_id']}, n_words int"
        )
        out = found if out is None else out.unionByName(found)
    return out
