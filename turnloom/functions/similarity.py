"""Similarity of texts: token overlap in the JVM, subsequence ratios in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def tokens(normal: Column) -> Column:
    """The distinct tokens of a normalised text."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: t != ""))


def set_overlap(x: Column, y: Column) -> Column:
    """Shared tokens of two arrays of distinct tokens over those of the shorter; 0 if either is empty."""
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def token_overlap(a: Column, b: Column) -> Column:
    """``set_overlap`` of two normalised texts."""
    return set_overlap(tokens(a), tokens(b))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit of an integer for each character of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, at = full, where.get
    for places in [at(ch, 0) for ch in b]:
        hit = row & places
        row = row + hit | row - hit  # what is carried beyond the last bit never comes back
    return (full & ~row).bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty strings."""
    both = len(a) + len(b)
    return 1.0 if not both else 2.0 * lcs_length(a, b) / both


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared tokens and the shared tokens with either side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    rest_a, rest_b = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not rest_a or not rest_b):
        return 1.0
    with_a, with_b = f"{shared} {rest_a}".strip(), f"{shared} {rest_b}".strip()
    best = ratio(with_a, with_b)
    if shared:
        best = max(best, ratio(shared, with_a), ratio(shared, with_b))
    return best


@lru_cache(maxsize=200_000)
def text_similarity(a: str, b: str) -> float:
    """0.65 of the blended ratios (0.7 plain, 0.3 by token sets) and 0.35 of the token overlap; 0 if either is empty."""
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    overlap = len(x & y) / min(len(x), len(y)) if x and y else 0.0
    return 0.65 * (0.7 * ratio(a, b) + 0.3 * token_set_ratio(a, b)) + 0.35 * overlap


#: Longest text, and most different characters, that are compared in bulk; others one by one.
BULK_CHARS, BULK_ALPHABET, BULK_PAIRS = 256, 400, 16_384


def _code_points(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _bulk_texts(strings: list[str], alphabet: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each string the places of each character as bits (an array for each 64 places, flat over strings and
    characters), the characters by place, and the lengths."""
    size = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    at = np.repeat(np.arange(len(strings)), size)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    code = np.searchsorted(alphabet, _code_points(strings))
    chars = np.zeros((int(size.max()), len(strings)), dtype=np.int64)
    chars[place, at] = code
    slot, bit = at * len(alphabet) + code, np.uint64(1) << (place & 63).astype(np.uint64)
    masks = []
    for w in range((len(chars) + 63) // 64):
        own = (place >> 6) == w
        mask = np.zeros(len(strings) * len(alphabet), dtype=np.uint64)
        np.bitwise_or.at(mask, slot[own], bit[own])
        masks.append(mask)
    return masks, chars, size


def _bulk_lcs(masks: list[np.ndarray], chars: np.ndarray, size: np.ndarray, alphabet: int, a: np.ndarray, b: np.ndarray, keep: list[np.ndarray] | None = None) -> np.ndarray:
    """``lcs_length`` of the strings a[k] and b[k]. ``keep``: for each 64 places the bits of those that count, of all
    strings a and then of all strings b."""
    short, long_ = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    # The bits are those of the longer string if it has one word of them, else of the shorter.
    swap = (size[a] < size[b]) == (long_ <= 64)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    width, steps = (size[p] + 63) // 64, size[q]
    out = np.zeros(len(a), dtype=np.int64)
    order = np.lexsort((-steps, width))
    for begin in range(0, len(order), BULK_PAIRS):
        these = order[begin : begin + BULK_PAIRS]
        these = these[np.argsort(-steps[these], kind="stable")]
        words, last = int(width[these].max()), steps[these]
        active = np.searchsorted(-last, -np.arange(int(last[0]) if len(last) else 0), side="left")
        base, other = p[these] * alphabet, q[these]
        rows = [np.full(len(these), ~np.uint64(0)) for _ in range(words)]
        if keep is not None:
            turned = swap[these]
            kept_p = [np.where(turned, x[1][these], x[0][these]) for x in keep]
            kept_q = [np.where(turned, x[0][these], x[1][these]) for x in keep]
        for k, n in enumerate(active):
            index = base[:n] + chars[k].take(other[:n])
            if keep is not None:
                counts = np.negative((kept_q[k >> 6][:n] >> np.uint64(k & 63)) & np.uint64(1))
            carry = None
            for w in range(words):
                row, hit = rows[w][:n], masks[w].take(index)
                if keep is not None:
                    hit &= kept_p[w][:n]
                    hit &= counts
                hit &= row
                total = row + hit
                if w + 1 < words or carry is not None:
                    over = total < hit
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                row -= hit
                row |= total
        out[these] = sum((np.bitwise_count(~x).astype(np.int64) for x in rows), np.zeros(len(these), dtype=np.int64))
    return out


def text_similarities(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``text_similarity`` of texts[a[k]] and texts[b[k]] for each k, equal to the last bit: the subsequences of many
    pairs are followed at once. The tokens that two texts share are cut from both, as their common beginning adds its
    length."""
    out = np.zeros(len(a))
    length = np.array([len(t) for t in texts], dtype=np.int64)
    alphabet = np.unique(np.append(_code_points(texts), np.uint32(32)))
    bulk = (length[a] > 0) & (length[b] > 0) & (length[a] < BULK_CHARS) & (length[b] < BULK_CHARS) & (len(alphabet) <= BULK_ALPHABET)
    for k in np.flatnonzero(~bulk & (length[a] > 0) & (length[b] > 0)):
        out[k] = text_similarity(texts[a[k]], texts[b[k]])
    if not bulk.any():
        return out
    used, renumbered = np.unique(np.concatenate([a[bulk], b[bulk]]), return_inverse=True)
    own = [texts[i] for i in used]
    plain = _bulk_texts(own, alphabet)
    words = [sorted(set(t.split())) for t in own]
    n_words = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    most = max(1, int(n_words.max()))
    # Of each text its tokens in order, each with a space after it: numbers, lengths and bits of their places.
    ordered = _bulk_texts([" ".join(ws) + " " for ws in words], alphabet)
    flat = [w for ws in words for w in ws]
    at = np.repeat(np.arange(len(words)), n_words)
    slot = np.arange(len(flat)) - np.repeat(np.cumsum(n_words) - n_words, n_words), at
    number, spans, starts = np.full((most, len(own)), -1, dtype=np.int32), np.zeros((most, len(own)), dtype=np.int64), np.zeros((most, len(own)), dtype=np.int64)
    number[slot] = pd.factorize(np.array(flat, dtype=object))[0]
    spans[slot] = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)) + 1
    np.cumsum(spans[:-1], axis=0, out=starts[1:])
    low_bits = np.array([(1 << k) - 1 for k in range(65)], dtype=np.uint64)
    bits = [low_bits[np.clip(starts + spans - 64 * w, 0, 64)] & ~low_bits[np.clip(starts - 64 * w, 0, 64)] for w in range(len(ordered[0]))]
    total = spans.sum(axis=0)
    left, right = renumbered[: bulk.sum()], renumbered[bulk.sum() :]
    found = np.zeros(len(left))
    order = np.lexsort((n_words[right], n_words[left]))
    for begin in range(0, len(order), BULK_PAIRS):
        these = order[begin : begin + BULK_PAIRS]
        x, y = left[these], right[these]
        both = (plain[2][x] + plain[2][y]).astype(float)
        ratios = 2.0 * _bulk_lcs(*plain, len(alphabet), x, y) / both
        n_x, n_y = int(n_words[x].max()), int(n_words[y].max())
        mine, theirs = [number[j].take(x) for j in range(n_x)], [number[j].take(y) for j in range(n_y)]
        in_x, in_y = np.zeros((n_x, len(x)), dtype=bool), np.zeros((n_y, len(y)), dtype=bool)
        for i, u in enumerate(mine):
            for j, v in enumerate(theirs):
                same = u == v
                in_x[i] |= same
                in_y[j] |= same
        shared, n_shared = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        some_bits = bits[: int(max(total[x].max(), total[y].max()) + 63) // 64]
        keep_x, keep_y = [np.zeros(len(x), dtype=np.uint64) for _ in some_bits], [np.zeros(len(x), dtype=np.uint64) for _ in some_bits]
        for i in range(n_x):
            hit = in_x[i] & (mine[i] >= 0)
            n_shared += hit
            shared += np.where(hit, spans[i].take(x), 0)
            for kept, part in zip(keep_x, some_bits):
                kept |= np.where(hit, np.uint64(0), part[i].take(x))
        for j in range(n_y):
            for kept, part in zip(keep_y, some_bits):
                kept |= np.where(in_y[j], np.uint64(0), part[j].take(y))
        rest_x, rest_y = total[x] - shared, total[y] - shared
        least = np.minimum(n_words[x], n_words[y])
        sets = np.where((least > 0) & (n_shared > 0), 1.0, 0.0)
        apart = np.flatnonzero((rest_x > 0) & (rest_y > 0) & (least > 0))
        if len(apart):
            lcs = _bulk_lcs(*ordered, len(alphabet), x[apart], y[apart], [(u[apart], v[apart]) for u, v in zip(keep_x, keep_y)])
            s, size_x, size_y = shared[apart], total[x][apart] - 1, total[y][apart] - 1
            best = 2.0 * (s + lcs - 1) / (size_x + size_y)
            some = s > 0
            head = np.where(some, s - 1, 0)
            with_x, with_y = 2.0 * head / (head + size_x), 2.0 * head / (head + size_y)
            sets[apart] = np.where(some, np.maximum(best, np.maximum(with_x, with_y)), best)
        overlap = np.where(least > 0, n_shared / np.maximum(least, 1), 0.0)
        found[these] = 0.65 * (0.7 * ratios + 0.3 * sets) + 0.35 * overlap
    out[np.flatnonzero(bulk)] = found
    return out


@F.pandas_udf(DoubleType())
def fuzzy_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``text_similarity`` of two normalised columns; null counts as empty."""
    number: dict[str, int] = {}
    left, right = (np.array([number.setdefault(x or "", len(number)) for x in side], dtype=np.int64) for side in (a, b))
    return pd.Series(text_similarities(list(number), left, right), dtype="float64")


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of two columns; null counts as empty."""
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@lru_cache(maxsize=10_000)
def without_best_span(source: str, removed: str, least: float = 0.55) -> str:
    """The source without the token span most similar to ``removed``, among spans up to three tokens longer or shorter;
    the first of equals, shorter spans before longer. The source as it is if none is similar enough.

    Only equal texts have similarity 1. Else lengths and shared tokens bound the similarity of each span; the one of the
    greatest bound is compared, and from each token where a span may still reach it one pass gives the plain ratios of
    the spans that begin there. With the best conceivable token set ratio they bound it anew, and what can't win isn't
    compared."""
    words, gone = source.split(), removed.split()
    if not words or not gone:
        return " ".join(words)
    target = " ".join(gone)
    if least <= 1.0:
        for i in range(len(words) - len(gone) + 1):
            if words[i] == gone[0] and words[i : i + len(gone)] == gone:
                return " ".join(words[:i] + words[i + len(gone) :])
    where: dict[str, int] = {}
    for i, ch in enumerate(target):
        where[ch] = where.get(ch, 0) | 1 << i
    full, wanted, size = (1 << len(target)) - 1, set(gone), len(target)
    shortest, longest = max(1, len(gone) - 3), min(len(words), len(gone) + 3)
    lengths = [len(w) for w in words]
    bounds: list[tuple[int, list[tuple[int, int, float, float]]]] = []  # first token, and of its spans last token, characters, overlap, bound
    seed = 0.0, 0, 0
    for i in range(len(words) - shortest + 1):
        chars, own, shared, spans_here = -1, set(), 0, []
        for k in range(i, min(len(words), i + longest)):
            chars += lengths[k] + 1
            if words[k] not in own:
                own.add(words[k])
                shared += words[k] in wanted
            if k - i + 1 >= shortest:
                overlap = shared / min(len(own), len(wanted))
                most = 0.65 * (0.7 * (2.0 * min(chars, size) / (chars + size)) + 0.3) + 0.35 * overlap
                if most >= least:
                    spans_here.append((k, chars, overlap, most))
                    if shared and most > seed[0]:
                        seed = most, i, k
        if spans_here:
            bounds.append((i, spans_here))
    floor = max(least, text_similarity(" ".join(words[seed[1] : seed[2] + 1]), target)) if seed[0] else least
    places: dict[str, list[int]] = {}
    spans = []
    for i, spans_here in bounds:
        kept = [x for x in spans_here if x[3] >= floor]
        if not kept:
            continue
        row, upto = full, i
        for k, chars, overlap, _ in kept:
            for j in range(upto, k + 1):
                word = words[j]
                if word not in places:
                    places[word] = [where.get(ch, 0) for ch in " " + word]
                for hits in places[word][1:] if j == i else places[word]:
                    hit = row & hits
                    row = row + hit | row - hit
            upto = k + 1
            most = 0.65 * (0.7 * (2.0 * (full & ~row).bit_count() / (chars + size)) + 0.3) + 0.35 * overlap
            if most >= floor:
                spans.append((-most, k - i + 1, i))
    best, cut = -1.0, (0, 0)
    for most, length, i in sorted(spans):
        if -most < best:
            break
        s = text_similarity(" ".join(words[i : i + length]), target)
        if s > best or s == best and (length, i) < cut:
            best, cut = s, (length, i)
    return " ".join(words[: cut[1]] + words[cut[1] + cut[0] :]) if best >= least else " ".join(words)


@F.pandas_udf(StringType())
def span_removed(source: pd.Series, removed: pd.Series) -> pd.Series:
    """``without_best_span`` of two columns; null counts as empty."""
    return pd.Series([without_best_span(x or "", y or "") for x, y in zip(source, removed)], dtype="object")
