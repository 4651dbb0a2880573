"""Problem 10: pages of keywords, links, menus or tags instead of sentences.

A page is cut into segments (lines, and sentences within them). Of each segment
some signs are observed: an end mark, function words without one, the form of a field,
many items, wording repeated inside it, wording repeated over the page, addresses,
tags, arrows, shortness. A hidden Markov model with the states prose, data
(the lines of a data sheet), link, tag and menu, whose states give each sign with a probability of their own, labels the
segments (Viterbi), so that neighbours decide where signs are weak. A page is
flagged if more than half of its words are in segments of links, tags or menus.
The model starts from prior counts and is fitted by Baum-Welch to all pages: their
signs are found once and kept, each round sums the expected counts of every page in
tasks. Labels and shares are computed for every page, whole.

Defined cases: null, empty and blank texts are no spam; repeated texts are each
reported; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dialoom.session import cut

STATES = ("prose", "data", "link", "tag", "menu")
#: States from here on are no text to read.
OTHER = 2
SIGNS = ("ended", "words", "field", "items", "repeated", "common", "address", "hash", "arrows", "short")
#: Rounds of Baum-Welch.
ROUNDS = 3
#: Weight of the prior counts against those of so many pages. With more pages it grows
#: in proportion: else the states of a large table would leave what they stand for.
PRIOR, PRIOR_PAGES = 20_000.0, 1500
#: Segments whose expected counts are computed at once (those of one page at least).
PART = 50_000
#: Segments beyond which a page is labelled alone: few others would go in step with it.
ALONE = 200
#: Decimals of fitted probabilities: the order of sums over tasks does not show in them.
DECIMALS = 9
#: Repetition inside a segment from which it is no plain sentence.
REPEATED = 0.12
#: A word is common on a page if it stands in so many segments and so large a share of
#: them; a segment is so if this share of its words is.
SEGMENTS, SPREAD, COMMON = 3, 0.12, 0.34
#: Share of words that are not prose from which a page is flagged.
SHARE = 0.5

#: Prior probabilities of the signs per state, in the order of SIGNS.
EMISSIONS = np.array([
    [0.75, 0.20, 0.05, 0.02, 0.005, 0.02, 0.010, 0.004, 0.005, 0.20],
    [0.03, 0.12, 0.985, 0.02, 0.010, 0.05, 0.010, 0.004, 0.030, 0.85],
    [0.10, 0.20, 0.05, 0.10, 0.10, 0.25, 0.95, 0.02, 0.05, 0.40],
    [0.05, 0.10, 0.05, 0.30, 0.10, 0.25, 0.02, 0.80, 0.02, 0.50],
    [0.20, 0.10, 0.02, 0.25, 0.30, 0.40, 0.02, 0.02, 0.20, 0.75],
])
#: Prior transition counts: segments of a kind come in runs.
MOVES = np.array([[0.90, 0.03, 0.02, 0.02, 0.03], [0.09, 0.88, 0.01, 0.01, 0.01], [0.10, 0.02, 0.78, 0.02, 0.08], [0.10, 0.02, 0.02, 0.78, 0.08], [0.10, 0.02, 0.04, 0.04, 0.80]])
START = np.array([0.6, 0.1, 0.1, 0.1, 0.1])

_CUT = re.compile(r"(?<=[。！？!?])(?![。！？!?])|(?<=[a-zà-ÿ\d)]\.)\s+|[\r\n  ]+")
_ADDRESS = re.compile(r"https?:|www\.|<a\s|\b[\w-]{1,63}(?:\.[\w-]{1,63}){1,6}/\S|href=", re.I)
_ENDED = re.compile(r"[。！？!?.…～~][\s\"”’』」)）]*$")
_FIELD = re.compile(r"^[\s\-•*]*[^\s:：\t|,，、]{1,10}(?: [^\s:：\t|,，、]{1,10})?\s*(?:[:：\t|]|\s{2,})\s*\S")
_SEPARATORS = "、,，|/;；·•\t"
_TAG_NAMES = ("标签", "tags", "关键词", "关键字", "keywords", "labels", "热搜", "热词")
_ARROWS = "»›>|｜→"
_FUNCTION = re.compile(
    r"[的了是在我您请就都也和会要把这与为从若以等后前内还给被让用先再吗呢吧啦哦哈呀们没可能已它其之由将该很]|[ぁ-んァ-ヶ]|[가-힣]|[Ѐ-ӿ]{2,}|[฀-๿]{3,}"
    r"|\b(?:the|is|are|of|to|and|a|an|in|for|with|on|it|you|we|your|our|by|be|was|from|this|that|as|at|or|not|has|have|le|la|les|des|est|dans|vous|nous|der|die|das|und|ist|wir|sie|el|los|en|para|con|se|que|un|une|es|von|im|den|pas|du|au|am|sind|wurde|nach|bei|il|di|che|por|no)\b",
    re.I,
)
_HAN = re.compile(r"[㐀-鿿]")


def repetition(segment: str) -> float:
    """Share of the segment's three-character runs (of two-word runs in Latin
    text) that it has had before; 0 where it is surely less than REPEATED."""
    if _HAN.search(segment):
        n = len(segment) - 2
        # Runs are at least as many as the characters that they begin with.
        if n <= 3 or 1 - len(set(segment[:n])) / n < REPEATED:
            return 0.0
        return 1 - len(set(zip(segment, segment[1:], segment[2:]))) / n
    words = segment.lower().split()
    n = len(words) - 1
    return 1 - len(set(zip(words, words[1:]))) / n if n > 4 else 0.0


#: Words: ideographs one by one, runs of other letters and figures.
_HANS, _OTHERS = re.compile("[㐀-鿿]+"), re.compile(r"[^\W_㐀-鿿]+")
_RUNS, _LONG = re.compile("[㐀-鿿]{2,}"), re.compile(r"[^\W\d_㐀-鿿]{4,}")


@lru_cache(100_000)
def signs_of(segment: str) -> tuple[int, int]:
    """Signs of a segment as bits, and its number of words."""
    bits, size, low = 0, len(segment), segment.lower()
    if ("/" in low or "http" in low or "www." in low or "<a" in low or "href" in low) and _ADDRESS.search(segment):
        bits |= 1 << 6
    hashes = segment.count("#") + segment.count("＃")
    if hashes >= 2 or hashes and segment.lstrip()[:1] in "#＃":
        bits |= 1 << 7
    if size > 9 and repetition(segment) >= REPEATED:
        bits |= 1 << 4
    if sum(map(segment.count, _ARROWS)) >= 2:
        bits |= 1 << 8
    items = sum(map(segment.count, _SEPARATORS)) + 1
    if items >= 5:
        bits |= 1 << 3
    hans = sum(map(len, _HANS.findall(segment)))
    units = hans + len(_OTHERS.findall(segment))
    if _ENDED.search(segment[-40:]):
        return bits | 1, units
    words = hans or units
    if words <= 12:
        bits |= 1 << 9
    # As many function words as sentences of this length have: no more need be found.
    enough = max(2, -(-words // 12)) if words > 6 else 1
    if next(islice(_FUNCTION.finditer(segment), enough - 1, None), None) is not None:
        bits |= 1 << 1
    if items <= 5 and _FIELD.match(segment) and not low.lstrip(" -•*").startswith(_TAG_NAMES):
        bits |= 1 << 2
    return bits, units


@lru_cache(20_000)
def content(segment: str) -> frozenset:
    """Words of content: pairs of ideographs, longer words of other scripts."""
    out = set(_LONG.findall(segment.lower()))
    for run in _RUNS.findall(segment):
        out.update(map(add, run, run[1:]))
    return frozenset(out)


def observe(text: str) -> tuple[list[int], list[int]]:
    """Signs and numbers of words of a page's segments."""
    parts = segments(text)
    found = [signs_of(s) for s in parts]
    codes, sizes = [c for c, _ in found], [n for _, n in found]
    least = max(SEGMENTS, SPREAD * len(found))
    if len(found) < least:
        return codes, sizes
    words = [content(s) for s in parts]
    seen = Counter(chain.from_iterable(words))
    common = {w for w, n in seen.items() if n >= least}
    if common:
        codes = [c | 1 << 5 if own and len(own & common) >= COMMON * len(own) else c for c, own in zip(codes, words)]
    return codes, sizes


def segments(text: str) -> list[str]:
    """The segments of a page that hold text."""
    return [s for s in _CUT.split(text) if s and not s.isspace()]


_BITS = (np.arange(1 << len(SIGNS))[:, None] >> np.arange(len(SIGNS))) & 1


def table(emissions: np.ndarray) -> np.ndarray:
    """Probability of each set of signs in each state."""
    return np.exp(np.log(emissions) @ _BITS.T + np.log(1 - emissions) @ (1 - _BITS.T))


def in_step(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Order in which the segments of pages, longest first, go place by place: the
    pages that reach a place are the first ones. With the page of each segment in
    that order, whether another one follows it, and the span of each place."""
    lengths = np.array([len(p) for p in pages])
    page = np.repeat(np.arange(len(pages)), lengths)
    place = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(place, kind="stable")
    page, place = page[order], place[order]
    ends = np.cumsum(np.bincount(place)).tolist()
    return order, page, place + 1 < lengths[page], list(zip([0, *ends], ends))


class Markov:
    """The model in logarithms."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emissions: np.ndarray):
        self.start, self.moves, self.emissions = np.log(start), np.log(moves), np.log(table(emissions))
        self.steps, self.emit = self.moves.T.tolist(), self.emissions.T.tolist()
        # What a segment can win outside prose.
        self.gains = [max(e[OTHER:]) - e[0] for e in self.emit]
        # What leaving prose costs at least: entering, or starting there; staying is dearer too.
        enter = min(self.moves[a, 0] - self.moves[a, OTHER:].max() for a in range(OTHER))
        leave = min(0.0, min(self.moves[0, b] - self.moves[OTHER:, b].max() for b in range(OTHER)))
        stay = self.moves[0, 0] - self.moves[OTHER:, OTHER:].max()
        self.cost = min(enter, self.start[0] - self.start[OTHER:].max()) + leave if stay >= 0 else -np.inf

    def prose_only(self, codes: list[int], gains: list[float]) -> bool:
        """Whether no run of segments can win what leaving prose costs: then no best
        path leaves it. (Prose in place of such a run is never worse.)"""
        run = 0.0
        for c in codes:
            run = max(0.0, run + gains[c])
            if run >= self.cost:
                return False
        return True

    def viterbi(self, codes: list[int]) -> list[int]:
        score = [a + b for a, b in zip(self.start.tolist(), self.emit[codes[0]])]
        back, states = [], range(len(score))
        for c in codes[1:]:
            now, origin = [], []
            for into, e in zip(self.steps, self.emit[c]):
                ways = list(map(add, score, into))
                top = max(ways)
                now.append(top + e)
                origin.append(ways.index(top))
            back.append(origin)
            score = now
        path = [max(states, key=lambda i: score[i])]
        for origin in reversed(back):
            path.append(origin[path[-1]])
        return path[::-1]

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """`viterbi` of many pages, longest first, in step."""
        order, _, _, spans = in_step(pages)
        score = self.emissions.T[np.concatenate(pages)[order]]
        origin = np.zeros(score.shape, np.int8)
        score[: len(pages)] += self.start
        for (into, _), (a, b) in zip(spans, spans[1:]):
            last, from_ = score[into : into + b - a], origin[a:b]
            top = last[:, :1] + self.moves[0]
            for state in range(1, len(self.start)):
                way = last[:, state : state + 1] + self.moves[state]
                from_[way > top] = state
                np.maximum(top, way, out=top)
            score[a:b] += top
        path = score.argmax(axis=1)
        for (into, _), (a, b) in zip(spans[-2::-1], spans[:0:-1]):
            path[into : into + b - a] = origin[np.arange(a, b), path[a:b]]
        states = np.empty_like(path)
        states[order] = path
        return np.split(states, np.cumsum([len(p) for p in pages])[:-1])


#: Probabilities of starts, moves and signs.
Parameters = tuple[np.ndarray, np.ndarray, np.ndarray]
#: How signs and numbers of words of a page's segments are kept.
CODE, SIZE = np.dtype("<i2"), np.dtype("<i4")


def expected(pages: list[tuple[np.ndarray, int]], parameters: Parameters) -> np.ndarray:
    """Expected counts of starts, moves, signs and states, in one array, over pages
    (signs of the segments, number of such pages)."""
    start, moves, emissions = parameters
    pages = sorted(pages, key=lambda p: -len(p[0]))
    texts, times = [p for p, _ in pages], np.array([float(n) for _, n in pages])
    order, page, followed, spans = in_step(texts)
    obs = np.concatenate(texts)[order]
    given = table(emissions).T[obs]
    alpha, beta = np.empty_like(given), np.ones_like(given)
    reach = np.broadcast_to(start, (len(pages), len(start)))
    for a, b in spans:
        now = reach[: b - a] * given[a:b]
        scale = now.sum(axis=1, keepdims=True)
        now /= scale
        alpha[a:b] = now
        given[a:b] /= scale
        reach = now @ moves
    for (into, _), (a, b) in zip(spans[-2::-1], spans[:0:-1]):
        beta[into : into + b - a] = (given[a:b] * beta[a:b]) @ moves.T
    n, weight = len(pages), times[page][:, None]
    gamma = alpha * beta
    gamma *= weight / gamma.sum(axis=1, keepdims=True)
    # Segments that are followed, and those that follow, are in the same order.
    before = (alpha * weight)[followed]
    m_count = moves * np.einsum("ni,nj->ij", before, given[n:] * beta[n:])
    e_count = np.array([np.bincount(obs, g, len(_BITS)) for g in gamma.T])
    return np.concatenate([gamma[:n].sum(axis=0), m_count.ravel(), (e_count @ _BITS).ravel(), e_count.sum(axis=1)])


def refit(counts: np.ndarray) -> Parameters:
    """Parameters from the prior counts and the expected ones of all pages."""
    k = len(START)
    s_count, m_count, e_count, total = np.split(counts, np.cumsum([k, k * k, k * len(SIGNS)]))
    # Each page starts once.
    prior = PRIOR * max(1.0, s_count.sum() / PRIOR_PAGES)
    start, moves = START * prior / 10 + s_count, MOVES * prior + m_count.reshape(MOVES.shape)
    emissions = (EMISSIONS * prior + e_count.reshape(EMISSIONS.shape)) / (prior + total[:, None])
    start, moves = start / start.sum(), moves / moves.sum(axis=1, keepdims=True)
    return start.round(DECIMALS), moves.round(DECIMALS), np.clip(emissions.round(DECIMALS), 1e-4, 1 - 1e-4)


def parts_of(pages: Counter) -> Iterator[list[tuple[np.ndarray, int]]]:
    """Different pages that hold text and their numbers, in parts of PART segments."""
    part, size = [], 0
    for codes, n in pages.items():
        if not codes:
            continue
        part.append((np.frombuffer(codes, CODE), n))
        size += len(part[-1][0])
        if size >= PART:
            yield part
            part, size = [], 0
    if part:
        yield part


def page_signs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, codes, sizes` for every page: signs and numbers of words of its segments."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [observe(t or "") for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "codes": [np.array(c, CODE).tobytes() for c, _ in found], "sizes": [np.array(n, SIZE).tobytes() for _, n in found]})

    return df.select(key, text).mapInPandas(read, f"{key} long, codes binary, sizes binary")


def fit_pages(signs: DataFrame) -> Markov:
    """The model for a table, from the `codes` of all its pages."""
    parameters = START, MOVES, EMISSIONS
    pages = signs.select("codes")
    for _ in range(ROUNDS):

        def count(batches: Iterator[pd.DataFrame], given: Parameters = parameters) -> Iterator[pd.DataFrame]:
            sums = [expected(part, given) for pdf in batches for part in parts_of(Counter(pdf["codes"]))]
            if sums:
                yield pd.DataFrame({"counts": [sum(sums)]})

        rows = pages.mapInPandas(count, "counts array<double>").collect()
        if not rows:
            break
        parameters = refit(np.sum([r.counts for r in rows], axis=0))
    return Markov(*parameters)


def shares(codes: Iterable[bytes], sizes: Iterable[bytes], model: Markov) -> list[float]:
    """Share of each page's words in segments that are not prose. Pages of the same
    signs are labelled once, short ones many at a time."""
    codes = list(codes)
    other: dict[bytes, np.ndarray | None] = dict.fromkeys(codes)
    for part in parts_of(Counter(c for c in other if not model.prose_only(np.frombuffer(c, CODE).tolist(), model.gains))):
        pages = sorted((p for p, _ in part), key=len, reverse=True)
        for p in pages:
            if len(p) > ALONE:
                other[p.tobytes()] = np.array(model.viterbi(p.tolist())) >= OTHER
        if short := [p for p in pages if len(p) <= ALONE]:
            other.update((p.tobytes(), states >= OTHER) for p, states in zip(short, model.labels(short)))
    out = []
    for c, n in zip(codes, sizes):
        words = np.frombuffer(n, SIZE)
        out.append(0.0 if other[c] is None else int(words[other[c]].sum()) / max(1, int(words.sum())))
    return out


def other_share(text: str | None, model: Markov) -> float:
    """Share of a page's words in segments that are not prose."""
    codes, sizes = observe(text or "")
    return shares([np.array(codes, CODE).tobytes()], [np.array(sizes, SIZE).tobytes()], model)[0]


def page_labels(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, other_share` for every page."""
    signs = cut(page_signs(df, key, text))
    send = df.sparkSession.sparkContext.broadcast(fit_pages(signs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "other_share": shares(pdf["codes"], pdf["sizes"], send.value)})

    return signs.mapInPandas(run, f"{key} long, other_share double")


def spam_pages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` of the pages that are mostly keywords, links, menus or tags."""
    return page_labels(df, key, text).where(F.col("other_share") > SHARE).select(key)
